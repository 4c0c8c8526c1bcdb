from __future__ import annotations

import datetime as dt

import seeds

from pulsemart.operators import cdc, monitor, quality

D = dt.date(2024, 3, 5)


def test_each_mart_rule(spark):
    bad = {
        "hour_range": dict(report_hour=24),
        "movements_negative": dict(movements_count=-1, successful_movements=-2, max_response_time=1),
        "success_rate_range": dict(success_rate=100.5),
        "response_negative": dict(avg_response_time=-0.1),
        "battery_range": dict(avg_battery_level=101.0),
        "errors_negative": dict(error_count=-1),
        "more_successes_than_movements": dict(successful_movements=11),
        "no_response_measured": dict(max_response_time=0),
    }
    rows = [seeds.mart_row(rule, 1, D, 8, **{}) | values for rule, values in bad.items()] + [seeds.mart_row("fine", 1, D, 8)]
    found = {r.user_id: r.violated for r in quality.violations(seeds.mart(spark, rows), quality.mart_rules()).collect()}
    assert set(found) == set(bad)
    assert all(rule in found[rule] for rule in bad)
    assert found["movements_negative"] == ["movements_negative", "successful_negative"]
    counts = {r.rule: r.violations for r in quality.violation_counts(seeds.mart(spark, rows), quality.mart_rules()).collect()}
    assert counts["hour_range"] == 1 and set(counts) == set(quality.mart_rules())


def test_missing_values_break_no_range(spark):
    row = seeds.mart_row("a", 1, D, 8) | dict(success_rate=None, avg_battery_level=None, max_response_time=None)
    assert quality.violations(seeds.mart(spark, [row]), quality.mart_rules()).count() == 0


def test_keys_references_required_values(spark):
    devices = seeds.prostheses(spark)
    twice = devices.unionByName(devices.filter("prosthesis_id in (1, 5)"))
    found = quality.duplicates(twice, ["chip_id"]).collect()
    assert [(r.chip_id, r.occurrences) for r in found] == [("chip-1", 2)]  # missing chips are not equal
    known = seeds.customers(spark).filter("customer_id <> 3")
    assert [r.prosthesis_id for r in quality.orphans(devices, "customer_id", known, "customer_id").collect()] == [3]
    counts = {r.column: (r.rows, r.nulls) for r in quality.nulls(devices, ["chip_id", "status", "customer_id"]).collect()}
    assert counts == {"chip_id": (8, 1), "status": (8, 0), "customer_id": (8, 1)}


def test_domains(spark):
    devices = spark.createDataFrame([("active",), ("lost",), (None,)], "status string")
    assert [r.status for r in quality.violations(devices, quality.device_rules()).collect()] == ["lost"]
    moves = spark.createDataFrame([("grip",), ("wave",)], "movement_type string")
    assert [r.movement_type for r in quality.violations(moves, quality.telemetry_rules()).collect()] == ["wave"]


def test_empty_feed_is_initializing(spark):
    from pulsemart import schemas

    logs = {e: spark.createDataFrame([], schemas.change_state(e)) for e in ("customers", "prostheses", "models")}
    health = monitor.cdc_health(logs).collect()
    assert [(r.row_count, r.last_version, r.status) for r in health] == [(0, None, "initializing")] * 3
    assert [(r.total, r.active) for r in monitor.cdc_status(logs).collect()] == [(0, 0)] * 3
    ready = monitor.readiness(cdc.customer_data(*logs.values())).first()
    assert (ready.mart_records, ready.mart_ready, ready.status) == (0, False, "initializing")


def test_lag(spark):
    progress = spark.createDataFrame(
        [("a", 0, 1500, 500), ("a", 1, 10, 9), ("b", 0, 1000, None), ("c", 0, 5, 9)],
        "topic string, partition int, end_offset long, committed_offset long",
    )
    got = {r.topic: (r.lag, r.status) for r in monitor.lag(progress).collect()}
    assert got == {"a": (1001, "degraded"), "b": (1000, "healthy"), "c": (0, "healthy")}


def test_log_lines(spark):
    lines = spark.createDataFrame(
        [
            ("request_id=1 user=ada ip=1.1.1.1 method=GET path=/api/reports status=200 duration_ms=10.50",),
            ("2024-03-01 INFO request_id=2 user=ada ip=1.1.1.1 method=GET path=/api/reports status=404 duration_ms=20.00",),
            ("request_id=3 user=ada ip=1.1.1.1 method=GET path=/api/reports status=503 duration_ms=30.00",),
            ("worker started",),
        ],
        "line string",
    )
    row = monitor.access_log(lines).collect()
    assert len(row) == 1
    r = row[0]
    assert (r.path, r.user, r.requests, r.ok, r.client_errors, r.server_errors) == ("/api/reports", "ada", 3, 1, 1, 1)
    assert (r.avg_ms, r.p50_ms, r.p99_ms) == (20.17, 20.0, 30.0)
    edge = spark.createDataFrame(
        [
            ('1.1.1.1 - - [t] "GET /r/a HTTP/1.1" 200 5 "-" "ua" "-" cache_status=HIT rt=0.002',),
            ('1.1.1.1 - - [t] "GET /r/a HTTP/1.1" 200 5 "-" "ua" "-" cache_status=MISS rt=0.102',),
            ('1.1.1.1 - - [t] "GET /r/a HTTP/1.1" 200 5 "-" "ua" "-" cache_status=- rt=0.102',),
            ("noise",),
        ],
        "line string",
    )
    hit = monitor.cache_ratio(edge).collect()
    assert [(r.path, r.requests, r.hits, r.hit_ratio) for r in hit] == [("/r/a", 3, 1, 0.3333)]
    assert monitor.parse_edge_log(edge).filter("cache_status = 'HIT'").first().duration_ms == 2.0
