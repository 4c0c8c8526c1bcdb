"""Counts and percentiles out of merged sketches, against exact ones; lines of logs that do not parse."""

from __future__ import annotations

import datetime as dt

import pytest
import seeds
from pyspark.sql import functions as F

from pulsemart.operators import monitor, report, rollup


def test_merged_days_estimate_as_many_users_as_the_whole(spark):
    rows = seeds.mart(spark, [seeds.mart_row("x", 0, dt.date(2024, 3, 1), 0)]).drop("user_id", "prosthesis_id", "report_date")
    many = spark.range(300_000).selectExpr(
        "concat('u', id % 50000) user_id", "id % 70000 prosthesis_id", "date_add(date'2024-03-01', cast(id % 6 as int)) report_date"
    )
    mart = many.crossJoin(F.broadcast(rows))
    days = rollup.fleet_days(mart).cache()
    assert days.count() == 6
    whole = rollup.finish_fleet(rollup.merge(days.withColumn("all", F.lit(1)), ["all"]), ["all"]).first()
    assert abs(whole.users - 50_000) <= rollup.SKETCH_ERROR * 50_000
    assert abs(whole.devices - 70_000) <= rollup.SKETCH_ERROR * 70_000
    assert whole.hour_rows == 300_000
    exact = {r.report_date: r.users for r in report.fleet_daily(mart, None).collect()}
    for r in rollup.finish_fleet(days, ["report_date"]).collect():
        assert abs(r.users - exact[r.report_date]) <= rollup.SKETCH_ERROR * exact[r.report_date]
    days.unpersist()


def test_sketches_do_not_depend_on_loads_given_twice(spark):
    mart = seeds.mart(spark, [seeds.mart_row(u, d, dt.date(2024, 3, 1), h) for u, d in (("a", 1), ("b", 2)) for h in range(4)])
    days = rollup.fleet_days(mart)
    twice = rollup.finish_fleet(rollup.merge(days.unionByName(days), ["report_date"]), ["report_date"]).first()
    assert (twice.users, twice.devices, twice.hour_rows) == (2, 2, 16)


def test_partials_without_sketches_merge_as_before(spark):
    mart = seeds.mart(spark, [seeds.mart_row("a", 1, dt.date(2024, 3, 1), 1)])
    assert not set(rollup.merge(rollup.daily_partials(mart), rollup.DAILY_KEYS).columns) & set(rollup.SKETCHES)


@pytest.mark.parametrize("shape", ["id", "pow(id, 1.7)", "cast(id % 10 as double)"])
def test_merged_percentiles_keep_their_rank_bound(spark, shape):
    n = 1_000_000
    requests = spark.range(n).selectExpr(
        "'/p' path", "concat('u', id % 40) user", "200 status", f"cast({shape} as double) duration_ms"
    )
    parts = monitor.access_partials(requests, ["path", "user"])
    got = monitor.finish_access(monitor.merge_access(parts, ["path"]), ["path"]).first()
    assert got.requests == got.ok == n
    for p, value in ((0.5, got.p50_ms), (0.99, got.p99_ms)):
        below = requests.filter(F.col("duration_ms") < value).count() / n
        up_to = requests.filter(F.col("duration_ms") <= value).count() / n
        assert below - monitor.LATENCY_RANK_ERROR <= p <= up_to + monitor.LATENCY_RANK_ERROR


def test_no_durations_give_no_percentiles(spark):
    requests = spark.createDataFrame([("/p", "u", 500, None)], "path string, user string, status int, duration_ms double")
    one = monitor.finish_access(monitor.access_partials(requests, ["path"]), ["path"]).first()
    assert (one.requests, one.server_errors, one.avg_ms, one.p50_ms, one.p99_ms) == (1, 1, None, None, None)
    none = monitor.merge_access(monitor.access_partials(requests.limit(0), ["path", "user"]), ["path"])
    assert monitor.finish_access(none, ["path"]).count() == 0


def test_every_service_line_is_a_request_or_a_fault(spark):
    good = "request_id=1 user=ada ip=1.1.1.1 method=GET path=/p status=200 duration_ms=1.5"
    lines = spark.createDataFrame(
        [(good,), (good.replace("200", "2xx"),), (good.replace("1.5", "fast"),), ("started",), ("again",), ("",), ("  ",), (None,)],
        "line string",
    )
    faults = {r.reason: (r.lines, r.example) for r in monitor.service_faults(lines).collect()}
    assert {k: v[0] for k, v in faults.items()} == {"status": 1, "duration": 1, "no request": 2, "empty": 3}
    assert faults["no request"][1] == "again"
    left_out = sum(v[0] for k, v in faults.items() if k != "duration")
    assert monitor.parse_service_log(lines).count() + left_out == lines.count()


def test_edge_lines_too(spark):
    good = '1.1.1.1 - - [t] "GET /r/a HTTP/1.1" 200 5 "-" "ua" "-" cache_status=HIT rt=0.002'
    lines = spark.createDataFrame([(good,), (good.replace("0.002", "0.0.2"),), ("noise",), (None,)], "line string")
    assert {r.reason: r.lines for r in monitor.edge_faults(lines).collect()} == {"duration": 1, "no request": 1, "empty": 1}
    assert monitor.parse_edge_log(lines).count() == 2
    assert monitor.edge_faults(lines.limit(0)).count() == 0
