from __future__ import annotations

import datetime as dt

import pytest
import seeds

from pulsemart import schemas
from pulsemart.operators import crm, hourly, mart, upsert

AT = dt.datetime(2024, 3, 5, 10, 0)


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def owners(spark):
    return crm.customer_prosthesis(seeds.customers(spark), seeds.prostheses(spark), seeds.models(spark))


def test_hourly_measures(spark):
    rows = by(hourly.aggregate(seeds.raw(spark), "2024-03-06 00:00:00"), "chip_id", "hour_start")
    first = rows["chip-1", AT]
    assert (first.movements_count, first.successful_movements) == (2, 1)
    assert (first.avg_response_time, first.min_response_time, first.max_response_time) == (100.0, 100, 100)
    assert (first.min_battery_level, first.max_battery_level, first.avg_battery_level) == (20, 80, 60.0)
    assert (first.error_count, first.warning_count) == (1, 1)
    assert first.avg_myo_amplitude == 5.0
    assert first.updated_at == dt.datetime(2024, 3, 6)
    assert rows["chip-1", AT + dt.timedelta(hours=1)].avg_myo_amplitude == 0.0
    idle = rows["chip-2", AT]
    assert (idle.movements_count, idle.avg_response_time) == (0, None)


def test_hour_is_half_open(spark):
    one = hourly.aggregate_hour(seeds.raw(spark).filter("chip_id = 'chip-1'"), AT).collect()
    assert [(r.hour_start, r.movements_count) for r in one] == [(AT, 2)]


def test_backfill_equals_hour_by_hour(spark):
    raw = seeds.raw(spark)
    whole = hourly.backfill(raw, AT)
    hours = [r.hour_start for r in hourly.hours_present(raw).collect()]
    parts = [hourly.aggregate_hour(raw, h, AT) for h in hours]
    loop = parts[0]
    for part in parts[1:]:
        loop = loop.unionByName(part)
    assert sorted(map(str, whole.collect())) == sorted(map(str, loop.collect()))


def test_present_and_lookback(spark):
    stats = hourly.aggregate(seeds.raw(spark), AT)
    rows = by(hourly.present(stats), "chip_id", "report_hour")
    assert rows["chip-1", 10].success_rate == 50.0
    assert rows["chip-2", 10].success_rate == 0.0
    assert rows["chip-1", 10].report_date == dt.date(2024, 3, 5)
    kept = hourly.since(stats, AT + dt.timedelta(hours=3), 2)
    assert {r.hour_start for r in kept.collect()} == {AT + dt.timedelta(hours=1)}


def test_sessions(spark):
    rows = by(hourly.sessions(seeds.raw(spark)), "session_id")
    s1 = rows[("s1",)]
    assert (s1.duration_seconds, s1.total_movements, s1.successful_movements, s1.error_count) == (3600, 3, 2, 1)
    assert (s1.min_battery_level, s1.avg_response_time_ms) == (20, (100 + 100 + 50) / 3)
    assert set(rows) == {("s1",), ("s2",), ("s3",)}


def test_customer_view(spark):
    rows = by(owners(spark), "prosthesis_id")
    assert set(rows) == {(1,), (2,), (3,), (4,), (5,), (6,)}
    assert rows[(1,)].customer_full_name == "Stone Ada June"
    assert rows[(2,)].customer_full_name == "Rivers Ben"
    assert rows[(3,)].last_updated_at == seeds.T0 + dt.timedelta(days=2)
    assert rows[(1,)].last_updated_at == seeds.T0 + dt.timedelta(hours=1)


def test_chip_rules(spark):
    view = owners(spark)
    assert {r.prosthesis_id for r in crm.mart_source(view).collect()} == {1, 2, 3, 4, 6}
    assert {r.prosthesis_id for r in crm.mart_source(view, allow_empty_chip=False).collect()} == {1, 2, 3, 4}


@pytest.mark.parametrize("salt", [1, 5])
def test_mart(spark, salt):
    telemetry = hourly.present(hourly.aggregate(seeds.raw(spark), AT))
    rows = mart.build(telemetry, crm.mart_source(owners(spark)), salt)
    assert rows.columns == mart.COLUMNS
    types = dict(rows.dtypes)
    assert all(types[f.name] == f.dataType.simpleString() for f in schemas.MART.fields if f.name in types)
    found = by(rows, "user_id", "prosthesis_id", "report_hour")
    assert set(found) == {("ada", 1, 10), ("ada", 1, 11), ("ada", 4, 10), ("ben", 2, 10)}
    idle = found["ben", 2, 10]
    assert (idle.avg_response_time, idle.min_response_time, idle.success_rate) == (0.0, 0, 0.0)
    assert idle.source_updated_at == AT


def test_empty_inputs_give_no_rows(spark):
    telemetry = hourly.present(hourly.aggregate(seeds.raw(spark).limit(0), AT))
    assert mart.build(telemetry, crm.mart_source(owners(spark))).count() == 0


def test_crm_source_prefers_primary(spark):
    view = crm.mart_source(owners(spark))
    one = view.filter("prosthesis_id = 1")
    assert {r.prosthesis_id for r in mart.crm_source(one, view).collect()} == {1}
    assert {r.prosthesis_id for r in mart.crm_source(one.limit(0), view).collect()} == {1, 2, 3, 4, 6}
    assert mart.crm_source(one.limit(0), view.limit(0)).count() == 0


def test_user_info_takes_the_newest_hour(spark):
    d = dt.date(2024, 3, 5)
    rows = seeds.mart(
        spark,
        [
            seeds.mart_row("ada", 1, d, 9, customer_name="Old"),
            seeds.mart_row("ada", 1, d, 11, customer_name="New"),
            seeds.mart_row("ada", 4, d, 10, customer_name="Mid"),
        ],
    )
    info = mart.user_info(rows)
    assert [(r.user_id, r.customer_name) for r in info.collect()] == [("ada", "New")]
    found = mart.lookup(spark.createDataFrame([("ada",), ("nobody",)], "user_id string"), info)
    assert by(found, "user_id")[("nobody",)].customer_name is None


def test_seed_insert_is_idempotent(spark):
    new = seeds.models(spark)
    once = upsert.insert_if_absent(new.limit(0), new.unionByName(new), ["model_code"], ["model_id"])
    assert once.count() == 5
    assert upsert.insert_if_absent(once, new, ["model_code"], ["model_id"]).count() == 0
