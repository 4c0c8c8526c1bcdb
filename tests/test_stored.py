"""Tables in buckets of their join key, and the state of streams read from their checkpoints."""

from __future__ import annotations

import datetime as dt

import pytest
import seeds

from pulsemart.operators import hourly, mart, publish
from pulsemart.sources import bucketed
from pulsemart.streaming import state, telemetry
from pulsemart.streaming.triggers import DRAIN_ONCE


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def sides(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    # a third of all rows under one chip, chips that only one side has, and none
    left = spark.range(3000).selectExpr(
        "case when id % 3 = 0 then 'hot' when id = 1 then null else concat('c', id % 70) end chip_id", "cast(id % 24 as int) report_hour", "id"
    )
    right = spark.createDataFrame([("hot", 0), (None, -1)] + [(f"c{i}", i) for i in range(50)], "chip_id string, owner int")
    yield left, right
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bucketed_sides_join_without_a_shuffle(spark, sides, path):
    left, right = sides
    bucketed.write(left, "b_hourly", path + "/hourly", ["chip_id"], 8)
    bucketed.write(right, "b_owners", path + "/owners", ["chip_id"], 8)
    joined = mart.join(spark.table("b_hourly"), spark.table("b_owners"))
    assert "Exchange" in plan(mart.join(left, right)) and "Exchange" not in plan(joined)
    columns = ["chip_id", "report_hour", "id", "owner"]
    assert sorted(map(str, joined.select(*columns).collect())) == sorted(map(str, mart.join(left, right).select(*columns).collect()))
    # in a session that does not know the tables yet
    spark.sql("DROP TABLE b_hourly")
    spark.sql("DROP TABLE b_owners")
    again = mart.join(
        bucketed.attach(spark, "b_hourly", path + "/hourly", left.schema, ["chip_id"], 8),
        bucketed.attach(spark, "b_owners", path + "/owners", right.schema, ["chip_id"], 8),
    )
    assert "Exchange" not in plan(again) and again.count() == joined.count()


def test_a_load_replaces_the_table(spark, sides, path):
    left, _ = sides
    for rows in (left, left.filter("report_hour < 3"), left.limit(0)):
        bucketed.write(rows, "b_again", path + "/t", ["chip_id"], 4)
        assert spark.table("b_again").count() == rows.count()


def test_number_of_buckets_follows_the_size():
    assert [bucketed.buckets_for(n, 100) for n in (0, 1, 100, 101, 350, 900)] == [1, 1, 1, 2, 4, 16]


def test_open_windows_of_a_stopped_stream(spark, path):
    raw = seeds.raw(spark)
    raw.write.parquet(path + "/raw")
    stream = spark.readStream.schema(raw.schema).parquet(path + "/raw")
    query = telemetry.keep_hourly(stream, path + "/h", path + "/cp", dt.datetime(2024, 3, 9), lookback_hours=100_000, trigger=DRAIN_ONCE)
    assert query.awaitTermination(240)
    hours = hourly.aggregate(raw, "2024-03-09 00:00:00")
    windows = state.open_windows(spark, path + "/cp").collect()
    expected = {r.hour_start: r["count"] for r in hours.groupBy("hour_start").count().collect()}
    assert {r.window_start: r.open_groups for r in windows} == expected
    assert all(r.window_end - r.window_start == dt.timedelta(hours=1) and 0 < r.largest_partition <= r.open_groups for r in windows)
    chips = state.open_by_key(spark, path + "/cp", "chip_id").collect()
    assert {r.chip_id: r.open_groups for r in chips} == {r.chip_id: r["count"] for r in hours.groupBy("chip_id").count().collect()}
    assert all(r.state_bytes > 0 for r in chips)
    assert state.operators(spark, path + "/cp").select("operatorName").first()[0] == "stateStoreSave"


def test_published_documents_keep_their_buckets(spark, path):
    rows = seeds.mart(spark, [seeds.mart_row(f"u{i}", i, dt.date(2024, 3, 1), 8) for i in range(9)])
    out = path + "/docs"
    publish.write_all(rows, out, buckets=4)
    assert publish.buckets_at(spark, out) == 4
    publish.refresh(spark, rows.filter("user_id <> 'u3'"), out, rows.filter("user_id in ('u3', 'u4')"))
    assert publish.read(spark, out, "daily", "u3").count() == 0 and publish.read(spark, out, "daily", "u4").count() == 2
    assert publish.read(spark, out, "summary").select("bucket").distinct().count() <= 4
    with pytest.raises(ValueError):
        publish.write_all(rows, out, buckets=8)
    assert [publish.buckets_for(n) for n in (0, 1, 20_000, 20_001, 10**9)] == [1, 1, 1, 2, 65536]
