from __future__ import annotations

import datetime as dt

import pytest
import seeds

from pulsemart.operators import hourly, monitor, publish, rollup, upsert
from pulsemart.plans import loads
from pulsemart.sources import mart_store, tables
from pulsemart.streaming import telemetry
from pulsemart.streaming.triggers import DRAIN_ONCE, EVERY_QUARTER_HOUR

AS_OF = dt.datetime(2024, 3, 8)


def crm_tables(spark):
    return {"customers": seeds.customers(spark), "prostheses": seeds.prostheses(spark), "models": seeds.models(spark)}


def shown(df, *drop):
    return sorted(map(str, df.drop(*drop).select(*sorted(set(df.columns) - set(drop))).collect()))


def test_batch_load_end_to_end(spark, path):
    raw = seeds.busy_samples(crm_tables(spark)["prostheses"].filter("chip_id <> ''").select("chip_id"), "2024-03-07")
    targets = {"rollup_path": path + "/rollup", "days_path": path + "/days", "documents_path": path + "/docs"}
    loads.load_hourly(spark, raw, path + "/hourly", AS_OF)
    # sampling starts on 1 March, the lookback reaches back to it
    assert loads.read_hourly(spark, path + "/hourly").count() == 6 * 7 * 15

    def load(as_of):
        return loads.batch_load(spark, path + "/hourly", crm_tables(spark), path + "/mart", as_of, **targets)

    status = load(AS_OF)
    assert status["records_loaded"] == 4 * 7 * 15 and status["affected_users"] == 3
    assert (status["min_date"], status["max_date"]) == (dt.date(2024, 3, 1), dt.date(2024, 3, 7))
    mart = mart_store.scan(spark, path + "/mart")
    first = shown(mart, "etl_processed_at")
    stored = rollup.finish_daily(spark.read.parquet(path + "/rollup"))
    assert shown(stored, "avg_response_time") == shown(rollup.daily(mart), "avg_response_time")
    assert spark.read.parquet(path + "/days").count() == 3 * 7
    docs = shown(publish.read(spark, path + "/docs"))
    assert len(docs) == 3 * (7 + 2) + 4 * 7  # reports, and hours of each device

    # a later run over the same hours changes nothing but the stamp
    load(AS_OF + dt.timedelta(minutes=15))
    again = mart_store.scan(spark, path + "/mart")
    kept = dt.datetime(2024, 3, 1, 0, 15)
    assert again.filter(again.source_updated_at < kept).count() == 0
    assert shown(again, "etl_processed_at") == first
    assert shown(publish.read(spark, path + "/docs")) == docs
    stored = rollup.finish_daily(spark.read.parquet(path + "/rollup"))
    assert shown(stored, "avg_response_time") == shown(rollup.daily(again), "avg_response_time")


def test_documents_after_a_load_equal_documents_built_anew(spark, path):
    rows = seeds.mart(
        spark, [seeds.mart_row(u, d, dt.date(2024, 3, day), h) for u, d in (("ada", 1), ("ben", 2)) for day in (1, 2, 3) for h in (8, 9)]
    ).drop("etl_processed_at")
    mart_store.load(spark, rows, path + "/mart", AS_OF)
    publish.refresh_load(spark, rows, rollup.daily_user(rows), rows, path + "/docs", buckets=2)
    old = shown(publish.read(spark, path + "/docs"))
    # one day of one user is loaded again with other values, and a new user appears
    again = rows.filter("user_id = 'ada' and report_date = '2024-03-02'").withColumn("error_count", rows.error_count + 4)
    fresh = seeds.mart(spark, [seeds.mart_row("cleo", 3, dt.date(2024, 3, 4), 8)]).drop("etl_processed_at")
    delta = again.unionByName(fresh)
    mart_store.load(spark, delta, path + "/mart", AS_OF + dt.timedelta(minutes=15))
    whole = mart_store.scan(spark, path + "/mart")
    for _ in range(2):
        publish.refresh_load(spark, whole, rollup.daily_user(whole), delta, path + "/docs", buckets=2)
        now = shown(publish.read(spark, path + "/docs"))
        assert now == shown(publish.all_documents(whole, buckets=2).select(*publish.FIELDS))
        assert now != old


def test_retention(spark, path):
    rows = seeds.mart(spark, [seeds.mart_row("a", 1, d, 8) for d in (dt.date(2023, 3, 8), dt.date(2023, 3, 9), dt.date(2024, 3, 8))])
    mart_store.load(spark, rows.drop("etl_processed_at"), path + "/mart", AS_OF)
    upsert.overwrite_partitions(rollup.daily_user(rows), path + "/days", ["report_date"], ["user_id"])
    # 365 days after 9 March 2023 is 8 March 2024: that day is over its term, like the one before
    assert loads.apply_retention(spark, AS_OF, path + "/mart", (path + "/days",)) == 4
    assert [r.report_date for r in mart_store.scan(spark, path + "/mart").collect()] == [dt.date(2024, 3, 8)]
    assert loads.apply_retention(spark, AS_OF, path + "/mart", (path + "/days",)) == 0


def test_append_mode_counts_twice(spark, path):
    stats = hourly.aggregate(seeds.raw(spark), "2024-03-05 12:00:00")
    from pulsemart.operators import crm

    owners = crm.mart_source(crm.customer_prosthesis(*crm_tables(spark).values()))
    for at in (AS_OF, AS_OF + dt.timedelta(minutes=15)):
        loads.load_mart(spark, stats, owners, path + "/mart", at, replace=False)
    assert mart_store.scan(spark, path + "/mart").count() == 8


def test_load_hourly_never_cuts_the_first_hour(spark, path):
    at = dt.datetime(2024, 3, 5, 10, 7)
    loads.load_hourly(spark, seeds.raw(spark), path + "/h", at, lookback_hours=0)
    rows = {r.chip_id: r for r in loads.read_hourly(spark, path + "/h").filter("hour_start < '2024-03-05 11:00:00'").collect()}
    assert rows["chip-1"].movements_count == 2


def test_observed_load(spark, path):
    rows, seen = monitor.observe_load(seeds.mart(spark, [seeds.mart_row("a", 1, dt.date(2024, 3, d), 8) for d in (1, 2, 3)]))
    rows.write.parquet(path + "/m")
    assert seen.get == {"records_count": 3, "min_date": dt.date(2024, 3, 1), "max_date": dt.date(2024, 3, 3)}


def test_stream_hourly_equals_batch(spark, path):
    raw = seeds.busy_samples(spark.createDataFrame([("c1",), ("c2",)], "chip_id string"), "2024-03-08")
    raw = raw.withColumn("warning_flags", raw.warning_flags.cast("int"))

    def run():
        stream = spark.readStream.schema(raw.schema).parquet(path + "/raw")
        assert telemetry.keep_hourly(stream, path + "/h", path + "/cp", "2024-03-09 00:00:00", trigger=DRAIN_ONCE).awaitTermination(240)

    even = "minute(timestamp) % 2 = 0"
    raw.filter(even).write.mode("append").parquet(path + "/raw")
    run()
    raw.filter(f"not ({even})").write.mode("append").parquet(path + "/raw")  # the same hours, completed later
    run()
    rounded = ["avg_actuator_temp", "avg_myo_amplitude"]
    stored = loads.read_hourly(spark, path + "/h")
    assert shown(stored, *rounded) == shown(hourly.aggregate(raw, "2024-03-09 00:00:00"), *rounded)


def test_stream_drops_samples_past_the_lookback(spark, path):
    base = seeds.raw(spark).filter("chip_id = 'chip-1'")
    base.write.mode("append").parquet(path + "/raw")

    def run():
        stream = spark.readStream.schema(base.schema).parquet(path + "/raw")
        query = telemetry.keep_hourly(stream, path + "/h", path + "/cp", AS_OF, lookback_hours=2, trigger=DRAIN_ONCE)
        assert query.awaitTermination(240)

    run()
    late = base.limit(1).selectExpr("* except (timestamp)", "timestamp '2024-03-05 05:00:00' as timestamp").select(*base.columns)
    late.write.mode("append").parquet(path + "/raw")
    run()
    hours = {r.hour_start.hour for r in loads.read_hourly(spark, path + "/h").collect()}
    assert hours == {10, 11}


def test_stream_daily_equals_batch(spark, path):
    rows = seeds.mart(spark, [seeds.mart_row("a", d, dt.date(2024, 3, 1 + h % 2), h) for d in (1, 2) for h in range(8, 20)])

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(path + "/mart")
        assert telemetry.keep_daily(stream, path + "/daily", trigger=DRAIN_ONCE).awaitTermination(240)

    rows.filter("report_hour < 13").write.mode("append").parquet(path + "/mart")
    run()
    rows.filter("report_hour >= 13").write.mode("append").parquet(path + "/mart")
    run()
    stored = rollup.finish_daily(spark.read.parquet(path + "/daily"))
    assert shown(stored) == shown(rollup.daily(rows))


def test_cadence():
    assert EVERY_QUARTER_HOUR == {"processingTime": "15 minutes"}


def test_file_source_pushes_the_lookback_down(spark, path):
    hourly.aggregate(seeds.raw(spark), AS_OF).write.parquet(path + "/hourly_stats")
    rows = tables.hourly_stats(spark, tables.FileSource(path), "2024-03-05 13:00:00", 2)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(hour_start" in plan
    assert {r.hour_start.hour for r in rows.collect()} == {11}


def test_time_slices_cover_the_range_once():
    start, end = dt.datetime(2024, 3, 1), dt.datetime(2024, 3, 2)
    slices = tables.time_slices("ts", start, end, 4)
    assert len(slices) == 4
    assert slices[0].startswith("ts >= '2024-03-01 00:00:00'") and slices[-1].endswith("ts < '2024-03-02 00:00:00'")
    assert all(a.split("< ")[1] == b.split(" AND")[0].split(">= ")[1] for a, b in zip(slices, slices[1:]))
    with pytest.raises(ValueError):
        tables.time_slices("ts", end, start, 4)


def test_database_options():
    source = tables.DatabaseSource("jdbc:postgresql://db/crm", {"user": "u"}, partitions=8, prefix="crm.")
    options = source.options("customers", "customer_id", 0, 1000)
    assert options["dbtable"] == "crm.customers" and options["numPartitions"] == "8" and options["user"] == "u"


def test_a_database_stands_in_for_files(spark, monkeypatch):
    asked = []
    source = tables.DatabaseSource("jdbc:postgresql://db/crm", splits={"customers": ("customer_id", 0, 9)})
    monkeypatch.setattr(tables.DatabaseSource, "read", lambda self, spark, table, schema: asked.append(table))
    monkeypatch.setattr(
        tables.DatabaseSource, "read_slices", lambda self, spark, table, schema, column, start, end: asked.append((table, column))
    )
    tables.crm(spark, source)
    tables.hourly_stats(spark, source)
    tables.raw_telemetry(spark, source, dt.datetime(2024, 3, 1), dt.datetime(2024, 3, 2))
    assert asked == ["customers", "prostheses", "prosthesis_models", "hourly_stats", ("raw_telemetry", "timestamp")]


def test_a_table_without_a_split_is_refused(spark):
    with pytest.raises(ValueError):
        tables.DatabaseSource("jdbc:postgresql://db/crm").read(spark, "customers", None)
