"""Physical checks: what has to reach the scan, what must not be in a plan, and that hot keys change nothing."""

from __future__ import annotations

import datetime as dt
import os
import random
import re

import pytest
import seeds
from hypothesis import given, settings
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from pulsemart.operators import cdc, hourly, mart, monitor, profiles, publish, report, rollup, upsert
from pulsemart.plans import catalog
from pulsemart.session import shared_dir
from pulsemart.sources import mart_store
from pulsemart.sources import sample_tables as st

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored")) + "/mart"
    owners = spark.range(40).selectExpr(
        "concat('user', id % 30) user_id", "id prosthesis_id", "concat('chip', id) chip_id",
        *[f"concat('user', id % 30) {c}" for c in (
            "customer_name", "customer_email", "customer_region", "customer_branch", "prosthesis_model",
            "prosthesis_category", "prosthesis_serial")],
    )
    mart_store.load(spark, seeds.busy_mart(owners, "2024-03-03"), path, "2024-03-04 00:00:00")
    return path


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_python_and_no_products_in_any_plan(spark, name):
    text = plan(catalog.queries()[name](spark, FOLDER))
    for node in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas"):
        assert node not in text


def test_mart_scan_prunes_partitions_and_pushes_the_user(spark, stored):
    rows = mart_store.scan(spark, stored, "user3", dt.date(2024, 3, 1), dt.date(2024, 3, 2))
    text = plan(rows.select("user_id", "movements_count"))
    assert re.search(r"PartitionFilters: \[[^\]]*report_month[^\]]*report_date", text)
    assert "EqualTo(user_id,user3)" in text
    assert re.search(r"ReadSchema: struct<user_id:string,movements_count:bigint>", text)
    assert rows.count() == 2 * 14 * 2


def test_summary_reads_only_its_columns(spark, stored):
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan(report.user_summary(mart_store.scan(spark, stored)))).group(1)
    columns = {c.split(":")[0] for c in read.split(",")}
    assert columns.isdisjoint({"chip_id", "avg_myo_amplitude", "avg_actuator_temp", "warning_count", "etl_processed_at"})


def test_retention_prunes_partitions(spark, stored):
    text = plan(upsert.retain(mart_store.scan(spark, stored), "report_date", 365, "2025-03-01 00:00:00"))
    assert re.search(r"PartitionFilters: \[[^\]]*report_date", text)


def test_refresh_prunes_to_touched_days(spark, stored):
    delta = mart_store.scan(spark, stored).filter("report_hour = 9 and user_id = 'user1'")
    assert "dynamicpruning" in plan(rollup.refresh(mart_store.scan(spark, stored), delta))


def test_daily_aggregates_in_generated_hash_code(spark, stored):
    for df in (report.user_daily(mart_store.scan(spark, stored)), hourly.aggregate(st.raw_telemetry(spark, FOLDER))):
        text = plan(df)
        assert text.count("HashAggregate") == 2 and "SortAggregate" not in text
        assert text.count("Exchange") == 1


def test_time_range_reaches_the_scan(spark):
    text = plan(st.raw_telemetry(spark, FOLDER, dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3)))
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text


def test_top_rows_are_limited_before_the_shuffle(spark):
    for df in (profiles.consent_history(st.consent_events(spark, FOLDER)), report.report_list(st.mart_rows(spark, FOLDER))):
        text = plan(df)
        assert text.count("WindowGroupLimit") == 2
        assert "Partial" in text


def test_latest_combines_before_the_shuffle(spark):
    text = plan(upsert.latest(st.prosthesis_log(spark, FOLDER), ["prosthesis_id"], cdc.VERSION_ORDER))
    assert "partial_max" in text and "Window" not in text


def test_messages_and_lines_are_parsed_once(spark):
    good, _ = cdc.split_corrupt(cdc.decode(st.messages(st.customer_log(spark, FOLDER)), "customers"))
    assert plan(good).count("from_json") == 1
    assert plan(monitor.access_log(st.service_log(spark, FOLDER))).count("regexp_extract") == 1


def test_checks_of_messages_run_once_a_row(spark):
    """A filter on the reason takes no copy of the checks, and the generated code stays small enough to be compiled."""
    good, _ = cdc.split_corrupt(cdc.decode(st.messages(st.prosthesis_log(spark, FOLDER)), "prostheses"))
    counts = monitor.fault_counts({e: cdc.decode(st.faulty_messages(log, e), e) for e, log in st.change_logs(spark, FOLDER).items()})
    for rows, topics in ((good, 1), (counts, 3)):
        text = rows._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("THEN malformed") == topics
        assert not [line for line in text.splitlines() if "Filter" in line and "malformed" in line]


def test_whole_messages_are_not_copied(spark):
    """Only a message to be cut off goes through substring, which walks all its characters; each text is built once."""
    rows = st.messages(st.prosthesis_log(spark, FOLDER))
    text = rows._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("StructsToJson") == 1 and "1073741824" not in text
    cut, size = F.pmod("seq", F.lit(101)) == 0, F.length("value")
    sizes = {r.cut: (r.least, r.most) for r in rows.groupBy(cut.alias("cut")).agg(F.min(size).alias("least"), F.max(size).alias("most")).collect()}
    assert sizes[True] == (20, 20) and sizes[False][0] > 100


def test_loads_write_even_sorted_files(spark):
    text = plan(upsert.arrange(upsert.with_partitions(st.mart_rows(spark, FOLDER)), mart_store.PARTITIONS, mart_store.SORT))
    assert "REBALANCE_PARTITIONS_BY_COL" in text
    assert "Sort [report_month" in text


def test_a_huge_day_is_written_by_many_tasks(spark, path):
    rows = spark.range(400_000).selectExpr("uuid() v", "id u", "if(id % 10 = 0, date'2024-03-01', date'2024-03-02') d")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        upsert.overwrite_partitions(rows, path + "/t", ["d"], ["u"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = {d: len([f for f in os.listdir(f"{path}/t/{d}") if f.endswith(".parquet")]) for d in ("d=2024-03-01", "d=2024-03-02")}
    assert files["d=2024-03-02"] >= 4 and files["d=2024-03-01"] < files["d=2024-03-02"]
    assert spark.read.parquet(path + "/t").count() == 400_000


# -- hot keys: one key holds a third of all rows -----------------------------------------------------------


def hot_mart(spark):
    rows = spark.range(6000).selectExpr(
        "id", "if(id % 3 = 0, 'hot', concat('u', id % 200)) user_id", "id % 1500 prosthesis_id", "cast(id % 24 as int) report_hour"
    )
    template = seeds.mart(spark, [seeds.mart_row("x", 0, dt.date(2024, 3, 5), 0)]).drop("user_id", "prosthesis_id", "report_hour")
    literal = template.first().asDict()
    from pyspark.sql import functions as F

    rows = rows.select("*", *[F.lit(v).cast(template.schema[c].dataType).alias(c) for c, v in literal.items()])
    return rows.withColumn("movements_count", F.col("id")).drop("id")


def test_hot_user_reports_are_whole(spark):
    rows = hot_mart(spark)
    summary = {r.user_id: r.total_movements for r in report.user_summary(rows).collect()}
    assert summary["hot"] == sum(range(0, 6000, 3)) and sum(summary.values()) == sum(range(6000))
    docs = report.daily_document(rows).collect()
    assert sorted(h.movements_count for d in docs for h in d.hourly_stats) == list(range(6000))
    published = publish.documents(rows, "daily")
    days = {(d.user_id, d.report_date) for d in docs}
    assert published.select("object_key").distinct().count() == published.count() == len(docs) + len(days)


def test_hot_chip_joins_whole(spark):
    telemetry = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('c', id % 50)) chip_id", "cast(id % 24 as int) report_hour", "id")
    crm = spark.createDataFrame([("hot", 1)] + [(f"c{i}", i) for i in range(50)], "chip_id string, owner int")
    plain = sorted(map(str, mart.join(telemetry, crm).collect()))
    assert len(plain) == 3000
    salted = mart.join(telemetry, crm, salt=6).select("chip_id", "report_hour", "id", "owner")
    assert sorted(map(str, salted.collect())) == plain


@settings(max_examples=15, deadline=None)
@given(st_.lists(st_.tuples(st_.integers(0, 4), st_.integers(0, 6), st_.integers(0, 3), st_.booleans()), min_size=1, max_size=40))
def test_latest_against_brute_force(spark, events):
    events = [(k if i % 3 else 0, v, s, d) for i, (k, v, s, d) in enumerate(events)]
    df = spark.createDataFrame(events, "k int, _version int, _seq int, _deleted boolean")
    expected = {}
    for k, v, s, d in events:
        expected[k] = max(expected.get(k, (v, s, d)), (v, s, d))
    got = {r.k: (r._version, r._seq, r._deleted) for r in upsert.latest(df, ["k"], ["_version", "_seq"]).collect()}
    assert got == expected
    alive = {r.k for r in upsert.live(upsert.latest(df, ["k"], ["_version", "_seq"])).collect()}
    assert alive == {k for k, (_, _, d) in expected.items() if not d}


@settings(max_examples=10, deadline=None)
@given(st_.integers(0, 10_000))
def test_rollups_do_not_depend_on_how_rows_are_split(spark, seed):
    rnd = random.Random(seed)
    rows = [
        seeds.mart_row(f"u{rnd.randrange(3)}", rnd.randrange(3), dt.date(2024, 3, 1 + rnd.randrange(2)), h,
                       movements_count=rnd.randrange(5), avg_response_time=rnd.randrange(1000) / 100)
        for h in range(12)
    ]
    df = seeds.mart(spark, rows)
    cut = rnd.randrange(12)
    parts = rollup.daily_partials(df.filter(f"report_hour < {cut}")).unionByName(rollup.daily_partials(df.filter(f"report_hour >= {cut}")))
    def shown(d):
        return sorted(str(r) for r in rollup.finish_daily(d).selectExpr("* except (avg_response_time)", "round(avg_response_time, 6) r").collect())
    assert shown(rollup.merge(parts, rollup.DAILY_KEYS)) == shown(rollup.daily_partials(df))


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark, "/nowhere") == spark.conf.get("spark.checkpoint.dir")
