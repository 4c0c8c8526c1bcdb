"""Queries over what loads leave behind: the stored mart, published documents, bucketed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import crm, hourly, mart, publish, report, upsert
from ..session import scratch_dir
from ..sources import bucketed, mart_store
from ..sources import sample_tables as st
from .oracle import n, r, rate, sql
from .registry import query


def _stored(spark, folder) -> str:
    """The mart, loaded into files the way loads do it, in two overlapping loads."""
    path = scratch_dir(spark, "mart")
    rows = st.mart_rows(spark, folder)
    mart_store.load(spark, rows, path, st.AS_OF)
    mart_store.load(spark, rows.filter(F.col("report_hour") >= 22), path, st.AS_OF)
    return path


def _busiest(spark, path):
    """The user and day with the most hours, as a caller would name them: one row."""
    hours = mart_store.scan(spark, path).groupBy("user_id", "report_date").agg(F.count(F.lit(1)).alias("hours"))
    return hours.orderBy(F.desc("hours"), "user_id", "report_date").first()


_BUSIEST = "SELECT user_id, report_date FROM mart GROUP BY ALL ORDER BY count(*) DESC, user_id, report_date LIMIT 1"


@query(
    "stored_day_report",
    sql(
        f"""SELECT user_id, report_date, l.customer_name, l.prosthesis_id, l.prosthesis_model, l.prosthesis_serial,
              l.customer_region, d.* EXCLUDE (user_id, report_date)
            FROM (SELECT user_id, report_date, {n("sum(movements_count)")} AS total_movements,
                    {n("sum(successful_movements)")} AS total_successful,
                    {rate("sum(successful_movements)", "sum(movements_count)")} AS daily_success_rate,
                    {r("avg(avg_response_time)", 2)} AS avg_response_time, {r("avg(avg_battery_level)", 1)} AS avg_battery_level,
                    min(min_battery_level) AS min_battery_level, max(max_actuator_temp) AS max_actuator_temp,
                    {n("sum(error_count)")} AS total_errors, CAST(count(DISTINCT report_hour) AS INTEGER) AS active_hours
                  FROM mart WHERE (user_id, report_date) IN ({_BUSIEST}) GROUP BY user_id, report_date) d
              JOIN day_last l USING (user_id, report_date)""",
        "day_last",
    ),
)
def stored_day_report(spark, folder):
    """A user's day from the stored mart, by the scan that reads one date partition and pushes the user down."""
    path = _stored(spark, folder)
    asked = _busiest(spark, path)
    return report.daily_detail(mart_store.scan(spark, path, asked.user_id, asked.report_date, asked.report_date))


@query(
    "stored_user_hours",
    sql(
        f"""SELECT user_id, report_date, report_hour AS hour, prosthesis_id, movements_count, successful_movements,
              success_rate, avg_response_time, avg_battery_level, error_count
            FROM mart WHERE user_id = (SELECT user_id FROM ({_BUSIEST}))
              AND report_date >= (SELECT report_date FROM ({_BUSIEST}))""",
        "mart",
    ),
)
def stored_user_hours(spark, folder):
    """A user's hours from a date on, from the stored mart."""
    path = _stored(spark, folder)
    asked = _busiest(spark, path)
    return report.hourly_rows(mart_store.scan(spark, path, asked.user_id, asked.report_date))


@query(
    "stored_day_totals",
    sql(
        f"""SELECT report_date, count(*) AS hour_rows, count(DISTINCT user_id) AS users,
              {n("sum(movements_count)")} AS total_movements FROM mart GROUP BY report_date""",
        "mart",
    ),
)
def stored_day_totals(spark, folder):
    """Totals by day of the whole stored mart: hours loaded twice stand there once."""
    return (
        mart_store.scan(spark, _stored(spark, folder))
        .groupBy("report_date")
        .agg(
            F.count(F.lit(1)).alias("hour_rows"),
            F.count_distinct("user_id").alias("users"),
            F.sum("movements_count").alias("total_movements"),
        )
    )


@query(
    "stored_documents",
    sql(
        f"""SELECT kind, user_id, report_date, total_movements, object_key FROM (
              SELECT 'daily' AS kind, user_id, report_date, {n("sum(movements_count)")} AS total_movements,
                user_id || '/daily/' || report_date || '/report.json' AS object_key FROM mart GROUP BY user_id, report_date
              UNION ALL
              SELECT 'summary', user_id, CAST(NULL AS DATE), {n("sum(movements_count)")}, user_id || '/summary/summary.json'
                FROM mart GROUP BY user_id)""",
        "mart",
    ),
)
def stored_documents(spark, folder):
    """Reports and summaries read back from published files, after a refresh of the users of one last day."""
    path = scratch_dir(spark, "documents")
    rows = st.mart_rows(spark, folder)
    kinds = ("summary", "daily")
    publish.write_all(rows, path, kinds)
    publish.refresh(spark, rows, path, publish.affected(upsert.retain(rows, "report_date", 1, st.AS_OF)), kinds)
    return (
        publish.read(spark, path)
        .filter(F.col("prosthesis_id").isNull())
        .select(
            "kind", "user_id", "report_date", F.get_json_object("body", "$.total_movements").cast("long").alias("total_movements"),
            "object_key",
        )
    )


@query("mart_rows_bucketed", sql("SELECT * FROM mart", "mart"))
def mart_rows_bucketed(spark, folder):
    """The usage mart from hourly and owner tables kept in buckets of the chip: their join shuffles neither."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run, path = uuid.uuid4().hex, scratch_dir(spark, "bucketed")
    owners = crm.mart_source(st.customer_view(spark, folder), allow_empty_chip=False)
    bucketed.write(hourly.present(st.hourly_stats(spark, folder)), f"hourly_{run}", f"{path}/hourly", ["chip_id"], buckets)
    bucketed.write(owners, f"owners_{run}", f"{path}/owners", ["chip_id"], buckets)
    return mart.build(spark.table(f"hourly_{run}"), spark.table(f"owners_{run}"))
