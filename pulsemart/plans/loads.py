"""Whole loads: raw samples to hourly table, hourly table to mart, rollup and documents."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import defaults, schemas
from ..functions.times import moment
from ..operators import crm, hourly, mart, monitor, publish, rollup, upsert
from ..sources import mart_store

HOURLY_KEYS = ["chip_id", "hour_start"]


def load_hourly(
    spark: SparkSession, raw: DataFrame, path: str, as_of: dt.datetime, lookback_hours: int = defaults.BATCH_LOOKBACK_HOURS
) -> None:
    """Recomputes the hours inside the lookback from raw samples and upserts them.

    The lookback starts on the hour: a first hour cut in the middle would replace a whole one.
    """
    start = (as_of - dt.timedelta(hours=lookback_hours)).replace(minute=0, second=0, microsecond=0)
    stats = hourly.aggregate(raw.filter(F.col("timestamp") >= moment(start)), as_of)
    rows = stats.withColumn("report_date", F.to_date("hour_start"))
    upsert.upsert_into(spark, path, rows, HOURLY_KEYS, ["report_date"], HOURLY_KEYS, order=["updated_at"])


def read_hourly(spark: SparkSession, path: str, since: dt.datetime | None = None) -> DataFrame:
    """The hourly table, from an hour on; the date partition is bounded along with the hour."""
    schema = T.StructType([*schemas.HOURLY_STATS.fields, T.StructField("report_date", T.DateType())])
    rows = spark.read.schema(schema).parquet(path)
    if since is not None:
        rows = rows.filter((F.col("report_date") >= F.lit(since.date())) & (F.col("hour_start") >= moment(since)))
    return rows.drop("report_date")


def load_mart(
    spark: SparkSession,
    hourly_rows: DataFrame,
    owners: DataFrame,
    mart_path: str,
    as_of: dt.datetime,
    rollup_path: str | None = None,
    days_path: str | None = None,
    documents_path: str | None = None,
    document_buckets: int | None = None,
    replace: bool = True,
    since: dt.datetime | None = None,
) -> dict:
    """Joins hourly statistics with their owners and loads them, then brings rollups and documents up to date.

    Everything after the write reads the written rows back by their stamp instead of computing them again; `since`
    bounds that scan to the dates of the load.
    `replace=False` appends, which counts hours twice when they are loaded twice.
    """
    rows = mart.build(hourly.present(hourly_rows), owners)
    if replace:
        mart_store.load(spark, rows, mart_path, as_of)
    else:
        mart_store.append(rows, mart_path, as_of)
    delta = mart_store.scan(spark, mart_path, start=since.date() if since else None).filter(
        F.col("etl_processed_at") == moment(as_of)
    )
    counters = monitor.load_metrics(delta).first()
    if not counters.records_count:
        return {"records_loaded": 0, "affected_users": 0, "status": "no_data"}
    whole = mart_store.scan(spark, mart_path)
    touched = rollup.touched_days(delta)
    for path, how in ((rollup_path, rollup.daily_partials), (days_path, rollup.daily_user)):
        if path:
            # a rollup kept for the first time has to cover what the mart held before
            known = upsert.path_exists(spark, path)
            rows = rollup.stamp(rollup.refresh(whole, delta, how) if known else how(whole), as_of)
            upsert.rewrite_partitions(spark, path, rows, touched, ["report_date"], ["user_id"])
    if documents_path:
        days = spark.read.parquet(days_path) if days_path else rollup.daily_user(whole)
        publish.refresh_load(spark, whole, days, delta, documents_path, document_buckets)
    return {
        "records_loaded": counters.records_count,
        "affected_users": counters.unique_users,
        "min_date": counters.min_date,
        "max_date": counters.max_date,
        "status": "success",
    }


def batch_load(
    spark: SparkSession, hourly_path: str, customers: dict[str, DataFrame], mart_path: str, as_of: dt.datetime, **targets
) -> dict:
    """The regular load: customer side from the customer database, long lookback."""
    since = as_of - dt.timedelta(hours=defaults.BATCH_LOOKBACK_HOURS)
    owners = crm.mart_source(
        crm.customer_prosthesis(customers["customers"], customers["prostheses"], customers["models"])
    )
    return load_mart(spark, read_hourly(spark, hourly_path, since), owners, mart_path, as_of, since=since, **targets)


def change_load(
    spark: SparkSession,
    hourly_path: str,
    dimension: DataFrame,
    fallback: DataFrame,
    mart_path: str,
    as_of: dt.datetime,
    **targets,
) -> dict:
    """The change-fed load: customer side from the kept dimension, or from the view while that is empty, and a
    short lookback."""
    since = as_of - dt.timedelta(hours=defaults.CHANGE_LOOKBACK_HOURS)
    columns = [c for c in crm.MART_COLUMNS if c != "customer_id"]
    primary = dimension.filter(crm.has_chip(allow_empty=False)).select(*columns)
    view = fallback.withColumnRenamed("customer_full_name", "customer_name").select(*columns)
    owners = mart.crm_source(primary, view)
    return load_mart(spark, read_hourly(spark, hourly_path, since), owners, mart_path, as_of, since=since, **targets)


def apply_retention(
    spark: SparkSession,
    as_of: dt.datetime,
    mart_path: str | None = None,
    rollup_paths: tuple[str, ...] = (),
    hourly_path: str | None = None,
) -> int:
    """Drops what is past its retention, whole date partitions at a time; returns how many.

    Only partition values and row counts of file footers are read.
    """
    jobs = [(mart_path, mart_store.PARTITIONS, defaults.MART_RETENTION_DAYS)] if mart_path else []
    jobs += [(path, ["report_date"], defaults.MART_RETENTION_DAYS) for path in rollup_paths]
    jobs += [(hourly_path, ["report_date"], defaults.RAW_RETENTION_DAYS)] if hourly_path else []
    types = {"report_month": T.IntegerType(), "report_date": T.DateType()}
    dropped = 0
    for path, partitions, days in jobs:
        schema = T.StructType([T.StructField(p, types[p]) for p in partitions])
        dropped += upsert.drop_expired(spark, path, schema, partitions, "report_date", days, as_of)
    return dropped
