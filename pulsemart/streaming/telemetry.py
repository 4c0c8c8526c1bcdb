"""Streaming hourly statistics and daily rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import defaults, schemas
from ..functions.times import moment
from ..operators import hourly, rollup, upsert
from .triggers import start

HOURLY_KEYS = ["chip_id", "hour_start"]


def hourly_windows(raw: DataFrame, lookback_hours: int = defaults.BATCH_LOOKBACK_HOURS) -> DataFrame:
    """Hourly statistics in tumbling windows. Samples later than the lookback are not picked up, as in the
    batch; until then a late sample updates its hour."""
    return (
        raw.withWatermark("timestamp", f"{int(lookback_hours)} hours")
        .groupBy("chip_id", F.window("timestamp", "1 hour").alias("_w"))
        .agg(*hourly.measures())
        .select("chip_id", F.col("_w.start").alias("hour_start"), *[F.col(c) for c in _measure_names()])
    )


def _measure_names() -> list[str]:
    return [c for c in schemas.HOURLY_STATS.fieldNames() if c not in (*HOURLY_KEYS, "updated_at")]


def keep_hourly(
    raw: DataFrame,
    path: str,
    checkpoint: str | None = None,
    as_of=None,
    lookback_hours: int = defaults.BATCH_LOOKBACK_HOURS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Hourly table kept by upserting the hours each batch changed; only their date partitions are rewritten."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("updated_at", moment(as_of)).withColumn("report_date", F.to_date("hour_start"))
        upsert.upsert_into(batch.sparkSession, path, rows, HOURLY_KEYS, ["report_date"], HOURLY_KEYS, order=["updated_at"])

    return start(hourly_windows(raw, lookback_hours), write, "hourly", checkpoint, trigger, mode="update")


def daily_windows(mart: DataFrame, lookback_hours: int = defaults.BATCH_LOOKBACK_HOURS) -> DataFrame:
    """Daily partials of a stream of newly appended mart rows.

    Rows that replace hours loaded before must not come this way, they would be added; `rollup.refresh` is the
    form for loads that replace.
    """
    at = F.col("report_date").cast("timestamp") + F.make_dt_interval(hours=F.col("report_hour"))
    timed = mart.withColumn("_at", at).withWatermark("_at", f"{int(lookback_hours)} hours")
    # the watermark bounds state only through a window on the event time, so a day is grouped as one
    day = F.window("_at", "1 day").alias("_w")
    keys = [*rollup.DAILY_KEYS, day]
    return rollup.partials(timed, keys, ["customer_name", "prosthesis_model"], ["report_hour"]).drop("_w")


def keep_daily(
    mart: DataFrame,
    path: str,
    checkpoint: str | None = None,
    as_of=None,
    lookback_hours: int = defaults.BATCH_LOOKBACK_HOURS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Stored daily partials kept by upserting the groups each batch changed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = rollup.stamp(batch, as_of)
        # a group's partial only grows, so between two of one group the one with more rows is the newer
        upsert.upsert_into(
            batch.sparkSession, path, rows, rollup.DAILY_KEYS, ["report_date"], ["user_id", "prosthesis_id"], order=["hour_rows"]
        )

    return start(daily_windows(mart, lookback_hours), write, "daily", checkpoint, trigger, mode="update")
