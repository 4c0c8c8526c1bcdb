"""Raw samples to hourly statistics and usage sessions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stable_round, success_rate
from ..functions.times import moment

CHANNELS = ["myo_channel_1", "myo_channel_2", "myo_channel_3", "myo_channel_4"]


def _amplitude() -> Column:
    """Euclidean norm of the signal channels; a silent channel counts as 0."""
    squares = [F.pow(F.coalesce(F.col(c), F.lit(0.0)), F.lit(2.0)) for c in CHANNELS]
    total = squares[0]
    for square in squares[1:]:
        total = total + square
    return F.sqrt(total)


def measures() -> list[Column]:
    """The fourteen hourly measures. All of them are mergeable, so samples of one device are combined
    inside each task before the shuffle, however many samples that device sends."""
    moved = F.col("movement_type").isNotNull()
    response = F.col("response_time_ms")
    return [
        F.count_if(moved).alias("movements_count"),
        F.count_if(moved & F.col("movement_success")).alias("successful_movements"),
        F.avg(response).alias("avg_response_time"),
        F.min(response).alias("min_response_time"),
        F.max(response).alias("max_response_time"),
        F.avg("battery_level").alias("avg_battery_level"),
        F.min("battery_level").alias("min_battery_level"),
        F.max("battery_level").alias("max_battery_level"),
        F.avg("actuator_temp").alias("avg_actuator_temp"),
        F.max("actuator_temp").alias("max_actuator_temp"),
        F.count_if(F.col("error_code").isNotNull()).alias("error_count"),
        F.count_if(F.col("warning_flags") > 0).alias("warning_count"),
        F.avg(_amplitude()).alias("avg_myo_amplitude"),
        F.avg("connection_quality").alias("avg_connection_quality"),
    ]


def between(raw: DataFrame, start: dt.datetime | str | Column, end: dt.datetime | str | Column) -> DataFrame:
    """Samples in `[start, end)`: a sample on the hour belongs to the hour it opens."""
    return raw.filter((F.col("timestamp") >= moment(start)) & (F.col("timestamp") < moment(end)))


def aggregate(raw: DataFrame, as_of: dt.datetime | str | Column | None = None) -> DataFrame:
    """Hourly statistics of every device and hour present in `raw`, in one shuffle."""
    return (
        raw.groupBy("chip_id", F.date_trunc("hour", "timestamp").alias("hour_start"))
        .agg(*measures())
        .withColumn("updated_at", moment(as_of))
    )


def aggregate_hour(
    raw: DataFrame, hour_start: dt.datetime | str, as_of: dt.datetime | str | Column | None = None
) -> DataFrame:
    """Hourly statistics of the one hour that starts at `hour_start`."""
    start = moment(hour_start)
    return aggregate(between(raw, start, start + F.expr("INTERVAL 1 HOUR")), as_of)


def backfill(raw: DataFrame, as_of: dt.datetime | str | Column | None = None) -> DataFrame:
    """All hours at once. There is no loop over hours: the hour is part of the grouping key."""
    return aggregate(raw, as_of)


def hours_present(raw: DataFrame) -> DataFrame:
    return raw.select(F.date_trunc("hour", "timestamp").alias("hour_start")).distinct()


def since(hourly: DataFrame, as_of: dt.datetime | str | Column | None, lookback_hours: int) -> DataFrame:
    """Hours inside the lookback; what arrives later than that is never picked up."""
    return hourly.filter(F.col("hour_start") >= moment(as_of) - F.expr(f"INTERVAL {int(lookback_hours)} HOURS"))


def present(hourly: DataFrame) -> DataFrame:
    """Hourly statistics as loads read them: date, hour, success rate, means rounded to two digits."""
    rounded = [
        "avg_response_time",
        "avg_battery_level",
        "avg_actuator_temp",
        "avg_myo_amplitude",
        "avg_connection_quality",
    ]
    shown = {name: stable_round(F.col(name), 2).alias(name) for name in rounded}
    plain = [
        "avg_response_time",
        "min_response_time",
        "max_response_time",
        "avg_battery_level",
        "min_battery_level",
        "max_battery_level",
        "avg_actuator_temp",
        "max_actuator_temp",
        "error_count",
        "warning_count",
        "avg_myo_amplitude",
        "avg_connection_quality",
        "updated_at",
    ]
    return hourly.select(
        "chip_id",
        "hour_start",
        F.to_date("hour_start").alias("report_date"),
        F.hour("hour_start").alias("report_hour"),
        "movements_count",
        "successful_movements",
        success_rate(F.col("successful_movements"), F.col("movements_count")).alias("success_rate"),
        *[shown.get(name, F.col(name)) for name in plain],
    )


def sessions(raw: DataFrame) -> DataFrame:
    """Usage sessions: one row per session and device."""
    moved = F.col("movement_type").isNotNull()
    return (
        raw.filter(F.col("session_id").isNotNull())
        .groupBy("session_id", "chip_id")
        .agg(
            F.min("timestamp").alias("started_at"),
            F.max("timestamp").alias("ended_at"),
            F.count_if(moved).alias("total_movements"),
            F.count_if(moved & F.col("movement_success")).alias("successful_movements"),
            F.avg("response_time_ms").alias("avg_response_time_ms"),
            F.min("battery_level").alias("min_battery_level"),
            F.max("actuator_temp").alias("max_actuator_temp"),
            F.count_if(F.col("error_code").isNotNull()).alias("error_count"),
        )
        .withColumn(
            "duration_seconds", (F.unix_timestamp("ended_at") - F.unix_timestamp("started_at")).cast("int")
        )
        .select(
            "session_id",
            "chip_id",
            "started_at",
            "ended_at",
            "duration_seconds",
            "total_movements",
            "successful_movements",
            "avg_response_time_ms",
            "min_battery_level",
            "max_actuator_temp",
            "error_count",
        )
    )
