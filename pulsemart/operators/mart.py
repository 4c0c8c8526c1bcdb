"""The usage mart: hourly statistics with owner, device and model on every row."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import newest
from ..functions.times import moment

KEYS = ["user_id", "prosthesis_id", "report_date", "report_hour"]
ORDER = ["report_date", "report_hour", "prosthesis_id"]
USER_INFO = ["customer_name", "customer_email", "customer_region", "prosthesis_model", "prosthesis_serial"]

# Columns of a row before it is stamped by the load.
COLUMNS = [name for name in schemas.MART.fieldNames() if name != "etl_processed_at"]

COUNTS = ["movements_count", "successful_movements", "error_count", "warning_count"]
MEASURES = [
    "success_rate",
    "avg_response_time",
    "min_response_time",
    "max_response_time",
    "avg_battery_level",
    "min_battery_level",
    "max_battery_level",
    "avg_actuator_temp",
    "max_actuator_temp",
    "avg_connection_quality",
    "avg_myo_amplitude",
]


def crm_source(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """`primary` if it has any row, else `fallback`, decided inside the plan by probing for one row."""
    return primary.unionByName(fallback.filter(~primary.limit(1).exists()).select(*primary.columns))


def join(telemetry: DataFrame, crm: DataFrame, salt: int = 1) -> DataFrame:
    """Telemetry with its owner by chip; samples of unknown chips and devices without samples drop out.

    Adaptive execution broadcasts the customer side when its measured size allows and otherwise splits hot
    chips. `salt` > 1 spreads every chip over that many shuffle keys up front, by hour of day, for sessions in
    which adaptive skew handling is off; the customer side is repeated `salt` times, the result is the same.
    """
    if salt <= 1:
        return telemetry.join(crm, "chip_id")
    left = telemetry.withColumn("_salt", F.pmod(F.col("report_hour"), F.lit(salt)).cast("int"))
    right = crm.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return left.join(right, ["chip_id", "_salt"]).drop("_salt")


def project(joined: DataFrame) -> DataFrame:
    """The mart columns, with the source's change time under its mart name."""
    return joined.withColumnRenamed("updated_at", "source_updated_at").select(*COLUMNS)


def conform(rows: DataFrame) -> DataFrame:
    """Every column in its mart type."""
    types = {field.name: field.dataType for field in schemas.MART.fields}
    return rows.select(*[F.col(name).cast(types[name]).alias(name) for name in rows.columns])


def fill(rows: DataFrame) -> DataFrame:
    """Missing counts and measures become 0, as reports expect."""
    return rows.na.fill(0, subset=COUNTS + MEASURES)


def build(telemetry: DataFrame, crm: DataFrame, salt: int = 1) -> DataFrame:
    """Mart rows from presented hourly telemetry and the customer side."""
    return fill(conform(project(join(telemetry, crm, salt))))


def stamp(rows: DataFrame, as_of: dt.datetime | str | Column | None = None) -> DataFrame:
    return rows.withColumn("etl_processed_at", moment(as_of))


def user_info(mart: DataFrame) -> DataFrame:
    """Lookup table of users: the values on each user's newest hour, one row per user."""
    return (
        mart.groupBy("user_id")
        .agg(newest(ORDER, USER_INFO).alias("_last"))
        .select("user_id", *[F.col(f"_last.{name}").alias(name) for name in USER_INFO])
    )


def lookup(rows: DataFrame, info: DataFrame) -> DataFrame:
    """Rows with the user's lookup values; unknown users keep NULLs."""
    return rows.join(info, "user_id", "left")
