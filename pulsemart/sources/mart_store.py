"""The mart and its rollup as files: partitioned by month and date, sorted by user inside."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators import mart as mart_ops
from ..operators import upsert

PARTITIONS = ["report_month", "report_date"]
SORT = ["user_id", "report_hour", "prosthesis_id"]


def file_schema() -> T.StructType:
    return T.StructType([*schemas.MART.fields, T.StructField("report_month", T.IntegerType())])


def append(mart: DataFrame, path: str, as_of=None) -> None:
    """Adds stamped rows. Loading the same hours twice counts them twice; see `load` for the repeatable form."""
    rows = upsert.with_partitions(mart_ops.stamp(mart, as_of))
    upsert.arrange(rows, PARTITIONS, SORT).write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def load(spark: SparkSession, mart: DataFrame, path: str, as_of=None) -> None:
    """Adds stamped rows in place of those of the same user, device and hour: reruns change nothing."""
    rows = upsert.with_partitions(mart_ops.stamp(mart, as_of)).select(*file_schema().fieldNames())
    upsert.upsert_into(spark, path, rows, mart_ops.KEYS, PARTITIONS, SORT, order=["etl_processed_at"])


def scan(
    spark: SparkSession,
    path: str,
    user_id: str | None = None,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Mart rows, by user and inclusive date range. The month is bounded along with the date, since a filter on
    the date alone would still list every month."""
    rows = spark.read.schema(file_schema()).parquet(path)
    if start is not None:
        rows = rows.filter((F.col("report_month") >= start.year * 100 + start.month) & (F.col("report_date") >= F.lit(start)))
    if end is not None:
        rows = rows.filter((F.col("report_month") <= end.year * 100 + end.month) & (F.col("report_date") <= F.lit(end)))
    if user_id is not None:
        rows = rows.filter(F.col("user_id") == user_id)
    return rows.drop("report_month")
