"""Tables of the operational databases, from a database or from files, behind one description."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import hourly


@dataclass(frozen=True)
class FileSource:
    """Parquet tables below one folder, one directory (or file) per table."""

    folder: str

    def read(self, spark: SparkSession, table: str, schema) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.folder}/{table}")


@dataclass(frozen=True)
class DatabaseSource:
    """Tables of a JDBC database.

    A table is read by `partitions` tasks, split on a numeric key between known bounds (`splits`: table to key, lowest
    and highest value) or, for time series, by ready-made time slices; a single unsplit read would pass the whole table
    through one task, so a table without a split is refused.
    """

    url: str
    properties: dict[str, str] = field(default_factory=dict)
    partitions: int = 16
    prefix: str = ""
    splits: dict[str, tuple[str, int, int]] = field(default_factory=dict)

    def options(self, table: str, column: str, lower: int, upper: int) -> dict[str, str]:
        return {
            "url": self.url,
            "dbtable": self.prefix + table,
            "partitionColumn": column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(self.partitions),
            "fetchsize": "10000",
            "pushDownPredicate": "true",
            **self.properties,
        }

    def read(self, spark: SparkSession, table: str, schema) -> DataFrame:
        if table not in self.splits:
            raise ValueError(f"splits has no key and bounds for {table!r}")
        rows = spark.read.format("jdbc").options(**self.options(table, *self.splits[table])).load()
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])

    def read_slices(
        self, spark: SparkSession, table: str, schema, column: str, start: dt.datetime, end: dt.datetime
    ) -> DataFrame:
        rows = spark.read.jdbc(
            self.url,
            self.prefix + table,
            predicates=time_slices(column, start, end, self.partitions),
            properties={"fetchsize": "10000", **self.properties},
        )
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def time_slices(column: str, start: dt.datetime, end: dt.datetime, n: int) -> list[str]:
    """Half-open range conditions that cover `[start, end)` without overlap, one per reading task."""
    if end <= start:
        raise ValueError("end must be after start")
    n = max(1, n)
    edges = [start + (end - start) * i / n for i in range(n)] + [end]
    return [f"{column} >= '{a.isoformat(sep=' ')}' AND {column} < '{b.isoformat(sep=' ')}'" for a, b in zip(edges, edges[1:])]


def crm(spark: SparkSession, source: FileSource | DatabaseSource) -> dict[str, DataFrame]:
    """Customers, devices and models."""
    return {
        "customers": source.read(spark, "customers", schemas.CUSTOMERS),
        "prostheses": source.read(spark, "prostheses", schemas.PROSTHESES),
        "models": source.read(spark, "prosthesis_models", schemas.MODELS),
    }


def hourly_stats(spark: SparkSession, source: FileSource | DatabaseSource, as_of=None, lookback_hours: int | None = None) -> DataFrame:
    """Hourly statistics, all or inside a lookback; the bound is pushed down to the scan."""
    rows = source.read(spark, "hourly_stats", schemas.HOURLY_STATS)
    return rows if lookback_hours is None else hourly.since(rows, as_of, lookback_hours)


def raw_telemetry(spark: SparkSession, source: FileSource | DatabaseSource, start, end) -> DataFrame:
    """Raw samples in `[start, end)`; the bounds are pushed down to the scan, or are the slices of a database read."""
    if isinstance(source, DatabaseSource):
        return source.read_slices(spark, "raw_telemetry", schemas.RAW_TELEMETRY, "timestamp", start, end)
    return hourly.between(source.read(spark, "raw_telemetry", schemas.RAW_TELEMETRY), start, end)
