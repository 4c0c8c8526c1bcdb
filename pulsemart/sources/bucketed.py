"""Tables kept by buckets of their join key, so that loads that join them again and again shuffle neither side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of one bucket that a task sorts and joins without spilling.
BUCKET_BYTES = 256 << 20


def buckets_for(size_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for a table of that size: a power of two, so that tables of other sizes still match by whole buckets."""
    wanted = max(1, -(-size_bytes // bucket_bytes))
    return 1 << (wanted - 1).bit_length()


def write(rows: DataFrame, name: str, path: str, keys: list[str], buckets: int) -> None:
    """Replaces the table `name` at `path` by `rows`, bucketed and sorted by `keys`.

    Rows are shuffled by the keys into as many tasks as there are buckets, so that a bucket is one sorted file. A key that
    holds a large share of all rows makes its bucket as large; `mart.join(..., salt=n)` is the form for such tables.
    """
    (
        rows.repartition(buckets, *keys)
        .write.mode("overwrite")
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .option("path", path)
        .saveAsTable(name)
    )


def attach(spark: SparkSession, name: str, path: str, schema: T.StructType, keys: list[str], buckets: int) -> DataFrame:
    """The table at `path` under `name`, in sessions whose catalog does not know it: files alone don't tell that they are
    bucketed."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    by = ", ".join(f"`{k}`" for k in keys)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
        f"INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return spark.table(name)
