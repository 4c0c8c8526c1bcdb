"""Keyed tables that are written little by little: a run of files per batch, merged in tiers by size.

A batch adds one run with its own rows, so what it writes follows the batch and not the table. Readers take all runs and
let the newest version of each key stand. Runs of about the same size are merged when FANOUT of them are there, so a row
is written again once a tier, log(table / batch) times in all, and a reader meets at most FANOUT runs of each tier.

There is one writer per table. Rows are versioned, so a row that is there twice (a batch that is run again, a merge that
was not finished) changes nothing. A run counts once its writer has committed it. Merged runs stay for readers that began
before, until the next merge takes them away.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import upsert

FANOUT = 8
#: Runs up to this size are one tier; each further tier is FANOUT times larger.
SMALL = 4 << 20
_REPLACES = "_replaces-"


def bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def with_bucket(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, target


def _names(fs, target) -> list[str]:
    return [f.getPath().getName() for f in fs.listStatus(target)] if fs.exists(target) else []


def runs(spark: SparkSession, root: str) -> tuple[dict[str, str], list[str]]:
    """(name and path of each run that counts, paths of those replaced or never finished)."""
    fs, target = _files(spark, root)
    done, replaced, waste = {}, set(), []
    for name in sorted(n for n in _names(fs, target) if n.startswith("run=")):
        inside = _names(*_files(spark, f"{root}/{name}"))
        if "_SUCCESS" in inside:
            done[name] = f"{root}/{name}"
            replaced |= {"run=" + n[len(_REPLACES) :] for n in inside if n.startswith(_REPLACES)}
        else:
            waste.append(f"{root}/{name}")
    return {n: p for n, p in done.items() if n not in replaced}, waste + [p for n, p in done.items() if n in replaced]


def _sizes(spark: SparkSession, paths: dict[str, str]) -> dict[str, int]:
    return {n: fs.getContentSummary(at).getLength() for n, (fs, at) in ((n, _files(spark, p)) for n, p in paths.items())}


def _write(rows: DataFrame, path: str, sort: list[str], options: dict[str, str] | None = None) -> None:
    upsert.arrange(rows, ["bucket"], sort).write.mode("overwrite").options(**(options or {})).partitionBy("bucket").parquet(path)


def add(rows: DataFrame, root: str, keys: list[str], buckets: int, batch_id: int | None = None) -> None:
    """Adds rows as a run. A batch that is run again replaces its own run."""
    if rows.isEmpty():
        return
    name = f"b{batch_id:020d}" if batch_id is not None else f"u{uuid.uuid4().hex}"
    _write(rows.withColumn("bucket", bucket(keys, buckets)), f"{root}/run={name}", keys)


def read(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All rows of all runs with their bucket; several versions of a key may be there."""
    paths, _ = runs(spark, root)
    if not paths:
        return spark.createDataFrame([], with_bucket(schema))
    whole = T.StructType([*with_bucket(schema).fields, T.StructField("run", T.StringType())])
    return spark.read.schema(whole).option("basePath", root).parquet(*paths.values()).drop("run")


def lookup(spark: SparkSession, root: str, schema: T.StructType, column: str, keys: DataFrame, buckets: int) -> DataFrame:
    """All rows whose `column`, by which the table is dealt into buckets, is among keys (`column`).

    Only the buckets of these keys are read; the driver sees the bucket numbers, never more than there are buckets.
    """
    wanted = [r.bucket for r in keys.select(bucket([column], buckets).alias("bucket")).distinct().collect()]
    rows = read(spark, root, schema)
    return rows.filter(F.col("bucket").isin(wanted)).drop("bucket").join(keys.select(column).distinct(), column, "left_semi").select(*schema.fieldNames())


def merge(
    spark: SparkSession, root: str, schema: T.StructType, keys: list[str], fold: Callable[[DataFrame], DataFrame],
    fanout: int = FANOUT, options: dict[str, str] | None = None,
) -> int:
    """Merges every tier that has `fanout` runs, `fold` choosing what stays of their rows; returns how many merges it made.

    Each merge reads and writes the runs of one tier. What was replaced before goes first.
    """
    made = 0
    while True:
        paths, waste = runs(spark, root)
        if not made:
            upsert.drop_directories(spark, waste)
        tiers: dict[int, list[str]] = {}
        for name, size in _sizes(spark, paths).items():
            tiers.setdefault(max(0, math.ceil(math.log(max(size, 1) / SMALL, fanout))), []).append(name)
        full = [names for _, names in sorted(tiers.items()) if len(names) >= fanout]
        if not full:
            return made
        whole = T.StructType([*with_bucket(schema).fields, T.StructField("run", T.StringType())])
        rows = spark.read.schema(whole).option("basePath", root).parquet(*[paths[n] for n in full[0]]).drop("run")
        path = f"{root}/run=m{uuid.uuid4().hex}"
        _write(fold(rows), path, keys, options)
        for name in full[0]:
            fs, marker = _files(spark, f"{path}/{_REPLACES}{name.removeprefix('run=')}")
            fs.createNewFile(marker)
        made += 1
