"""Versioned rows, upserts, deletes and retention on plain files.

Parquet has no row-level update, so every change is a new set of rows for the partitions it touches. All
choices between rows are aggregates rather than windows: a key with very many versions is reduced inside each
map task before the shuffle and never has to pass through one task whole.
"""

from __future__ import annotations

import datetime as dt

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import month_key
from ..functions.times import days_before, moment


def _pick(rows: DataFrame, keys: list[str], order: list[str], last: bool) -> DataFrame:
    """One whole row per key, first or last by `order`; ties fall back to the row itself, so the result does
    not depend on the order of the input."""
    packed = F.struct(
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        F.struct(*rows.columns).alias("_row"),
    )
    how = F.max if last else F.min
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(how(packed).alias("_p")).select("_p._row.*")


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last version of each key. Deleted keys come back as their tombstones; see `live`."""
    return _pick(log, keys, order, last=True)


def live(versions: DataFrame) -> DataFrame:
    """Drops tombstones. Only ever applied to latest versions: dropping them earlier would bring back the
    version before the delete."""
    return versions.filter(~F.col("_deleted"))


def deleted_flag(op: Column) -> Column:
    return F.coalesce(op == "d", F.lit(False))


def replace(base: DataFrame, delta: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """`base` with the rows of `delta` put in place of those with the same key.

    Untouched rows of `base` are only filtered: while the delta's keys are small enough to be broadcast at run
    time the base is not shuffled at all. `order` decides between rows of one key inside the delta.
    """
    kept = base.join(delta.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(_pick(delta, keys, order or [], last=True))


def merge_latest(base: DataFrame, delta: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest version per key over both sides, for deltas that may arrive late or twice."""
    return latest(base.unionByName(delta), keys, order)


def insert_if_absent(
    existing: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None
) -> DataFrame:
    """Rows of `new` whose key is not there yet, one per key (the first by `order`)."""
    first = _pick(new, keys, order or [], last=False)
    return first.join(existing.select(*keys).distinct(), keys, "left_anti").select(*new.columns)


def insert_for_new_groups(existing: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """Rows of `new` whose whole group (say, a user) has no rows yet."""
    return new.join(existing.select(*group).distinct(), group, "left_anti").select(*new.columns)


def delete(base: DataFrame, keys: DataFrame) -> DataFrame:
    """`base` without the rows matching `keys` on its columns."""
    return base.join(keys.distinct(), keys.columns, "left_anti").select(*base.columns)


def delete_where_in(base: DataFrame, column: str, values: list) -> DataFrame:
    """`base` without rows whose `column` is in a short literal list; NULLs stay."""
    return base.filter(~F.coalesce(F.col(column).isin(*values), F.lit(False)))


def retain(df: DataFrame, column: str, days: int, as_of: dt.datetime | str | Column | None = None) -> DataFrame:
    """Rows young enough to keep; on a date partition this prunes the scan (the cast then vanishes)."""
    return df.filter(F.to_date(F.col(column)) > days_before(as_of, days))


def coalesce_latest(
    log: DataFrame, keys: list[str], order: str, always: list[str] | None = None
) -> DataFrame:
    """Per key and column the newest value that is not NULL; `always` columns take the newest row's value,
    NULL or not. This is an upsert whose missing fields leave the stored ones alone."""
    always = always or []
    picked = []
    for name in log.columns:
        if name in keys:
            continue
        value = F.struct(F.col(order).alias("o"), F.col(name).alias("v"))
        if name not in always and name != order:
            value = F.when(F.col(name).isNotNull(), value)
        picked.append(F.max(value)["v"].alias(name))
    return log.groupBy(*keys).agg(*picked).select(*log.columns)


def touch(
    base: DataFrame,
    delta: DataFrame,
    keys: list[str],
    as_of: dt.datetime | str | Column | None,
    column: str = "updated_at",
    always: bool = False,
) -> DataFrame:
    """`delta` with its change time kept up: new rows and rows whose values differ from `base` get `as_of`,
    unchanged rows keep the stored time. `always` stamps every row that is written over an old one."""
    values = [c for c in delta.columns if c not in keys and c != column]
    old = base.select(*keys, F.struct(*values).alias("_old"), F.col(column).alias("_old_at"))
    same = F.col("_old_at").isNotNull() & F.struct(*values).eqNullSafe(F.col("_old"))
    if always:
        same = F.lit(False)
    at = F.when(same, F.col("_old_at")).otherwise(moment(as_of))
    return delta.drop(column).join(old, keys, "left").withColumn(column, at).select(*delta.columns)


# -- files -------------------------------------------------------------------------------------------------


def with_partitions(df: DataFrame, date: str = "report_date") -> DataFrame:
    """Adds the month, the coarse partition value above the date."""
    return df.withColumn("report_month", month_key(F.col(date)))


def arrange(df: DataFrame, partitions: list[str], sort: list[str]) -> DataFrame:
    """Rows placed for a partitioned write: files of even size, sorted inside.

    Rebalancing by partition value writes small partitions as one file and splits large or hot ones at the
    advisory size, so a day that holds most rows is still written by many tasks. Sorting by the partition
    values first keeps one file open per task; the rest of the order gives narrow column ranges per row group.
    """
    return df.hint("rebalance", *partitions).sortWithinPartitions(*partitions, *sort)


def overwrite_partitions(
    df: DataFrame, path: str, partitions: list[str], sort: list[str], options=None, file_format: str = "parquet"
) -> None:
    """Replaces exactly the partitions `df` holds rows for. A rerun writes the same files again; a failed run
    leaves the old ones, since files are staged by the writer and moved at commit."""
    (
        arrange(df, partitions, sort)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**(options or {}))
        .partitionBy(*partitions)
        .format(file_format)
        .save(path)
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def upsert_into(
    spark: SparkSession,
    path: str,
    delta: DataFrame,
    keys: list[str],
    partitions: list[str],
    sort: list[str],
    order: list[str] | None = None,
    versions: bool = False,
    options: dict[str, str] | None = None,
) -> None:
    """Upserts `delta` (with its partition columns) into the files at `path`.

    Only partitions the delta touches are read and written: the semi-join on partition values prunes the scan at
    run time. `versions` keeps whichever side is newer by `order`, for late or repeated deltas; otherwise the
    delta wins. The delta is persisted with spill since it is read for its partitions, its keys and its rows.
    """
    delta = delta.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if path_exists(spark, path):
            # the table's own schema holds, not one guessed from file names
            base = spark.read.schema(delta.schema).parquet(path)
            touched = base.join(delta.select(*partitions).distinct(), partitions, "left_semi").select(*delta.columns)
            merged = merge_latest(touched, delta, keys, order or []) if versions else replace(touched, delta, keys, order)
        else:
            merged = _pick(delta, keys, order or [], last=True)
        overwrite_partitions(merged, path, partitions, sort, options)
    finally:
        delta.unpersist()


def rewrite_partitions(
    spark: SparkSession,
    path: str,
    rows: DataFrame,
    hit: DataFrame,
    partitions: list[str],
    sort: list[str],
    options: dict[str, str] | None = None,
    file_format: str = "parquet",
) -> None:
    """Makes `rows` the whole content of the partitions listed in `hit`.

    An overwrite only replaces partitions it has rows for, so partitions left without any are removed by name.
    The driver sees at most one row per directory.
    """
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        emptied = hit.distinct().join(rows.select(*partitions).distinct(), partitions, "left_anti").collect()
        overwrite_partitions(rows, path, partitions, sort, options, file_format)
    finally:
        rows.unpersist()
    drop_directories(spark, [f"{path}/" + "/".join(f"{p}={row[p]}" for p in partitions) for row in emptied])


def delete_from(spark: SparkSession, path: str, keys: DataFrame, schema, partitions: list[str], sort: list[str]) -> None:
    """Deletes the rows matching `keys` from files at `path`, rewriting only partitions that hold such rows."""
    base = spark.read.schema(schema).parquet(path)
    hit = base.join(keys.distinct(), keys.columns, "left_semi").select(*partitions).distinct()
    touched = base.join(hit, partitions, "left_semi").select(*base.columns)
    rewrite_partitions(spark, path, delete(touched, keys), hit, partitions, sort)


def expired_partitions(df: DataFrame, partitions: list[str], date: str, days: int, as_of=None) -> DataFrame:
    """Partition values past retention."""
    return df.filter(F.col(date) <= days_before(as_of, days)).select(*partitions).distinct()


def drop_expired(spark: SparkSession, path: str, schema, partitions: list[str], date: str, days: int, as_of=None) -> int:
    """Removes partitions past retention; returns how many. The driver sees one row per directory, no data."""
    base = spark.read.schema(schema).parquet(path)
    rows = expired_partitions(base, partitions, date, days, as_of).collect()
    drop_directories(spark, [f"{path}/" + "/".join(f"{p}={row[p]}" for p in partitions) for row in rows])
    return len(rows)


def drop_directories(spark: SparkSession, paths: list[str]) -> None:
    """Removes directories by name; names that do not exist are passed over."""
    for name in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(name)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
