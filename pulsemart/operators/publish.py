"""Report documents as keyed JSON rows: build, write, read back, find missing ones, refresh.

An object store keeps one object per report; a distributed table of millions of one-row directories would not
work, so documents are rows `(object_key, ..., body)` in JSON files, grouped by kind, by day (daily reports) and
by a hash bucket of the user. A refresh rewrites only the days and buckets that hold documents it replaces.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from . import report, upsert

KINDS = ("list", "summary", "daily")
BUCKETS = 64
# A bucket of one day holds the reports of so many users at most, as far as the users of the first load tell.
USERS_PER_BUCKET = 20_000
# File below the documents that holds how many buckets they are kept in; readers of files pass over it.
LAYOUT = "_layout"
PARTITIONS = ["kind", "day", "bucket"]
SORT = ["user_id", "object_key"]
FIELDS = schemas.PUBLISHED.fieldNames()
# Day of documents that are not about one.
NO_DAY = "all"


def object_key(kind: str) -> Column:
    """Path of a document in the object store: a day has one report and the hours of each device beside it."""
    user = F.col("user_id")
    if kind == "list":
        return F.concat(user, F.lit("/list/reports.json"))
    if kind == "summary":
        return F.concat(user, F.lit("/summary/summary.json"))
    name = F.lit("report.json")
    if kind == "hours":
        name = F.concat(F.lit("hours-"), F.col("prosthesis_id").cast("string"), F.lit(".json"))
    return F.concat(user, F.lit("/daily/"), F.date_format("report_date", "yyyy-MM-dd"), F.lit("/"), name)


def url(base: str, key: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/reports/"), key)


def bucket_of(user: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(user), F.lit(buckets)).cast("int")


def buckets_for(users: int) -> int:
    """Buckets for that many users: a power of two."""
    return 1 << (max(1, -(-users // USERS_PER_BUCKET)) - 1).bit_length()


def buckets_at(spark: SparkSession, path: str, default: int = BUCKETS) -> int:
    """Buckets the documents at `path` are kept in."""
    place = f"{path}/{LAYOUT}"
    return int(spark.read.text(place).first()[0]) if upsert.path_exists(spark, place) else default


def _settle(mart: DataFrame, path: str, buckets: int | None) -> int:
    """Buckets for documents at `path`: those that are there already, else the given number, else one from the number of
    users. It stays for good, since files of two layouts could not be told apart; a new layout takes a new folder."""
    spark = mart.sparkSession
    place = f"{path}/{LAYOUT}"
    if upsert.path_exists(spark, path):
        known = buckets_at(spark, path)
        if buckets is not None and buckets != known:
            raise ValueError(f"documents at {path} are kept in {known} buckets, not {buckets}")
        return known
    chosen = buckets or buckets_for(mart.agg(F.approx_count_distinct("user_id")).first()[0])
    spark.range(1).select(F.lit(str(chosen)).alias("value")).coalesce(1).write.text(place)
    return chosen


def documents(mart: DataFrame, kind: str, buckets: int = BUCKETS) -> DataFrame:
    """The documents of one kind, serialised. Daily ones are reports and, apart from them, the hours of each device:
    one form for every size of account."""
    if kind == "list":
        return serialise(report.list_document(mart), "list", buckets)
    if kind == "summary":
        return serialise(report.user_summary(mart), "summary", buckets)
    if kind == "daily":
        reports = serialise(report.daily_detail(mart), "daily", buckets)
        return reports.unionByName(serialise(report.device_hours(mart), "hours", buckets))
    raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")


def serialise(docs: DataFrame, kind: str, buckets: int = BUCKETS) -> DataFrame:
    """Documents as `(kind, day, bucket, object_key, user_id, report_date, prosthesis_id, body)` rows; `hours` of
    devices are stored with the daily reports."""
    date = F.col("report_date") if kind in ("daily", "hours") else F.lit(None).cast("date")
    device = F.col("prosthesis_id") if kind == "hours" else F.lit(None)
    return docs.select(
        F.lit("daily" if kind == "hours" else kind).alias("kind"),
        F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit(NO_DAY)).alias("day"),
        bucket_of(F.col("user_id"), buckets).alias("bucket"),
        object_key(kind).alias("object_key"),
        "user_id",
        date.alias("report_date"),
        device.cast("long").alias("prosthesis_id"),
        F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}).alias("body"),
    )


def all_documents(mart: DataFrame, kinds=KINDS, buckets: int = BUCKETS) -> DataFrame:
    parts = [documents(mart, kind, buckets) for kind in kinds]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def read(spark: SparkSession, path: str, kind: str | None = None, user_id: str | None = None) -> DataFrame:
    """Published documents; kind and user narrow the scan to single directories."""
    rows = spark.read.schema(schemas.PUBLISHED).json(path)
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    if user_id is not None:
        bucket = bucket_of(F.lit(user_id), buckets_at(spark, path))
        rows = rows.filter((F.col("bucket") == bucket) & (F.col("user_id") == user_id))
    return rows


def affected(delta: DataFrame) -> DataFrame:
    """Users a load touched."""
    return delta.select("user_id").distinct()


def missing(wanted: DataFrame, published: DataFrame) -> DataFrame:
    """Wanted documents that are not published yet, matched on the columns of `wanted`."""
    return wanted.distinct().join(published.select(*wanted.columns).distinct(), wanted.columns, "left_anti")


def refreshed(mart: DataFrame, users: DataFrame | None, kinds=KINDS, buckets: int = BUCKETS) -> DataFrame:
    """Rebuilt documents of the given users, or of all users."""
    rows = mart if users is None else mart.join(users.select("user_id").distinct(), "user_id", "left_semi")
    return all_documents(rows, kinds, buckets)


def write_all(mart: DataFrame, path: str, kinds=KINDS, buckets: int | None = None) -> None:
    """Publishes everyone's documents, replacing whatever was there of these kinds."""
    buckets = _settle(mart, path, buckets)
    below = ["day", "bucket"]
    for kind in kinds:
        rows = documents(mart, kind, buckets).drop("kind")
        (
            upsert.arrange(rows, below, SORT)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy(*below)
            .json(f"{path}/kind={kind}")
        )


def _replace_documents(spark: SparkSession, path: str, stored: DataFrame, kept: DataFrame, new: DataFrame) -> None:
    """Rewrites the directories of `stored` and of `new` to hold `kept` and `new`."""
    hit = stored.select(*PARTITIONS).distinct()
    rows = kept.select(*FIELDS).unionByName(new.select(*FIELDS))
    upsert.rewrite_partitions(spark, path, rows, hit, PARTITIONS, SORT, file_format="json")


def refresh(
    spark: SparkSession,
    mart: DataFrame,
    path: str,
    users: DataFrame | None = None,
    kinds=KINDS,
    buckets: int | None = None,
) -> None:
    """Brings all published documents of `users` up to date; without users, of everyone.

    Old documents of an affected user all go, so a day deleted from the mart does not stay published. The rest
    of the same buckets is carried over unchanged; other buckets are neither read nor written.
    """
    if users is None or not upsert.path_exists(spark, path):
        write_all(mart, path, kinds, buckets)
        return
    buckets = _settle(mart, path, buckets)
    users = users.select("user_id").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    try:
        hit = users.select(bucket_of(F.col("user_id"), buckets).alias("bucket")).distinct()
        stored = read(spark, path).filter(F.col("kind").isin(*kinds)).join(hit, "bucket", "left_semi")
        kept = stored.join(users, "user_id", "left_anti")
        _replace_documents(spark, path, stored, kept, refreshed(mart, users, kinds, buckets))
    finally:
        users.unpersist()


def refresh_load(
    spark: SparkSession, mart: DataFrame, days: DataFrame, delta: DataFrame, path: str, buckets: int | None = None
) -> None:
    """Brings published documents up to date after a load that added or replaced the mart rows in `delta`.

    Lists and summaries of affected users come from the stored user-day partials `days`, daily reports are
    rebuilt for the loaded user-days only. So neither the whole mart nor the daily reports of other days are
    read or written, which `refresh` would do.
    """
    if not upsert.path_exists(spark, path):
        write_all(mart, path, buckets=buckets)
        return
    buckets = _settle(mart, path, buckets)
    keys = ["user_id", "report_date"]
    pairs = delta.select(*keys).distinct().persist(StorageLevel.MEMORY_AND_DISK)
    try:
        users = pairs.select("user_id").distinct()
        dates = pairs.select("report_date").distinct()
        of_users = days.join(users, "user_id", "left_semi")
        touched = mart.join(dates, "report_date", "left_semi").join(pairs, keys, "left_semi")
        new = (
            serialise(report.list_document_from(of_users), "list", buckets)
            .unionByName(serialise(report.user_summary_from(of_users), "summary", buckets))
            .unionByName(documents(touched, "daily", buckets))
        )
        bucket = bucket_of(F.col("user_id"), buckets).alias("bucket")
        places = (
            pairs.select(F.lit("daily").alias("kind"), F.date_format("report_date", "yyyy-MM-dd").alias("day"), bucket)
            .unionByName(users.select(F.lit("list").alias("kind"), F.lit(NO_DAY).alias("day"), bucket))
            .unionByName(users.select(F.lit("summary").alias("kind"), F.lit(NO_DAY).alias("day"), bucket))
            .distinct()
        )
        stored = read(spark, path).join(places, PARTITIONS, "left_semi")
        is_daily = F.col("kind") == "daily"
        kept = (
            stored.filter(is_daily)
            .join(pairs, keys, "left_anti")
            .select(*FIELDS)
            .unionByName(stored.filter(~is_daily).join(users, "user_id", "left_anti").select(*FIELDS))
        )
        _replace_documents(spark, path, stored, kept, new)
    finally:
        pairs.unpersist()
