"""Streaming ingest of the change feed: append-only logs, current state, customer dimension.

Every batch writes partitions that depend only on the batch and the stored state, so a batch that is run again
after a failure leaves the same files.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators import cdc, upsert
from ..sources import runs
from ..sources.changelog import once
from .triggers import AT_ONCE, start

BUCKETS = 64
# Lookups by chip and by external id skip row groups of merged runs; a batch's own run is too small to need filters.
BLOOM = {
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.bloom.filter.enabled#chip_id": "true",
    "parquet.bloom.filter.enabled#external_id": "true",
}


class TooManyBrokenMessages(RuntimeError):
    pass


def _add(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, kind)])


def write_dead_letters(decoded: DataFrame, batch_id: int, path: str) -> None:
    """Messages that could not be decoded, under the batch's number; a replay writes the same rows again."""
    _, bad = cdc.split_corrupt(decoded)
    upsert.overwrite_partitions(bad.withColumn("batch_id", F.lit(batch_id).cast("long")), path, ["batch_id"], [])


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    fields = [("value", T.StringType()), ("_seq", T.LongType()), (cdc.REASON, T.StringType()), ("batch_id", T.LongType())]
    return spark.read.schema(T.StructType([T.StructField(n, t) for n, t in fields])).parquet(path)


# -- log ---------------------------------------------------------------------------------------------------


def write_log_batch(
    batch: DataFrame, batch_id: int, entity: str, log_path: str, dead_path: str, max_broken: int | None = None
) -> None:
    """One batch of messages into the log, broken ones into the dead-letter table, under the batch's number."""
    decoded = cdc.decode(batch, entity).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        good, bad = cdc.split_corrupt(decoded)
        if max_broken is not None:
            broken = bad.count()
            if broken > max_broken:
                raise TooManyBrokenMessages(f"{broken} broken messages of {entity} in batch {batch_id}, {max_broken} allowed")
        rows = good.withColumn("batch_id", F.lit(batch_id).cast("long"))
        upsert.overwrite_partitions(rows, log_path, ["batch_id"], schemas.CHANGE_KEYS[entity])
        write_dead_letters(decoded, batch_id, dead_path)
    finally:
        decoded.unpersist()


def ingest(
    messages: DataFrame,
    entity: str,
    log_path: str,
    dead_path: str,
    checkpoint: str | None = None,
    trigger: dict | None = None,
    max_broken: int | None = None,
    within: str | None = None,
) -> StreamingQuery:
    """Continuous ingest of one entity. `max_broken` stops the stream on a batch with more broken messages;
    without it any number is set aside. Messages delivered again `within` a time (say, `defaults.REDELIVERY`) of their
    first arrival are left out, see `changelog.once`; without it they are taken in, which the latest version per key
    does not mind but the log grows by."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_log_batch(batch, batch_id, entity, log_path, dead_path, max_broken)

    messages = once(messages, within) if within else messages
    return start(messages, write, f"ingest-{entity}", checkpoint, trigger or AT_ONCE)


def read_log(spark: SparkSession, log_path: str, entity: str) -> DataFrame:
    return spark.read.schema(_add(schemas.change_state(entity), "batch_id", T.LongType())).parquet(log_path).drop("batch_id")


def compact_log(spark: SparkSession, log_path: str, entity: str, upto: int) -> None:
    """Folds the batches up to `upto` into one that holds the latest version per key.

    The folded batch is written before the old ones are dropped; a reader in between sees versions twice, which
    latest-by-key does not mind.
    """
    stored = spark.read.schema(_add(schemas.change_state(entity), "batch_id", T.LongType())).parquet(log_path)
    old = stored.filter(F.col("batch_id") <= upto)
    numbers = [row.batch_id for row in old.select("batch_id").distinct().collect()]
    folded = upsert.latest(old.drop("batch_id"), schemas.CHANGE_KEYS[entity], cdc.VERSION_ORDER)
    upsert.overwrite_partitions(folded.withColumn("batch_id", F.lit(upto).cast("long")), log_path, ["batch_id"], schemas.CHANGE_KEYS[entity])
    upsert.drop_directories(spark, [f"{log_path}/batch_id={n}" for n in numbers if n != upto])


# -- state -------------------------------------------------------------------------------------------------


def _newest(entity: str):
    """Of several rows of a key, the one with the newest version."""
    return lambda rows: upsert.latest(rows, schemas.CHANGE_KEYS[entity], cdc.VERSION_ORDER)


def apply_state(
    spark: SparkSession, changes: DataFrame, entity: str, path: str, buckets: int = BUCKETS, batch_id: int | None = None
) -> None:
    """Changes into the stored state: the newest version of each key stands, whatever order batches arrive in.

    The batch's rows are one more run of the table (see `sources.runs`); nothing stored is read or written again but by
    merges. The bucket count is fixed for the life of the table.
    """
    keys = schemas.CHANGE_KEYS[entity]
    rows = _newest(entity)(changes.select(*schemas.change_state(entity).fieldNames()))
    runs.add(rows, path, keys, buckets, batch_id)


def merge_state(spark: SparkSession, entity: str, path: str, fanout: int = runs.FANOUT) -> int:
    return runs.merge(spark, path, schemas.change_state(entity), schemas.CHANGE_KEYS[entity], _newest(entity), fanout, BLOOM)


def read_state(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """Stored state, tombstones included; empty before the first batch."""
    return _newest(entity)(runs.read(spark, path, schemas.change_state(entity)).drop("bucket"))


def lookup_state(spark: SparkSession, path: str, entity: str, keys: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Stored state of some keys, tombstones included, from the buckets of these keys alone."""
    column = schemas.CHANGE_KEYS[entity][0]
    return _newest(entity)(runs.lookup(spark, path, schemas.change_state(entity), column, keys, buckets))


def keep_state(
    messages: DataFrame,
    entity: str,
    path: str,
    dead_path: str,
    checkpoint: str | None = None,
    trigger: dict | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Continuously kept current state of one entity."""

    def write(batch: DataFrame, batch_id: int) -> None:
        decoded = cdc.decode(batch, entity).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            apply_state(batch.sparkSession, cdc.split_corrupt(decoded)[0], entity, path, buckets, batch_id)
            write_dead_letters(decoded, batch_id, dead_path)
            merge_state(batch.sparkSession, entity, path)
        finally:
            decoded.unpersist()

    return start(messages, write, f"state-{entity}", checkpoint, trigger or AT_ONCE)


# -- customer dimension ------------------------------------------------------------------------------------

ENTITIES = ("customers", "prostheses", "models")
#: Which devices a customer or model ever had: a device's rows are found by its owner or model without reading the state.
INDEXES = {"customers": "customer_id", "models": "model_id"}
DEVICE = schemas.CHANGE_KEYS["prostheses"][0]


def tagged(streams: dict[str, DataFrame]) -> DataFrame:
    """The entities' messages as one stream, so that a batch sees changes of all three together."""
    parts = [stream.withColumn("entity", F.lit(entity)) for entity, stream in streams.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def index_schema(column: str) -> T.StructType:
    return schemas.struct(f"{column} INT, {DEVICE} INT")


def dimension_schema() -> T.StructType:
    """Dimension rows as stored: with the batch that made them, and whether the device has left the dimension."""
    return _add(_add(schemas.CUSTOMER_DATA, "_batch", T.LongType()), "_gone", T.BooleanType())


def _last_batch(rows: DataFrame) -> DataFrame:
    return upsert.latest(rows, [DEVICE], ["_batch"])


def read_dimension(spark: SparkSession, root: str) -> DataFrame:
    rows = _last_batch(runs.read(spark, f"{root}/customer_data", dimension_schema()).drop("bucket"))
    return rows.filter(~F.col("_gone")).select(*schemas.CUSTOMER_DATA.fieldNames())


def affected_devices(spark: SparkSession, changed: dict[str, DataFrame], root: str, buckets: int = BUCKETS) -> DataFrame:
    """Devices whose dimension row a batch can alter: changed themselves, or ever owned by a changed customer or made to a
    changed model. A device that has since changed hands is among them too, and is only worked out once more."""
    result = changed["prostheses"].select(DEVICE)
    for entity, column in INDEXES.items():
        found = runs.lookup(spark, f"{root}/index/{entity}", index_schema(column), column, changed[entity], buckets)
        result = result.unionByName(found.select(DEVICE))
    return result.distinct()


def dimension_rows(spark: SparkSession, devices: DataFrame, root: str, buckets: int = BUCKETS) -> DataFrame:
    """Dimension rows of some devices (prosthesis_id), from the buckets of the three states that hold these devices, their
    owners and their models."""
    held = upsert.live(lookup_state(spark, f"{root}/state/prostheses", "prostheses", devices, buckets)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        others = {}
        for entity, column in INDEXES.items():
            keys = held.select(column).filter(F.col(column).isNotNull()).distinct()
            others[entity] = upsert.live(lookup_state(spark, f"{root}/state/{entity}", entity, keys, buckets))
        return cdc.customer_data_of(others["customers"], held, others["models"])
    finally:
        held.unpersist()


def apply_feed_batch(batch: DataFrame, batch_id: int, root: str, buckets: int = BUCKETS) -> None:
    """One mixed batch: runs of the three states and of the indexes first, then the dimension rows of the devices it
    affects. All it reads of what is stored are the buckets of affected keys, all it writes are its own rows."""
    spark = batch.sparkSession
    decoded = {
        entity: cdc.decode(batch.filter(F.col("entity") == entity), entity).persist(StorageLevel.MEMORY_AND_DISK)
        for entity in ENTITIES
    }
    try:
        changed = {}
        for entity in ENTITIES:
            changed[entity], _ = cdc.split_corrupt(decoded[entity])
            apply_state(spark, changed[entity], entity, f"{root}/state/{entity}", buckets, batch_id)
            write_dead_letters(decoded[entity], batch_id, f"{root}/dead/{entity}")
        for entity, column in INDEXES.items():
            pairs = changed["prostheses"].select(column, DEVICE).filter(F.col(column).isNotNull()).distinct()
            runs.add(pairs, f"{root}/index/{entity}", [column], buckets, batch_id)
        hit = affected_devices(spark, changed, root, buckets).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            redone = dimension_rows(spark, hit, root, buckets)
            rows = hit.join(redone, DEVICE, "left").select(
                *schemas.CUSTOMER_DATA.fieldNames(),
                F.lit(batch_id).cast("long").alias("_batch"),
                F.col("user_id").isNull().alias("_gone"),
            )
            runs.add(rows, f"{root}/customer_data", [DEVICE], buckets, batch_id)
        finally:
            hit.unpersist()
        merge_feed(spark, root)
    finally:
        for rows in decoded.values():
            rows.unpersist()


def merge_feed(spark: SparkSession, root: str, fanout: int = runs.FANOUT) -> None:
    """Merges the tiers of all tables below `root` that are full."""
    for entity in ENTITIES:
        merge_state(spark, entity, f"{root}/state/{entity}", fanout)
    for entity, column in INDEXES.items():
        runs.merge(spark, f"{root}/index/{entity}", index_schema(column), [column], DataFrame.distinct, fanout)
    runs.merge(spark, f"{root}/customer_data", dimension_schema(), [DEVICE], _last_batch, fanout, BLOOM)


def keep_dimension(
    streams: dict[str, DataFrame],
    root: str,
    checkpoint: str | None = None,
    trigger: dict | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Continuously kept states and customer dimension below `root`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        apply_feed_batch(batch, batch_id, root, buckets)

    return start(tagged(streams), write, "customer-dimension", checkpoint, trigger or AT_ONCE)
