"""Session settings for clusters and tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

TIME_ZONE = "UTC"

# Runtime settings the operators count on; all of them can be set on a live session.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # also the size of the files a rebalanced write leaves
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
}

# Jobs describe hundreds of columns; recording a Python call site for each costs more than planning them.
BUILD_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

# Streams keep one row of state per device and hour inside the lookback: on disk, with incremental checkpoints.
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def prepare(spark: SparkSession, time_zone: str = TIME_ZONE) -> SparkSession:
    """Pin the time zone (it decides hours and dates) and keep adaptive execution on."""
    spark.conf.set("spark.sql.session.timeZone", time_zone)
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def prepare_streaming(spark: SparkSession) -> SparkSession:
    for key, value in STREAM_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    app: str = "pulsemart",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session for jobs and tests. On a cluster `master` and sizes come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**BUILD_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def shared_dir(spark: SparkSession, unset: str | None = None) -> str:
    """The folder every executor can reach, as named by the cluster.

    `unset` is used only where the cluster names none, as in local tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if unset is None:
        raise ValueError("spark.checkpoint.dir is not set and no folder was given")
    return unset.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for tables of this run, in the folder the cluster shares. A folder of this machine stands in only
    where none is named and the session is local."""
    master = spark.sparkContext.master
    if spark.conf.get("spark.checkpoint.dir", None) is None and (master == "local" or master.startswith("local[")):
        return f"{tempfile.mkdtemp()}/{name}"
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
