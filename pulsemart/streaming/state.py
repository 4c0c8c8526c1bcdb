"""What a stream holds in its state, read from its checkpoint while it rests or runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def state(spark: SparkSession, checkpoint: str, operator: int = 0, batch_id: int | None = None) -> DataFrame:
    """State rows (partition_id, key, value) of a stateful operator as of a batch, the last committed one by default."""
    reader = spark.read.format("statestore").option("operatorId", operator)
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    return reader.load(checkpoint).select("partition_id", "key", "value")


def operators(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Stateful operators of the stream with their partitions and the batches whose state can be read."""
    return spark.read.format("state-metadata").load(checkpoint)


def open_windows(spark: SparkSession, checkpoint: str, operator: int = 0, batch_id: int | None = None) -> DataFrame:
    """Windows of a windowed aggregate that can still change: start and end, the groups that are open in each, and the
    largest number of them in one partition of the state.

    A window leaves the state once the watermark is past its end, so the oldest one shows how far the stream waits back.
    """
    rows = state(spark, checkpoint, operator, batch_id)
    names = [f.name for f in rows.schema["key"].dataType.fields if _is_window(f)]
    if len(names) != 1:
        raise ValueError("the operator does not group by one window")
    window = F.col("key")[names[0]]
    return (
        rows.groupBy(window["start"].alias("window_start"), window["end"].alias("window_end"), "partition_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("window_start", "window_end")
        .agg(F.sum("n").alias("open_groups"), F.max("n").alias("largest_partition"))
    )


def open_by_key(spark: SparkSession, checkpoint: str, key: str, operator: int = 0, batch_id: int | None = None) -> DataFrame:
    """Open groups and the bytes of their state (as text) by one part of the key, such as the device."""
    rows = state(spark, checkpoint, operator, batch_id)
    size = F.octet_length(F.to_json("key")) + F.octet_length(F.to_json("value"))
    return rows.groupBy(F.col("key")[key].alias(key)).agg(F.count(F.lit(1)).alias("open_groups"), F.sum(size).alias("state_bytes"))


def _is_window(field) -> bool:
    return getattr(field.dataType, "names", None) == ["start", "end"]
