"""The change feed: one JSON object per message, read from topics or from files of the same messages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import defaults

TOPICS = {"customers": "crm.customers", "prostheses": "crm.prostheses", "models": "crm.prosthesis_models"}


def kafka_options(
    servers: str,
    entity: str,
    max_offsets: int | None = None,
    min_partitions: int | None = None,
    topics: dict[str, str] = TOPICS,
) -> dict[str, str]:
    """Reader options. Starting at the earliest offset takes in the initial snapshot (operation `r`) before the
    changes, from the same topic. `min_partitions` splits topics of few partitions over more reading tasks."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topics[entity],
        "startingOffsets": "earliest",
        "failOnDataLoss": "true",
    }
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    if min_partitions:
        options["minPartitions"] = str(min_partitions)
    return options


def kafka_stream(
    spark: SparkSession, servers: str, entity: str, max_offsets: int | None = None, min_partitions: int | None = None
) -> DataFrame:
    """Messages of an entity's topic as (value, seq). Needs the Kafka connector on the class path."""
    options = kafka_options(servers, entity, max_offsets, min_partitions)
    rows = spark.readStream.format("kafka").options(**options).load()
    return rows.select(F.col("value").cast("string").alias("value"), F.col("offset").alias("seq"))


def _written() -> Column:
    """Position of a message from a file: when the file was written, in microseconds. Files written later win among equal
    versions, in whatever order they are read; equal versions of one key in one file are settled by the row itself."""
    return F.unix_micros(F.col("_metadata.file_modification_time"))


def file_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Messages from text files that appear in `folder`, one per line, as (value, seq)."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder).select("value", _written().alias("seq"))


def file_batch(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(folder).select("value", _written().alias("seq"))


def once(messages: DataFrame, within: str = defaults.REDELIVERY) -> DataFrame:
    """A stream of messages without those that came before, word for word, less than `within` ago.

    A message carries its key, operation and version, so the same words are the same change, whatever its position in the
    feed the second time. Time is that of arrival: no message is ever late, however old its version, and the state, 16
    bytes and a key a message, is given up after `within`.
    """
    return (
        messages.withColumns({"_a": F.xxhash64("value"), "_b": F.xxhash64(F.lit("message"), "value"), "_arrived": F.current_timestamp()})
        .withWatermark("_arrived", within)
        .dropDuplicatesWithinWatermark(["_a", "_b"])
        .drop("_a", "_b", "_arrived")
    )


def kafka_progress(progress: dict) -> list[tuple[str, int, int, int]]:
    """(topic, partition, end_offset, committed_offset) rows from a stream's last progress report, the input of
    `monitor.lag`. There is one row per topic partition."""
    return [row for source in progress.get("sources", []) if _offsets(source.get("latestOffset")) for row in source_progress(source)]


def source_progress(source: dict) -> list[tuple[str, int, int | None, int | None]]:
    """(topic, partition, end_offset, committed_offset) of one source of a progress report. A source without topics, such
    as files or generated rows, is one topic of one partition; end_offset is None where it does not tell its end."""
    latest, done = _offsets(source.get("latestOffset")), _offsets(source.get("endOffset"))
    if any(isinstance(v, dict) for v in (latest or done).values()):
        return [
            (topic, int(partition), int(end), int(done.get(topic, {}).get(partition, 0)))
            for topic, partitions in (latest or done).items()
            for partition, end in partitions.items()
        ]
    return [(source.get("description") or "", 0, _number(source.get("latestOffset")), _number(source.get("endOffset")))]


def _number(value) -> int | None:
    """The offset of a source without topics: a number, or an object that holds one."""
    if isinstance(value, str):
        value = json.loads(value)
    if isinstance(value, dict):
        value = value.get("logOffset", value.get("offset"))
    return int(value) if isinstance(value, (int, float)) else None


def _offsets(value) -> dict:
    if isinstance(value, str):
        value = json.loads(value)
    return value if isinstance(value, dict) else {}
