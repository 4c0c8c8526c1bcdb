"""What running streams report about themselves, kept as a table that `monitor.lag` reads."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import upsert
from ..schemas import struct
from ..sources.changelog import source_progress

PROGRESS = struct(
    """query STRING, run_id STRING, batch_id BIGINT, at TIMESTAMP, topic STRING, partition INT, end_offset BIGINT,
       committed_offset BIGINT, input_rows BIGINT, state_rows BIGINT, day DATE"""
)


def progress_rows(report: dict) -> list[tuple]:
    """Rows of PROGRESS from one progress report: one per topic partition, or per source where it has none."""
    at = dt.datetime.fromisoformat(report["timestamp"].replace("Z", "+00:00"))
    state = sum(o.get("numRowsTotal", 0) for o in report.get("stateOperators") or [])
    head = (report.get("name") or report["id"], report["runId"], report["batchId"], at)
    return [
        (*head, topic, partition, end, done, source.get("numInputRows"), state, at.date())
        for source in report.get("sources", [])
        for topic, partition, end, done in source_progress(source)
    ]


class ProgressLog(StreamingQueryListener):
    """Appends every progress report of the session's streams to the table at `path`, partitioned by day.

    Reports come once a batch, or every ten seconds from an idle stream, and make a small file each; a report that can't
    be written is left out rather than stopping the stream it tells of. `spark.streams.addListener(ProgressLog(...))`.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.failed = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        try:
            rows = progress_rows(json.loads(event.progress.json))
            if rows:
                self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").partitionBy("day").parquet(self.path)
        except Exception:  # noqa: BLE001  whatever went wrong, it must not reach the stream
            self.failed += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    if not upsert.path_exists(spark, path):
        return spark.createDataFrame([], PROGRESS)
    return spark.read.schema(PROGRESS).parquet(path)


def newest(progress: DataFrame) -> DataFrame:
    """The last report of each query, topic and partition, the input of `monitor.lag`."""
    return upsert.latest(progress, ["query", "topic", "partition"], ["at", "batch_id"])


def throughput(progress: DataFrame) -> DataFrame:
    """Batches, rows and span of time per query and day, from batches that took in rows."""
    batch = progress.filter(F.col("input_rows") > 0).groupBy("query", "day", "run_id", "batch_id").agg(
        F.min("at").alias("at"), F.max("input_rows").alias("rows"), F.max("state_rows").alias("state_rows")
    )
    return batch.groupBy("query", "day").agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("rows").alias("rows"),
        F.max("state_rows").alias("max_state_rows"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
    )
