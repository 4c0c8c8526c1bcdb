"""When a stream runs and where it keeps its progress. One run at a time is what a stream does anyway."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..session import shared_dir

EVERY_QUARTER_HOUR = {"processingTime": "15 minutes"}  # loads
AT_ONCE = {"processingTime": "0 seconds"}  # the change feed: a batch follows the one before
DRAIN_ONCE = {"availableNow": True}


def start(
    stream: DataFrame,
    write: Callable[[DataFrame, int], None],
    name: str,
    checkpoint: str | None = None,
    trigger: dict | None = None,
    mode: str = "append",
) -> StreamingQuery:
    """Runs `write` on every batch. Without a `checkpoint` progress is kept below the folder the cluster shares,
    under `name`."""
    where = checkpoint or f"{shared_dir(stream.sparkSession)}/streams/{name}"
    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", where)
        .trigger(**(trigger or EVERY_QUARTER_HOUR))
        .start()
    )
