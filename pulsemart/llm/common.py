"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts of the operators define it: space and U+0009 to U+000D.
BLANK = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Entries of one generation of a worker's memo; two are held at most, which bounds its memory.
MEMO_ENTRIES = 300_000
#: Longer strings are worked out each time rather than kept in a memo.
MEMO_LENGTH = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's spark.checkpoint.dir. A folder of this machine stands in only
    where none is named and the session is local, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp()
    return _local[context.applicationId]


_local: dict[str, str] = {}


def checkpoint(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder: cuts lineage and outlives executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Spark's own setting to remove a query's shuffle files when it ends, rather than whenever the driver's garbage goes.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: as checkpoint(), compressed, and without its shuffle files once it
    is written. Stays until discard() or until that folder is cleared."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(df: DataFrame | None) -> None:
    """Deletes the files of a table made by stored(), once nothing reads them any more."""
    path = getattr(df, "_stored_at", None)
    if path is not None:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives Python workers this package, once per application, unless their path already has it."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root, app = os.path.dirname(package), spark.sparkContext.applicationId
    if app in _shipped or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    name = os.path.join(tempfile.mkdtemp(), os.path.basename(package))
    spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", root, os.path.basename(package)))
    _shipped.add(app)


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, list]]], schema: str
) -> DataFrame:
    """Runs `fn` over the columns of each Arrow batch as Python lists; `schema` is a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship_package(df.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


class Memo(dict):
    """Remembers what `make` returns for short strings: those used since the generation before the last began."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MEMO_LENGTH:
            if len(self) >= MEMO_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


# White space beyond ASCII, and what only some libraries count as white space.
_SPACE = r"\s\x1c-\x1f\x85\u180e\u200b"
# A blank or newline beside more white space or at either end of the text: a cut before it could part a run of white
# space, which byte-level vocabularies read as a whole.
_RUNS = re.compile(rf"[ \n][{_SPACE}]|[{_SPACE}][ \n]|^[ \n]|[ \n]\Z")
_PIECES = re.compile(rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def pre_tokens(text: str) -> list[str]:
    """Cuts a text into words with the white space before them; joined they are the text.

    The split pattern of byte-level vocabularies takes white space only at the start of a piece (or as a piece of its
    own that looks at nothing but the character after the run), so no piece crosses from a word into the white space
    behind it: words can be encoded one by one.
    """
    if not text:
        return []
    if _RUNS.search(text):
        return _PIECES.findall(text)
    pieces: list[str] = []
    before = ""
    for line in text.split("\n"):
        first, *rest = line.split(" ")
        pieces.append(before + first)
        pieces += [" " + w for w in rest]
        before = "\n"
    return pieces
