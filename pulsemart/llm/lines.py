"""Lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, LOWER, UPPER, text_or_empty


def _keys(text: Column) -> Column:
    """Key of each line: stripped at both ends, A-Z lower-cased."""
    return F.transform(
        F.split(text, "\n", -1),
        lambda line: F.translate(F.regexp_replace(line, f"^[{BLANK}]+|[{BLANK}]+\\z", ""), UPPER, LOWER),
    )


def _hashes(key: Column) -> tuple[Column, Column]:
    """128 bits of a key in two longs: equal for no two lines of any corpus one could hold."""
    return F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key, F.length(key)).alias("b")


def drop_shared_lines(docs: DataFrame, min_documents: int = 2, min_chars: int = 10) -> DataFrame:
    """The rows of docs (doc_id, text, others) as a struct `row` without the text, with kept (the text left), n_lines, n_dropped.

    A line whose key has at least `min_chars` code points and is found in at least `min_documents` documents stays only
    in the smallest doc_id that holds it, there with all its repeats. Only hashes of lines are shuffled; the lines of a
    document are exploded once each, counted with map-side sums, and the hits of a document come back as one row, so
    the texts meet them in one join and lines are put back by their position in the text.

    Null and empty texts are one empty line. Rows that share a doc_id are one document with several texts. A row without
    doc_id keeps all its lines and makes no other row lose one. An empty table gives an empty result. A document whose lines all go keeps the empty text.
    """
    others = F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row")
    source = docs.select(others, "doc_id", text_or_empty().alias("text")).withColumn("version", F.xxhash64("text"))
    held = (
        source.filter(F.col("doc_id").isNotNull())
        .select("doc_id", "version", F.posexplode(_keys(F.col("text"))).alias("pos", "key"))
        .filter(F.length("key") >= min_chars)
        .select("doc_id", "version", "pos", *_hashes(F.col("key")))
    )
    if min_documents == 2:  # two documents hold a line where its smallest and largest id differ: one pass, no sets
        shared = F.min("doc_id") != F.max("doc_id")
    else:
        shared = F.count_distinct("doc_id") >= min_documents
    keeper = (
        held.groupBy("a", "b")
        .agg(F.min("doc_id").alias("keeper"), shared.alias("shared"))
        .filter("shared")
        .select("a", "b", "keeper")
    )
    hits = (
        held.join(keeper, ["a", "b"])
        .filter(F.col("doc_id") != F.col("keeper"))
        .groupBy("doc_id", "version")
        .agg(F.array_sort(F.collect_set("pos")).alias("hits"))
    )
    marked = source.join(hits, ["doc_id", "version"], "left").select(
        "row", "text", F.split("text", "\n", -1).alias("lines"), "hits"
    )
    # the runs of lines between dropped positions, so that the work is linear in the lines
    ends = F.concat("hits", F.array(F.size("lines")))
    runs = F.transform(
        ends,
        lambda end, i: F.slice(
            F.col("lines"),
            F.when(i == 0, F.lit(1)).otherwise(F.get(F.col("hits"), i - 1) + 2),
            end - F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("hits"), i - 1) + 1),
        ),
    )
    return marked.select(
        "row",
        F.when(F.col("hits").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n")).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.array_size("hits"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each document."""
    rows = drop_shared_lines(docs.select("doc_id", "text"))
    return rows.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def without_shared_lines(docs: DataFrame) -> DataFrame:
    """docs with the texts that line dedup leaves; n_chars, where there is one, is counted again."""
    rows = drop_shared_lines(docs)
    made = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return rows.select(*[(made[c] if c in made else F.col("row")[c]).alias(c) for c in docs.columns])


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
shared AS (
  SELECT k, min(doc_id) AS keeper FROM lines WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT l.doc_id, l.pos, l.line, s.k IS NOT NULL AND l.doc_id <> s.keeper AS hit
  FROM lines l LEFT JOIN shared s ON l.k = s.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT hit), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
