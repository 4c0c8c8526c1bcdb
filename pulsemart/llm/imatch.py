"""I-Match fingerprints: digests of a document's mid-frequency terms in randomised parts of the lexicon."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, text_or_empty

#: Band of document frequencies, as shares of all documents: idf = -ln(share).
RAREST, COMMONEST = 0.0005, 0.05
#: So many terms are sent to all tasks at most; the rest of the band is joined by a shuffle (see `lexicon`).
MAX_LEXICON = 100_000
#: Randomised lexicons: one term in so many, each rate with PER_RATE seeds.
RATES = (16, 32, 64, 192)
PER_RATE = 8
LEXICONS = len(RATES) * PER_RATE
#: Documents of neighbouring ids that are sorted together on average.
NEIGHBOURS = 64
_WIDE = 1024


def terms(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))


def lexicon(docs: DataFrame, most: int = MAX_LEXICON) -> tuple[DataFrame, DataFrame | None]:
    """h, mask (bit k: the term is in lexicon k) of all terms within the frequency band, in two tables.

    Terms are counted as they are and then known by 64-bit hashes, however long. The first table has the most frequent ones, `most` rows at
    most, and is sent to all tasks; it also holds terms above the band (mask 0), so that their places needn't be joined.
    The second has the rest of the band, for a shuffled join, and is None where nothing is left. Frequencies are cut
    between bins of 1/64 of a doubling, of which there are few.
    """
    n = docs.count()
    counts = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    mask = F.lit(0).cast("long")
    for k in range(LEXICONS):
        chosen = F.pmod(F.xxhash64("term", F.lit(k)), F.lit(RATES[k // PER_RATE])) == 0
        mask = mask.bitwiseOR(F.when(chosen, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    mask = F.when(F.col("df") <= max(2.0, COMMONEST * n), mask).otherwise(F.lit(0).cast("long"))
    counts = counts.filter(F.col("df") >= max(2.0, RAREST * n))
    counts = checkpoint(counts.select(F.xxhash64("term").alias("h"), mask.alias("mask"), F.floor(F.log2("df") * 64).cast("long").alias("bin")))
    edge, held = 0, 0
    for r in sorted(counts.groupBy("bin").agg(F.count("*").alias("terms")).collect(), reverse=True):
        held += r.terms
        if held > most:
            edge = r.bin + 1
            break
    rest = counts.filter((F.col("bin") < edge) & (F.col("mask") != 0)).select("h", "mask") if edge else None
    return counts.filter(F.col("bin") >= edge).select("h", "mask"), rest


def digests(texts: DataFrame, terms_of: tuple[DataFrame, DataFrame | None], keys: list[str], told_by: list[str]) -> DataFrame:
    """keys, digests (a number for each lexicon, 0 where none of its terms occurs) of each distinct keys of texts (keys, text).

    A digest is the exclusive or of the hashes of the distinct terms. It depends on the set of terms alone, as the hash
    of the sorted terms does, and is reduced map-side. Terms that are not sent to all tasks are joined by a shuffle, and
    what they add is joined by `told_by`, two of the keys. Texts that share keys, or what tells them, must be equal.
    """
    frequent, rest = terms_of
    parts = [
        F.bit_xor(F.when(F.col("mask").bitwiseAND(F.lit(1 << k).cast("long")) != 0, F.col("h")).otherwise(F.lit(0))).alias(f"d{k}")
        for k in range(LEXICONS)
    ]
    held = texts.select(*keys, F.explode_outer(terms(F.col("text"))).alias("term")).withColumn("h", F.xxhash64("term"))
    out = held.join(F.broadcast(frequent), "h", "left").groupBy(*keys).agg(*parts)  # MAX_LEXICON rows at most
    if rest is not None:
        places = texts.select(*told_by, F.explode(terms(F.col("text"))).alias("term")).select(*told_by, F.xxhash64("term").alias("h"))
        places = places.join(F.broadcast(frequent), "h", "left_anti").join(rest, "h").distinct()
        more = places.groupBy(*told_by).agg(*parts)
        more = more.select(*[F.col(c).alias(f"{c}_") for c in told_by], *[F.col(f"d{k}").alias(f"r{k}") for k in range(LEXICONS)])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in told_by])
        out = out.join(more, same, "left").withColumns(
            {f"d{k}": F.coalesce(f"d{k}", F.lit(0)).bitwiseXOR(F.coalesce(f"r{k}", F.lit(0))) for k in range(LEXICONS)}
        )
    return out.select(*keys, F.array(*[F.xxhash64(f"d{k}").bitwiseAND(0x7FFFFFFF).cast("int") * (F.coalesce(f"d{k}", F.lit(0)) != 0).cast("int") for k in range(LEXICONS)]).alias("digests"))


def likeness(a: Column, b: Column, same_text: Column) -> Column:
    """Share of equal digests among the lexicons in which either text has a term; without any, whether the texts are equal."""
    told = F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: (p.x != 0) | (p.y != 0))
    same = F.size(F.filter(told, lambda p: p.x == p.y))
    return F.when(F.size(told) > 0, same / F.size(told)).otherwise(same_text.cast("double"))


def shown(values: Column, version: Column) -> Column:
    """A fingerprint as text: a short hash for each lexicon; of texts without terms of any, the hash of the whole text."""
    parts = F.transform(values, lambda d: F.when(d == 0, F.lit("-")).otherwise(F.lower(F.hex(d))))
    told = F.exists(values, lambda d: d != 0)
    return F.when(told, F.array_join(parts, ".")).otherwise(F.concat(F.lit("text:"), F.lower(F.hex(version))))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with next_id and next_text of the next document by descending doc_id; the last has the first.

    No row number and no global sort: ids are cut into ranges of NEIGHBOURS documents on average, each range is sorted on
    its own, and only the first document of a range goes to the range before it. The ranges are put in order in two
    levels, so one task sees one row in NEIGHBOURS * 1024 documents. Rows of one doc_id are in order of their texts. A row
    without doc_id is its own next document.
    """
    ids = docs.filter(F.col("doc_id").isNotNull())
    low, high, n = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, high = low or 0, high or 0
    width = max(1, -(-(high - low + 1) * NEIGHBOURS // max(n, 1)))
    bucket = F.expr(f"cast((cast(doc_id as decimal(20, 0)) - {low}) div {width} as bigint)")
    placed = ids.withColumn("bucket", bucket)

    ranges = placed.select("bucket").distinct().withColumn("wide", F.expr(f"bucket div {_WIDE}"))
    tops = ranges.groupBy("wide").agg(F.min("bucket").alias("first"))
    order = Window.orderBy("wide")  # one row in NEIGHBOURS * _WIDE documents
    tops = tops.select("wide", F.coalesce(F.lead("first").over(order), F.min("first").over(Window.partitionBy())).alias("after"))
    up = F.lead("bucket").over(Window.partitionBy("wide").orderBy("bucket"))
    target = ranges.withColumn("up", up).join(tops, "wide").select("bucket", F.coalesce("up", "after").alias("up"))

    down = Window.partitionBy("bucket").orderBy(F.desc("doc_id"), F.desc("text"))
    inside = placed.select(
        "bucket", "doc_id", "text",
        F.row_number().over(down).alias("place"),
        F.lead("doc_id").over(down).alias("next_id"),
        F.lead("text").over(down).alias("next_text"),
    )
    heads = inside.filter("place = 1").select("bucket", F.col("doc_id").alias("head_id"), F.col("text").alias("head_text"))
    heads = heads.join(target, "bucket").select(F.col("up").alias("bucket"), "head_id", "head_text")
    last = F.col("next_id").isNull()
    out = inside.join(heads, "bucket", "left").select(
        "doc_id",
        "text",
        F.when(last, F.col("head_id")).otherwise(F.col("next_id")).alias("next_id"),
        F.when(last, F.col("head_text")).otherwise(F.col("next_text")).alias("next_text"),
    )
    alone = docs.filter(F.col("doc_id").isNull()).select(
        "doc_id", "text", F.col("doc_id").alias("next_id"), F.col("text").alias("next_text")
    )
    return out.union(alone)


def compared(docs: DataFrame, most: int = MAX_LEXICON) -> DataFrame:
    """Fingerprints of each row of docs (doc_id, text), of its edited text, and how alike they and the next document's are.

    The edited text has the last half of the code points replaced by the first as many of the next document (by
    descending doc_id). Built-in functions throughout: document frequencies are counted map-side first, the `most`
    frequent terms of the lexicon are broadcast and only places of others are shuffled, texts are shuffled once (to meet
    their neighbours), and after that only digests are.

    A null text is an empty one. Texts without terms of the lexicon (empty ones too) have the hash of the whole text as
    their fingerprint, and are alike (1) where they are equal and not (0) otherwise. Other columns are not read; an empty table gives
    an empty result.
    """
    source = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    terms_of = lexicon(source, most)
    edited = F.expr("concat(substring(text, 1, n_chars - half), substring(next_text, 1, half))")
    facts = ["row", "doc_id", "version", "next_id", "next_version", "edited_version", "n_chars", "edited_sha256"]
    both = (
        with_next(source)
        .withColumn("n_chars", F.char_length("text"))
        .withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
        .select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "next_id", "n_chars", edited.alias("edited"),
            F.xxhash64("text").alias("version"), F.xxhash64("next_text").alias("next_version"),
        )
        .withColumns({"edited_sha256": F.sha2("edited", 256), "edited_version": F.xxhash64("edited")})
        .withColumnRenamed("edited", "text")
    )
    changed = digests(both, terms_of, facts, ["doc_id", "edited_version"])
    plain = digests(source.withColumn("version", F.xxhash64("text")), terms_of, ["doc_id", "version"], ["doc_id", "version"])
    own = plain.select(F.col("doc_id").alias("own_id"), F.col("version").alias("own_version"), F.col("digests").alias("own"))
    following = plain.select(F.col("doc_id").alias("f_id"), F.col("version").alias("f_version"), F.col("digests").alias("next"))
    return (
        changed.join(own, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("version") == F.col("own_version")))
        .join(following, F.col("next_id").eqNullSafe(F.col("f_id")) & (F.col("next_version") == F.col("f_version")))
        .select(
            "doc_id",
            F.col("n_chars").cast("long").alias("n_chars"),
            "edited_sha256",
            shown(F.col("own"), F.col("version")).alias("fingerprint"),
            shown(F.col("digests"), F.col("edited_version")).alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("digests"), F.col("version") == F.col("edited_version")).alias("near_edited"),
            likeness(F.col("own"), F.col("next"), F.col("version") == F.col("next_version")).alias("near_next"),
        )
    )
