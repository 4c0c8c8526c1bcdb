"""Near-duplicate documents by banded MinHash and odd sketches."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_batches, ship_package, stored, text_or_empty
from .graph import components

#: Bands of so many samples each. A pair at similarity 0.8 shares no band with a probability of (1 - 0.8^5)^32 = 3e-6.
BANDS, ROWS = 32, 5
#: Bits of an odd sketch.
SKETCH_BITS = 512
#: Candidates whose sketches put their similarity lower than the threshold by this much are not compared in full. At
#: similarity 0.8 the sketch of 160 samples has a standard error of 0.035: it errs so far about once in 10^5 pairs.
#: Leaders of its buckets that a document is compared with at most in each round, before what is still apart is compared in
#: full. The first round joins most of a large group by one comparison a document.
PARTNERS = (1, 4, 4)
#: Lists of ids up to this length are sent to all tasks; longer ones are joined by a shuffle.
FEW_IDS = 200_000
SKETCH_MARGIN = 0.16
#: Members of larger buckets that the rounds leave apart are compared in blocks instead of pair by pair.
LARGE = 32
#: Documents and shingles of one block, about.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 500_000
_PART = 2048


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of `words` words; of all words where there are fewer."""
    parts = text.encode().lower().split()  # bytes: lower-cases A-Z and splits at ASCII white space alone
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, n)
    size = min(words, n)
    mixed = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ one[k : n - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


class Signer:
    """MinHash samples of a set, as band hashes and as an odd sketch."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 1):
        k = bands * rows
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factor = rng.integers(1, 2**63, k, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 2**63, k, np.uint64)
        self.toggle = rng.integers(1, 2**63, k, np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = rng.integers(1, 2**63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)

    def samples(self, values: np.ndarray) -> np.ndarray:
        low = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(values), _PART):
            part = self.factor[:, None] * values[None, k : k + _PART] + self.shift[:, None]
            np.minimum(low, part.min(axis=1), out=low)
        return low

    def bands_of(self, samples: np.ndarray) -> list[int]:
        mixed = samples.reshape(self.bands, self.rows)
        mixed = ((mixed ^ (mixed >> np.uint64(31))) * self.band).sum(axis=1, dtype=np.uint64)
        return ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64).tolist()

    def sketch_of(self, samples: np.ndarray) -> list[int]:
        """Parity bitmap: each sample, with its number, flips one bit."""
        spots = ((samples ^ (samples >> np.uint64(32))) * self.toggle) >> np.uint64(64 - int(math.log2(SKETCH_BITS)))
        bits = np.bincount(spots.astype(np.int64), minlength=SKETCH_BITS) & 1
        return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def similarity_estimate(differing: Column, samples: int = BANDS * ROWS) -> Column:
    """Similarity of two sets from the number of differing bits of their odd sketches.

    Each of d differing samples flips two bits, so the expected share of odd bits is (1 - exp(-4 d / bits)) / 2.
    """
    share = F.least(differing / F.lit(float(SKETCH_BITS)), F.lit(0.4999))
    return 1 + F.log(1 - 2 * share) * (SKETCH_BITS / 4 / samples)


def _differing(a: Column, b: Column) -> Column:
    return sum(
        (F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k))) for k in range(1, SKETCH_BITS // 64)),
        F.bit_count(F.get(a, 0).bitwiseXOR(F.get(b, 0))),
    )


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, key (digest of the whole set, null for an empty one), bands, sketch of each row."""

    def run(batches):
        signer = Signer()
        for batch in batches:
            out = {"doc_id": batch["doc_id"], "n": [], "key": [], "bands": [], "sketch": []}
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                values = shingles(text, words)
                key = None
                if len(values) and doc_id is not None:
                    key = _digest(values)
                samples = signer.samples(values) if key else None
                out["n"].append(len(values))
                out["key"].append(key)
                out["bands"].append(signer.bands_of(samples) if key else None)
                out["sketch"].append(signer.sketch_of(samples) if key else None)
            yield out

    return map_batches(docs, run, "doc_id long, n long, key binary, bands array<long>, sketch array<long>")


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """id, key, set of each row of docs (id, text)."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t, words) for t in batch["text"]]
            yield {"id": batch["id"], "key": [_digest(s) for s in sets], "set": [s.view(np.int64) for s in sets]}

    return map_batches(docs.select("id", "text"), run, "id long, key binary, set array<long>")


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ids (id)."""
    few = ids.limit(FEW_IDS + 1).count() <= FEW_IDS
    return rows.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    wanted = stored(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    sets = _only(sets, wanted).drop("key")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b"
    )
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("a", "b").distinct()


def _links(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) between the documents of two blocks, one for every two components that they join."""
    out = {}
    if len(left) and len(right):
        root, n = left["root"].to_numpy(), left["n"].to_numpy()
        sketch = np.stack(left["sketch"].to_list()).view(np.uint64)
        owner = np.repeat(np.arange(len(left)), n)
        values = np.concatenate(left["set"].to_list())
        order = np.argsort(values)
        values, owner = values[order], owner[order]
        for r in right.itertuples():
            share = np.bitwise_count(sketch ^ r.sketch.view(np.uint64)).sum(axis=1) / SKETCH_BITS
            estimate = 1 + np.log(1 - 2 * np.minimum(share, 0.4999)) * (SKETCH_BITS / 4 / (BANDS * ROWS))
            likely = (root != r.root) & (estimate >= percent / 100 - SKETCH_MARGIN)
            likely &= np.minimum(n, r.n) * 100 >= np.maximum(n, r.n) * percent
            if not likely.any():
                continue
            first = np.searchsorted(values, r.set, "left")
            many = np.searchsorted(values, r.set, "right") - first
            spots = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
            common = np.bincount(owner[spots], minlength=len(left))
            for k in np.flatnonzero(likely & (common * 100 >= (n + r.n - common) * percent)):
                out.setdefault((root[k], r.root), (left["rep"].iat[k], r.rep))
    return pd.DataFrame(list(out.values()), columns=["a", "b"], dtype=np.int64)


def _names(side: DataFrame, full: DataFrame) -> list[str]:
    """Columns of their join on rep."""
    return ["rep", *[c for c in side.columns + full.columns if c != "rep"]]


def _blocks(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """rows (rep, n, others) with the number of a block among the rows of the same `by`, dealt evenly by hash."""
    wanted = F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)
    sizes = rows.groupBy(*by).agg(F.ceil(wanted).alias("wanted"))
    return rows.join(sizes, by).withColumn(name, F.pmod(F.xxhash64("rep"), "wanted")).drop("wanted")


def _in_blocks(placed: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) in the buckets of `placed` (bucket, rep, root, main) between members outside the bucket's main
    component and all the rest; `full` has n, sketch and set of each rep.

    Members outside are dealt into blocks by their main component, and all that share a bucket with a block are dealt
    into blocks against it. One task compares one block with one block.
    """
    ship_package(placed.sparkSession)
    sizes = full.groupBy("rep").agg(F.max("n").alias("n"))
    left = placed.filter("root <> main").groupBy("rep").agg(F.min("root").alias("root"), F.min("main").alias("of"))
    left = stored(_blocks(left.join(sizes, "rep"), ["of"], "block").drop("n"))
    of_bucket = placed.join(left.select("rep", "of", "block"), "rep").select("bucket", "of", "block").distinct()
    right = placed.join(of_bucket, "bucket").select("of", "block", "rep", "root").distinct()
    right = stored(_blocks(right.join(sizes, "rep"), ["of", "block"], "against").drop("n"))
    left = left.join(right.select("of", "block", "against").distinct(), ["of", "block"])
    keys = ["of", "block", "against"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _links(a, b, percent)

    columns = [*keys, "rep", "root", "n", "sketch", "set"]
    here, there = (side.join(full.toDF(*full.columns), "rep").toDF(*_names(side, full)).select(*columns) for side in (left, right))
    return here.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    Two documents are linked where `percent` or more of the shingles of either stand in both. Rows with equal sets are
    one class, represented by the smallest doc_id; the work below is on representatives alone:
    1. Each band of MinHash samples is a bucket. In each round a bucket whose members are in several components has a
       leader, drawn by hash, and every member of another component than its leader's is a candidate with it, with
       PARTNERS leaders at most. The XOR of two odd sketches gives a precise similarity, and what is near or over the
       threshold is confirmed on full sets. Connected components of the links follow. A round makes PARTNERS candidates
       a document at most, however large a bucket.
    2. Whatever is then in one bucket but not in one component is compared without a cap: members outside the bucket's
       largest component with all the rest, by sketches first. A bucket whose members are connected by then, such as one
       of thousands of near copies, gives no pair. Buckets of more than LARGE members are compared block by block, where
       only links leave a task; a document's set is sent once a block that it is compared with, not once a pair.
    Components of all links are the result; no candidate is left out, only those that can't change it.

    Texts without words (null and empty ones too) have an empty set and are linked with nothing. A row without doc_id is
    linked with nothing, has no component_id and is kept. Rows that share a doc_id are one document with several texts:
    it has the links of all of them, and its rows have one component_id. Other columns of `docs` are not read; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    signed = stored(signatures(texts, words))
    classes = stored(signed.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("rep")))
    # a class of equal sets has its smallest doc_id for a node; a node stands for as many sets as it is the smallest of
    nodes = stored(
        signed.join(classes, "key")
        .filter(F.col("doc_id") == F.col("rep"))
        .select("rep", "key", "n", "bands", "sketch")
        .dropDuplicates(["rep", "key"])
    )
    # the classes of one document's texts belong together
    of_doc = signed.select("doc_id", "key").filter(F.col("key").isNotNull()).join(classes, "key")
    ties = of_doc.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).filter("a <> last").select("doc_id", "a")
    ties = stored(of_doc.join(ties, "doc_id").filter("a <> rep").select("a", F.col("rep").alias("b")).distinct())
    sketches = nodes.select("rep", "n", "sketch")
    held = nodes.select("rep", F.posexplode("bands").alias("band", "bucket"))
    crowded = held.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").select("bucket")
    held = stored(held.join(crowded, "bucket", "left_semi"))
    # full sets of the documents that share a bucket with another, made once
    members = stored(held.select(F.col("rep").alias("id")).distinct())
    sources = texts.filter(F.col("text") != "").withColumnRenamed("doc_id", "id")
    sets = stored(_sets(_only(sources, members), words).dropDuplicates(["id", "key"]))
    discard(members)

    def confirmed(pairs: DataFrame) -> DataFrame:
        likely = (
            pairs.join(sketches.toDF("a", "n_a", "sketch_a"), "a")
            .join(sketches.toDF("b", "n_b", "sketch_b"), "b")
            .filter(_likely(percent))
            .select("a", "b")
            .distinct()
        )
        return _confirmed(stored(likely), sets, percent)

    roots = None
    for k, partners in enumerate(PARTNERS):
        # the first draw is the same in all buckets, so that few leaders serve a large group
        draw = F.xxhash64("rep", F.lit(k)) if k == 0 else F.xxhash64("rep", "bucket", F.lit(k))
        placed = _placed(held, roots)
        leaders = (
            placed.groupBy("bucket")
            .agg(F.min(F.struct(draw.alias("draw"), "rep", "root")).alias("l"), F.min("root").alias("x"), F.max("root").alias("y"))
            .filter("x <> y")
            .select("bucket", "l.draw", F.col("l.rep").alias("leader"), F.col("l.root").alias("leader_root"))
        )
        offers = placed.join(leaders, "bucket").filter("root <> leader_root").groupBy("rep", "leader").agg(F.min("draw").alias("draw"))
        best = Window.partitionBy("rep").orderBy("draw", "leader")
        pairs = (
            offers.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= partners)
            .select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
        )
        found = confirmed(pairs)
        known = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")) if k else ties
        roots = components(known.union(found))

    placed = _placed(held, roots)
    parts = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mixed = (
        parts.groupBy("bucket")
        .agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("size"))
        .filter("parts > 1").select("bucket", F.col("top.root").alias("main"), "size")
    )
    left_over = stored(placed.join(mixed, "bucket"))
    rest = left_over.filter(F.col("size") <= LARGE).join(nodes.select("rep", "n", "sketch", "bands"), "rep")
    left = rest.filter("root <> main").select(
        "bucket", "band", F.col("rep").alias("l"), F.col("root").alias("l_root"),
        F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"), F.col("bands").alias("bands_a"),
    )
    right = rest.select(
        "bucket", F.col("rep").alias("r"), F.col("root").alias("r_root"), "main",
        F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"), F.col("bands").alias("bands_b"),
    )
    apart = (F.col("l_root") != F.col("r_root")) & ((F.col("r_root") == F.col("main")) | (F.col("l") < F.col("r")))
    # a pair comes from the first of the bands it shares
    earlier = F.exists(
        F.arrays_zip(F.slice("bands_a", 1, F.col("band")).alias("x"), F.slice("bands_b", 1, F.col("band")).alias("y")),
        lambda p: p.x == p.y,
    )
    second = stored(
        left.join(right, (left.bucket == right.bucket) & apart & _likely(percent) & ~earlier)
        .select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"))
        .distinct()
    )
    full = sets.withColumnRenamed("id", "rep").join(nodes.select("rep", "key", "n", "sketch"), ["rep", "key"]).drop("key")
    found = stored(
        _confirmed(second, sets, percent).union(_in_blocks(left_over.filter(F.col("size") > LARGE), full, percent))
    )
    if not found.isEmpty():
        known = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(known.union(found))
    grouped = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", F.coalesce("root", "rep").alias("component")
    )
    return (
        signed.select("doc_id", "n", "key")
        .join(grouped, "key", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs (doc_id, text, others), all columns, without the documents that near_duplicates() doesn't keep."""
    dropped = near_duplicates(docs, words, percent).filter("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def _placed(held: DataFrame, roots: DataFrame | None) -> DataFrame:
    """held with the component (root) of each representative."""
    if roots is None:
        return held.withColumn("root", F.col("rep"))
    placed = held.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    return placed.withColumn("root", F.coalesce("root", "rep"))


def _likely(percent: int) -> Column:
    """Set sizes allow the similarity, and the sketches put it near or over the threshold."""
    low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    estimate = similarity_estimate(_differing(F.col("sketch_a"), F.col("sketch_b")))
    return (low * 100 >= high * percent) & (estimate >= percent / 100 - SKETCH_MARGIN)


NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM words UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other),
least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM words w JOIN least_of c ON c.doc_id = w.doc_id LEFT JOIN sizes s ON s.doc_id = w.doc_id
"""
