"""Product codes of vectors: k-means over parts with integer codebooks, skipping what norm-of-sum bounds rule out."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, ship_package, stored

#: Scaled components beyond this, either way, count as this: sums and distances stay exact far below it.
LIMIT = 1 << 31
#: Entries that share one lower bound.
GROUP = 32
#: Labels up to this number are sent to all tasks with their errors; more are joined by a shuffle.
FEW_LABELS = 100_000
_LONGEST = (1 << 63) - 1


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all entries: float64 where that holds them, else Python integers."""
    reach = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * reach * reach * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    return np.stack([((x.astype(object) - e.astype(object)) ** 2).sum(1) for e in entries], 1)


def _own(x: np.ndarray, entries: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to the entry of its code; infinite where it has none yet (-1)."""
    if not (code >= 0).any():
        return np.full(len(x), np.inf)
    gap = x - entries[code]
    if int(np.abs(gap).max(initial=0)) ** 2 * x.shape[1] < 1 << 53:
        return (gap.astype(np.float64) ** 2).sum(1)
    return (gap.astype(object) ** 2).sum(1)


def _root_down(squares: np.ndarray) -> np.ndarray:
    """Square roots as float32, never above the true ones."""
    roots = np.sqrt(squares.astype(np.float64)) * (1 - 1e-12)
    out = roots.astype(np.float32)
    return np.where(out > roots, np.nextafter(out, np.float32(-np.inf)), out)


def reassign(x: np.ndarray, books: list[np.ndarray], code: np.ndarray, low: np.ndarray, stamp: np.ndarray):
    """Nearest entry of the last of `books` for each row of x, as (code, low, stamp, squared distance, rows scanned).

    `books` is the codebook of this part in every round so far. `low` holds, for each row and group of entries, a lower
    bound of the distance to the nearest entry of the group other than the row's own, true for the codebook of round
    `stamp`. No entry has since come nearer than by the norm of the sum of its moves, that is, the distance between the
    entry then and now; the sum of the norms, which bounds carried from round to round would use up, is never less. The
    distance to the row's own entry is worked out exactly. Only groups whose bound does not exceed it are scanned, and
    only those get a new bound and stamp. Ties take the lower index.
    """
    now, t = books[-1], len(books) - 1
    starts = np.arange(0, len(now), GROUP)
    group_of = np.arange(len(now)) // GROUP
    moved = np.stack(
        [np.maximum.reduceat(np.sqrt(((now - b).astype(np.float64) ** 2).sum(1)), starts) for b in books]
    ) * (1 + 1e-12)
    own = _own(x, now, code)
    bound = low - moved[stamp, np.arange(len(starts))]
    scan = bound <= (np.sqrt(own.astype(np.float64)) * (1 + 1e-12))[:, None]
    best, at = own.copy(), code.copy()
    first, second = np.full(low.shape, np.inf, own.dtype), np.full(low.shape, np.inf, own.dtype)
    for g, a in enumerate(starts):
        rows = np.flatnonzero(scan[:, g])
        if not len(rows):
            continue
        far = squared(x[rows], now[a : a + GROUP])
        if far.dtype != best.dtype:  # some rows need the longer integers: all comparisons are exact either way
            best, first, second = best.astype(object), first.astype(object), second.astype(object)
            far = far.astype(object)
        mine = np.flatnonzero(group_of[code[rows]] == g) if t or (code >= 0).any() else np.empty(0, np.int64)
        mine = mine[code[rows[mine]] >= 0]
        far[mine, code[rows[mine]] - a] = np.inf
        nearest = far.argmin(1)
        line = np.arange(len(rows))
        first[rows, g] = far[line, nearest]
        far[line, nearest] = np.inf
        second[rows, g] = far.min(1)
        least, spot = first[rows, g], a + nearest
        better = (least < best[rows]) | ((least == best[rows]) & (spot < at[rows]))
        best[rows[better]], at[rows[better]] = least[better], spot[better]
    line = np.arange(len(x))
    changed = at != code
    into = line[changed]
    first[into, group_of[at[into]]] = second[into, group_of[at[into]]]
    left = line[changed & (code >= 0)]  # the entry left behind now counts for the bound of its group
    old = group_of[code[left]]
    low_out, stamp_out = np.where(scan, _root_down(first), low), np.where(scan, t, stamp)
    low_out[left, old] = np.minimum(np.where(scan[left, old], low_out[left, old], _root_down(np.maximum(bound[left, old], 0) ** 2)), _root_down(own[left]))
    stamp_out[left, old] = t
    return at, low_out.astype(np.float32), stamp_out.astype(np.int8), best, int(scan.sum())


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _arrow_lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = rows.shape
    offsets = pa.array(np.arange(0, n * width + 1, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).reshape(-1), kind))


def _edges(width: int, parts: int) -> list[int]:
    return [p * width // parts for p in range(parts + 1)]


def _assigned(state: DataFrame, history: list[list[np.ndarray]], edges: list[int]) -> DataFrame:
    """state with the codes for the last codebook of each part, their bounds, and the squared distances summed."""
    spark, width, parts = state.sparkSession, edges[-1], len(edges) - 1
    groups = -(-len(history[0][0]) // GROUP)
    known = spark.sparkContext.broadcast(history)
    ship_package(spark)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = _lists(batch.column("x"), width).astype(np.int64)
            code = _lists(batch.column("code"), parts).astype(np.int64)
            low = _lists(batch.column("low"), parts * groups).astype(np.float32).reshape(n, parts, groups).copy()
            stamp = _lists(batch.column("stamp"), parts * groups).reshape(n, parts, groups).copy()
            code, error = code.copy(), np.zeros(n, object)
            for p in range(parts):
                books = [book[p] for book in known.value]
                code[:, p], low[:, p], stamp[:, p], far, _ = reassign(
                    x[:, edges[p] : edges[p + 1]], books, code[:, p], low[:, p], stamp[:, p]
                )
                error += np.array([int(v) for v in far], object)
            out = {
                "x": batch.column("x"),
                "code": _arrow_lists(code, pa.int16()),
                "low": _arrow_lists(low.reshape(n, -1), pa.float32()),
                "stamp": _arrow_lists(stamp.reshape(n, -1), pa.int8()),
                "error": pa.array([min(v, _LONGEST) for v in error], pa.int64()),
            }
            yield pa.RecordBatch.from_arrays([out.get(c, batch.column(c)) for c in names], names=names)

    names = state.columns
    return state.mapInArrow(run, state.schema)


def _means(state: DataFrame, book: list[np.ndarray], edges: list[int]) -> list[np.ndarray]:
    """The next codebook: floored means of the parts at each entry; an entry without parts stays."""
    parts, k = len(edges) - 1, len(book[0])
    ship_package(state.sparkSession)

    def run(batches):
        count, total = np.zeros((parts, k), np.int64), np.zeros((k, edges[-1]), np.int64)
        for batch in batches:
            x, code = _lists(batch.column("x"), edges[-1]).astype(np.int64), _lists(batch.column("code"), parts)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                entry, first = np.unique(code[order, p], return_index=True)
                count[p, entry] += np.diff(np.append(first, len(order)))
                a, b = edges[p], edges[p + 1]
                total[entry, a:b] += np.add.reduceat(x[order, a:b], first, axis=0) if len(order) else 0
        for p in range(parts):
            entry = np.flatnonzero(count[p])
            rows = total[entry, edges[p] : edges[p + 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(entry), p, np.int32)),
                    pa.array(entry.astype(np.int32)),
                    pa.array(count[p, entry]),
                    _arrow_lists(rows, pa.int64()),
                ],
                names=["part", "entry", "n", "total"],
            )

    partial = state.select("x", "code").mapInArrow(run, "part int, entry int, n long, total array<long>")
    exact = F.sum(F.col("v").cast("decimal(38,0)"))  # tasks' sums in longs, their total beyond
    sums = (
        partial.select("part", "entry", "n", F.posexplode_outer("total").alias("pos", "v"))
        .groupBy("part", "entry", "pos")
        .agg(F.sum("n").alias("n"), exact.alias("v"))
        .filter("pos IS NOT NULL")
    )
    new = [b.copy() for b in book]
    for r in sums.collect():  # as many rows as a codebook has components
        new[r.part][r.entry, r.pos] = int(r.v) // r.n
    return new


def compress(
    vectors: DataFrame,
    column: str = "embedding",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    keep: tuple[str, ...] = ("label",),
) -> tuple[DataFrame, list[np.ndarray]]:
    """Product codes of vectors (vec_id, `column`, the columns `keep`): (rows, last codebooks of all parts).

    Rows are vec_id, the columns `keep`, code (entry of each part) and error (squared distances summed). Components
    become floor(scale * x), vectors are cut into `parts` consecutive parts, and each part is clustered on its own:
    its entries start as that part of the `entries` smallest vec_ids; each round assigns all parts and replaces each
    entry by the floored mean of its parts. All distances that decide are exact integers.

    A pass over the stored rows assigns them by `reassign`, with the codebooks of all rounds and each row's bounds and
    stamps; a second one adds up the entries' parts within each task, so that an entry that takes in most rows is no hot
    key. The rows are written to the shared folder once a round, and those of the round before are then deleted. The
    driver holds the codebooks only, whose size the parameters fix.

    Dropped are rows whose vector is null, empty, holds a null or a component that is not finite, or has another length
    than that of the smallest vec_id. Vectors are cut as evenly as their length allows. Rows without vec_id or sharing
    one are coded each on its own; a vec_id that starts an entry does so once, with the smallest of its vectors. Fewer
    ids than `entries` give as many entries. Scaled components beyond LIMIT count as LIMIT, errors beyond a long as the
    largest long. An empty table gives no rows and empty codebooks. Other columns are not read.
    """
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    top = float(LIMIT)
    broken = F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform("v", lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(top)), F.lit(-top))))
    rows = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *kept, F.col(column).cast("array<double>").alias("v"))
        .filter((F.size("v") > 0) & ~broken)
        .withColumn("x", whole)
        .drop("v")
    )
    lead = rows.agg(F.min(F.struct(F.isnull("vec_id"), "vec_id", F.size("x").alias("width")))).first()[0]
    names = ["vec_id", *keep, "code", "error"]
    if lead is None:
        empty = rows.select("vec_id", *kept_names(keep), F.lit(None).cast("array<int>").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.toDF(*names).limit(0), []
    edges = _edges(lead.width, parts)
    rows = rows.filter(F.size("x") == lead.width)
    ids = [r.vec_id for r in rows.filter("vec_id IS NOT NULL").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    seeds = rows.filter(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").collect()
    if not seeds:  # no row has an id
        seeds = rows.select("x").distinct().orderBy("x").limit(1).collect()
    start = np.array([r.x for r in seeds], np.int64)
    history = [[start[:, a:b] for a, b in zip(edges, edges[1:], strict=False)]]
    bounds = parts * -(-len(start) // GROUP)
    state = rows.select(
        "vec_id", *kept_names(keep), "x",
        F.array_repeat(F.lit(-1).cast("short"), parts).alias("code"),
        F.array_repeat(F.lit(float("-inf")).cast("float"), bounds).alias("low"),
        F.array_repeat(F.lit(0).cast("byte"), bounds).alias("stamp"),
        F.lit(0).cast("long").alias("error"),
    )
    before = None
    for _ in range(rounds):
        state = stored(_assigned(state, history, edges))
        discard(before)
        before = state
        history.append(_means(state, history[-1], edges))
    last = stored(_assigned(state, history, edges).select("vec_id", *kept_names(keep), "code", "error"))
    discard(before)
    return last.toDF(*names), history[-1]


def kept_names(keep: tuple[str, ...]) -> list[str]:
    """Inner names of the columns that are carried along, which can't clash with those used here."""
    return [f"k{i}" for i in range(len(keep))]


def code_digests(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each vector that compress() codes.

    code has two hexadecimal digits a part; label_error is the error of all vectors of the label, null being one, and
    the largest long where it is beyond that.
    """
    rows, books = compress(vectors)
    # a list of labels as short as this one can be sent to all tasks; a longer one is joined by a shuffle
    sums = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    few = sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    sums = sums.select(
        F.col("label").alias("of"), F.least("total", F.lit(_LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error")
    )
    digits = F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    joined = rows.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(
        "vec_id", F.array_join(digits, "").alias("code"), "error", "label_error",
        F.lit(books_sha256(books)).alias("codebooks_sha256"),
    )


def books_sha256(books: list[np.ndarray]) -> str:
    """Digest of all components as decimal numbers, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for book in books for v in book.reshape(-1)).encode()).hexdigest()


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """SQL for code_digests() over vectors of one length whose ids are not repeated, each round spelled out."""
    nearest = """
assigned{r} AS MATERIALIZED (
  SELECT vec_id, part, min(struct_pack(far := far, entry := entry)) AS best FROM (
    SELECT p.vec_id, p.part, b.entry, p.xx - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x) AS far
    FROM pieces p JOIN book{r} b ON p.part = b.part) GROUP BY vec_id, part),"""
    mean = """
book{n} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN (
    SELECT part, entry, list(floor(total / n) ORDER BY pos) AS x FROM (
      SELECT part, entry, pos, sum(v) AS total, count(*) AS n FROM (
        SELECT a.part, a.best.entry AS entry, unnest(range(1, len(p.x) + 1)) AS pos, unnest(p.x) AS v
        FROM assigned{r} a JOIN pieces p ON p.vec_id = a.vec_id AND p.part = a.part) GROUP BY part, entry, pos)
    GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry),"""
    steps = "".join(nearest.format(r=r) + mean.format(r=r, n=r + 1) for r in range(rounds)) + nearest.format(r=rounds)
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: floor(CAST(v AS DOUBLE) * {scale})) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
pieces AS MATERIALIZED (
  SELECT vec_id, part, x, list_inner_product(x, x) AS xx FROM (
    SELECT vec_id, part, x[part * len(x) // {parts} + 1:(part + 1) * len(x) // {parts}] AS x
    FROM kept, (SELECT unnest(range({parts})) AS part))),
book0 AS MATERIALIZED (
  SELECT part, entry, x FROM (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}) JOIN pieces USING (vec_id)),
{steps}
coded AS (
  SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.far) AS BIGINT) AS error
  FROM assigned{rounds} GROUP BY vec_id),
digest AS (
  SELECT sha256(string_agg(array_to_string(list_transform(x, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS d
  FROM book{rounds})
SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, d AS codebooks_sha256
FROM coded c JOIN kept k USING (vec_id), digest
"""


CODES_SQL = codes_sql()
