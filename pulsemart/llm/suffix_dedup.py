"""Byte strings that stand in an earlier document as well, found by sorting suffixes bucket by bucket."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import discard, ship_package, stored, text_or_empty

#: Of any two positions, the same shift below PERIOD takes both to a position whose remainder is in COVER.
PERIOD, COVER = 16, (0, 1, 2, 5, 8)
#: Bytes of text that a task works on at once when it looks for anchors.
BLOCK = 1 << 20
#: Anchors that a task gathers before it hands them on.
HELD = 2_000_000
#: Bytes of a bucket that is sorted at once, about; an anchor of more is dealt out window by window.
BUCKET = 1 << 20
#: Rows up to this number are sent to all tasks; more are joined by a shuffle.
FEW = 200_000

_SHIFT = np.array(
    [
        [next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)]
        for a in range(PERIOD)
    ]
)


# -- sorting one bucket --------------------------------------------------------------------------------------


def _words(data: bytes) -> np.ndarray:
    """The eight bytes at every position as a number that sorts as they do; data must have eight bytes more than used."""
    return np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))


def _ranks(key: np.ndarray) -> np.ndarray:
    """Rank of each value, equal for equal ones, from 1."""
    return np.unique(key, return_inverse=True)[1].astype(np.int64) + 1


def _prefix_ranks(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rank of the 16 bytes at each position."""
    return _ranks(_ranks(words[at].astype(np.uint64)) << 32 | _ranks(words[at + 8].astype(np.uint64)))


def cover_ranks(words: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Rank of the `depth` bytes or more at each cover position (remainder in COVER) of n bytes, equal bytes having equal
    ranks; 0 elsewhere. Ranks of 16 bytes come from sorting them, ranks of twice the bytes from pairs of ranks."""
    at = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).reshape(-1)
    at = at[at < n]
    rank = _prefix_ranks(words, at)
    known, step = PERIOD, len(COVER)
    while known < depth and len(at) and rank.max() < len(at):
        after = np.concatenate([rank[step:], np.zeros(min(step, len(rank)), np.int64)])
        rank = _ranks(rank << 32 | after)
        known, step = 2 * known, 2 * step
    out = np.zeros(n + 2 * PERIOD, np.int64)
    out[at] = rank
    return out


def window_classes(data: bytes, at: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the windows data[at:at + length] sorted, and whether each is another than the one before it.

    Windows whose first 16 bytes only one owner has are left out. The others are ties: within one remainder they are
    sorted by the rank of one cover position behind them, and the sorted remainders are merged two by two, each
    comparison by the ranks at the shift that takes both windows to the cover.
    """
    words = _words(data + bytes(4 * PERIOD + length + 8))
    group = _prefix_ranks(words, at)
    order = np.argsort(group)
    starts = np.flatnonzero(np.diff(group[order], prepend=0))
    several = np.minimum.reduceat(owner[order], starts) != np.maximum.reduceat(owner[order], starts) if len(at) else starts
    tied = np.flatnonzero(several[group - 1]) if len(at) else order
    if not len(tied):
        return tied, np.empty(0, bool)
    rank = cover_ranks(words, len(data), length)
    at, group, rest = at[tied], group[tied], at[tied] % PERIOD

    def merged(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(group[y], group[x], "left"), np.searchsorted(group[y], group[x], "right")
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            here, there = x[open_], y[middle]
            shift = _SHIFT[rest[here], rest[there]]
            less = rank[at[there] + shift] < rank[at[here] + shift]
            low[open_[less]], high[open_[~less]] = middle[less] + 1, middle[~less]
            open_ = open_[low[open_] < high[open_]]
        out = np.empty(len(x) + len(y), np.int64)
        # windows equal in all that counts may differ behind it, for one shift and not for another: any order will do
        places = np.maximum.accumulate(low) + np.arange(len(x))
        free = np.ones(len(out), bool)
        free[places] = False
        out[places], out[free] = x, y
        return out

    near = rank[at + _SHIFT[rest, rest]]
    order = np.argsort(group << 32 | near)
    order = order[np.argsort(rest[order].astype(np.int8), kind="stable")]  # radix: sixteen values
    lists = np.split(order, np.searchsorted(rest[order], np.arange(1, PERIOD)))
    while len(lists) > 1:
        lists = [merged(a, b) for a, b in zip(lists[::2], lists[1::2], strict=True)]
    order = lists[0]
    spots = at[order]
    same = group[order][1:] == group[order][:-1]
    for k in {*range(PERIOD, length - 7, 8), length - 8}:
        here = words[spots + k]
        same &= here[1:] == here[:-1]
    return tied[order], np.concatenate([[True], ~same])


def later_windows(data: bytes, sizes: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, place) of the windows of `length` bytes that a run of a smaller doc holds as well, in order. Runs follow one
    another in data and are `sizes` bytes long."""
    many = sizes - length + 1
    run = np.repeat(np.arange(len(sizes)), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = place + np.repeat(np.cumsum(sizes) - sizes, many)
    order, new = window_classes(data, at, docs[run], length)
    if not len(order):
        return order, order
    owner = docs[run[order]]
    starts = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(owner, starts), np.diff(np.append(starts, len(order))))
    hit = np.sort(order[owner > least])
    return run[hit], place[hit]


def _intervals(run: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, end) of the bytes under consecutive windows."""
    if not len(run):
        return run, place, place
    cut = np.flatnonzero((run[1:] != run[:-1]) | (place[1:] != place[:-1] + 1)) + 1
    first, last = np.append(0, cut), np.append(cut, len(run)) - 1
    return run[first], place[first], place[last] + length


def _spread_out(many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place of `many` as often as it says, and the count within the place."""
    return np.repeat(np.arange(len(many)), many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _later_parts(runs: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, end) of the bytes of runs that stand in a run of a smaller doc as well. Equal runs are sorted as one,
    that of the smallest of their docs; the others then stand there whole."""
    number: dict[bytes, int] = {}
    of = np.fromiter((number.setdefault(r, len(number)) for r in runs), np.int64, len(runs))
    sizes = np.fromiter(map(len, number), np.int64, len(number))
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, of, docs)
    run, start, end = _intervals(*later_windows(b"".join(number), sizes, least, length), length)
    first = np.flatnonzero(docs == least[of])
    first = first[np.argsort(of[first], kind="stable")]
    begin = np.searchsorted(of[first], np.arange(len(number)))
    which, nth = _spread_out(np.diff(np.append(begin, len(first)))[run])
    others = np.flatnonzero(docs != least[of])
    return (
        np.concatenate([first[begin[run[which]] + nth], others]),
        np.concatenate([start[which], np.zeros(len(others), np.int64)]),
        np.concatenate([end[which], sizes[of[others]]]),
    )


# -- anchors -------------------------------------------------------------------------------------------------


def _least_hashes(data: bytes, length: int) -> np.ndarray:
    """For the window of `length` bytes at every position, the least hash of the strings (of 16 bytes, or 8 in short
    windows) in it: equal windows have the same."""
    gram = 16 if length >= 32 else 8
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    n = len(data) - gram + 1
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    if gram > 8:
        h ^= words[gram - 8 : gram - 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    width, wanted = 1, length - gram + 1
    while 2 * width <= wanted:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    if width < wanted:
        h = np.minimum(h[: width - wanted], h[wanted - width :])
    return h


def _pieces(texts: Iterable[bytes], length: int) -> Iterator[tuple[int, int, bytes]]:
    """(number of the text, offset, bytes): long texts in pieces that share length - 1 bytes, short ones not at all."""
    for k, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), BLOCK):
            yield k, at, text[at : at + BLOCK + length - 1]


def anchor_runs(texts: Iterable[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text, start, windows, anchor) of the runs of windows that share an anchor, for a block of text at a
    time."""

    def block(pieces):
        sizes = np.array([len(p) for _, _, p in pieces])
        many = sizes - length + 1
        total, before = many.sum(), np.cumsum(many) - many
        value = _least_hashes(b"".join(p for _, _, p in pieces), length)[
            np.arange(total) + np.repeat(np.cumsum(sizes) - sizes - before, many)
        ]
        new = np.concatenate([[True], value[1:] != value[:-1]])
        new[before] = True
        first = np.flatnonzero(new)
        piece = np.searchsorted(before, first, "right") - 1
        number, offset = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
        start = first - before[piece] + offset[piece]
        return number[piece], start, np.diff(np.append(first, total)), value[first].view(np.int64)

    held, size = [], 0
    for piece in _pieces(texts, length):
        held.append(piece)
        size += len(piece[2])
        if size >= BLOCK:
            yield block(held)
            held, size = [], 0
    if held:
        yield block(held)


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    """at, anchor, doc_id, shared: the anchors of each task's documents, one row a document.

    Of the documents of a task with the same anchor only the first has to hear of other tasks: its row is at the anchor's
    place, the others are known to share it and go wherever their hash sends them.
    """
    ship_package(texts.sparkSession)

    def flush(anchors, docs):
        anchor, doc = np.concatenate(anchors), np.concatenate(docs)
        order = np.lexsort((doc, anchor))
        anchor, doc = anchor[order], doc[order]
        fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
        anchor, doc = anchor[fresh], doc[fresh]
        first = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        shared = ~first
        shared[:-1] |= ~first[1:]
        mixed = (anchor ^ (doc * np.int64(0x1E3779B97F4A7C15))) * np.int64(0x3F58476D1CE4E5B9)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.where(first, anchor, mixed)), pa.array(anchor), pa.array(doc), pa.array(shared)],
            names=["at", "anchor", "doc_id", "shared"],
        )

    def run(batches):
        anchors, docs, held = [], [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for number, _, _, anchor in anchor_runs((t.as_buffer().to_pybytes() for t in batch.column("data")), length):
                anchors.append(anchor)
                docs.append(ids[number])
                held += len(anchor)
                if held >= HELD:
                    yield flush(anchors, docs)
                    anchors, docs, held = [], [], 0
        if held:
            yield flush(anchors, docs)

    return texts.select("doc_id", "data").mapInArrow(run, "at long, anchor long, doc_id long, shared boolean")


_INT = pa.int64()
_RUN = pa.schema(
    [("anchor", _INT), ("doc_id", _INT), ("version", _INT), ("spots", pa.list_(_INT)), ("data", pa.binary()), ("known", _INT)]
)
_SPAN = pa.schema([("doc_id", _INT), ("version", _INT), ("start", _INT), ("end", _INT)])
_KEPT = pa.schema(
    [
        ("doc_id", _INT), ("version", _INT), ("n_bytes", _INT),
        ("spans", pa.list_(pa.struct([("start", _INT), ("end", _INT)]))), ("kept", pa.binary()),
    ]
)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _marked_runs(texts: DataFrame, length: int) -> DataFrame:
    """The runs of windows of texts (doc_id, version, data, anchors) at the anchors listed, with their bytes."""
    ship_package(texts.sparkSession)

    def run(batches):
        for batch in batches:
            ids, versions = batch.column("doc_id").to_pylist(), batch.column("version").to_pylist()
            data = [t.as_buffer().to_pybytes() for t in batch.column("data")]
            wanted = [np.sort(a.values.to_numpy(zero_copy_only=False)) for a in batch.column("anchors")]
            out = []
            for number, start, many, anchor in anchor_runs(data, length):
                for part in np.split(np.arange(len(number)), np.flatnonzero(number[1:] != number[:-1]) + 1):
                    k = number[part[0]]
                    spot = np.searchsorted(wanted[k], anchor[part])
                    part = part[wanted[k][np.minimum(spot, len(wanted[k]) - 1)] == anchor[part]]
                    text = data[k]
                    for a, s, m in zip(anchor[part].tolist(), start[part].tolist(), many[part].tolist(), strict=True):
                        out.append((a, ids[k], versions[k], [s], text[s : s + m + length - 1], None))
                if len(out) > 20_000:
                    yield _rows(_RUN, out)
                    out = []
            yield _rows(_RUN, out)

    return texts.mapInArrow(run, from_arrow_schema(_RUN))


def _single_windows(runs: DataFrame, length: int) -> DataFrame:
    """Each run as single windows under their own hashes, each distinct window of a task once for its smallest document.

    The other documents' windows are known to stand in a smaller one: they come with `known`, the end of their bytes.
    """
    ship_package(runs.sparkSession)

    def flush(seen):
        out = []
        for window, (doc, places) in seen.items():
            key = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)
            out += [(key, doc, version, spots, window, None) for version, spots in places.items()]
        seen.clear()
        return _rows(_RUN, out)

    def run(batches):
        seen: dict[bytes, tuple[int, dict[int, list[int]]]] = {}
        for batch in batches:
            known = []
            for r in batch.to_pylist():
                for k in range(len(r["data"]) - length + 1):
                    window, doc, version = r["data"][k : k + length], r["doc_id"], r["version"]
                    spots = [s + k for s in r["spots"]]
                    old = seen.get(window)
                    if old is None or doc < old[0]:
                        if old is not None:
                            known += [(0, old[0], v, [s], None, s + length) for v, all_ in old[1].items() for s in all_]
                        seen[window] = (doc, {version: spots})
                    elif doc == old[0]:
                        old[1].setdefault(version, []).extend(spots)
                    else:
                        known += [(0, doc, version, [s], None, s + length) for s in spots]
                if len(known) > 20_000:
                    yield _rows(_RUN, known)
                    known = []
                if len(seen) * length > BUCKET:
                    yield flush(seen)
            yield _rows(_RUN, known)
        yield flush(seen)

    return runs.mapInArrow(run, from_arrow_schema(_RUN))


def _sorted_buckets(runs: DataFrame, length: int) -> DataFrame:
    """doc_id, version, start, end of the bytes of runs that stand in a smaller document as well. Runs of one anchor are
    one after the other; a bucket is as many anchors as make up BUCKET bytes, and only one is held at a time."""
    ship_package(runs.sparkSession)

    def found(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        doc, version = rows.column("doc_id").to_numpy(), rows.column("version").to_numpy()
        row, start, end = _later_parts(rows.column("data").to_pylist(), doc, length)
        spots = rows.column("spots").chunk(0)
        all_spots, edges = spots.values.to_numpy(), spots.offsets.to_numpy().astype(np.int64)
        which, nth = _spread_out(np.diff(edges)[row])
        row, spot = row[which], all_spots[edges[row[which]] + nth]
        columns = doc[row], version[row], spot + start[which], spot + end[which]
        return pa.RecordBatch.from_arrays([pa.array(c, _INT) for c in columns], schema=_SPAN)

    def run(batches):
        bucket, size, last = [], 0, None
        for batch in batches:
            anchor = batch.column("anchor").to_numpy()
            sizes = np.cumsum(np.diff(np.frombuffer(batch.column("data").buffers()[1], np.int32)[batch.column("data").offset :][: len(anchor) + 1]))
            new = np.flatnonzero(np.concatenate([[anchor[0] != last], anchor[1:] != anchor[:-1]])) if len(anchor) else []
            begin = 0
            for k in new:  # the first row of each anchor: a bucket may end before it
                held = int(sizes[k - 1]) if k else 0
                if size + held >= BUCKET:
                    bucket.append(batch.slice(begin, k - begin))
                    yield found(bucket)
                    bucket, size, begin = [], -held, k
            if len(anchor):
                bucket.append(batch.slice(begin))
                size, last = size + int(sizes[-1]), anchor[-1]
        if bucket:
            yield found(bucket)

    return runs.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, from_arrow_schema(_SPAN))


# -- documents -----------------------------------------------------------------------------------------------


def _sent(rows: DataFrame) -> DataFrame:
    """rows, broadcast where there are few."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def _texts(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("version", F.xxhash64("text"))


def repeated_spans(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, version, start, end: bytes of docs (doc_id, text) covered by strings of `length` bytes that start in a
    document with a smaller doc_id as well. Spans may overlap; version tells rows of one doc_id apart.

    1. Texts that stand under a smaller doc_id whole are covered whole, and take no part in what follows: what they hold,
       the smaller document holds.
    2. An anchor is the least hash of a window's short strings, so equal windows have equal anchors, and some 18 windows
       in a row share one. Anchors in one document only are dropped; a task sends each distinct anchor once.
    3. What is left, runs of windows with the bytes under them, is dealt into buckets by anchor, and a task sorts one
       bucket of suffixes at a time (window_classes): by 16 bytes, and long ties by ranks of a difference cover, made once
       for the bucket. Its memory is bounded by BUCKET bytes. Neighbours equal in `length` bytes are one class.
    4. An anchor with more than BUCKET bytes, such as one of a passage in a third of all documents, is dealt out window by
       window, by the windows' own hashes, after each task has resolved its own repeats of a window. They are then sorted
       like all others.

    Intermediate tables are stored in the shared folder and deleted when used up, all but the result.
    """
    if length < PERIOD:
        raise ValueError(f"length must be {PERIOD} at least")
    texts = _texts(docs).filter("doc_id IS NOT NULL")
    long_ones = F.octet_length("text") >= length
    sums = texts.filter(long_ones).select(
        "doc_id", "version", F.xxhash64(F.lit("text"), "text").alias("b"), F.octet_length("text").cast("long").alias("end")
    )
    firsts = sums.groupBy("version", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first <> last")
    copies = stored(
        sums.join(firsts, ["version", "b"]).filter("doc_id > first").select("doc_id", "version", "end").distinct()
    )
    source = texts.filter(long_ones).select("doc_id", "version", F.encode("text", "UTF-8").alias("data"))
    whole = source.join(_sent(copies.select("doc_id", "version")), ["doc_id", "version"], "left_anti")
    few = copies.limit(FEW + 1).count() <= FEW
    # while the list of copies is long, taking them out would shuffle all texts: their anchors do no harm
    anchors = _anchors(whole if few else source, length)
    marks = stored(
        anchors.repartition("at")
        .withColumns(_spread("at"))
        .filter("low <> high OR any_shared")
        .groupBy("doc_id")
        .agg(F.collect_list("anchor").alias("anchors"))
    )
    runs = stored(_marked_runs(whole.join(marks, "doc_id"), length))
    discard(marks)
    hot = _sent(
        stored(runs.groupBy("anchor").agg(F.sum(F.octet_length("data")).alias("size")).filter(F.col("size") > BUCKET).select("anchor"))
    )
    single = stored(_single_windows(runs.join(hot, "anchor", "left_semi").select(*runs.columns), length))
    cold = runs.join(hot, "anchor", "left_anti").select(*runs.columns)
    sorted_ = _sorted_buckets(cold.unionByName(single.filter("known IS NULL")), length)
    at_once = single.filter("known IS NOT NULL").select("doc_id", "version", F.get("spots", F.lit(0)).alias("start"), F.col("known").alias("end"))
    spans = sorted_.unionByName(at_once).unionByName(copies.select("doc_id", "version", F.lit(0).cast("long").alias("start"), "end"))
    spans = stored(spans)
    for used in (copies, runs, single):
        discard(used)
    return spans


def _spread(at: str) -> dict:
    here = Window.partitionBy(at)
    return {
        "low": F.min("doc_id").over(here),
        "high": F.max("doc_id").over(here),
        "any_shared": F.bool_or("shared").over(here),
    }


def without_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, version, n_bytes, spans (removed, in order, apart), kept (bytes left) of each row of docs (doc_id, text).

    Removed are the bytes in repeated_spans(). Texts are UTF-8; a null one is empty. A row without doc_id keeps all and
    makes no other row lose anything. Rows that share a doc_id are one document with several texts, each judged by
    smaller doc_ids alone. What is left may part a character; it is bytes. Other columns are not read. An empty table
    gives an empty result.
    """
    spans = repeated_spans(docs, length).groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    texts = _texts(docs).select("doc_id", "version", F.encode("text", "UTF-8").alias("data"))
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, version, data, spans in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                joined: list[list[int]] = []
                for s in sorted((s["start"], s["end"]) for s in spans or []):
                    if joined and s[0] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], s[1])
                    else:
                        joined.append(list(s))
                edges = [0, *(e for s in joined for e in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc_id, version, len(data), [{"start": a, "end": b} for a, b in joined], kept))
            yield _rows(_KEPT, out)

    joined = texts.join(spans, ["doc_id", "version"], "left").select("doc_id", "version", "data", "spans")
    return joined.mapInArrow(run, from_arrow_schema(_KEPT))


def repeat_digests(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs, as without_repeats() leaves it."""
    return without_repeats(docs, length).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


REPEATS_SQL = """
WITH docs AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
parts AS (
  SELECT doc_id, part, substr(h, 2000 * part + 1, 2098) AS h, n FROM (
    SELECT doc_id, h, n, unnest(range(0, n // 1000 + 1)) AS part FROM docs)),
windows AS MATERIALIZED (
  SELECT doc_id, 1000 * part + k AS pos, substr(h, 2 * k + 1, 100) AS w FROM (
    SELECT doc_id, part, h, unnest(range(0, least(1000, n - 49 - 1000 * part))) AS k FROM parts)),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w HAVING min(doc_id) <> max(doc_id)),
hits AS (SELECT doc_id, pos FROM windows JOIN firsts USING (w) WHERE doc_id > first),
marked AS (
  SELECT doc_id, pos, coalesce(pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50, TRUE) AS new FROM hits),
numbered AS (SELECT doc_id, pos, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM marked),
spans AS (SELECT doc_id, min(pos) AS a, max(pos) + 50 AS b FROM numbered GROUP BY doc_id, span),
pieces AS (
  SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start, a AS stop FROM spans
  UNION ALL SELECT d.doc_id, d.n, coalesce(s.b, 0), d.n FROM docs d LEFT JOIN (SELECT doc_id, max(b) AS b FROM spans GROUP BY doc_id) s USING (doc_id)),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * start + 1, 2 * (stop - start)), '' ORDER BY stop) AS h
  FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(s.removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(s.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM docs d JOIN kept k USING (doc_id) LEFT JOIN (
  SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM spans GROUP BY doc_id) s USING (doc_id)
"""
