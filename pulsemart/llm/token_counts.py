"""Token counts without token ids."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .byte_level import word_encoder
from .common import MEMO_LENGTH, map_batches, pre_tokens, ship_package, stored, text_or_empty

#: At most so many pre-tokens are sent to every task (see `count_tokens`).
FREQUENT = 200_000
#: Distinct pre-tokens that a task counts before it drops the rare ones from its summary.
SUMMARY = 500_000
#: Documents whose pre-tokens are gathered before they are shuffled; their numbers inside fit 16 bits.
BLOCK = 16_384
#: Occurrences that a task gathers before it hands them on.
HELD = 4_000_000


def frequent_words(texts: DataFrame, frequent: int) -> DataFrame:
    """word: pre-tokens that make up more than 1 in `frequent` of all occurrences, fewer than `frequent` of them.

    A pre-token with such a share of all has it in one split at least; each split hands on those that have it there, with
    their counts. A split drops rare ones whenever its summary is full, so a pre-token near the share may be missed:
    that costs a row in the shuffle, and no result hangs on it.
    """

    def run(batches):
        seen: Counter = Counter()
        total = 0
        for batch in batches:
            for text in batch["text"]:
                words = pre_tokens(text)
                total += len(words)
                seen.update(words)
                if len(seen) > SUMMARY:
                    seen = Counter({w: n for w, n in seen.items() if n * frequent > total})
        some = [(w, n) for w, n in seen.items() if n * frequent > total and len(w) <= MEMO_LENGTH]
        yield {"word": [w for w, _ in some], "n": [n for _, n in some], "total": [0] * len(some)}
        yield {"word": [None], "n": [0], "total": [total]}

    counted = stored(
        map_batches(texts, run, "word string, n long, total long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    )
    total = counted.filter("word IS NULL").agg(F.sum("total")).first()[0] or 0
    return counted.filter(F.col("word").isNotNull() & (F.col("n") * frequent > total)).select("word", "n")


def count_pieces(words: DataFrame, vocabulary: str, ranks: str | None, pattern: str | None) -> DataFrame:
    """word, n, pieces: what the vocabulary makes of each distinct pre-token."""

    def run(batches):
        encode = word_encoder(vocabulary, ranks, pattern)
        for batch in batches:
            yield batch | {"pieces": [len(ids) // 4 for ids in encode(batch["word"])]}

    return map_batches(words, run, "word string, n long, pieces long")


_WORDS = pa.schema([("word", pa.string()), ("block", pa.int64()), ("docs", pa.binary()), ("times", pa.binary())])
_SUMS = pa.schema([("block", pa.int64()), ("head", pa.bool_()), ("docs", pa.binary()), ("n", pa.binary())])
_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _frequencies(docs: DataFrame, known) -> DataFrame:
    """Rows of _WORDS for each block of documents: one without a word, with the documents' ids, sizes and the tokens of
    their frequent pre-tokens, and one for each other pre-token with the documents that hold it (16 bits each) and, where
    any holds it more than once, how often. A block's number is made of those of its split and of its first row."""
    ship_package(docs.sparkSession)

    def run(batches):
        words, pieces = known.value
        common = {w: k for k, w in enumerate(words)}
        pieces = np.array([*pieces, 0], np.float64)
        block, ids, sizes, codes, held, numbers = TaskContext.get().partitionId() << 33, [], [], [], 0, _Numbers(common)

        def flush():
            code = np.concatenate(codes) if codes else np.empty(0, np.int64)
            doc = np.repeat(np.arange(len(ids)), [len(c) for c in codes])
            often = code < len(common)
            sure = np.bincount(doc[often], pieces[code[often]], len(ids)).astype(np.int64)
            null = np.array([i is None for i in ids], np.int64)
            head = np.array([i or 0 for i in ids], np.int64).tobytes()
            yield _batch(_WORDS, [None], [block], [head], [np.concatenate([null, sizes, sure]).astype(np.int64).tobytes()])
            pairs, times = np.unique((code[~often] - len(common)) << 16 | doc[~often], return_counts=True)
            if not len(pairs):
                return
            rare = list(numbers)[len(common) :]
            first = np.searchsorted(pairs >> 16, np.arange(len(rare) + 1))
            more = np.flatnonzero(np.maximum.reduceat(times, first[:-1]) > 1)
            several: list[bytes | None] = [None] * len(rare)
            for k in more.tolist():
                several[k] = times[first[k] : first[k + 1]].astype(np.uint32).tobytes()
            spots = pa.Array.from_buffers(
                pa.binary(), len(rare), [None, pa.py_buffer((first * 2).astype(np.int32)), pa.py_buffer(pairs.astype(np.uint16))]
            )
            whole = _batch(_WORDS, rare, np.full(len(rare), block), spots, several)
            yield from (whole.slice(k, 50_000) for k in range(0, len(rare), 50_000))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                some = pre_tokens(text)
                codes.append(np.fromiter(map(numbers.__getitem__, some), np.int64, len(some)))
                ids.append(doc_id)
                sizes.append(len(text.encode()))
                held += len(some)
                if len(ids) == BLOCK or held > HELD:
                    yield from flush()
                    block += len(ids)
                    ids, sizes, codes, held, numbers = [], [], [], 0, _Numbers(common)
        if ids:
            yield from flush()

    return docs.mapInArrow(run, from_arrow_schema(_WORDS))


def _binary(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(values, first value of each row and the end) of a column of numbers as bytes."""
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8, edges[-1] - edges[0], edges[0]).tobytes() if edges[-1] > edges[0] else b""
    return np.frombuffer(values, kind), (edges - edges[0]) // np.dtype(kind).itemsize


def _sums(words: DataFrame, vocabulary: str, ranks: str | None, pattern: str | None) -> DataFrame:
    """Rows of _SUMS from words (rows of _WORDS, those without a word first, equal ones one after the other): each distinct
    pre-token is encoded once, and its pieces are added up by document and sent back to the documents' block."""
    ship_package(words.sparkSession)

    def run(batches):
        encode = word_encoder(vocabulary, ranks, pattern)
        held, last, last_pieces = [], None, 0

        def summed():
            block, doc, n = (np.concatenate(c) for c in zip(*held, strict=True))
            row, first, place = np.unique(block + doc, return_index=True, return_inverse=True)
            total = np.bincount(place, n, len(row)).astype(np.uint32)
            block, doc = block[first], doc[first]
            cut = np.flatnonzero(np.diff(block, prepend=-1))
            spots, totals = (np.split(a, cut[1:]) for a in (doc, total))
            rows = [a.tobytes() for a in spots], [a.tobytes() for a in totals]
            return _batch(_SUMS, block[cut], np.zeros(len(cut), bool), *rows)

        for batch in batches:
            heads = batch.column("word").null_count
            if heads:
                some = batch.slice(0, heads)
                yield _batch(_SUMS, some.column("block"), np.ones(heads, bool), some.column("docs"), some.column("times"))
            some = batch.slice(heads)
            if not len(some):
                continue
            word = some.column("word").to_pylist()
            new = [w for w, before in zip(word, [last, *word], strict=False) if w != before]
            made = {last: last_pieces} | {w: len(ids) // 4 for w, ids in zip(new, encode(new), strict=True)}
            last = word[-1]
            last_pieces = made[last]
            doc, edges = _binary(some.column("docs"), np.uint16)
            many = np.diff(edges)
            n = np.repeat(np.fromiter(map(made.__getitem__, word), np.int64, len(word)), many)
            times = some.column("times")
            if times.null_count < len(times):
                for k in np.flatnonzero(times.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    n[edges[k] : edges[k + 1]] *= np.frombuffer(times[k].as_py(), np.uint32)
            held.append((np.repeat(some.column("block").to_numpy(), many), doc, n))
            if sum(len(h[1]) for h in held) >= HELD:
                yield summed()
                held = []
        if held:
            yield summed()

    return words.mapInArrow(run, from_arrow_schema(_SUMS))


def _added(sums: DataFrame) -> DataFrame:
    """Rows of _COUNTS from sums (rows of _SUMS, those of a block one after the other, its head first)."""

    def run(batches):
        block, ids, sizes, total = None, [], None, None

        def shown():
            return _batch(_COUNTS, ids, sizes, total)

        for batch in batches:
            for here, head, docs, n in zip(*(batch.column(c).to_pylist() for c in _SUMS.names), strict=True):
                if head:
                    if block is not None:
                        yield shown()
                    null, sizes, total = np.frombuffer(n, np.int64).reshape(3, -1).copy()
                    ids = [None if x else i for x, i in zip(null, np.frombuffer(docs, np.int64).tolist(), strict=True)]
                    block = here
                else:
                    total[np.frombuffer(docs, np.uint16)] += np.frombuffer(n, np.uint32)
        if block is not None:
            yield shown()

    return sums.mapInArrow(run, from_arrow_schema(_COUNTS))


def count_tokens(
    docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, frequent: int = FREQUENT
) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of docs (doc_id, text).

    Pre-tokens are counted once per distinct value over all documents, joined to the pre-token frequencies of each
    document and summed; ids are never made for a document. Pre-tokens with more than 1 in `frequent` of all occurrences
    (so there are fewer than `frequent` of them, each of MEMO_LENGTH characters at most) go to every task with their
    pieces and are summed on the spot: a hot pre-token never meets in one task. All others are shuffled by pre-token,
    once a block of documents with the list of documents that hold it; where equal ones meet, they are encoded once, and
    their pieces go back to the blocks as sums by document.

    A block's number is that of its split and place. Splits of files are the same each time they are read; other input
    should be written first, so that a task that is run again after its executor was lost numbers its blocks as before.

    Null and empty texts have no tokens. Each row is counted on its own, rows of one doc_id or none included. Other
    columns of `docs` are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    common = count_pieces(frequent_words(texts.select("text"), frequent), vocabulary, ranks, pattern).collect()
    known = spark.sparkContext.broadcast(([r.word for r in common], [r.pieces for r in common]))
    dealt = _frequencies(texts, known).repartition(F.coalesce(F.xxhash64("word"), F.xxhash64("block")))
    sums = _sums(dealt.sortWithinPartitions(F.asc_nulls_first("word")), vocabulary, ranks, pattern)
    return _added(sums.repartition("block").sortWithinPartitions("block", F.desc("head")))
