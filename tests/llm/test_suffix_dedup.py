"""Repeated byte strings against a table of all windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemart.llm import suffix_dedup
from pulsemart.llm.common import shared_folder


def plain(rows, length=50):
    """Digest rows of (doc_id, text) by a dictionary of all windows."""
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - length + 1) if i is not None else ():
            w = b[k : k + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1) if i is not None else ():
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def digests(docs, length=50):
    return sorted((tuple(r) for r in suffix_dedup.repeat_digests(docs, length).collect()), key=repr)


def shuffled(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    return docs.withColumns({c: F.lit("x") for c in ("version", "data", "anchor", "spots", "at", "known", "end", "n_bytes", "first")})


def made(seed, n=80):
    """Texts that share passages of many lengths, at many places, some of them periodic."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["é", "日本", "\n", "ab" * 9]
    passages = [" ".join(rng.choices(words, k=k)) for k in (5, 12, 13, 14, 15, 16, 17, 18, 20, 40, 200)] + ["a" * 130, "ab " * 60]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randrange(40)))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            parts += [p[rng.randrange(6) : len(p) - rng.randrange(6)], " ".join(rng.choices(words, k=rng.randrange(20)))]
        rows.append((i if rng.random() < 0.9 else rng.randrange(n), "".join(parts)))
    return rows + [(n + k, rows[k][1]) for k in range(0, 20, 3)] + rows[:3]


@pytest.mark.parametrize("length", [16, 50])
def test_equal_to_all_windows(spark, length):
    rows = made(length)
    assert digests(shuffled(spark, rows), length) == plain(rows, length)


def test_buckets_blocks_and_single_windows_do_not_matter(spark, monkeypatch):
    """Small blocks of text, tasks that hand on early, buckets of a few runs, and every larger anchor window by window."""
    for name, value in {"BLOCK": 100, "HELD": 20, "BUCKET": 300, "FEW": 0}.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = made(3, 40)
    assert digests(shuffled(spark, rows)) == plain(rows)


def test_odd_texts(spark, odd, odd_texts):
    rows = [(i, t) for i, t in ((t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(odd_texts, 1))]
    assert digests(odd) == plain(rows)


def test_one_passage_in_most_documents(spark):
    rng = random.Random(9)
    passage = "the same words stand in nearly all of the documents of this table, again and again and again"
    rows = [(i, "".join(rng.choices("abcdefgh ", k=60)) + passage + "".join(rng.choices("abcdefgh ", k=60))) for i in range(500)]
    out = digests(shuffled(spark, rows))
    assert out == plain(rows)
    assert sum(r[2] >= len(passage) for r in out) == 499


def test_no_documents_and_files(spark, no_documents):
    assert digests(no_documents) == []
    assert digests(shuffled(spark, [(1, None), (2, ""), (3, "short")])) == plain([(1, None), (2, ""), (3, "short")])
    with pytest.raises(ValueError, match="16"):
        suffix_dedup.repeated_spans(no_documents, 8)
    assert shared_folder(spark)


def test_cover_takes_all_pairs_to_its_positions():
    for a in range(16):
        for b in range(16):
            d = suffix_dedup._SHIFT[a, b]
            assert {(a + d) % 16, (b + d) % 16} <= set(suffix_dedup.COVER)


def test_order_of_windows_is_the_order_of_their_bytes():
    rng = random.Random(2)
    for size in (3, 26):
        data = bytes(rng.choices(range(97, 97 + size), k=3000)) + b"ab" * 200 + b"a" * 300
        at = np.arange(len(data) - 49)
        order, new = suffix_dedup.window_classes(data, at, at, 50)
        windows = [data[k : k + 50] for k in order]
        assert windows == sorted(windows)
        assert [True, *(a != b for a, b in zip(windows, windows[1:], strict=False))] == new.tolist()
