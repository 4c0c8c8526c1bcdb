"""Product codes against plain k-means in whole numbers, and the bounds against full scans."""

from __future__ import annotations

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemart.llm import vector_codes
from pulsemart.llm.common import shared_folder

FIELDS = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """{row number: (code, error)} and the books, by full scans over Python integers."""
    width = len(min((r for r in rows if r[0] is not None), key=lambda r: r[0])[1])
    whole = [[max(-(2**31), min(2**31, math.floor(v * scale))) for v in np.array(r[1], np.float32).tolist()] for r in rows]
    edges = [p * width // parts for p in range(parts + 1)]
    first = {}
    for r, x in zip(rows, whole, strict=True):
        if r[0] is not None:
            first[r[0]] = min(first.get(r[0], x), x)
    books = [[first[i][a:b] for i in sorted(first)[:entries]] for a, b in zip(edges, edges[1:], strict=False)]

    def assign():
        out = []
        for x in whole:
            best = []
            for p, book in enumerate(books):
                part = x[edges[p] : edges[p + 1]]
                best.append(min((sum((u - v) ** 2 for u, v in zip(part, e, strict=True)), k) for k, e in enumerate(book)))
            out.append(([k for _, k in best], sum(d for d, _ in best)))
        return out

    for _ in range(rounds):
        codes = assign()
        for p, book in enumerate(books):
            for k in range(len(book)):
                mine = [x[edges[p] : edges[p + 1]] for x, (c, _) in zip(whole, codes, strict=True) if c[p] == k]
                if mine:
                    book[k] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    return assign(), books


def table(spark, rows, fields=FIELDS):
    return spark.createDataFrame(rows, fields).repartition(3)


def check(spark, rows, **how):
    got, books = vector_codes.compress(table(spark, rows), **how)
    codes, expected = plain(rows, **how)
    assert [b.tolist() for b in books] == expected
    want = sorted((repr(r[0]), repr(r[2]), c, min(e, 2**63 - 1)) for r, (c, e) in zip(rows, codes, strict=True))
    assert sorted((repr(r.vec_id), repr(r.label), list(r.code), r.error) for r in got.collect()) == want


@pytest.mark.parametrize("spread,width,entries", [(1, 8, 40), (0.002, 8, 40), (3e4, 6, 5), (2e6, 5, 70)])
def test_equal_to_full_scans(spark, spread, width, entries):
    """Few and many ties, components for which float64 is not exact, parts of unequal widths."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=width) * spread).astype(np.float32).tolist(), i % 3) for i in range(150)]
    check(spark, rows, entries=entries, rounds=4)


def test_repeated_null_and_fewer_ids(spark):
    rng = np.random.default_rng(4)
    one = [(7, rng.normal(size=4).tolist(), 1)] * 5 + [(7, rng.normal(size=4).tolist(), None)]
    rows = one + [(None, rng.normal(size=4).tolist(), None), (3, [0.5] * 4, 2), (9, [0.5] * 4, 2)]
    check(spark, rows)


def test_moves_over_rounds_keep_bounds_true():
    """Bounds kept from rounds long past decide as a full scan does, though most groups are not scanned."""
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(4000, 6)) * 200).astype(np.int64)
    books, n = [x[:256].copy()], len(x)
    code, low, stamp = np.full(n, -1), np.full((n, 8), -np.inf, np.float32), np.zeros((n, 8), np.int8)
    scanned = []
    for _ in range(8):
        code, low, stamp, far, work = vector_codes.reassign(x, books, code, low, stamp)
        full = vector_codes.squared(x, books[-1])
        assert (code == full.argmin(1)).all() and (far == full.min(1)).all()
        other = full.copy()
        other[np.arange(n), code] = np.inf
        least = np.sqrt(np.minimum.reduceat(other, np.arange(0, 256, 32), axis=1))
        moved = np.stack([np.maximum.reduceat(np.sqrt(((books[-1] - b) ** 2).sum(1)), np.arange(0, 256, 32)) for b in books])
        assert (low - moved[stamp, np.arange(8)] <= least + 1e-3).all()
        scanned.append(work)
        new = books[-1].copy()
        for k in np.unique(code):
            new[k] = x[code == k].sum(0) // (code == k).sum()
        books.append(new)
    assert scanned[0] == n * 8 and scanned[-1] < n * 8 / 2


def test_broken_vectors_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2, 0.3, 0.4], 1), (2, None, 1), (3, [0.1, None, 0.2, 0.3], 1), (4, [nan, 0.0, 0.0, 0.0], 1),
            (5, [0.0, -inf, 0.0, 0.0], 1), (6, [], 1), (7, [0.1], 1), (8, [0.1, 0.2, 0.3, 0.5], None)]
    docs = table(spark, rows).withColumns({c: F.lit("x") for c in ("x", "code", "error", "k0", "low", "total", "v", "of")})
    out = {r.vec_id: r for r in vector_codes.code_digests(docs).collect()}
    assert sorted(out) == [1, 8]
    assert out[1].code == "00000000" and out[8].code == "00000001" and out[8].label_error == out[8].error == 0
    assert vector_codes.code_digests(spark.createDataFrame([], FIELDS)).collect() == []


def test_files_of_earlier_rounds_are_gone(spark):
    folder = Path(shared_folder(spark))
    before = set(folder.glob("stored-*"))
    rows = [(i, [i / 7.0] * 4, 0) for i in range(20)]
    assert vector_codes.compress(table(spark, rows))[0].count() == 20
    assert len(set(folder.glob("stored-*")) - before) == 1
