"""Divergence of sources against a plain version in whole numbers."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pulsemart.llm import source_audit

FIELDS = "doc_id long, text string, lang string, source string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, top=10):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        df = Counter(w for la, _, words in docs if la == lang for w in set(words))
        kept = sorted(w for w in df if df[w] >= least)
        counts = {s: Counter() for la, s, _ in docs if la == lang}
        for la, s, words in docs:
            if la == lang:
                counts[s].update(words)
        whole = sum(counts.values(), Counter())

        def chances(count, kept=kept):
            total = sum(count[w] for w in kept)
            return [1 + 10**9 * (count[w] + 2) // (total + 2 * len(kept)) for w in kept]

        p, q = {s: chances(c) for s, c in counts.items()}, chances(whole)
        for s in counts:
            pairs = [(-sum((x - y) ** 2 // (x + y) for x, y in zip(p[s], p[o], strict=True)), o.encode(), o) for o in counts if o != s]
            words = [(-((x - y) ** 2 // (x + y)), w.encode(), w) for w, x, y in zip(kept, p[s], q, strict=True) if counts[s][w] and x > y]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(words)[:top])):
                out |= {(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)}
    return out


def made(n, seed, sources=7):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Été", "日本", "don", "X"]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "fr", None]), rng.choice([None, "", *[f"s{k}é" for k in range(sources)]])
        text = " ".join(rng.choices(words, k=rng.randrange(30)))
        rows.append((i, rng.choice([text, text, "Same, same TEXT\x00again's\n", None, "", "123 ++"]), lang, source))
    return rows


def audited(spark, rows, **how):
    docs = spark.createDataFrame(rows, FIELDS).repartition(5)
    clashing = docs.withColumns({c: F.lit("x") for c in ("a", "b", "n", "term", "rows", "total", "kept", "p0", "sources")})
    out = [tuple(r) for r in source_audit.audit(clashing, **how).collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_equal_to_plain_counts(spark):
    rows = made(600, 1)
    assert audited(spark, rows) == plain(rows)


def test_blocks_and_flushes_do_not_matter(spark, monkeypatch):
    """Sources and terms in many blocks, tasks that hand on early, nothing broadcast."""
    for name, value in {"BLOCK_SOURCES": 2, "BLOCK_ROWS": 40, "HELD": 5, "FEW": 0}.items():
        monkeypatch.setattr(source_audit, name, value)
    rows = made(300, 2)
    assert audited(spark, rows, min_documents=3) == plain(rows, least=3)


def test_copies_are_read_once(spark):
    rows = [(i, "hot text here " * 3, "en", f"s{i % 3}") for i in range(400)] + made(60, 3)
    docs = spark.createDataFrame(rows, FIELDS).select("lang", "source", "text").fillna("")
    texts = source_audit.distinct_texts(docs).collect()
    assert len(texts) == len({(r.lang, r.text) for r in docs.collect()})
    hot = next(r for r in texts if r.lang == "en" and r.text and r.text.startswith("hot"))
    assert {s.source: s.n for s in hot.sources} == {"s0": 134, "s1": 133, "s2": 133}
    assert audited(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [
    [],
    [(1, None, None, None)],
    [(1, "rare words", "en", "a"), (2, "x" * 60_000, "en", "b"), (3, "more", "en", "c")],
    [(7, "one two", "en", "a")] * 12 + [(7, "one", "en", "b")] * 12,
])
def test_odd_tables(spark, rows):
    assert audited(spark, rows) == plain(rows)
