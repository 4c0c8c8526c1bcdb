"""Line dedup, near duplicates and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import compare
import pytest
from conftest import MEADOW, documents

from pulsemart.llm import graph, imatch, lines, minhash
from pulsemart.llm.catalog import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op1_near_dedup", "op4_line_dedup"])
def test_query_equals_its_sql(spark, name):
    got = compare.spark_rows(queries()[name](spark, FOLDER))
    assert got == compare.sql_rows(compare.connect(FOLDER), oracle_sql()[name])
    assert got[1]


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def brute_components(rows, words, percent):
    sets = []
    for _, text in rows:
        w = WORD.findall(lower(text or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and None not in (rows[i][0], rows[j][0]) and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        component = None if doc_id is None else min(rows[j][0] for j in range(len(rows)) if find(j) == find(i))
        out.append((str(doc_id), len(sets[i]), str(component), doc_id == component))
    return sorted(out)


def variants(n):
    """A chain of texts: neighbours are near copies, the ends are not."""
    words = [f"w{i}" for i in range(120)]
    out = []
    for k in range(n):
        words = list(words)
        words[(7 * k) % 120] = f"new{k}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("turn", [1, -1])
def test_texts_under_one_id_are_one_document(spark, turn):
    """Its links are those of all its texts, in whatever order the rows stand."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(1, a), (5, a + " more"), (5, b + " more"), (9, b), (7, c), (5, c), (20, c + " more"), (30, "else"), (30, "other")][::turn]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted({(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 2).collect()})
    assert got == [(1, 1, True), (5, 1, False), (7, 1, False), (9, 1, False), (20, 1, False), (30, 30, True)]
    assert sorted(r.doc_id for r in minhash.keep_one(docs, 2).collect()) == [1, 30, 30]


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(spark, odd, words):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = minhash.near_duplicates(odd, words).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute_components(rows, words, 80)


def test_a_chain_of_near_copies_is_one_component(spark):
    rows = list(enumerate(variants(60), 1))
    got = minhash.near_duplicates(documents(spark, rows), 2).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute_components(rows, 2, 80)


def test_a_large_group_around_the_threshold_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LARGE", 3)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    monkeypatch.setattr(minhash, "PARTNERS", (1,))
    used = []
    links = minhash._in_blocks
    monkeypatch.setattr(minhash, "_in_blocks", lambda *a: used.append(links(*a)) or used[-1])
    draw = random.Random(3)
    rows = []
    for k in range(1, 151):
        words = [f"w{i}" for i in range(120)]
        for place in draw.sample(range(120), draw.randint(3, 14)):
            words[place] = f"new{k}-{place}"
        rows.append((k, " ".join(words)))
    got = minhash.near_duplicates(documents(spark, rows), 2).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute_components(rows, 2, 80)
    assert used[0].count() > 0


def test_keep_one_returns_documents(spark):
    docs = documents(spark, [MEADOW, MEADOW + " x", "another text that stands alone here", (None, MEADOW)])
    kept = minhash.keep_one(docs, words=2)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7), (2, 9), (3, 5)], "a long, b long")
    got = {(r.node, r.root) for r in graph.components(links).collect()}
    assert got == {(3, 3), (4, 3), (5, 3), (2, 2), (8, 2), (9, 2)}


def brute_lines(rows):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        all_lines = (text or "").split("\n")
        kept = [
            line
            for line in all_lines
            if doc_id is None or len(holders.get(key(line), ())) < 2 or min(holders[key(line)]) == doc_id
        ]
        out.append((str(doc_id), len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_lines_equal_brute_force(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = lines.line_digests(odd).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == brute_lines(rows)
    texts = lines.without_shared_lines(odd)
    assert texts.columns == odd.columns and texts.count() == odd.count()


def test_a_higher_threshold_counts_documents_not_lines(spark):
    line = "a line of some length"
    docs = documents(spark, [f"{line}\n{line}\n{line}", line, "other line entirely"])
    assert {r.n_dropped for r in lines.drop_shared_lines(docs, min_documents=3).collect()} == {0}
    docs = documents(spark, [line, line, line])
    dropped = {r.row.doc_id: r.n_dropped for r in lines.drop_shared_lines(docs, min_documents=3).collect()}
    assert dropped == {1: 0, 2: 1, 3: 1}


def test_fingerprints(spark, odd):
    got = {str(r.doc_id): r for r in imatch.compared(odd.filter("doc_id IS NOT NULL")).collect()}
    rows = [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect() if r.doc_id is not None]
    ordered = sorted(rows, reverse=True)
    for i, (doc_id, text) in enumerate(ordered):
        following, half = ordered[(i + 1) % len(ordered)][1], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        if [d for d, _ in rows].count(doc_id) == 1:
            assert got[str(doc_id)].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert got[str(doc_id)].n_chars == len(text)
    assert got["5"].fingerprint == got["6"].fingerprint  # equal texts
    assert imatch.compared(odd).count() == odd.count()


def test_fingerprints_tell_edits_from_strangers(spark):
    rows = imatch.compared(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    long = [r for r in rows if r.n_chars > 400]
    assert sum(r.near_edited > r.near_next for r in long) > 0.85 * len(long)
    by_print = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_print.setdefault(r.fingerprint, r)


def brute_band(texts):
    """For each text the set of its terms within the band, and all terms within or above it."""
    sets = [{w for w in re.split(r"[\W_]+", t.lower()) if w} for t in texts]
    df = {}
    for s in sets:
        for w in s:
            df[w] = df.get(w, 0) + 1
    low, high = max(2.0, imatch.RAREST * len(texts)), max(2.0, imatch.COMMONEST * len(texts))
    return [{w for w in s if low <= df[w] <= high} for s in sets], {w for w in df if df[w] >= low}


def test_the_whole_band_counts_however_frequent_or_long_its_terms_are(spark):
    """Texts with the same terms of the band have the same fingerprint, and others, by the rarest and longest terms alone, don't."""
    rng = random.Random(3)
    texts = [" ".join(rng.sample([f"w{k}" for k in range(400)], 12)) for _ in range(300)]
    texts += [f"rare{k // 2} {'long' * 12}{k // 2}" for k in range(100)]
    docs = documents(spark, texts)
    whole = {r.doc_id: r.fingerprint for r in imatch.compared(docs).collect()}
    band, known = brute_band(texts)
    assert all(band[300 + k] == {f"rare{k // 2}", "long" * 12 + f"{k // 2}"} for k in range(100))
    for most in (0, 40, 300):
        _, rest = imatch.lexicon(docs, most)
        assert rest is not None and rest.count() > 0
        assert {r.doc_id: r.fingerprint for r in imatch.compared(docs, most).collect()} == whole
    frequent, rest = imatch.lexicon(docs)
    assert rest is None and frequent.count() == len(known)
    told = [whole[301 + k] for k in range(100) if not whole[301 + k].startswith("text:")]
    assert len(told) > 80 and len(set(told)) == len(told) // 2


def test_no_documents(no_documents):
    assert minhash.near_duplicates(no_documents).count() == 0
    assert lines.line_digests(no_documents).count() == 0
    assert imatch.compared(no_documents).count() == 0
