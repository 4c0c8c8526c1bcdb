"""License scan, quality rules, HTML extraction, toxicity and the pipeline."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from conftest import MEADOW, documents

from pulsemart.llm import html_text, licenses, outliers, packing, toxicity
from pulsemart.llm.common import table
from pulsemart.llm.queries import BYTE_LEVEL

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def test_license_base_equals_brute_force(odd):
    got = {(str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(odd).collect()}
    expected = set()
    for r in odd.select("doc_id", "text").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text or ""))
        found = [
            (i, label)
            for phrase, label in licenses.PHRASES.items()
            for i in range(len(w))
            if w[i : i + len(phrase.split())] == phrase.split()
        ]
        starts = [i for i, _ in found]
        labels = ",".join(sorted({label for _, label in found}))
        expected.add((str(r.doc_id), len(w), len(found), min(starts, default=None), max(starts, default=None), labels))
    assert got == expected


@pytest.mark.parametrize(
    ("text", "label", "edits"),
    [
        ("zz general publc licens zz", "gpl", 2),
        ("aa apahe license", "apache", 1),
        ("released under the mit licence", "mit", 1),
        ("mit lixense", "mit", 1),
        ("mozila public license", "mpl", 1),
    ],
)
def test_notices_are_found_with_edits(text, label, edits):
    spans = licenses.NoticeSearch(licenses.NOTICES).spans(text)
    assert label in {s.label for s in spans} and edits in {s.edits for s in spans}


def test_every_edit_within_the_bound_is_found():
    notice = "general public license"
    search = licenses.NoticeSearch({notice: "gpl"})
    rng = np.random.default_rng(5)
    for _ in range(200):
        text = list(notice)
        for _ in range(2):
            i = int(rng.integers(len(text)))
            text[i : i + 1] = [["x", text[i]], ["q"], []][int(rng.integers(3))]
        assert search.spans("aaa bbb " + "".join(text) + " ccc"), "".join(text)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize(
    ("text", "starts"),
    [
        ("mit licence mit license", [0, 2]),
        ("mit licens foo mit license mit licens", [0, 3, 5]),
        ("general public licens general public license general publik license", [0, 3, 3, 6, 6]),
        ("kit license it license m t license emit license mitx license", []),
        ("released under the kit license", []),
        ("releasd under teh mit licence", [3]),
    ],
)
def test_nearby_notices_are_all_found_and_label_words_stand(text, starts):
    found = licenses.NoticeSearch({"mit license": "mit", "general public license": "gpl"}).spans(text)
    assert sorted({s.start for s in found}) == sorted(set(starts))


def test_spans_against_edit_distances():
    """Every run of words within the bound of a notice meets a span, and every span is within the bound."""
    search = licenses.NoticeSearch({"general public license": "gpl", "creative commons attribution": "cc"})
    rng = np.random.default_rng(11)
    pool = ["general", "public", "license", "creative", "commons", "attribution", "licens", "publik", "genral", "comons", "x", "the"]
    for _ in range(150):
        w = [pool[int(i)] for i in rng.integers(len(pool), size=14)]
        if rng.integers(2):
            at = int(rng.integers(10))
            w[at : at + 3] = ["general", ["public", "publc"][int(rng.integers(2))], ["license", "licence"][int(rng.integers(2))]]
        spans = search.spans(" ".join(w))
        for notice, label, edits in (("general public license", "gpl", 2), ("creative commons attribution", "cc", 2)):
            mine = [(s.start, s.start + s.length) for s in spans if s.label == label]
            for a, b in mine:
                assert edit_distance(" ".join(w[a:b]), notice) <= edits
            for a in range(len(w)):
                for b in range(a + 1, min(len(w), a + 5) + 1):
                    if edit_distance(" ".join(w[a:b]), notice) <= edits:
                        assert any(s < b and a < e for s, e in mine), (w, a, b)


def brute_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), failed


def test_statistics_equal_brute_force(odd):
    got = sorted((str(r.doc_id), *[r[c] for c in outliers.BASE]) for r in outliers.verdicts(odd).collect())
    assert got == sorted((str(r.doc_id), *brute_statistics(r.text)) for r in odd.select("doc_id", "text").collect())
    kept = outliers.keep_good(odd)
    assert kept.columns == odd.columns


def test_estimate_follows_the_core(spark):
    """Means and covariance of the closest documents, as numpy works them out, whatever far documents do."""
    rng = np.random.default_rng(1)
    good = rng.normal(0, 400, (600, len(outliers.FEATURES))).astype(int)
    bad = rng.normal(9000, 50, (80, len(outliers.FEATURES))).astype(int)
    rows = [("en", "a", False, *map(int, r)) for r in np.vstack([good, bad])]
    schema = "lang string, source string, base_failed boolean, " + ", ".join(f"{f} long" for f in outliers.FEATURES)
    found = spark.createDataFrame(rows, schema)
    by_source = outliers.groups(found)
    judged = outliers.judged(found, by_source, outliers.estimates(found, by_source)).collect()
    flags = [r.kept for r in judged if r[outliers.FEATURES[0]] < 5000]
    assert all(flags) and not any(r.kept for r in judged if r[outliers.FEATURES[0]] > 5000)
    squared = np.sort([r.distance for r in judged])[: len(good)]
    centred = good - good.mean(axis=0)
    exact = np.sort(np.einsum("ij,jk,ik->i", centred, np.linalg.inv(np.cov(good.T)), centred))
    assert abs(np.median(squared) / np.median(exact) - 1) < 0.35


@pytest.mark.parametrize(("large", "lang"), [(600, "en"), (600, "xx"), (40, "en"), (40, None)])
def test_small_groups_are_judged(spark, large, lang):
    """A small source is held against its language and a rare language against all, also where all are few or copies."""
    rng = np.random.default_rng(4)
    rows = [("en", "hot", False, *map(int, r)) for r in rng.normal(0, 400, (large, len(outliers.FEATURES)))]
    rows += [("en", None, False, *[100] * len(outliers.FEATURES))] * 30
    rows += [(lang, "rare", False, *[value] * len(outliers.FEATURES)) for value in (0, 9000)]
    rows += [("zz", "none", True, *[0] * len(outliers.FEATURES))]
    schema = "lang string, source string, base_failed boolean, " + ", ".join(f"{f} long" for f in outliers.FEATURES)
    found = spark.createDataFrame(rows, schema)
    by_source = outliers.groups(found)
    judged = outliers.judged(found, by_source, outliers.estimates(found, by_source)).collect()
    assert len(judged) == len(rows) and all(r.distance is not None for r in judged)
    assert {r[outliers.FEATURES[0]]: r.kept for r in judged if r.source == "rare"} == {0: True, 9000: False}
    assert np.mean([r.kept for r in judged if r.lang == "en" and r.source != "rare"]) > 0.98
    assert not any(r.kept for r in judged if r.lang == "zz")


def test_quality_verdict_against_labels(spark):
    rows = outliers.verdicts(table(spark, MORE, "documents")).filter("NOT base_failed").join(table(spark, MORE, "labels"), "doc_id")
    shares = defaultdict(list)
    for r in rows.select("quality", "kept").collect():
        shares[r.quality].append(r.kept)
    assert np.mean(shares[1]) > 0.97 and np.mean(shares[0]) < 0.1


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var x="</p>";</script></head><body><nav><a>menu</a></nav>
<div class="ad">buy</div><article><h1>Head &amp; line</h1><p>a <b>bold</b>word<br><p>next&nbsp;one
<div class="tail">Read our other pages</div><section class="comments">nice</section></article><footer>f</footer>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, version long")


def test_main_text(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.replace("next", f"number {i}"), "x", 1) for i in range(1, 8)]
    rows += [(20, None, None, None, None), (21, "nowhere", "", "x", 1), (None, "http://b.example/", PAGE, "x", 1)]
    rows += [(30, "http://c.example", "<p>just <i>text", "x", 1), (30, "http://c.example", "<p>just <i>text", "x", 1)]
    rows += [(31, "http://c.example", "<main>m<aside>s</aside></main> rest <", "x", 1), (32, "http://c.example", "a < b & c", "x", 1)]
    got = sorted((str(r.page_id), r.text) for r in html_text.main_text(pages(spark, rows)).collect())
    expected = [(str(i), f"Head & line a boldword number {i} one") for i in range(1, 8)]  # the tail is a template
    expected += [("20", ""), ("21", ""), ("None", "Head & line a boldword next one Read our other pages")]
    expected += [("30", "just text"), ("30", "just text"), ("31", "m"), ("32", "a < b & c")]
    assert got == sorted(expected)
    assert html_text.main_text(pages(spark, [])).count() == 0


def test_copies_of_a_page_are_no_templates(spark):
    rows = [(i, "http://a.example/", PAGE, "x", 1) for i in range(50)]
    assert {r.text for r in html_text.main_text(pages(spark, rows)).collect()} == {"Head & line a boldword next one Read our other pages"}


def test_names_inside_an_article_are_judged_whole(spark):
    kept = ["share-price", "search-engine", "related-work", "comment-theory", "notice-period"]
    gone = ["share-buttons", "related_posts", "sidebar left", "ad-slot-3", "cookie-banner box", "comments"]
    html = "<article>" + "".join(f"<div class='{c}'>{i}</div>" for i, c in enumerate(kept + gone)) + "</article>"
    html2 = "<main><p>a long essay about things</p><article>teaser</article><p>goes on</p></main>"
    got = [r.text for r in html_text.main_text(pages(spark, [(1, "http://a/", html, "", 1), (2, "http://b/", html2, "", 1)])).orderBy("page_id").collect()]
    assert got == ["0 1 2 3 4", "a long essay about things teaser goes on"]


@pytest.mark.parametrize("few", [html_text.FEW_TEMPLATES, 0])
def test_templates_equal_brute_force(spark, few):
    """Whole pages of blocks, some of them repeated on many pages of a host, some named, some neither."""
    rng = np.random.default_rng(8)
    rows, blocks = [], {}
    for page in range(400):
        host = "hot" if page % 3 == 0 else f"h{page % 7}"
        parts = [f"common {int(rng.integers(6))}", f"rare {int(rng.integers(90))}", f"own {page} " + "word " * 20]
        named = f"<nav>links {int(rng.integers(3))}</nav><div class='ad'>buy {page}</div>"
        rows.append((page, f"http://{host}/{page}", named + "".join(f"<div>{p}</div>" for p in parts), "x", 1))
        blocks[page] = (host, parts, re.search("links .", named).group())
    pages_of = Counter(h for h, _, _ in blocks.values())
    seen = Counter((h, p) for h, parts, nav in blocks.values() for p in {*parts, nav})
    expected = {}
    for page, (host, parts, nav) in blocks.items():
        def template(p):
            return seen[host, p] >= 5 and 2 ** seen[host, p] >= pages_of[host]
        text = " ".join(" ".join(p for p in parts if not template(p)).split())
        expected[page] = (text, sum(template(p) for p in (*parts, nav)), sum(len(p) for p in parts if template(p)))
    got = html_text.main_text(pages(spark, rows), few=few).collect()
    assert {r.page_id: (r.text, r.n_templates, r.n_template_chars) for r in got} == expected
    assert any(n for _, n, _ in expected.values()) and len(got) == 400


def test_toxicity_on_held_out_documents(spark):
    docs, labels = table(spark, MORE, "documents"), table(spark, MORE, "labels")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits >= 0.7 * sum(r.toxic for r in rows) and hits >= 0.9 * sum(r.predicted for r in rows)


def test_voters_come_from_all_labelled_documents(spark, monkeypatch):
    """Rare words that the fit's documents don't show, and runs of over 40 letters, become voters that reject."""
    monkeypatch.setattr(toxicity, "MAX_TRAINING", 20)
    run = "ни" * 30
    rows = [(i, ["a fine day", "a fine day zorgle you", f"a {run} day"][i % 40 if i % 40 < 3 else 0], int(i % 40 in (1, 2))) for i in range(2000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    predicted = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    assert predicted == {r[0]: r[2] for r in rows}
    patterns = ["zor", "zorg", "zorgle$", "fig$", "figs$", "ig$", "ig"]
    kept = toxicity._shortest(spark.createDataFrame([(p, 5) for p in patterns], "pattern string, t long"))
    assert {r.pattern for r in kept.collect()} == {"zor", "fig$", "figs$", "ig$", "ig"}


def test_toxicity_of_odd_rows(odd, no_documents, no_labels):
    rows = toxicity.toxicity(odd, no_labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert toxicity.toxicity(no_documents, no_labels).count() == 0
    assert toxicity.keep_clean(odd, no_labels).columns == odd.columns


def test_held_out_labels_are_not_read(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    assert toxicity.train(docs, labels) == toxicity.train(docs, flipped)


def test_label_model_outvotes_wrong_labels():
    rng = np.random.default_rng(2)
    truth = rng.random(2000) < 0.3
    votes = np.stack([np.where(truth, rng.random(2000) < 0.7, rng.random(2000) < 0.02) for _ in range(8)], axis=1)
    given = np.where(rng.random(2000) < 0.05, ~truth, truth)
    posterior = toxicity.label_model(votes.astype(np.float32), given.astype(float))
    assert ((posterior > 0.5) == truth).mean() > 0.99 > (given == truth).mean()


def test_pipeline_stages(spark):
    docs = table(spark, MORE, "documents")
    before = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, MORE)
        assert out.columns == before, name
    packed = corpus_pipeline.run(spark, SMALL)
    pieces = packed.collect()
    assert pieces and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(packed.columns)
    per_document = defaultdict(int)
    for p in pieces:
        per_document[p.doc_id] += p.length
    assert all(per_document[p.doc_id] == p.doc_tokens for p in pieces)


def test_whole_pipeline_equals_its_stages_in_a_row(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    clean = {r.doc_id for r in toxicity.toxicity(docs, table(spark, SMALL, "labels")).filter("predicted = 0").collect()}
    good = docs.filter(docs.doc_id.isin(clean))
    kept = {r.doc_id for r in outliers.verdicts(good).filter("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    holders = {}
    for d in sorted(texts):
        for line in texts[d].split("\n"):
            holders.setdefault(lower(line.strip(" \t\n\x0b\x0c\r")), d)
    lines = {}
    for d, t in texts.items():
        keys = [(line, lower(line.strip(" \t\n\x0b\x0c\r"))) for line in t.split("\n")]
        lines[d] = "\n".join(line for line, k in keys if len(k) < 10 or holders[k] == d)
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if (w := WORD.findall(lower(t))) else set() for d, t in lines.items()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    expected = {d for d in sets if find(d) == d}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()} == expected


def test_sentences_end_pieces(spark):
    ends = packing.sentence_ends(BYTE_LEVEL["vocabulary"])
    assert ends.sum() > 10
    rows = documents(spark, [(1, (MEADOW + ". ") * 400)])
    pieces = sorted(packing.pack(rows, **BYTE_LEVEL).collect(), key=lambda p: p.start)
    assert len(pieces) > 3 and all(ends[p.ids[-1]] for p in pieces[:-1])
