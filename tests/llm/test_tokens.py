"""Token operators against the tokenizers library."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pulsemart.llm import bpe, packing, token_counts
from pulsemart.llm.common import pre_tokens
from pulsemart.llm.queries import BYTE_LEVEL, WORDS


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(BYTE_LEVEL["vocabulary"])


def rows_of(odd):
    return [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]


def ids_of(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


def test_pre_tokens_join_to_the_text(odd_texts):
    for t in odd_texts:
        text = (t[1] if isinstance(t, tuple) else t) or ""
        assert "".join(pre_tokens(text)) == text


def test_round_trip_equals_the_library(odd):
    library = Tokenizer.from_file(WORDS)
    expected = []
    for doc_id, text in rows_of(odd):
        ids = ids_of(library, text)
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((str(doc_id), len(ids), " ".join(map(str, ids)), decoded))
    got = [(str(r.doc_id), r.n_tokens, r.ids, r.decoded) for r in bpe.encode_decode(odd, WORDS).collect()]
    assert sorted(got) == sorted(expected)
    digests = {(str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(odd, WORDS).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert digests == {(d, sha(i), sha(t)) for d, _, i, t in expected}


def test_no_merge_crosses_a_forced_cut():
    codec = bpe.Codec(WORDS)
    assert codec.fragments("zqxjkw") != ["zqxjkw"]
    assert "".join(codec.fragments("zqxjkw")) == "zqxjkw"


@pytest.mark.parametrize("frequent", [1, token_counts.FREQUENT])  # 1: all pre-tokens take the shuffled half
def test_counts_equal_the_library(odd, byte_level, frequent):
    counted = token_counts.count_tokens(odd, **BYTE_LEVEL, frequent=frequent).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in counted)
    assert got == sorted((str(d), len(t.encode()), len(ids_of(byte_level, t))) for d, t in rows_of(odd))


def test_packing_holds_every_id_once(odd, byte_level):
    pieces = packing.pack(odd, **BYTE_LEVEL).collect()
    documents, sequences = defaultdict(int), defaultdict(list)
    for p in pieces:
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length
        documents[str(p.doc_id)] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
    expected = defaultdict(int)
    for d, t in rows_of(odd):
        expected[str(d)] += len(ids_of(byte_level, t)) + 1
    assert documents == expected
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW


def test_cuts_cost_least():
    rng = np.random.default_rng(3)
    for _ in range(50):
        places = [0, *np.cumsum(rng.integers(1, 9, 12)).tolist()]
        costs = [0, *rng.integers(0, 6, 12).tolist()]
        window = 11
        best = {0: (0, [])}
        for j in range(1, len(places)):
            best[j] = min(
                (best[i][0] + window - (places[j] - places[i]) + costs[j], [*best[i][1], places[j]])
                for i in range(j)
                if i in best and places[j] - places[i] <= window
            )
        cuts = packing.choose_cuts(places, costs, window)
        end = places.index(cuts[-1])
        reach = [best[j][0] for j in range(1, len(places)) if places[-1] - places[j] < window]
        paid, at = 0, 0
        for c in cuts:
            paid += window - (c - at) + costs[places.index(c)]
            at = c
        assert paid == best[end][0] == min(reach)


def test_no_documents(no_documents):
    assert bpe.encode_decode(no_documents, WORDS).count() == 0
    assert packing.pack(no_documents, **BYTE_LEVEL).count() == 0
    assert token_counts.count_tokens(no_documents, **BYTE_LEVEL).count() == 0


def test_vocabularies_are_given_by_path():
    assert public_tokenizers.path("word_bpe_49k.json") == WORDS
