"""Encoding and decoding with a word-end BPE vocabulary, cut at byte pairs that no token holds."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_batches, text_or_empty


def inner_pairs(tokens: list[str], word_end: str) -> set[str]:
    """Pairs of neighbouring bytes (in the vocabulary's one-character-a-byte spelling) inside any token."""
    pairs = set()
    for token in tokens:
        token = token.removesuffix(word_end)
        pairs.update(token[i : i + 2] for i in range(len(token) - 1))
    return pairs


def byte_spelling() -> dict[str, str]:
    """The character that spells each byte (given as a Latin-1 character) in byte-level vocabularies.

    Printable bytes spell themselves; the others take the characters from U+0100 on, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): chr(b) for b in shown} | {chr(b): chr(0x100 + i) for i, b in enumerate(hidden)}


#: Words of characters that no normal form and no Unicode table changes, where the library's steps have a short form:
#: normalising is lower-casing, and letters alone are one pre-token.
_PLAIN = re.compile("[\x21-\x7e\xa1-ɏ]+").fullmatch


class Codec:
    """Ids of a text, fragment by fragment.

    A merge makes a token out of two neighbours, so two bytes that stand side by side in no token are never merged:
    between them a cut is certain, and what lies left and right is encoded alone. White space is in no token, hence the
    first cuts; words are normalised and split into pre-tokens by the library and cut further at all other such pairs.
    Only the last fragment of a pre-token carries the word-end suffix. Fragments are merged by the library's own model,
    once with and once without the suffix, and remembered up to a bound.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, models

        self._library = Tokenizer.from_file(vocabulary)
        self._library.no_truncation()
        self._library.no_padding()
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._special = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._pairs = inner_pairs(list(model["vocab"]), model["end_of_word_suffix"])
        inner = models.BPE(vocab=model["vocab"], merges=merges)
        last = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=model["end_of_word_suffix"])
        self._shown = {i: (f" {i}", f" {t}") for t, i in self._library.get_vocab(with_added_tokens=True).items()}
        self._letters = {ord(b): c for b, c in byte_spelling().items()}
        self._inner = Memo(lambda s: self._show([t.id for t in inner.tokenize(s)]))
        self._last = Memo(lambda s: self._show([t.id for t in last.tokenize(s)]))
        self._words = Memo(self._word)

    def _show(self, ids: list[int]) -> tuple[str, str]:
        shown = [self._shown[i] for i in ids]
        return "".join([s[0] for s in shown]), "".join([s[1] for s in shown])

    def fragments(self, pre_token: str) -> list[str]:
        pairs, start, out = self._pairs, 0, []
        for i in range(1, len(pre_token)):
            if pre_token[i - 1 : i + 1] not in pairs:
                out.append(pre_token[start:i])
                start = i
        return [*out, pre_token[start:]]

    def pre_tokens(self, word: str) -> list[str]:
        if _PLAIN(word):
            normal = word.lower()
            if normal.isalpha():
                return [normal if normal.isascii() else normal.encode().decode("latin-1").translate(self._letters)]
        else:
            normal = self._library.normalizer.normalize_str(word)
        return [p for p, _ in self._library.pre_tokenizer.pre_tokenize_str(normal)]

    def _word(self, word: str) -> tuple[str, str]:
        if any(s in word for s in self._special):
            return self._show(self._library.encode(word, add_special_tokens=False).ids)
        parts = []
        for pre_token in self.pre_tokens(word):
            *inner, last = self.fragments(pre_token)
            parts += [self._inner[f] for f in inner]
            parts.append(self._last[last])
        if len(parts) == 1:
            return parts[0]
        return "".join([p[0] for p in parts]), "".join([p[1] for p in parts])

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids as decimals joined by spaces, the decoded text."""
        words = self._words
        parts = [words[w] for w in text.replace("\n", " ").split(" ")]
        ids = "".join([p[0] for p in parts])
        return ids.count(" "), ids[1:], "".join([p[1] for p in parts])[1:]


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimals joined by spaces), decoded for each row of docs (doc_id, text).

    For vocabularies without a decoder, whose decoded text is the tokens joined by spaces. Each row is encoded on its
    own inside its scan task; nothing is shuffled. Null and empty texts have no ids and decode to the empty text.
    """
    return _apply(docs, vocabulary, lambda n, ids, text: (ids, text), "ids", "decoded")


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """As encode_decode(), with SHA-256 digests in place of ids and text, so that neither leaves its task."""

    def digest(n: int, ids: str, text: str) -> tuple[str, str]:
        return hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _apply(docs, vocabulary, digest, "ids_sha256", "decoded_sha256")


def _apply(docs: DataFrame, vocabulary: str, show: Callable, first: str, second: str) -> DataFrame:
    def run(batches):
        codec = Codec(vocabulary)
        for batch in batches:
            out = {"doc_id": batch["doc_id"], "n_tokens": [], first: [], second: []}
            for text in batch["text"]:
                n, ids, decoded = codec.encode(text)
                a, b = show(n, ids, decoded)
                out["n_tokens"].append(n)
                out[first].append(a)
                out[second].append(b)
            yield out

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")),
        run,
        f"doc_id long, n_tokens long, {first} string, {second} string",
    )
