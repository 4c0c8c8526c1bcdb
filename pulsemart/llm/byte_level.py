"""Ids of a byte-level vocabulary, worked out once per distinct word."""

from __future__ import annotations

import base64
import functools
import re
import struct

import numpy as np

from .common import MEMO_ENTRIES, MEMO_LENGTH, pre_tokens

#: A word (with at most one blank or newline before it) of characters whose classes no two Unicode tables disagree on.
_PLAIN = re.compile("[ \n]?[\x21-\x7e\xa1-ɏ]+").fullmatch


#: A text of such characters, blanks and newlines alone: both encoders then cut it into the same words.
_PLAIN_TEXT = re.compile("[ \n\x21-\x7e\xa1-ɏ]*").fullmatch


class WordEncoder:
    """Encodes single words as the tokenizers library does.

    With `ranks` (the same vocabulary as a rank file) and its split `pattern`, words of plain characters are merged by
    the faster rank encoder, which gives the same ids: all words of a call are joined by newlines, which are pieces of
    their own, encoded at once and parted again.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(vocabulary)
        self._library.no_truncation()
        self._library.no_padding()
        self._special = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._fast = None
        if ranks is not None:
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
            self._newline = merges[b"\n"]

    def text(self, text: str) -> bytes | None:
        """Ids of a whole text of plain characters without special strings, by one call of the rank encoder, which cuts and
        merges it as the library does; None for all others."""
        if self._fast is None or not _PLAIN_TEXT(text) or any(s in text for s in self._special):
            return None
        return self._fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()

    def __call__(self, words: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word."""
        plain = []
        if self._fast is not None:
            plain = [i for i, w in enumerate(words) if _PLAIN(w)]
            plain = [i for i in plain if not any(s in words[i] for s in self._special)]
        out: list[bytes] = [b""] * len(words)
        if plain:
            ids = self._fast.encode_to_numpy("\n".join([words[i].lstrip("\n") for i in plain]))
            ends = [*np.flatnonzero(ids == self._newline).tolist(), len(ids)]
            data, start = ids.astype("<u4").tobytes(), 0
            newline = struct.pack("<I", self._newline)
            for i, end in zip(plain, ends, strict=True):
                out[i] = newline + data[start:end * 4] if words[i][0] == "\n" else data[start:end * 4]
                start = end * 4 + 4
        rest = sorted(set(range(len(words))).difference(plain))
        for i, e in zip(rest, self._library.encode_batch([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        return out


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers. Plain texts are encoded at once, others word by word;
    their words are remembered up to a bound."""

    def __init__(self, vocabulary: str, ranks: str | None = None, pattern: str | None = None):
        self._encode = WordEncoder(vocabulary, ranks, pattern)
        self._known: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = [self._encode.text(t) for t in texts]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(rest, self._by_words([texts[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def _by_words(self, texts: list[str]) -> list[bytes]:
        cut = [pre_tokens(t) for t in texts]
        if len(self._known) > MEMO_ENTRIES:
            self._known, self._old = {}, self._known
        known, old = self._known, self._old
        new = set().union(*cut).difference(known)
        known.update([(w, old[w]) for w in new if w in old])
        new = list(new.difference(old))
        known.update(zip(new, self._encode(new), strict=True))
        out = [b"".join([known[w] for w in words]) for words in cut]
        for w in new:
            if len(w) > MEMO_LENGTH:
                del known[w]
        return out


@functools.lru_cache(maxsize=2)
def word_encoder(vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> WordEncoder:
    """One for all tasks of a worker process."""
    return WordEncoder(vocabulary, ranks, pattern)
