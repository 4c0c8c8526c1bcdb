"""License notices in texts, exact and with a few edits."""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_or_empty

#: Phrases whose every occurrence, word for word, is counted, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices that are also found with edits, with their labels, in words as words() gives them.
NOTICES = {
    **PHRASES,
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "gnu general public license version": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "creative commons attribution": "cc",
    "licensed under cc by": "cc",
    "released into the public domain": "public domain",
}
#: One edit (a character put in, left out or exchanged) is allowed for so many characters of a notice.
CHARS_PER_EDIT = 10
#: Label words shorter than this must stand unedited, for one edit makes another word of them.
SHORT_WORD = 4

_SEPARATORS = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_TO_BLANK = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def words(text: str) -> list[bytes]:
    """Runs of digits, letters (A-Z lower-cased) and characters beyond ASCII."""
    return text.encode().lower().translate(_TO_BLANK).split()


@dataclass(frozen=True)
class Span:
    label: str
    start: int  # in words
    length: int  # in words
    edits: int
    likeness: float


class NoticeSearch:
    """Finds notices with up to len / CHARS_PER_EDIT edits.

    A notice for which k edits are allowed is split into k + 1 parts. Wherever it stands with k edits or fewer, at least
    one part is untouched, so exact hits of the parts (all found in one pass of an automaton) locate every candidate.
    Around a hit the regex library matches the notice with bounded errors, which verifies the edits and gives the span. A
    short word that is the label itself has to stand there unedited: in "kit license" nothing tells of the MIT license.
    """

    def __init__(self, notices: dict[str, str]):
        self.notices = []
        self.seeds = ahocorasick.Automaton()
        for i, (notice, label) in enumerate(notices.items()):
            edits = len(notice) // CHARS_PER_EDIT
            self.notices.append((label, len(notice), edits, _pattern(notice, label, edits)))
            bounds = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                known = self.seeds.get(notice[a:b], ())
                self.seeds.add_word(notice[a:b], (*known, (i, a, b)))
        self.seeds.make_automaton()

    def spans(self, text: str) -> list[Span]:
        """Spans in a text of words joined by single spaces, by start; those of one notice don't overlap."""
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, hits in self.seeds.iter(text):
            for i, a, b in hits:
                _, size, edits, _ = self.notices[i]
                start = last + 1 - b - edits - 1
                windows.setdefault(i, []).append((start, start + size + 2 * edits + 2))
        out = []
        for i, places in windows.items():
            label, size, allowed, pattern = self.notices[i]
            for start, end in _united(places):
                at, end = max(0, start), min(len(text), end)
                while m := pattern.search(text, at, end):
                    edits = sum(m.fuzzy_counts)
                    if edits > allowed:
                        # each run of words kept the bound, the whole does not: go on at the next word
                        at = text.find(" ", m.start(), end) + 1
                        if not at:
                            break
                        continue
                    first = text.count(" ", 0, m.start())
                    out.append(Span(label, first, m.group().count(" ") + 1, edits, 1 - edits / size))
                    at = m.end()
        return sorted(out, key=lambda s: (s.start, s.label, s.length))


def _pattern(notice: str, label: str, edits: int) -> regex.Pattern:
    """The notice between word ends, with edits in every run of words between those that have to stand as they are. The
    first match is taken and improved (not the best one of the rest of the window, which would pass over those before)."""
    runs: list[tuple[bool, list[str]]] = []
    for word in notice.split():
        fixed = len(word) < SHORT_WORD and word in label.split()
        if runs and runs[-1][0] == fixed:
            runs[-1][1].append(word)
        else:
            runs.append((fixed, [word]))
    texts = [(fixed, regex.escape(" ".join(run), literal_spaces=True)) for fixed, run in runs]
    body = " ".join(text if fixed else f"(?:{text}){{e<={edits}}}" for fixed, text in texts)
    return regex.compile(rf"(?e)(?<![^ ])(?:{body})(?![^ ])")


def _united(places: list[tuple[int, int]]) -> list[list[int]]:
    """Overlapping windows as one."""
    out: list[list[int]] = []
    for start, end in sorted(places):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def places(text: str, phrase: str) -> list[int]:
    """Word numbers at which the phrase stands in a text of words joined by single spaces."""
    padded, sought, out = f" {text} ", f" {phrase} ", []
    at = padded.find(sought)
    while at >= 0:
        out.append(padded.count(" ", 0, at))
        at = padded.find(sought, at + 1)
    return out


def scan_licenses(docs: DataFrame, notices: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """What each row of docs (doc_id, text) says about licenses.

    n_words; n_base, first_word, last_word and base_labels of the phrases that stand word for word; spans (label, start
    and length in words, edits, likeness) of notices with edits; labels of both; score, the likeness of the best span, 1
    where a phrase stands exactly and 0 where nothing was found.

    Whole texts are searched inside their scan task; nothing is shuffled. Null and empty texts have no words; first_word
    and last_word are null where no phrase stands. Each row is scanned on its own, rows of one doc_id or none included.
    Other columns of `docs` are not read; an empty table gives an empty result.
    """
    notices, phrases = notices or NOTICES, phrases or PHRASES
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches):
        search = NoticeSearch(notices)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                parts = words(text)
                normal = b" ".join(parts).decode()
                base = [(p, label) for phrase, label in phrases.items() for p in places(normal, phrase)]
                spans = search.spans(normal)
                exact = {label for _, label in base}
                starts = [p for p, _ in base]
                rows.append(
                    (
                        doc_id, len(parts), len(base), min(starts, default=None), max(starts, default=None),
                        ",".join(sorted(exact)), ",".join(sorted(exact | {s.label for s in spans})),
                        1.0 if base else max((s.likeness for s in spans), default=0.0), [vars(s) for s in spans],
                    )
                )
            yield {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")),
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label: string, start: long, length: long, edits: long, likeness: double>>",
    )
