"""Order-preserving packing of documents into token sequences of bounded length."""

from __future__ import annotations

import functools
import json
import zlib
from collections import deque

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_level import Encoder
from .common import map_batches, text_or_empty

#: Tokens of a sequence at most.
WINDOW = 2048
#: Cost of a cut, in tokens of padding, after the last token of a sentence, and anywhere else inside a document.
SENTENCE_CUT, WORD_CUT = 8, 32
#: Inside longer stretches without a sentence end, every so many tokens may be cut at.
STRETCH = 64
#: Tokens that are gathered before cuts are chosen.
BLOCK = 32 * WINDOW

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
)


def choose_cuts(places: list[int], costs: list[int], window: int = WINDOW) -> list[int]:
    """Places to cut a run of tokens at so that padding plus the costs of the cuts is least.

    `places` are the allowed cuts, ascending and at most `window` apart, the first of them the start of the run; costs
    go with them. The total of a way that ends at place j is
        best[j] = costs[j] + min over i with places[j] - places[i] <= window of best[i] + window - (places[j] - places[i]).
    With best[i] + places[i] in a queue that is kept ascending, the least of the window stands in front, so each place
    enters and leaves once. The run may go on behind the last place: of the places less than a window before it, the one
    with the least total ends the way, and the rest stays for the next run. Ties take the later place.
    """
    best, back = [0] * len(places), [0] * len(places)
    queue: deque[tuple[int, int]] = deque([(places[0], 0)])
    for j in range(1, len(places)):
        at = places[j]
        while places[queue[0][1]] < at - window:
            queue.popleft()
        least, i = queue[0]
        best[j] = total = costs[j] + window - at + least
        back[j] = i
        key = total + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    last = len(places) - 1
    j = last
    for k in range(last - 1, 0, -1):
        if places[last] - places[k] >= window:
            break
        if best[k] < best[j]:
            j = k
    cuts = []
    while j:
        cuts.append(places[j])
        j = back[j]
    return cuts[::-1]


class Packer:
    """Takes encoded documents in order and gives the pieces of full sequences."""

    def __init__(self, first_sequence: int, sentence_end: np.ndarray, window: int = WINDOW, keep_ids: bool = False):
        self.sequence, self.window, self.sentence_end, self.keep_ids = first_sequence, window, sentence_end, keep_ids
        self.docs: deque[tuple[object, int, np.ndarray, int]] = deque()  # id, ids before, ids left, ids of the document
        self.tokens = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, ids, len(ids)))
        self.tokens += len(ids)

    def places(self) -> tuple[list[int], list[int]]:
        """Where the documents held may be cut, and what each cut costs: nothing at document ends, SENTENCE_CUT at sentence
        ends, and WORD_CUT at every STRETCH tokens of a document that goes on for longer without one."""
        sizes = np.array([len(ids) for _, _, ids, _ in self.docs])
        ids = np.concatenate([ids for _, _, ids, _ in self.docs])
        n, ends = len(ids), np.cumsum(sizes)
        cost = np.full(n + 1, -1)
        cost[1:][self.sentence_end[ids]] = SENTENCE_CUT
        cost[ends], cost[0] = 0, 0
        marks = np.flatnonzero(cost >= 0)
        gaps = np.flatnonzero(np.diff(marks) > STRETCH)
        if len(gaps):
            long_ones = np.zeros(len(sizes), bool)
            long_ones[np.searchsorted(ends, marks[gaps], "right")] = True
            place = np.arange(n) - np.repeat(ends - sizes, sizes)
            spots = np.repeat(long_ones, sizes) & (place % STRETCH == 0) & (cost[:n] < 0)
            cost[:n][spots] = WORD_CUT
            marks = np.flatnonzero(cost >= 0)
        return marks.tolist(), cost[marks].tolist()

    def flush(self, end: bool) -> list[tuple]:
        """Pieces of the sequences chosen so far; at the end of the input, of all that is left."""
        out: list[tuple] = []
        while self.docs:
            cuts = choose_cuts(*self.places(), self.window)
            done = 0
            for cut in cuts:
                out += self._take(cut - done)
                done = cut
            if not end:
                break
        return out

    def _take(self, length: int) -> list[tuple]:
        out, offset = [], 0
        while offset < length:
            doc_id, start, ids, total = self.docs.popleft()
            piece = ids[: length - offset]
            data = np.ascontiguousarray(piece, "<u4")
            out.append(
                (doc_id, start, len(piece), zlib.crc32(data), total, self.sequence, offset, piece if self.keep_ids else None)
            )
            offset += len(piece)
            if len(piece) < len(ids):
                self.docs.appendleft((doc_id, start + len(piece), ids[len(piece) :], total))
        self.tokens -= length
        self.sequence += 1
        return out


@functools.lru_cache(maxsize=2)
def sentence_ends(vocabulary: str) -> np.ndarray:
    """Flags the tokens that can end a sentence: their text ends with a full stop, a mark of its kind, or a newline."""
    with open(vocabulary, encoding="utf-8") as f:
        loaded = json.load(f)
    flags = np.zeros(max([*loaded["model"]["vocab"].values(), *(t["id"] for t in loaded["added_tokens"])]) + 1, bool)
    for token, i in loaded["model"]["vocab"].items():
        flags[i] = token[-1] in ".!?Ċ"  # the last is how byte-level vocabularies spell a newline
    return flags


def pack(
    docs: DataFrame,
    vocabulary: str,
    ranks: str | None = None,
    pattern: str | None = None,
    end_id: int = 1,
    window: int = WINDOW,
    keep_ids: bool = True,
) -> DataFrame:
    """Pieces (see SCHEMA) of sequences of at most `window` tokens: each document's ids and `end_id`, whole and in order.

    Documents keep the order in which each input split stores them; sequences never run across splits, so nothing is
    shuffled and a lost task is done again alone. A document longer than a window goes through several sequences. Cuts
    between sequences stand at document or sentence ends wherever that costs less than WORD_CUT tokens of padding. A
    sequence id is the number of the split and the place of the sequence in it. Memory is bounded by a block of tokens
    plus one batch of documents.

    A null or empty text is the end id alone. Rows are packed each on its own, rows of one doc_id or of none included.
    Other columns of `docs` are not read; an empty table gives an empty result.
    """

    def run(batches):
        encode, ends = Encoder(vocabulary, ranks, pattern), sentence_ends(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 40, ends, window, keep_ids)
        stop = np.array([end_id], "<u4").tobytes()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

        def shown(pieces):
            return {n: list(c) for n, c in zip(names, zip(*pieces, strict=True), strict=True)}

        for batch in batches:
            texts = batch["text"]
            for k in range(0, len(texts), 64):
                some = texts[k : k + 64]
                for doc_id, data in zip(batch["doc_id"][k : k + 64], encode(some), strict=True):
                    packer.add(doc_id, np.frombuffer(data + stop, "<u4"))
                if packer.tokens >= BLOCK and (pieces := packer.flush(False)):
                    yield shown(pieces)
        if pieces := packer.flush(True):
            yield shown(pieces)

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, SCHEMA)
