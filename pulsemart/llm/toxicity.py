"""Toxicity scores from weak supervision: many voters, a label model over them, a linear classifier on its labels."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, checkpoint, map_batches, ship_package, text_or_empty

#: Insults as any word list of moderation tools has them: voters before anything is learned.
INSULTS = """
asshole bastard bitch clown coward creep cretin disgusting dumb dumbass filth fool freak garbage hate hideous idiot
idiotic ignorant imbecile jerk kill liar loser lunatic moron moronic nasty parasite pathetic pervert pig rat retard
scum shit sick slut stupid sucker swine thug trash ugly vermin vile whore worthless
""".split()
#: Ways to address an insult, voters too: a pattern over the lower-cased text.
ADDRESSED = {
    "you are a": r"\byou(?:'re| are) (?:such )?an? \w+",
    "shut up": r"\b(?:shut up|get lost|go away|drop dead)\b",
    "people like you": r"\b(?:people|someone) like you\b",
}
#: Labelled documents that the label model and the classifier are fitted on: all of them up to this bound, then those of
#: the smallest id hashes. Patterns are counted in all labelled documents.
MAX_TRAINING = 20_000
#: Labels of so many documents are sent to all tasks at most, and joined by a shuffle beyond.
FEW_LABELS = 500_000
#: Patterns a task counts before it passes them on, and letters of a whole word that are kept beside its hash.
MAX_COUNTED, WORD_CHARS = 200_000, 40
#: Voters found in labelled documents (words and word beginnings that stand almost only in toxic ones) at most.
MAX_VOTERS = 512
#: A found voter stands in so many toxic documents at least, with this smoothed share of all documents that hold it.
MIN_SUPPORT, MIN_PRECISION = 4, 0.75
#: Lengths of word beginnings.
BEGINNINGS = range(3, 11)
THRESHOLD = 0.7
#: Accuracy the label model ascribes to given labels.
GIVEN = 0.9

_WORD = re.compile(r"[^\W\d_]+")


def patterns_of(word: str) -> list[str]:
    """A word (marked as whole; a long one by its start and hash) and its beginnings."""
    whole = word
    if len(word) > WORD_CHARS:
        whole = f"{word[:WORD_CHARS]}#{hashlib.blake2b(word.encode('utf-8', 'replace'), digest_size=16).hexdigest()}"
    return [f"{whole}$", *(word[:k] for k in BEGINNINGS if k <= len(word))]


def in_training_fold(doc_id):
    return F.crc32(doc_id.cast("string")) % 3 != 1


def _distinct_words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """A model from docs (doc_id, text) and labels (doc_id, toxic): voters, weights and a scale.

    Only labels of the training fold are read. Frequencies of patterns by class are counted in Spark over all of them;
    the driver gets the best MAX_VOTERS patterns and the votes on MAX_TRAINING documents, both bounded. A found voter that
    those documents hardly show is weighted by its counts: alone it scores its smoothed share of toxic documents.
    """
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & in_training_fold(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    few = known.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    labelled = texts.join(F.broadcast(known) if few else known, "doc_id").drop("doc_id")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAINING)
    chosen = texts.join(F.broadcast(sample), "doc_id").drop("doc_id")  # at most MAX_TRAINING rows of two numbers

    def count(batches):
        number, toxic, patterns = Counter(), Counter(), Memo(lambda w: tuple(patterns_of(w)))

        def counted():
            return {"pattern": list(number), "t": [toxic[p] for p in number], "n": list(number.values())}

        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"], strict=True):
                found = set().union(*map(patterns.__getitem__, _distinct_words(text)))
                number.update(found)
                if label:
                    toxic.update(found)
                if len(number) >= MAX_COUNTED:
                    yield counted()
                    number, toxic = Counter(), Counter()
        yield counted()

    counts = (
        map_batches(labelled, count, "pattern string, t long, n long")
        .groupBy("pattern")
        .agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
        .filter((F.col("t") >= MIN_SUPPORT) & (F.col("t") >= MIN_PRECISION * (F.col("n") + 1)))
    )
    best = _shortest(checkpoint(counts)).orderBy(F.desc("t"), F.length("pattern"), "pattern").limit(MAX_VOTERS).collect()
    voters = [f"{w}$" for w in INSULTS] + [r.pattern for r in best]
    voters = list(dict.fromkeys(voters))
    voter = Voter(voters)

    def vote(batches):
        for batch in batches:
            yield {"votes": [voter(t) for t in batch["text"]], "toxic": batch["toxic"]}

    rows = map_batches(chosen, vote, "votes array<int>, toxic int").collect()
    votes = np.zeros((len(rows), len(voter)), np.float32)
    for i, row in enumerate(rows):
        votes[i, row.votes] = 1
    toxic = np.array([r.toxic for r in rows], np.float64)
    posterior = label_model(votes, toxic)
    weights, bias = linear_fit(votes, posterior)
    margin = votes @ weights + bias
    slope, shift = scale_fit(margin, toxic)
    weights, bias = weights * slope, float(bias * slope + shift)
    shown, number = votes.sum(axis=0), {p: i for i, p in enumerate(voters)}
    for r in best:
        if shown[number[r.pattern]] < MIN_SUPPORT:
            share = r.t / (r.n + 1)
            weights[number[r.pattern]] = np.log(share / (1 - share)) - bias
    return {"voters": voters, "weights": weights.tolist(), "bias": bias}


def _shortest(counts: DataFrame) -> DataFrame:
    """counts (pattern, others) without patterns of which a beginning is there too: it stands in as many documents."""
    stem = F.regexp_replace("pattern", r"\$$", "")
    starts = F.array(*[F.substring(stem, 1, k) for k in BEGINNINGS])
    longer = (
        counts.select("pattern", F.explode(F.array_distinct(starts)).alias("start"))
        .filter((F.col("start") != F.col("pattern")) & (F.length("start") >= BEGINNINGS[0]))
        .join(counts.select(F.col("pattern").alias("start")), "start")
        .select("pattern")
    )
    return counts.join(longer, "pattern", "left_anti")


class Voter:
    """Numbers of the voters that find something in a text."""

    def __init__(self, voters: list[str]):
        self.voters = {p: i for i, p in enumerate(voters)}
        self.addressed = [re.compile(p) for p in ADDRESSED.values()]
        self._words: Memo | None = None

    def __len__(self) -> int:
        return len(self.voters) + len(self.addressed)

    def __getstate__(self):
        return {"voters": self.voters, "addressed": self.addressed, "_words": None}

    def __call__(self, text: str) -> list[int]:
        if self._words is None:
            voters = self.voters
            self._words = Memo(lambda w: tuple(voters[p] for p in patterns_of(w) if p in voters))
        words = self._words
        found = {i for w in _distinct_words(text) for i in words[w]}
        lowered = text.lower()
        found.update(len(self.voters) + k for k, p in enumerate(self.addressed) if p.search(lowered))
        return sorted(found)


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior probability of the label for each row of votes (1: votes for toxic, 0: abstains).

    A generative model: given the label, voter j votes with rate[label, j]. EM estimates the rates (the accuracies) and
    the prior. The given label is one more voter, of fixed accuracy GIVEN: it anchors voters that seldom meet others,
    such as those of a language with few documents, and can be outvoted. Voters agree more than the label explains, e.g.
    beginnings of one word; their residual correlations are estimated in each round, and a voter's evidence is divided
    by how many voters it stands for.
    """
    n, m = votes.shape
    if not n:
        return np.zeros(0)
    anchor = np.where(given > 0, 1, -1) * np.log(GIVEN / (1 - GIVEN))
    posterior = np.where(given > 0, GIVEN, 1 - GIVEN)
    for _ in range(rounds):
        weight = np.stack([1 - posterior, posterior]).astype(np.float32)
        total = weight.sum(axis=1, keepdims=True)
        rate = (weight @ votes + np.array([[0.02], [1.0]], np.float32)) / (total + 2.0)
        rate = np.clip(rate, 1e-5, 1 - 1e-5)
        residual = votes - weight.T @ rate
        residual /= np.sqrt((residual**2).sum(axis=0)) + 1e-6
        shared = np.clip(residual.T @ residual, 0, 1)
        np.fill_diagonal(shared, 1)
        evidence = (np.log(rate[1] / rate[0]) / shared.sum(axis=1)).astype(np.float32)
        silence = (np.log((1 - rate[1]) / (1 - rate[0])) / shared.sum(axis=1)).astype(np.float32)
        share = min(max(posterior.mean(), 1e-3), 0.5)
        odds = anchor + np.log(share / (1 - share)) + votes @ (evidence - silence) + silence.sum()
        new = 1 / (1 + np.exp(-np.clip(odds.astype(np.float64), -30, 30)))
        done = np.abs(new - posterior).max() < 1e-4
        posterior = new
        if done:
            break
    return posterior


def linear_fit(x: np.ndarray, target: np.ndarray, rounds: int = 300, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps; weights below 0 make no sense for votes."""
    n, m = x.shape
    w, bias, before, before_bias = np.zeros(m, np.float32), -2.0, np.zeros(m, np.float32), -2.0
    if not n:
        return w + 4, bias
    step = np.float32(4 / (1 + (x.sum(axis=1) ** 2).mean() ** 0.5))
    for k in range(rounds):
        ahead = w + k / (k + 3) * (w - before)
        ahead_bias = bias + k / (k + 3) * (bias - before_bias)
        wrong = (1 / (1 + np.exp(-(x @ ahead + ahead_bias)))) - target
        before, before_bias = w, bias
        w = np.maximum(ahead - step * ((wrong @ x / n).astype(np.float32) + penalty * ahead / 10), 0)
        bias = float(ahead_bias - step * wrong.mean())
    return w, bias


def scale_fit(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift that fit margins to labels (a logistic curve, with one doc of each class put in on either side)."""
    if not len(label):
        return 1.0, 0.0
    x = np.concatenate([margin, [margin.max(), margin.min()]]).astype(np.float64)
    y = np.concatenate([label, [1, 0]])
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        g = np.array([((p - y) * x).sum() + 1e-2 * (slope - 1), (p - y).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * x * x).sum() + 1e-2, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, shift = max(slope - move[0], 0.05), shift - move[1]
    return float(slope), float(shift)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (0 to 1) of each row of docs (doc_id, text); only the whole text counts.

    Nothing is shuffled. Null and empty texts get the score of a text on which no voter votes. Each row is scored on its
    own, rows of one doc_id or none included.
    """
    voter, weights, bias = Voter(model["voters"]), np.array(model["weights"]), model["bias"]

    def run(batches):
        for batch in batches:
            odds = np.array([bias + weights[voter(t)].sum() for t in batch["text"]], np.float64)
            yield {"doc_id": batch["doc_id"], "score": (1 / (1 + np.exp(-np.clip(odds, -30, 30)))).tolist()}

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, "doc_id long, score double"
    )


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text), learned from labels (doc_id, toxic).

    Without any label of the training fold the score rests on the word list alone. A row without doc_id is never held
    out of anything: it has no label and held_out is false. Other columns are not read; an empty table gives an empty
    result.
    """
    scored = score(docs, train(docs, labels))
    held_out = F.coalesce(~in_training_fold(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, others), all columns, whose score stays below THRESHOLD."""
    from pyspark.sql.pandas.functions import pandas_udf

    ship_package(docs.sparkSession)
    model = train(docs, labels)
    voter, weights, bias = Voter(model["voters"]), np.array(model["weights"]), model["bias"]
    limit = np.log(THRESHOLD / (1 - THRESHOLD))

    @pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series([bias + weights[voter(t)].sum() < limit for t in text], dtype=bool)

    return docs.filter(clean(text_or_empty()))
