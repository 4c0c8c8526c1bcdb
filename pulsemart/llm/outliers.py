"""Quality rules: robust multivariate outliers among text statistics, per language and source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, checkpoint, text_or_empty

#: Words a document needs, and the share of words in repeated three-word windows (percent) it may have.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Documents a group needs for an estimate of its own. Those of smaller groups are held against that of their whole
#: language, then of all documents, which is regularised where there are fewer than this even so.
MIN_GROUP = 200
#: Rows of sources or estimates that are sent to all tasks, about 300 bytes each.
FEW_GROUPS = 20_000
#: Share of a group's documents its estimate rests on.
CORE = 0.75
#: Rounds of choosing the closest documents and estimating again.
ROUNDS = 3
#: Squared distance beyond which a document is rejected; the median of the chi-squared law of FEATURES degrees that
#: distances are scaled to. No normal data lie beyond such a cutoff; text statistics have long tails and clean documents stay.
CUTOFF = 150.0
#: Statistics are kept as whole thousandths: sums are then exact and don't depend on the order of rows.
UNIT = 1000
#: Smallest spread of a statistic, in thousandths: nearly constant ones must not reject every other value.
FLOOR = 150
#: Distances (in steps of 1/64) are told apart up to this one when their quantiles are taken.
FARTHEST = 1 << 16

SYMBOLS = "#*$%&|<>"
FEATURES = ["log_words", "word_length", "symbol_share", "upper_share", "mark_share", "repeat_share"]
MEDIAN = 5.348  # of the chi-squared law of 6 degrees


def statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper and n_marks of the column text,
    base_failed (too few words, or too many of them in repeated windows) and the transformed statistics.

    Three-word windows are compared by 64-bit hashes, sorted inside the row so that equal ones are neighbours: n log n
    for a text of any length.
    """
    text = F.col("text")
    blanks = " \t\n\x0b\x0c\r"

    def count_of(characters: str) -> Column:
        return (F.col("n_chars_") - F.char_length(F.translate(text, characters, ""))).cast("long")

    lines = F.filter(F.split(text, "\n", -1), lambda line: F.char_length(F.translate(line, blanks, "")) > 0)
    out = docs.withColumns(
        {
            "words_": F.array_remove(F.split(text, f"[{BLANK}]+"), ""),
            "lines_": lines,
            "n_chars_": F.char_length(text),
        }
    ).withColumns(
        {
            "n_words": F.size("words_").cast("long"),
            "word_chars": F.char_length(F.translate(text, blanks, "")).cast("long"),
            "n_symbols": count_of(SYMBOLS),
            "n_upper": count_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            "n_marks": count_of("!?"),
            "n_dup_lines": (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"),
            "windows_": F.when(
                F.size("words_") >= 3,
                F.sort_array(
                    F.transform(
                        F.sequence(F.lit(0), F.size("words_") - 3),
                        lambda i: F.struct(
                            F.xxhash64(F.get("words_", i), F.get("words_", i + 1), F.get("words_", i + 2)).alias("h"),
                            i.alias("i"),
                        ),
                    )
                ),
            ),
        }
    )

    def repeated(window: Column, k: Column) -> Column:
        h, no = window["h"], F.lit(False)
        before, after = F.get("windows_", k - 1)["h"], F.get("windows_", k + 1)["h"]
        return F.coalesce(h == before, no) | F.coalesce(h == after, no)

    starts = F.transform(F.filter("windows_", repeated), lambda w: w["i"])
    covered = F.array_distinct(F.flatten(F.transform("starts_", lambda i: F.array(i, i + 1, i + 2))))
    return (
        out.withColumn("starts_", starts)
        .withColumn("n_repeat_words", F.coalesce(F.array_size(covered), F.lit(0)).cast("long"))
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED),
        )
        .drop("words_", "lines_", "n_chars_", "windows_", "starts_")
        .withColumns(_features())
    )


def _features() -> dict[str, Column]:
    """Transformed statistics in thousandths: logarithms of counts, roots of shares (which evens out their spread)."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    values = {
        "log_words": F.log(words),
        "word_length": F.log(chars / words) * 2,
        "symbol_share": F.sqrt(F.col("n_symbols") / chars) * 4,
        "upper_share": F.sqrt(F.col("n_upper") / chars) * 4,
        "mark_share": F.sqrt(F.col("n_marks") / chars) * 4,
        "repeat_share": F.sqrt(F.col("n_repeat_words") / words) * 2,
    }
    return {name: F.round(v * UNIT).cast("long") for name, v in values.items()}


def _bin(squared: Column) -> Column:
    return F.least(F.floor(F.sqrt(squared) * 64), F.lit(FARTHEST)).cast("long")


def _closest(rows: DataFrame) -> DataFrame:
    """group, edge (bin of the CORE quantile of distances), scale (of squared distances, to the chi-squared median)."""
    middle = F.pow((F.col("mid") + 0.5) / 64, 2)
    return (
        rows.withColumn("bin", _bin(F.col("squared")))
        .groupBy("group")
        .agg(F.count("*").alias("n"), F.percentile("bin", F.lit(CORE)).alias("edge"), F.percentile("bin", F.lit(0.5)).alias("mid"))
        .withColumn("scale", F.lit(MEDIAN) / middle)
        # the median of a few documents, copies perhaps, must not undo the smallest spread
        .select("group", "edge", F.when(F.col("n") < MIN_GROUP, F.least("scale", F.lit(1.0))).otherwise(F.col("scale")).alias("scale"))
    )


def _first_distance() -> Column:
    """Squared distance from the medians in units of the absolute deviations."""
    return reduce(lambda a, b: a + b, [F.pow((F.col(f) - F.col(f"mid_{f}")) / F.col(f"dev_{f}"), 2) for f in FEATURES])


def _covariance(rows: DataFrame) -> DataFrame:
    """group and the Cholesky factor (l_i_j) and means (mean_i) of the rows of each group, from exact sums.

    Covariances of a core of fewer documents than that of a group of MIN_GROUP shrink towards 0, the more the fewer.
    """
    p = range(len(FEATURES))
    sums = [F.sum(F.col(FEATURES[i]).cast("decimal(19,0)")).alias(f"s_{i}") for i in p]
    squares = [
        F.sum((F.col(FEATURES[i]) * F.col(FEATURES[j])).cast("decimal(19,0)")).alias(f"s_{i}_{j}") for i in p for j in p if j <= i
    ]
    out = rows.groupBy("group").agg(F.count("*").alias("n"), *sums, *squares)
    out = out.withColumns({f"mean_{i}": F.col(f"s_{i}").cast("double") / F.col("n") for i in p})
    shrunk = F.least(F.col("n") / F.lit(MIN_GROUP * CORE), F.lit(1.0))
    out = out.withColumns(
        {
            f"c_{i}_{j}": (F.col(f"s_{i}_{j}").cast("double") / F.col("n") - F.col(f"mean_{i}") * F.col(f"mean_{j}"))
            * (F.lit(1.0) if i == j else shrunk)
            + F.lit(float(FLOOR * FLOOR if i == j else 0))
            for i in p
            for j in p
            if j <= i
        }
    )
    for j in p:  # column by column; each needs the ones before it
        done = reduce(lambda a, b: a - b, [F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)], F.col(f"c_{j}_{j}"))
        out = out.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(done, F.lit(1.0))))
        out = out.withColumns(
            {
                f"l_{i}_{j}": reduce(
                    lambda a, b: a - b, [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)], F.col(f"c_{i}_{j}")
                )
                / F.col(f"l_{j}_{j}")
                for i in p
                if i > j
            }
        )
    return out.select("group", *[f"mean_{i}" for i in p], *[f"l_{i}_{j}" for i in p for j in p if j <= i])


def _with_distance(rows: DataFrame) -> DataFrame:
    """Adds `squared`, the squared Mahalanobis distance, by forward substitution with the Cholesky factor."""
    for i, f in enumerate(FEATURES):
        rest = reduce(
            lambda a, b: a - b, [F.col(f"l_{i}_{k}") * F.col(f"y_{k}") for k in range(i)], F.col(f) - F.col(f"mean_{i}")
        )
        rows = rows.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))
    return rows.withColumn("squared", reduce(lambda a, b: a + b, [F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(len(FEATURES))]))


def groups(found: DataFrame) -> DataFrame:
    """lang, source, group (which estimate the documents of each language and source are held against) and feeds (which
    estimates those that pass the base rules go into). The estimate of a language or of all is of all its documents, and
    is only made where a smaller group needs it."""
    passing = F.sum((~F.col("base_failed")).cast("long"))
    counts = checkpoint(found.groupBy("lang", "source").agg(passing.alias("n")))
    small = F.col("n") < MIN_GROUP
    pools = counts.groupBy(F.col("lang").alias("pool")).agg(F.sum("n").alias("pooled"), F.max(small).alias("needed"))
    pools = checkpoint(pools.withColumn("few", F.col("pooled") < MIN_GROUP))
    last = bool(pools.agg(F.max("few")).first()[0])
    own = F.concat(F.lit("source "), F.to_json(F.struct("lang", "source")))
    whole = F.concat(F.lit("language "), F.to_json(F.struct("lang")))
    every = F.lit("all")
    feeds = [F.when(~small, own), F.when(F.col("needed") & ~F.col("few"), whole), F.when(F.lit(last), every)]
    return counts.join(pools, F.col("lang").eqNullSafe(F.col("pool"))).select(
        "lang",
        "source",
        F.when(~small, own).when(~F.col("few"), whole).otherwise(every).alias("group"),
        F.array_compact(F.array(*feeds)).alias("feeds"),
    )


def _small(rows: DataFrame) -> DataFrame:
    """Hinted for a broadcast while there are few enough; more sources than that are left to a shuffled join."""
    return F.broadcast(rows) if rows.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else rows


def _placed(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """rows with their group and feeds."""
    known = by_source.select(F.col("lang").alias("lang_"), F.col("source").alias("source_"), "group", "feeds")
    same = F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_"))
    return rows.join(_small(known), same, "left").drop("lang_", "source_")


def estimates(found: DataFrame, by_source: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimate (means, Cholesky factor, scale) of each group.

    Starts from medians and absolute deviations, then ROUNDS times takes the CORE share of documents that is closest and
    estimates means and covariances from it. Squared distances are scaled so that their median is that of the
    chi-squared law. Each small table of estimates is checkpointed, since the next one uses it twice.
    """
    rows = _placed(found.filter("NOT base_failed"), by_source)
    rows = checkpoint(rows.select(F.explode("feeds").alias("group"), *FEATURES))
    middle = checkpoint(rows.groupBy("group").agg(*[F.percentile(f, F.lit(0.5)).alias(f"mid_{f}") for f in FEATURES]))
    away = rows.join(middle, "group").select("group", *[F.abs(F.col(f) - F.col(f"mid_{f}")).alias(f) for f in FEATURES])
    spread = away.groupBy("group").agg(
        *[F.greatest(F.percentile(f, F.lit(0.5)) * 1.4826, F.lit(float(FLOOR))).alias(f"dev_{f}") for f in FEATURES]
    )
    start = checkpoint(middle.join(spread, "group"))
    measured = rows.join(start, "group").withColumn("squared", _first_distance()).select("group", *FEATURES, "squared")
    for _ in range(ROUNDS):
        edges = checkpoint(_closest(measured))
        core = measured.join(edges, "group").filter(_bin(F.col("squared")) <= F.col("edge"))
        current = checkpoint(_covariance(core))
        measured = _with_distance(rows.join(current, "group")).select("group", *FEATURES, "squared")
    return checkpoint(current.join(_closest(measured).select("group", "scale"), "group"))


def judged(found: DataFrame, by_source: DataFrame, estimated: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """found with `distance` (scaled and squared; null only where no document at all passes the base rules) and `kept`."""
    rows = _with_distance(_placed(found, by_source).drop("feeds").join(_small(estimated), "group", "left"))
    distance = F.col("squared") * F.col("scale")
    # one comparison of both verdicts: alone, the base rules would be pushed down as a filter that repeats their work
    worst = F.greatest(F.col("base_failed").cast("double") * 1e300, F.coalesce("distance", F.lit(0.0)))
    kept = worst <= cutoff
    return rows.withColumn("distance", distance).withColumn("kept", kept).select(*found.columns, "distance", "kept")


def verdicts(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed, distance and kept for each row of docs (doc_id, text, lang, source).

    Built-in functions throughout. All that crosses the cluster are sums and counts of distances per group, reduced
    map-side, so a group with a third of all documents is no problem. Sums are of whole numbers and quantiles are exact
    over bins: results don't depend on partitioning. Statistics are written once (checkpoint), texts never.

    Null texts are empty ones and fail the base rules; a null language or source is a value of its own. Each row is
    judged on its own text, rows of one doc_id or none included. Other columns of `docs` are not read; an empty table
    gives an empty result.
    """
    found = checkpoint(statistics(docs.select("doc_id", "lang", "source", text_or_empty().alias("text"))).drop("text"))
    by_source = checkpoint(groups(found))
    return judged(found, by_source, estimates(found, by_source), cutoff)


def keep_good(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs that verdicts() keeps, with all their columns. Statistics are worked out twice so that no text is
    shuffled or written: once for the estimates, once for the verdict."""
    names = docs.columns
    source = docs.select(F.struct(*[F.col(c) for c in names]).alias("row_"), "lang", "source", text_or_empty().alias("text"))
    found = statistics(source)
    kept_facts = checkpoint(found.select("lang", "source", "base_failed", *FEATURES))
    by_source = checkpoint(groups(kept_facts))
    rows = judged(found, by_source, estimates(kept_facts, by_source), cutoff).filter("kept")
    return rows.select(*[F.col("row_")[c].alias(c) for c in names])


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
