"""How far the sources of a language diverge in their words, each distinct text read once."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_package, stored, text_or_empty

#: Probabilities are whole numbers out of this.
ONE = 1_000_000_000
#: Terms that a task counts before it hands them on.
HELD = 400_000
#: Rows (texts with copies, groups of a language and source) up to this number are sent to all tasks; more are joined by
#: a shuffle.
FEW = 200_000
#: Sources of one block, and (term, source) rows of one task when pairs are evaluated, about.
BLOCK_SOURCES, BLOCK_ROWS = 64, 50_000

#: A-Z to a-z; letters and whatever is beyond ASCII stay, all else becomes a blank.
_TERMS = bytes(
    c if c >= 0x80 or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256)
)


def terms(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters and characters beyond ASCII, A-Z lower-cased, in UTF-8."""
    return text.encode().translate(_TERMS).split()


def _sent(rows: DataFrame) -> DataFrame:
    """rows, broadcast where there are few."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def _key() -> list[Column]:
    """128 bits of the text in two longs: equal for no two texts of any corpus one could hold."""
    return [F.xxhash64("text").alias("a"), F.xxhash64(F.lit("text"), "text", F.length("text")).alias("b")]


def distinct_texts(rows: DataFrame) -> DataFrame:
    """lang, text, sources [(source, n)]: each distinct text of a language with its number of rows in each source, from
    rows (lang, source, text) without nulls.

    Hashes are counted first, map-side sums before the shuffle. A text that stands once goes on from where it is read;
    only texts that stand more often are shuffled, after each task has dropped its own repeats.
    """
    keyed = rows.select("lang", "source", "text", *_key())
    counted = keyed.groupBy("lang", "a", "b", "source").agg(F.count("*").alias("n"))
    copied = stored(
        counted.groupBy("lang", "a", "b")
        .agg(F.collect_list(F.struct("source", "n")).alias("sources"), F.sum("n").alias("rows"))
        .filter("rows > 1")
        .drop("rows")
    )
    known, key = _sent(copied), ["lang", "a", "b"]
    once = F.array(F.struct("source", F.lit(1).cast("long").alias("n")))
    single = keyed.join(known.select(*key), key, "left_anti").select("lang", "text", once.alias("sources"))
    more = (
        keyed.join(known.select(*key), key, "left_semi")
        .groupBy(*key)
        .agg(F.first("text").alias("text"))
        .join(known, key)
        .select("lang", "text", "sources")
    )
    return single.unionByName(more)


def count_terms(texts: DataFrame) -> DataFrame:
    """lang, source, term, n, df of distinct_texts(), summed within tasks: each text is cut into terms once, its counts
    and its one document weighted by the number of its rows in each source."""
    ship_package(texts.sparkSession)
    schema = "lang string, source string, term string, n long, df long"

    def flush(held):
        for (lang, source), (n, df) in held.items():
            words = list(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(words), pa.string()),
                    pa.array([source] * len(words), pa.string()),
                    pa.array([w.decode() for w in words], pa.string()),
                    pa.array(list(n.values()), pa.int64()),
                    pa.array([df[w] for w in words], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "df"],
            )
        held.clear()

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, text, sources in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "sources")), strict=True):
                words = terms(text)
                if not words:
                    continue
                if len(sources) == 1 and sources[0]["n"] == 1:
                    n, df = held.setdefault((lang, sources[0]["source"]), (Counter(), Counter()))
                    n.update(words)
                    df.update(set(words))
                else:
                    counts = Counter(words)
                    for s in sources:
                        n, df = held.setdefault((lang, s["source"]), (Counter(), Counter()))
                        for w, c in counts.items():
                            n[w] += c * s["n"]
                            df[w] += s["n"]
                        if sum(len(c) for c, _ in held.values()) > HELD:
                            yield from flush(held)
            if sum(len(c) for c, _ in held.values()) > HELD:
                yield from flush(held)
        yield from flush(held)

    return texts.mapInArrow(run, schema)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _probability(n: str, total: str, kept: str) -> Column:
    return F.expr(f"1 + CAST((CAST({ONE} AS DECIMAL(38,0)) * ({n} + 2)) div ({total} + 2 * {kept}) AS BIGINT)")


def pair_sums(rows: pd.DataFrame, same: bool) -> pd.DataFrame:
    """x, y, value, shared: for pairs of sources, the divergence summed over the terms of `rows` that either has, and how
    many those are.

    `rows` has source, side (0 or 1), term (null in rows that only name a source), p, and p0, which holds for terms that
    the source lacks. Pairs are those of the two sides, or of one side where they are the `same`. A source's terms are
    compared with each other source's probabilities at these terms; those of the other that it lacks add the rest.
    """
    names = rows.drop_duplicates("source").sort_values("source")
    sources, side, p0 = names["source"].to_numpy(), names["side"].to_numpy(), names["p0"].to_numpy(np.int64)
    given = rows[rows["term"].notna()]
    column, words = pd.factorize(given["term"])
    line = pd.Index(sources).get_indexer(given["source"])
    p = np.repeat(p0[:, None], len(words), axis=1)
    has = np.zeros(p.shape, bool)
    p[line, column], has[line, column] = given["p"].to_numpy(np.int64), True
    out = []
    for i in range(len(sources)):
        others = np.arange(i + 1, len(sources)) if same else np.flatnonzero(side == 1) if side[i] == 0 else []
        if not len(others):
            continue
        mine = np.flatnonzero(has[i])
        theirs, both = p[np.ix_(others, mine)], has[np.ix_(others, mine)]
        value = divergence(p[i, mine], theirs).sum(1) - (divergence(p0[i], theirs) * both).sum(1)
        for k, j in enumerate(others):
            own = p[j, has[j]]
            n = len(mine) + len(own) - int(both[k].sum())
            out.append((sources[i], sources[j], p0[i], p0[j], int(value[k] + divergence(p0[i], own).sum()), n))
    return pd.DataFrame(out, columns=["x", "y", "p0_x", "p0_y", "value", "shared"])


def _pairs(rated: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for each two sources of a language, from rated (lang, source, term, p) and groups.

    Sources and terms are dealt into blocks; one task sums up one block of terms for one pair of source blocks, all of
    whose sources it is told, and the sums of the blocks are added up. Terms that both lack all have the same divergence.
    """
    ship_package(rated.sparkSession)
    sizes = groups.groupBy("lang").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_SOURCES), F.lit(1)).alias("blocks"), F.sum("terms").alias("rows")
    )
    dealt = groups.join(_sent(sizes), "lang").select(
        "lang", "source", "p0", "kept", "blocks",
        F.greatest(F.ceil(F.col("rows") * 2 / (F.col("blocks") * BLOCK_ROWS)), F.lit(1)).alias("cuts"),
        F.pmod(F.xxhash64("source"), "blocks").alias("block"),
    )
    known = _sent(dealt)
    cut = F.pmod(F.xxhash64("term"), "cuts")
    facts = rated.join(known, ["lang", "source"]).select("lang", "source", "term", "p", "p0", "kept", "block", "blocks", cut.alias("cut"))
    names = dealt.select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"), "p0", "kept",
        "block", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut"),
    )
    spread = facts.unionByName(names).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select(
        "lang", "source", "term", "p", "p0", "kept", "cut", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
    )

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = pair_sums(rows, key[1] == key[2])
        return out.assign(lang=key[0], kept=key[4])

    sums = (
        spread.groupBy("lang", "i", "j", "cut", "kept")
        .applyInPandas(run, "lang string, kept long, x string, y string, p0_x long, p0_y long, value long, shared long")
        .groupBy("lang", "kept", "x", "y", "p0_x", "p0_y")
        .agg(F.sum("value").alias("value"), F.sum("shared").alias("shared"))
        .withColumn("value", F.col("value") + (F.col("kept") - F.col("shared")) * _divergence("p0_x", "p0_y"))
    )
    ways = F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))
    return sums.withColumn("way", F.explode(ways)).select("lang", "way.source", "way.item", "value")


def audit(docs: DataFrame, min_documents: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: how each source differs from the others of its language, and in which terms.

    Terms are runs of letters (see terms()). A language keeps the terms that stand in `min_documents` or more of its
    documents. With count of a term in a source (or the whole language), N the sum of counts over the V kept terms,
    p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and two distributions differ at a term by floor((p - q)^2 / (p + q)).
    Part `pair` has every other source of the language with the sum over all kept terms; part `term` the `top` terms that
    are commoner in the source than in the language. All arithmetic is whole.

    Copies of a text collapse first (distinct_texts), each distinct text is read once with its weights (count_terms), and
    pairs are evaluated over the terms that either source has (_pairs). Counts are summed within tasks before they are
    shuffled by term, so that a term in every document, or a source with most rows, is no hot key.

    Null text, lang and source count as empty ones. Repeated rows each count. A source without terms, and a language
    without kept terms, still have their pairs, with value 0 where nothing is kept. Other columns are not read. An empty
    table gives no rows.
    """
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], text_or_empty().alias("text"))
    of_term = Window.partitionBy("lang", "term")
    kept = stored(
        count_terms(distinct_texts(rows))
        .repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
        .withColumns({"all_df": F.sum("df").over(of_term), "all_n": F.sum("n").over(of_term), "least": F.min("source").over(of_term)})
        .filter(F.col("all_df") >= min_documents)
        .select("lang", "term", "source", "n", "all_n", (F.col("least") == F.col("source")).cast("long").alias("lead"))
    )
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    langs = kept.groupBy("lang").agg(F.sum("lead").alias("kept"), F.sum("n").alias("all_total"))
    zero = {"total": 0, "terms": 0, "kept": 0, "all_total": 0}
    groups = stored(
        rows.groupBy("lang", "source").agg(F.count("*").alias("_"))
        .drop("_")
        .join(totals, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .fillna(zero)
        .withColumn("p0", F.when(F.col("kept") > 0, _probability("0", "total", "nullif(kept, 0)")).otherwise(F.lit(1)).cast("long"))
    )
    rated = kept.join(_sent(groups.drop("p0", "terms")), ["lang", "source"]).select(
        "lang", "source", "term", _probability("n", "total", "kept").alias("p"), _probability("all_n", "all_total", "kept").alias("q")
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    common = (
        rated.filter("p > q")
        .select("lang", "source", F.col("term").alias("item"), _divergence("p", "q").alias("value"))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= top)
        .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    )
    pairs = _pairs(rated, groups).withColumn("rank", F.row_number().over(best))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(common)


AUDIT_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
held AS (SELECT lang, source, id, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM held GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT h.lang, h.source, h.term, count(*) AS n FROM held h JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS all_n
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
rated AS (
  SELECT lang, source, term, n,
    1 + CAST(1000000000::HUGEINT * (n + 2) // (sum(n) OVER g + 2 * count(*) OVER g) AS BIGINT) AS p,
    1 + CAST(1000000000::HUGEINT * (all_n + 2) // (sum(all_n) OVER g + 2 * count(*) OVER g) AS BIGINT) AS q
  FROM cells WINDOW g AS (PARTITION BY lang, source)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(v.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM rated x JOIN rated y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) v
    ON v.lang = a.lang AND v.source = a.source AND v.item = b.source)
SELECT lang, source, 'pair' AS part, item, value,
  CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // (p + q) DESC, term) AS INTEGER) AS rank
  FROM rated WHERE n > 0 AND p > q) WHERE rank <= 10
"""
