"""State of the pipeline as queries: change feed, loads, lag, access logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import defaults, schemas
from ..functions import stable_round
from . import upsert
from .cdc import REASON, VERSION_ORDER

CHANGE_TABLE_NAMES = {
    "customers": "crm_customers",
    "prostheses": "crm_prostheses",
    "models": "crm_prosthesis_models",
}


def _key_states(log: DataFrame, entity: str) -> DataFrame:
    """Newest version and its delete flag per key: narrow, so the status never moves whole rows."""
    keys = schemas.CHANGE_KEYS[entity]
    newest = F.max(F.struct(*VERSION_ORDER, "_deleted"))
    return log.groupBy(*keys).agg(newest.alias("_n")).select("_n._version", "_n._deleted")


def _each(logs: dict[str, DataFrame], one) -> DataFrame:
    parts = [one(entity, log) for entity, log in logs.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def cdc_status(logs: dict[str, DataFrame]) -> DataFrame:
    """Known and live keys per entity."""

    def one(entity: str, log: DataFrame) -> DataFrame:
        return _key_states(log, entity).agg(
            F.lit(entity).alias("entity"),
            F.count(F.lit(1)).alias("total"),
            F.count_if(~F.col("_deleted")).alias("active"),
        )

    return _each(logs, one)


def cdc_health(logs: dict[str, DataFrame]) -> DataFrame:
    """Live rows and newest version per table, with the state of the whole feed on every row."""

    def one(entity: str, log: DataFrame) -> DataFrame:
        live = _key_states(log, entity).filter(~F.col("_deleted"))
        return live.agg(
            F.lit(CHANGE_TABLE_NAMES[entity]).alias("table_name"),
            F.count(F.lit(1)).alias("row_count"),
            F.max("_version").alias("last_version"),
        )

    tables = _each(logs, one)
    # one row per table, so folding them into one row is bounded
    whole = tables.agg(F.collect_list(F.struct(*tables.columns)).alias("_tables"), F.sum("row_count").alias("_rows"))
    status = F.when(F.col("_rows") > 0, "healthy").otherwise("initializing")
    return whole.select(F.inline("_tables"), status.alias("status"))


def fault_counts(decoded: dict[str, DataFrame]) -> DataFrame:
    """Messages set aside per entity and reason, from `cdc.decode` of each entity."""

    def one(entity: str, rows: DataFrame) -> DataFrame:
        bad = rows.filter(F.col(REASON).isNotNull())
        return bad.groupBy(F.col(REASON).alias("reason")).agg(F.count(F.lit(1)).alias("messages")).select(
            F.lit(entity).alias("entity"), "reason", "messages"
        )

    return _each(decoded, one)


def readiness(rows: DataFrame) -> DataFrame:
    """Whether the dimension can serve: record count, flag and status in one row."""
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("mart_records"),
        (n > 0).alias("mart_ready"),
        F.when(n > 0, "ready").otherwise("initializing").alias("status"),
    )


def load_check(mart: DataFrame, user_ids: list[str] | None = None) -> DataFrame:
    """Rows and date range per user, for a short list of users or all of them."""
    rows = mart if user_ids is None else mart.filter(F.col("user_id").isin(*user_ids))
    return (
        rows.groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("total_records"),
            F.min("report_date").alias("first_date"),
            F.max("report_date").alias("last_date"),
        )
        .orderBy("user_id")
    )


def recent_changes(log: DataFrame, entity: str, limit: int = defaults.RECENT_CHANGES_LIMIT) -> DataFrame:
    """Rows of an entity changed last, newest version first."""
    keys = schemas.CHANGE_KEYS[entity]
    newest = upsert.latest(log, keys, VERSION_ORDER)
    return newest.orderBy(F.desc("_version"), F.desc("_seq"), *keys).limit(limit)


def observe_load(rows: DataFrame, name: str = "load") -> tuple[DataFrame, Observation]:
    """`rows` with counters that fill while the load writes them, at no extra pass. Distinct counts cannot be
    observed; `load_metrics` has them."""
    seen = Observation(name)
    return (
        rows.observe(
            seen,
            F.count(F.lit(1)).alias("records_count"),
            F.min("report_date").alias("min_date"),
            F.max("report_date").alias("max_date"),
        ),
        seen,
    )


def load_metrics(rows: DataFrame, by: str = "user_id") -> DataFrame:
    """Record count, distinct users (or chips) and date range of a load."""
    return rows.agg(
        F.count(F.lit(1)).alias("records_count"),
        F.count_distinct(by).alias(f"unique_{by.removesuffix('_id')}s"),
        F.min("report_date").alias("min_date"),
        F.max("report_date").alias("max_date"),
    )


def lag(progress: DataFrame, threshold: int = defaults.LAG_THRESHOLD) -> DataFrame:
    """Lag per topic from rows (topic, partition, end_offset, committed_offset), such as `progress.newest` has of running
    streams. The lag of a topic one of whose ends is not known is unknown too."""
    behind = F.greatest(F.col("end_offset") - F.coalesce(F.col("committed_offset"), F.lit(0)), F.lit(0))
    known = F.count("end_offset") == F.count(F.lit(1))
    return (
        progress.groupBy("topic")
        .agg(F.when(known, F.sum(F.when(F.col("end_offset").isNotNull(), behind))).alias("lag"))
        .withColumn(
            "status",
            F.when(F.col("lag").isNull(), "unknown").when(F.col("lag") > threshold, "degraded").otherwise("healthy"),
        )
    )


# -- access logs -------------------------------------------------------------------------------------------


# Size of a sketch of durations, and how far the rank of its percentiles may be off at that size.
LATENCY_K = 400
LATENCY_RANK_ERROR = 0.01
SERVICE_FIELDS = ["request_id", "user", "ip", "method", "path", "status", "duration_ms"]
_SERVICE_LINE = " ".join(rf"{name}=\S+" for name in SERVICE_FIELDS)
_EDGE_LINE = r'"\S+ (\S+)[^"]*" (\d{3}) .*cache_status=(\S+) rt=([0-9.]+)'


def _tokens(text: Column, n: int) -> Column:
    """`text` split at blanks, by way of a one-element explode so that the expression behind it is computed
    once however many parts are read; lines that do not match give NULL."""
    parts = F.split(text, " ", n)
    return F.explode(F.array(parts)).alias("t")


def parse_service_log(lines: DataFrame) -> DataFrame:
    """Request lines of the report service (`key=value` pairs) from column `line`; other lines drop out."""
    found = lines.select(_tokens(F.regexp_extract("line", _SERVICE_LINE, 0), len(SERVICE_FIELDS)))
    values = {name: F.substring(F.get("t", F.lit(i)), len(name) + 2, 1 << 30) for i, name in enumerate(SERVICE_FIELDS)}
    values["status"] = values["status"].try_cast("int")
    values["duration_ms"] = values["duration_ms"].try_cast("double")
    rows = found.filter(F.size("t") == len(SERVICE_FIELDS)).select(*[v.alias(name) for name, v in values.items()])
    return rows.filter(F.col("status").isNotNull())


def parse_edge_log(lines: DataFrame) -> DataFrame:
    """Lines of the edge cache: request path, status, cache outcome, request time in ms."""
    whole = "^.*?" + _EDGE_LINE + ".*$"
    found = lines.filter(F.col("line").rlike(_EDGE_LINE)).select(_tokens(F.regexp_replace("line", whole, "$1 $2 $3 $4"), 4))
    return found.select(
        F.get("t", F.lit(0)).alias("path"),
        F.get("t", F.lit(1)).cast("int").alias("status"),
        F.get("t", F.lit(2)).alias("cache_status"),
        (F.get("t", F.lit(3)).try_cast("double") * 1000).alias("duration_ms"),
    )


def _outcomes() -> list[Column]:
    status = F.col("status")
    return [
        F.count(F.lit(1)).alias("requests"),
        F.count_if(status < 400).alias("ok"),
        F.count_if((status >= 400) & (status < 500)).alias("client_errors"),
        F.count_if(status >= 500).alias("server_errors"),
    ]


def access_log(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Requests, outcome classes and latency per path and user.

    Percentiles are exact: counts per distinct duration (kept to 0.01 ms) that merge, so a hot path costs no more memory
    than its distinct durations.
    """
    return parse_service_log(lines).groupBy(*(keys or ["path", "user"])).agg(
        *_outcomes(),
        stable_round(F.avg("duration_ms"), 2).alias("avg_ms"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY duration_ms)").alias("p50_ms"),
        F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY duration_ms)").alias("p99_ms"),
    )


def access_partials(requests: DataFrame, keys: list[str], k: int = LATENCY_K) -> DataFrame:
    """Mergeable form of the access log: outcome counts and a sketch of the durations (a few kB) by `keys`, from parsed
    requests. Stored by the hour or day, any span of them is merged without the lines."""
    duration = F.col("duration_ms")
    return requests.groupBy(*keys).agg(
        *_outcomes(),
        F.sum(duration).alias("duration_sum"),
        F.count(duration).alias("duration_n"),
        F.kll_sketch_agg_double(duration, k).alias("durations"),
    )


def merge_access(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Partials united by fewer keys, or those of several loads by the same ones."""
    totals = ["requests", "ok", "client_errors", "server_errors", "duration_sum", "duration_n"]
    return parts.groupBy(*keys).agg(
        *[F.sum(name).alias(name) for name in totals], F.kll_merge_agg_double("durations").alias("durations")
    )


def finish_access(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of `access_log` from partials. Percentiles are values seen, whose rank is off by LATENCY_RANK_ERROR
    at most (99 % confidence); NULL without any duration."""
    some = F.col("duration_n") > 0

    def percentile(p: float) -> Column:
        return F.when(some, F.kll_sketch_get_quantile_double("durations", F.lit(p)))

    return parts.select(
        *keys,
        "requests",
        "ok",
        "client_errors",
        "server_errors",
        stable_round(F.try_divide(F.col("duration_sum"), F.col("duration_n")), 2).alias("avg_ms"),
        percentile(0.5).alias("p50_ms"),
        percentile(0.99).alias("p99_ms"),
    )


def service_faults(lines: DataFrame) -> DataFrame:
    """Lines of the service log by what is wrong with them: `empty`, `no request` and `status` leave the line out of
    reports, `duration` leaves its request without one."""
    found = lines.select("line", _tokens(F.regexp_extract("line", _SERVICE_LINE, 0), len(SERVICE_FIELDS)))

    def number(name: str, kind: str) -> Column:
        at = F.lit(SERVICE_FIELDS.index(name))
        return F.substring(F.get("t", at), len(name) + 2, 1 << 30).try_cast(kind)

    return _fault_counts(
        found, F.size("t") == len(SERVICE_FIELDS), {"status": number("status", "int"), "duration": number("duration_ms", "double")}
    )


def edge_faults(lines: DataFrame) -> DataFrame:
    """Lines of the edge cache by what is wrong with them, as `service_faults` has it."""
    whole = "^.*?" + _EDGE_LINE + ".*$"
    rows = lines.withColumn("_time", F.regexp_replace("line", whole, "$4").try_cast("double"))
    return _fault_counts(rows, F.coalesce(F.col("line").rlike(_EDGE_LINE), F.lit(False)), {"duration": F.col("_time")})


def _fault_counts(rows: DataFrame, is_request: Column, values: dict[str, Column]) -> DataFrame:
    """Lines and one example (the smallest) by reason."""
    reason = F.when(F.coalesce(F.trim("line"), F.lit("")) == "", "empty").when(~is_request, "no request")
    for name, value in values.items():
        reason = reason.when(value.isNull(), name)
    return (
        rows.select(reason.alias("reason"), "line")
        .filter(F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("lines"), F.min("line").alias("example"))
    )


def cache_ratio(lines: DataFrame) -> DataFrame:
    """Hits per path at the edge cache; requests that never asked the cache ("-") count as misses."""
    hits = F.count_if(F.col("cache_status") == "HIT")
    n = F.count(F.lit(1))
    return (
        parse_edge_log(lines)
        .groupBy("path")
        .agg(n.alias("requests"), hits.alias("hits"), stable_round(hits.cast("double") / n, 4).alias("hit_ratio"))
    )
