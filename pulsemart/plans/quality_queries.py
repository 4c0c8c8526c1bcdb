"""Data rules and access logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitor, quality, report
from ..sources import sample_tables as st
from .oracle import r, sql
from .registry import query

_RULES_BROKEN = {
    "more_successes_than_movements": "successful_movements > movements_count",
    "no_response_measured": "movements_count > 0 AND max_response_time = 0",
}


@query(
    "mart_violations",
    sql(
        " UNION ALL ".join(
            f"""SELECT user_id, prosthesis_id, report_date, report_hour, '{name}' AS rule FROM mart WHERE {bad}"""
            for name, bad in _RULES_BROKEN.items()
        ),
        "mart",
    ),
)
def mart_violations(spark, folder):
    """Mart rows that break a rule, one row per broken rule."""
    broken = quality.violations(st.mart_rows(spark, folder), quality.mart_rules())
    return broken.select("user_id", "prosthesis_id", "report_date", "report_hour", F.explode("violated").alias("rule"))


@query(
    "daily_violation_counts",
    sql(
        """SELECT (SELECT count(*) FROM (SELECT DISTINCT user_id, report_date FROM mart)) AS rows, rule, CAST(0 AS BIGINT) AS violations
           FROM (VALUES ('movements_negative'), ('successful_negative'), ('success_rate_range'), ('response_negative'),
             ('battery_range'), ('min_battery_range'), ('temperature_negative'), ('errors_negative'),
             ('active_hours_range')) t(rule)""",
        "mart",
    ),
)
def daily_violation_counts(spark, folder):
    """Daily reports checked against every bound of the report contract: none is broken."""
    return quality.violation_counts(report.daily_detail(st.mart_rows(spark, folder)), quality.daily_rules())


@query(
    "domain_violations",
    """SELECT c_custkey AS prosthesis_id, 'region_domain' AS rule FROM customer
         JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
         WHERE r_name NOT IN ('russia', 'europe')
       UNION ALL SELECT p_partkey, 'category_domain' FROM part WHERE p_type NOT IN ('arm', 'leg', 'hand', 'finger')""",
)
def domain_violations(spark, folder):
    """Coded values outside their domain: regions of customers, categories of models."""
    regions = quality.violations(st.customers(spark, folder), quality.customer_rules())
    categories = quality.violations(st.models(spark, folder), quality.model_rules())
    return regions.select(F.col("customer_id").alias("prosthesis_id"), F.explode("violated").alias("rule")).unionByName(
        categories.select(F.col("model_id").alias("prosthesis_id"), F.explode("violated").alias("rule"))
    )


@query(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
)
def duplicate_keys(spark, folder):
    """Order lines whose supposed key occurs more than once."""
    return quality.duplicates(st.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "orphan_devices",
    sql(
        """SELECT prosthesis_id, model_id, customer_id FROM prosthesis_latest
           WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM customer_latest WHERE NOT _deleted)""",
        "prosthesis_latest",
        "customer_latest",
    ),
)
def orphan_devices(spark, folder):
    """Devices, in their last version, whose customer does not exist or was deleted."""
    from ..operators import cdc, upsert

    devices = upsert.latest(st.prosthesis_log(spark, folder), ["prosthesis_id"], cdc.VERSION_ORDER)
    customers = cdc.current(st.customer_log(spark, folder), "customers")
    return quality.orphans(devices.select("prosthesis_id", "model_id", "customer_id"), "customer_id", customers, "customer_id")


@query(
    "null_counts",
    sql(
        """SELECT (SELECT count(*) FROM raw) AS rows, "column", nulls FROM (
             SELECT 'chip_id' AS "column", count(*) FILTER (WHERE chip_id IS NULL) AS nulls FROM raw
             UNION ALL SELECT 'timestamp', count(*) FILTER (WHERE ts IS NULL) FROM raw
             UNION ALL SELECT 'movement_type', count(*) FILTER (WHERE movement_type IS NULL) FROM raw
             UNION ALL SELECT 'response_time_ms', count(*) FILTER (WHERE response_time_ms IS NULL) FROM raw)""",
        "raw",
    ),
)
def null_counts(spark, folder):
    """Missing values per column of the raw samples."""
    return quality.nulls(st.raw_telemetry(spark, folder), ["chip_id", "timestamp", "movement_type", "response_time_ms"])


@query(
    "access_log",
    f"""SELECT '/api/reports/' || event_type AS path, CAST(user_id AS VARCHAR) AS "user", count(*) AS requests,
          count(*) FILTER (WHERE event_type NOT IN ('error', 'view')) AS ok,
          count(*) FILTER (WHERE event_type = 'view') AS client_errors,
          count(*) FILTER (WHERE event_type = 'error') AS server_errors,
          {r("avg(value)", 2)} AS avg_ms, quantile_disc(value, 0.5) AS p50_ms, quantile_disc(value, 0.99) AS p99_ms
        FROM events WHERE event_id % 1000 <> 999 GROUP BY event_type, user_id""",
)
def access_log(spark, folder):
    """Requests, outcomes and latency per path and user, parsed from log lines."""
    return monitor.access_log(st.service_log(spark, folder))


@query(
    "access_log_paths",
    f"""SELECT '/api/reports/' || event_type AS path, count(*) AS requests,
          count(*) FILTER (WHERE event_type NOT IN ('error', 'view')) AS ok,
          count(*) FILTER (WHERE event_type = 'view') AS client_errors,
          count(*) FILTER (WHERE event_type = 'error') AS server_errors,
          {r("avg(value)", 2)} AS avg_ms, quantile_disc(value, 0.5) AS p50_ms, quantile_disc(value, 0.99) AS p99_ms
        FROM events WHERE event_id % 1000 <> 999 GROUP BY event_type""",
)
def access_log_paths(spark, folder):
    """Requests, outcomes and latency per path alone: few, large groups."""
    return monitor.access_log(st.service_log(spark, folder), ["path"])


@query(
    "access_log_merged",
    f"""SELECT '/api/reports/' || event_type AS path, count(*) AS requests,
          count(*) FILTER (WHERE event_type NOT IN ('error', 'view')) AS ok,
          count(*) FILTER (WHERE event_type = 'view') AS client_errors,
          count(*) FILTER (WHERE event_type = 'error') AS server_errors, {r("avg(value)", 2)} AS avg_ms,
          true AS p50_near, true AS p99_near
        FROM events WHERE event_id % 1000 <> 999 GROUP BY event_type""",
)
def access_log_merged(spark, folder):
    """Paths from the merged partials of their users; percentiles out of sketches lie between the exact ones as far below
    and above as sketches may be off."""
    requests = monitor.parse_service_log(st.service_log(spark, folder))
    parts = monitor.access_partials(requests, ["path", "user"])
    merged = monitor.finish_access(monitor.merge_access(parts, ["path"]), ["path"])
    off = monitor.LATENCY_RANK_ERROR
    bounds = {f"p{name}_{side}": f"percentile_disc({max(0, min(1, p + by)):.4f}) WITHIN GROUP (ORDER BY duration_ms)"
              for name, p in (("50", 0.5), ("99", 0.99)) for side, by in (("low", -off), ("high", off))}
    exact = requests.groupBy("path").agg(*[F.expr(e).alias(name) for name, e in bounds.items()])

    def near(name: str):
        return F.col(f"p{name}_ms").between(F.col(f"p{name}_low"), F.col(f"p{name}_high")).alias(f"p{name}_near")

    totals = ["path", "requests", "ok", "client_errors", "server_errors", "avg_ms"]
    return merged.join(exact, "path").select(*totals, near("50"), near("99"))


@query(
    "log_faults",
    """SELECT 'service' AS log, 'no request' AS reason, count(*) AS lines, 'worker started' AS example
       FROM events WHERE event_id % 1000 = 999 HAVING count(*) > 0""",
)
def log_faults(spark, folder):
    """Lines of both logs that are no requests, with the reason."""
    service = monitor.service_faults(st.service_log(spark, folder)).select(F.lit("service").alias("log"), "*")
    edge = monitor.edge_faults(st.edge_log(spark, folder)).select(F.lit("edge").alias("log"), "*")
    return service.unionByName(edge)


@query(
    "cache_ratio",
    f"""SELECT '/reports/' || user_id || '/summary/summary.json' AS path, count(*) AS requests,
          count(*) FILTER (WHERE event_type NOT IN ('error', 'view')) AS hits,
          {r("CAST(count(*) FILTER (WHERE event_type NOT IN ('error', 'view')) AS DOUBLE) / count(*)", 4)} AS hit_ratio
        FROM events GROUP BY user_id""",
)
def cache_ratio(spark, folder):
    """Hit ratio of the edge cache per path, parsed from log lines."""
    return monitor.cache_ratio(st.edge_log(spark, folder))
