"""Queries from raw samples and customer tables up to the mart."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import error_rate, stable_round
from ..operators import crm, hourly, mart, upsert
from ..sources import sample_tables as st
from .oracle import AS_OF, r, sql
from .registry import query, rounded

FIRST, PAST_LAST = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)

_HOURLY_COLUMNS = f"""chip_id, hour_start, movements_count, successful_movements,
  {r("avg_response_time", 6)} AS avg_response_time, min_response_time, max_response_time,
  {r("avg_battery_level", 6)} AS avg_battery_level, min_battery_level, max_battery_level,
  {r("avg_actuator_temp", 6)} AS avg_actuator_temp, max_actuator_temp, error_count, warning_count,
  {r("avg_myo_amplitude", 6)} AS avg_myo_amplitude, {r("avg_connection_quality", 6)} AS avg_connection_quality,
  updated_at"""
_MEANS = [
    "avg_response_time",
    "avg_battery_level",
    "avg_actuator_temp",
    "avg_myo_amplitude",
    "avg_connection_quality",
]


@query(
    "raw_range_scan",
    sql(
        """SELECT telemetry_id, chip_id, ts AS "timestamp", movement_type, movement_success, response_time_ms,
             battery_level, error_code, warning_flags, session_id FROM raw
           WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'""",
        "raw",
    ),
)
def raw_range_scan(spark, folder):
    """Raw samples in a half-open time range."""
    return st.raw_telemetry(spark, folder, FIRST, PAST_LAST).select(
        "telemetry_id",
        "chip_id",
        "timestamp",
        "movement_type",
        "movement_success",
        "response_time_ms",
        "battery_level",
        "error_code",
        "warning_flags",
        "session_id",
    )


@query("hourly_stats", sql(f"SELECT {_HOURLY_COLUMNS} FROM hourly", "hourly"))
def hourly_stats(spark, folder):
    """Hourly statistics of every device."""
    return rounded(st.hourly_stats(spark, folder), 6, *_MEANS)


@query("hourly_presented", sql("SELECT * FROM present", "present"))
def hourly_presented(spark, folder):
    """Hourly statistics as loads read them."""
    return hourly.present(st.hourly_stats(spark, folder))


@query(
    "hourly_lookback",
    sql(f"SELECT * FROM present WHERE hour_start >= {AS_OF} - INTERVAL 168 HOUR", "present"),
)
def hourly_lookback(spark, folder):
    """Hours inside the batch lookback; the bound also reaches the scan of the samples."""
    as_of = dt.datetime.fromisoformat(st.AS_OF)
    stats = st.hourly_stats(spark, folder, start=as_of - dt.timedelta(hours=168))
    return hourly.since(hourly.present(stats), st.AS_OF, 168)


@query("hours_present", sql("SELECT DISTINCT date_trunc('hour', ts) AS hour_start FROM raw", "raw"))
def hours_present(spark, folder):
    """Hours with any sample."""
    return hourly.hours_present(st.raw_telemetry(spark, folder))


@query(
    "usage_sessions",
    sql(
        f"""SELECT session_id, chip_id, min(ts) AS started_at, max(ts) AS ended_at,
              CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS INTEGER) AS duration_seconds,
              count(*) FILTER (WHERE movement_type IS NOT NULL) AS total_movements,
              count(*) FILTER (WHERE movement_type IS NOT NULL AND movement_success) AS successful_movements,
              {r("avg(response_time_ms)", 6)} AS avg_response_time_ms, min(battery_level) AS min_battery_level,
              max(actuator_temp) AS max_actuator_temp,
              count(*) FILTER (WHERE error_code IS NOT NULL) AS error_count
            FROM raw GROUP BY session_id, chip_id""",
        "raw",
    ),
)
def usage_sessions(spark, folder):
    """Usage sessions of every device."""
    return rounded(hourly.sessions(st.raw_telemetry(spark, folder)), 6, "avg_response_time_ms")


@query(
    "hourly_upsert",
    sql(
        f"""SELECT * REPLACE (CASE WHEN hour_start >= TIMESTAMP '2024-01-16'
              THEN TIMESTAMP '2024-02-01 00:00:00' ELSE {AS_OF} END AS updated_at) FROM (SELECT {_HOURLY_COLUMNS} FROM hourly)""",
        "hourly",
    ),
)
def hourly_upsert(spark, folder):
    """Statistics of an earlier run with the hours of a later, overlapping run put in place."""
    earlier = hourly.aggregate(st.raw_telemetry(spark, folder, end=dt.datetime(2024, 1, 21)), st.AS_OF)
    later = hourly.aggregate(st.raw_telemetry(spark, folder, start=dt.datetime(2024, 1, 16)), "2024-02-01 00:00:00")
    return rounded(upsert.replace(earlier, later, ["chip_id", "hour_start"]), 6, *_MEANS)


@query("customer_prosthesis", sql("SELECT * FROM owners", "owners"))
def customer_prosthesis(spark, folder):
    """Active devices with owner and model."""
    return st.customer_view(spark, folder)


@query(
    "mart_source",
    sql(
        f"""SELECT {', '.join('customer_full_name AS customer_name' if c == 'customer_name' else c for c in crm.MART_COLUMNS)}
            FROM owners WHERE chip_id IS NOT NULL AND chip_id <> ''""",
        "owners",
    ),
)
def mart_source(spark, folder):
    """Customer side of the mart: devices bound to a chip."""
    return crm.mart_source(st.customer_view(spark, folder), allow_empty_chip=False)


_SOURCE_COLUMNS = "user_id, customer_name, prosthesis_id, chip_id, prosthesis_model"


def _sources(spark, folder):
    columns = _SOURCE_COLUMNS.split(", ")
    from ..operators import cdc

    logs = st.change_logs(spark, folder)
    primary = cdc.customer_data(logs["customers"], logs["prostheses"], logs["models"]).filter(F.col("chip_id") != "")
    fallback = crm.mart_source(st.customer_view(spark, folder))
    return primary.select(*columns), fallback.select(*columns)


@query(
    "crm_source_primary",
    sql(f"SELECT {_SOURCE_COLUMNS} FROM customer_data WHERE chip_id <> ''", "customer_data"),
)
def crm_source_primary(spark, folder):
    """Customer side from the change-fed table, since it has rows."""
    return mart.crm_source(*_sources(spark, folder))


@query(
    "crm_source_fallback",
    sql(
        """SELECT user_id, customer_full_name AS customer_name, prosthesis_id, chip_id, prosthesis_model
           FROM owners WHERE chip_id IS NOT NULL""",
        "owners",
    ),
)
def crm_source_fallback(spark, folder):
    """Customer side from the view when the change-fed table is still empty."""
    primary, fallback = _sources(spark, folder)
    return mart.crm_source(primary.filter(F.col("user_id") == "nobody"), fallback)


@query("mart_rows", sql("SELECT * FROM mart", "mart"))
def mart_rows(spark, folder):
    """The usage mart."""
    return st.mart_rows(spark, folder)


@query("mart_rows_salted", sql("SELECT * FROM mart", "mart"))
def mart_rows_salted(spark, folder):
    """The usage mart with hot chips spread over join keys by hour of day."""
    owners = crm.mart_source(st.customer_view(spark, folder), allow_empty_chip=False)
    return mart.build(hourly.present(st.hourly_stats(spark, folder)), owners, salt=8)


@query(
    "mart_error_rate",
    sql(
        f"""SELECT user_id, prosthesis_id, report_date, report_hour,
              CASE WHEN movements_count > 0 THEN {r("CAST(error_count AS DOUBLE) / movements_count", 6)} END AS error_rate
            FROM mart""",
        "mart",
    ),
)
def mart_error_rate(spark, folder):
    """Errors per movement of every mart row."""
    rate = error_rate(F.col("error_count"), F.col("movements_count"))
    return st.mart_rows(spark, folder).select(
        "user_id", "prosthesis_id", "report_date", "report_hour", stable_round(rate, 6).alias("error_rate")
    )


@query(
    "user_info_lookup",
    sql(
        """SELECT c.c_name AS user_id, u.customer_name, u.customer_email, u.customer_region, u.prosthesis_model,
             u.prosthesis_serial FROM customer c LEFT JOIN user_last u ON c.c_name = u.user_id""",
        "user_last",
    ),
)
def user_info_lookup(spark, folder):
    """Every customer with the values of their newest mart hour."""
    info = mart.user_info(st.mart_rows(spark, folder))
    return mart.lookup(st.table(spark, folder, "customer").select(F.col("c_name").alias("user_id")), info)
