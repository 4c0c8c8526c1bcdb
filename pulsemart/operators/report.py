"""Report queries over the mart, for all users in one job or filtered to one."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import defaults
from ..functions import day_mask_hours, stable_round, success_rate
from . import rollup
from .rollup import mean

USER_DAY_KEYS = [
    "user_id",
    "customer_name",
    "prosthesis_model",
    "prosthesis_serial",
    "customer_region",
    "report_date",
]
HOUR_COLUMNS = [
    "movements_count",
    "successful_movements",
    "success_rate",
    "avg_response_time",
    "avg_battery_level",
    "error_count",
]


# -- filters -----------------------------------------------------------------------------------------------


def for_user(df: DataFrame, user_id: str, date: dt.date | str | None = None) -> DataFrame:
    """Rows of one user, or of one user's day."""
    rows = df.filter(F.col("user_id") == F.lit(user_id))
    return rows if date is None else rows.filter(F.col("report_date") == F.lit(date).cast("date"))


def for_requests(df: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows asked for by a table of requests on its own columns, e.g. (user_id) or (user_id, report_date)."""
    return df.join(requests.distinct(), requests.columns, "left_semi")


def scope(df: DataFrame, principal: str, entitlements: DataFrame | None = None, admin: bool = False) -> DataFrame:
    """Rows `principal` may see: all for an admin, else their own and those entitled by (principal, user_id)."""
    if admin:
        return df
    own = F.col("user_id") == F.lit(principal)
    if entitlements is None:
        return df.filter(own)
    granted = entitlements.filter(F.col("principal") == F.lit(principal)).select("user_id")
    itself = df.sparkSession.range(1).select(F.lit(principal).alias("user_id"))
    mine = granted.union(itself).distinct()
    return df.join(mine, "user_id", "left_semi")


def scope_each(df: DataFrame, entitlements: DataFrame) -> DataFrame:
    """Every principal's view at once: one row per (principal, visible row)."""
    return df.join(entitlements.select("principal", "user_id").distinct(), "user_id")


# -- per day -----------------------------------------------------------------------------------------------


def _user_day_columns(cap: bool) -> list[Column]:
    return [
        *[F.col(k) for k in USER_DAY_KEYS],
        F.col("movements").alias("daily_movements"),
        F.col("successful").alias("daily_successful"),
        success_rate(F.col("successful"), F.col("movements"), empty="null", cap=cap).alias("daily_success_rate"),
        stable_round(mean("response_sum", "response_n"), 2).alias("avg_response_time_ms"),
        stable_round(mean("battery_sum", "battery_n"), 1).alias("avg_battery_percent"),
        stable_round(mean("temp_sum", "temp_n"), 1).alias("avg_temp_celsius"),
        F.col("battery_min").alias("min_battery_percent"),
        F.col("temp_max").alias("max_temp_celsius"),
        F.col("errors").alias("daily_errors"),
        stable_round(mean("quality_sum", "quality_n"), 1).alias("avg_connection_quality"),
        day_mask_hours(F.col("hours")).alias("active_hours"),
    ]


def user_daily(mart: DataFrame) -> DataFrame:
    """A user's day by device: totals, rounded means, extremes, active hours; the rate is at most 100."""
    return rollup.partials(mart, USER_DAY_KEYS).select(*_user_day_columns(cap=True))


def user_daily_cdc(mart: DataFrame, customer_data: DataFrame) -> DataFrame:
    """`user_daily` with names from the change-fed customer data and without the cap.

    Hours are pre-aggregated per chip and day before the join, so it moves one row per chip and day. A chip
    counts once, under its newest owner record; rows of unknown chips keep NULL names.
    """
    names = ["customer_name", "prosthesis_model", "prosthesis_serial", "customer_region"]
    owner = (
        customer_data.groupBy("chip_id")
        .agg(F.max(F.struct("_version", "user_id", *names)).alias("_c"))
        .select("chip_id", *[F.col(f"_c.{name}").alias(name) for name in names])
    )
    parts = rollup.partials(mart, ["user_id", "chip_id", "report_date"])
    return rollup.merge(parts.join(owner, "chip_id", "left"), USER_DAY_KEYS).select(*_user_day_columns(cap=False))


def _detail_columns() -> list[Column]:
    return [
        F.col("user_id"),
        F.col("report_date"),
        *[F.col(f"latest.{name}").alias(name) for name in rollup.DAY_NAMES],
        F.col("movements").alias("total_movements"),
        F.col("successful").alias("total_successful"),
        success_rate(F.col("successful"), F.col("movements")).alias("daily_success_rate"),
        stable_round(mean("response_sum", "response_n"), 2).alias("avg_response_time"),
        stable_round(mean("battery_sum", "battery_n"), 1).alias("avg_battery_level"),
        F.col("battery_min").alias("min_battery_level"),
        F.col("temp_max").alias("max_actuator_temp"),
        F.col("errors").alias("total_errors"),
        day_mask_hours(F.col("hours")).alias("active_hours"),
    ]


def daily_detail(mart: DataFrame) -> DataFrame:
    """A user's day over all devices, with the names of its newest hour."""
    return rollup.daily_user(mart).select(*_detail_columns())


def _hour_values() -> list[Column]:
    zero_if_null = {"success_rate", "avg_response_time", "avg_battery_level"}
    return [F.coalesce(c, F.lit(0.0)).alias(c) if c in zero_if_null else F.col(c) for c in HOUR_COLUMNS]


def hourly_rows(mart: DataFrame) -> DataFrame:
    """The hourly breakdown, flat; missing rates and means read 0."""
    hour = F.col("report_hour").alias("hour")
    return mart.select("user_id", "report_date", hour, "prosthesis_id", *_hour_values())


def device_hours(mart: DataFrame) -> DataFrame:
    """The hourly breakdown nested: one row per user, day and device with its hours as an array in order.

    A device has 24 hours a day at most (times the loads that were appended), so the array is bounded however many
    devices an account has.
    """
    hours = F.struct(F.col("report_hour").alias("hour"), *_hour_values())
    return mart.groupBy(*rollup.DAY_KEYS, "prosthesis_id").agg(F.sort_array(F.collect_list(hours)).alias("hourly_stats"))


def daily_document(mart: DataFrame) -> DataFrame:
    """Daily reports: the totals of a user's day beside the nested hours of each of its devices."""
    return daily_detail(mart).drop("prosthesis_id").join(device_hours(mart), rollup.DAY_KEYS)


def day_ranking(mart: DataFrame, date: dt.date | str | None = None) -> DataFrame:
    """Users of a day by movements, most first; without a date, of every day, newest day first."""
    rows = mart if date is None else mart.filter(F.col("report_date") == F.lit(date).cast("date"))
    return (
        rows.groupBy("user_id", "report_date")
        .agg(F.count(F.lit(1)).alias("hours"), F.sum("movements_count").alias("total_movements"))
        .orderBy(F.desc("report_date"), F.desc("total_movements"), "user_id")
    )


def fleet_daily(mart: DataFrame, days: int | None = defaults.FLEET_DAYS, approximate: bool = False) -> DataFrame:
    """Users, movements and mean response by day, newest `days` first (None for all days)."""
    users = F.approx_count_distinct("user_id") if approximate else F.count_distinct("user_id")
    result = (
        mart.groupBy("report_date")
        .agg(
            users.alias("users"),
            F.sum("movements_count").alias("total_movements"),
            F.avg("avg_response_time").alias("avg_response"),
        )
        .orderBy(F.desc("report_date"))
    )
    return result if days is None else result.limit(days)


# -- per user ----------------------------------------------------------------------------------------------


def _by_user(days: DataFrame) -> DataFrame:
    """User totals from user-day partials; a day is one row there, so active days are a plain count."""
    return days.groupBy("user_id").agg(
        F.max(F.struct("report_date", "latest")).alias("_last"),
        F.min("report_date").alias("first_activity_date"),
        F.max("report_date").alias("last_activity_date"),
        F.count(F.lit(1)).alias("active_days"),
        *[F.sum(name).alias(name) for name in rollup.ADDITIVE],
    )


def _name(name: str) -> Column:
    return F.col(f"_last.latest.{name}").alias(name)


def _summary(days: DataFrame, empty_rate: str, response: str, battery: str) -> DataFrame:
    return _by_user(days).select(
        "user_id",
        *[_name(n) for n in ("customer_name", "prosthesis_model", "prosthesis_serial", "customer_region")],
        "first_activity_date",
        "last_activity_date",
        (F.datediff("last_activity_date", "first_activity_date") + 1).alias("total_days"),
        "active_days",
        F.col("movements").alias("total_movements"),
        F.col("successful").alias("total_successful"),
        success_rate(F.col("successful"), F.col("movements"), empty=empty_rate).alias("overall_success_rate"),
        stable_round(mean("response_sum", "response_n"), 2).alias(response),
        stable_round(mean("battery_sum", "battery_n"), 1).alias(battery),
        F.col("errors").alias("total_errors"),
        stable_round(F.try_divide(F.col("errors"), F.col("active_days")), 2).alias("avg_errors_per_day"),
    )


def user_summary_from(days: DataFrame) -> DataFrame:
    """All-time summary from stored user-day partials (`rollup.daily_user`)."""
    return _summary(days, "zero", "avg_response_time", "avg_battery_level")


def user_summary(mart: DataFrame) -> DataFrame:
    """All-time summary per user; the rate is 0 without movements."""
    return user_summary_from(rollup.daily_user(mart))


def user_summary_view(mart: DataFrame) -> DataFrame:
    """All-time summary per user in view form; the rate is NULL without movements."""
    return _summary(rollup.daily_user(mart), "null", "avg_response_time_ms", "avg_battery_percent")


def list_header_from(days: DataFrame) -> DataFrame:
    return _by_user(days).select(
        "user_id",
        _name("customer_name"),
        _name("prosthesis_model"),
        F.col("active_days").alias("total_reports"),
        F.col("first_activity_date").alias("first_date"),
        F.col("last_activity_date").alias("last_date"),
    )


def list_header(mart: DataFrame) -> DataFrame:
    """Head of a user's report list: name, model, number of report days, date range."""
    return list_header_from(rollup.daily_user(mart))


def _list_days(mart: DataFrame) -> DataFrame:
    return rollup.partials(mart, rollup.DAY_KEYS).select(
        "user_id",
        "report_date",
        F.col("movements").alias("total_movements"),
        F.col("errors").alias("total_errors"),
        day_mask_hours(F.col("hours")).alias("active_hours"),
    )


def report_list(
    mart: DataFrame, user_id: str | None = None, limit: int = defaults.LIST_LIMIT, offset: int = 0
) -> DataFrame:
    """Report days, newest first, paged: of one user, or of every user at once."""
    if not defaults.LIST_LIMIT_MIN <= limit <= defaults.LIST_LIMIT_MAX:
        raise ValueError(f"limit must be in {defaults.LIST_LIMIT_MIN}..{defaults.LIST_LIMIT_MAX}, not {limit}")
    if offset < 0:
        raise ValueError(f"offset must not be negative: {offset}")
    if user_id is not None:
        return _list_days(for_user(mart, user_id)).orderBy(F.desc("report_date")).offset(offset).limit(limit)
    newest_first = Window.partitionBy("user_id").orderBy(F.desc("report_date"))
    return (
        _list_days(mart)
        .withColumn("_rank", F.row_number().over(newest_first))
        .filter((F.col("_rank") > offset) & (F.col("_rank") <= offset + limit))
        .drop("_rank")
    )


def list_document(mart: DataFrame, n: int = defaults.LIST_LIMIT) -> DataFrame:
    """Report list per user as one nested document: head plus the newest `n` days."""
    return list_document_from(rollup.daily_user(mart), n)


def list_document_from(days: DataFrame, n: int = defaults.LIST_LIMIT) -> DataFrame:
    """Report-list documents from user-day partials.

    Hours are merged to days first, so a user brings at most one row per calendar day to the second shuffle;
    ranking and nesting share it.
    """
    newest_first = Window.partitionBy("user_id").orderBy(F.desc("report_date"))
    day = F.struct(
        F.col("report_date"),
        F.col("movements").alias("total_movements"),
        F.col("errors").alias("total_errors"),
        day_mask_hours(F.col("hours")).alias("active_hours"),
    )
    return (
        days.withColumn("_rank", F.row_number().over(newest_first))
        .groupBy("user_id")
        .agg(
            F.max(F.struct("report_date", "latest")).alias("_last"),
            F.count(F.lit(1)).alias("total_reports"),
            F.min("report_date").alias("_first_date"),
            F.max("report_date").alias("_last_date"),
            F.sort_array(F.collect_list(F.when(F.col("_rank") <= n, day)), asc=False).alias("reports"),
        )
        .select(
            "user_id",
            _name("customer_name"),
            _name("prosthesis_model"),
            "total_reports",
            F.struct(F.col("_first_date").alias("first_date"), F.col("_last_date").alias("last_date")).alias("date_range"),
            "reports",
        )
    )


# -- presentation ------------------------------------------------------------------------------------------


def bands(
    df: DataFrame,
    success: str = "daily_success_rate",
    battery: str = "avg_battery_level",
    errors: str = "total_errors",
) -> DataFrame:
    """Traffic-light columns: success_band, battery_band and error_band are good, warn or bad."""

    def level(value: Column, limits: tuple[int, int]) -> Column:
        return F.when(value >= limits[0], "good").when(value >= limits[1], "warn").otherwise("bad")

    e = F.col(errors)
    return df.select(
        "*",
        level(F.col(success), defaults.SUCCESS_BANDS).alias("success_band"),
        level(F.col(battery), defaults.BATTERY_BANDS).alias("battery_band"),
        F.when(e == 0, "good").when(e < defaults.ERROR_WARN_BELOW, "warn").otherwise("bad").alias("error_band"),
    )
