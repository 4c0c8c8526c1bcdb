"""Declared data rules as queries: ranges, domains, uniqueness, references, required values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import defaults

Rules = dict[str, Column]


def between(column: str, low: float | None = None, high: float | None = None) -> Column:
    """True where the value is outside the closed range; a missing value breaks no range."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(column) < low)
    if high is not None:
        bad = bad | (F.col(column) > high)
    return F.coalesce(bad, F.lit(False))


def not_in(column: str, domain: tuple) -> Column:
    return F.coalesce(~F.col(column).isin(*domain), F.lit(False))


def mart_rules() -> Rules:
    """Bounds of hourly values."""
    return {
        "hour_range": between("report_hour", 0, 23),
        "movements_negative": between("movements_count", 0),
        "successful_negative": between("successful_movements", 0),
        "success_rate_range": between("success_rate", 0, 100),
        "response_negative": between("avg_response_time", 0),
        "battery_range": between("avg_battery_level", 0, 100),
        "errors_negative": between("error_count", 0),
        "more_successes_than_movements": F.col("successful_movements") > F.col("movements_count"),
        "no_response_measured": (F.col("movements_count") > 0) & (F.col("max_response_time") == 0),
    }


def daily_rules() -> Rules:
    """Bounds of daily report values."""
    return {
        "movements_negative": between("total_movements", 0),
        "successful_negative": between("total_successful", 0),
        "success_rate_range": between("daily_success_rate", 0, 100),
        "response_negative": between("avg_response_time", 0),
        "battery_range": between("avg_battery_level", 0, 100),
        "min_battery_range": between("min_battery_level", 0, 100),
        "temperature_negative": between("max_actuator_temp", 0),
        "errors_negative": between("total_errors", 0),
        "active_hours_range": between("active_hours", 0, 24),
    }


def summary_rules() -> Rules:
    """Bounds of all-time summary values."""
    return {
        "total_days_negative": between("total_days", 0),
        "active_days_negative": between("active_days", 0),
        "movements_negative": between("total_movements", 0),
        "successful_negative": between("total_successful", 0),
        "success_rate_range": between("overall_success_rate", 0, 100),
        "response_negative": between("avg_response_time", 0),
        "battery_range": between("avg_battery_level", 0, 100),
        "errors_negative": between("total_errors", 0),
        "errors_per_day_negative": between("avg_errors_per_day", 0),
    }


def device_rules() -> Rules:
    return {"status_domain": not_in("status", defaults.DEVICE_STATUSES)}


def model_rules() -> Rules:
    return {"category_domain": not_in("category", defaults.MODEL_CATEGORIES)}


def customer_rules() -> Rules:
    return {"region_domain": not_in("region", defaults.REGIONS)}


def telemetry_rules() -> Rules:
    return {"movement_domain": not_in("movement_type", defaults.MOVEMENT_TYPES)}


def violations(df: DataFrame, rules: Rules) -> DataFrame:
    """Rows that break a rule, with the names of the broken rules in `violated`."""
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return df.withColumn("violated", broken).filter(F.size("violated") > 0)


def violation_counts(df: DataFrame, rules: Rules) -> DataFrame:
    """Rows and violations per rule, in one pass: one row per rule, also for rules nobody breaks."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.array(
            *[F.struct(F.lit(name).alias("rule"), F.count_if(bad).alias("violations")) for name, bad in rules.items()]
        ).alias("_r"),
    )
    return counted.select("rows", F.inline("_r"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once; keys with a missing part are not compared."""
    present = df.select(*keys).dropna(subset=keys)
    return present.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter(F.col("occurrences") > 1)


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of `child` that refer to no row of `parent`; a missing reference is no orphan."""
    known = parent.select(F.col(parent_key).alias(key)).distinct()
    return child.filter(F.col(key).isNotNull()).join(known, key, "left_anti").select(*child.columns)


def nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and missing values per required column, in one pass."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.array(
            *[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls")) for c in columns]
        ).alias("_c"),
    )
    return counted.select("rows", F.inline("_c"))
