"""Daily rollups kept as mergeable partials.

Sums, counts, extremes and an hour mask can be combined in any order, ratios and means cannot. So partials are
what is stored and shuffled, and `finish_*` turns them into report columns at the very end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import day_mask_hours, hours_mask, newest, success_rate
from ..functions.times import moment

DAILY_KEYS = ["user_id", "prosthesis_id", "report_date"]
DAY_KEYS = ["user_id", "report_date"]
DAY_NAMES = ["customer_name", "prosthesis_id", "prosthesis_model", "prosthesis_serial", "customer_region"]
HOUR_ORDER = ["report_hour", "prosthesis_id"]

# Distinct counts that merge, by opt-in: sketch column and what it counts. A sketch holds 2^SKETCH_LG_K registers at most
# (about 4 kB), however many values it has seen.
SKETCHES = {"users_sketch": "user_id", "devices_sketch": "prosthesis_id"}
SKETCH_LG_K = 12
# Three standard errors of a merged sketch of that size (1.04 / sqrt(2^12) each).
SKETCH_ERROR = 0.05

ADDITIVE = [
    "hour_rows",
    "movements",
    "successful",
    "errors",
    "response_sum",
    "response_n",
    "response_weighted",
    "battery_sum",
    "battery_n",
    "temp_sum",
    "temp_n",
    "quality_sum",
    "quality_n",
]


def _measures() -> list[Column]:
    """How mart rows enter the partials; the additive ones are listed above, the others merge by their own kind."""
    response = F.col("avg_response_time")
    return [
        F.count(F.lit(1)).alias("hour_rows"),
        F.sum("movements_count").alias("movements"),
        F.sum("successful_movements").alias("successful"),
        F.sum("error_count").alias("errors"),
        F.sum(response).alias("response_sum"),
        F.count(response).alias("response_n"),
        F.sum(response * F.col("movements_count")).alias("response_weighted"),
        F.sum("avg_battery_level").alias("battery_sum"),
        F.count("avg_battery_level").alias("battery_n"),
        F.sum("avg_actuator_temp").alias("temp_sum"),
        F.count("avg_actuator_temp").alias("temp_n"),
        F.sum("avg_connection_quality").alias("quality_sum"),
        F.count("avg_connection_quality").alias("quality_n"),
        F.min("min_battery_level").alias("battery_min"),
        F.max("max_actuator_temp").alias("temp_max"),
        hours_mask(F.col("report_hour")).alias("hours"),
    ]


def partials(
    mart: DataFrame,
    keys: list[str | Column],
    names: list[str] | None = None,
    order: list[str] | None = None,
    extra: list[Column] | None = None,
) -> DataFrame:
    """Mergeable daily measures of mart rows by `keys`.

    With `names`, `latest` holds those columns as of the last row by `order`; `extra` aggregates share the same
    shuffle. Measures no caller reads are pruned from the plan, so one definition serves every report.
    """
    parts = _measures()
    if names:
        parts.append(newest(order or HOUR_ORDER, names).alias("latest"))
    return mart.groupBy(*keys).agg(*parts, *(extra or []))


def merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Combine partials that share `keys`: merging parts of a load equals rolling up the whole load."""
    merged = [F.sum(name).alias(name) for name in ADDITIVE]
    merged += [
        F.min("battery_min").alias("battery_min"),
        F.max("temp_max").alias("temp_max"),
        F.bit_or("hours").alias("hours"),
    ]
    if "latest" in parts.columns:
        merged.append(F.max("latest").alias("latest"))
    merged += [F.hll_union_agg(name).alias(name) for name in SKETCHES if name in parts.columns]
    return parts.groupBy(*keys).agg(*merged)


def mean(total: str, count: str) -> Column:
    return F.try_divide(F.col(total), F.col(count))


def daily_partials(mart: DataFrame) -> DataFrame:
    """Stored form of the daily rollup by user, device and date."""
    return partials(mart, DAILY_KEYS, ["customer_name", "prosthesis_model"], ["report_hour"])


def finish_daily(parts: DataFrame, weighted: bool = False) -> DataFrame:
    """Daily rollup columns. `avg_response_time` is the plain mean of hourly means; `weighted` adds the mean
    weighted by movements."""
    columns = [
        *[F.col(k) for k in DAILY_KEYS],
        F.col("latest.customer_name").alias("customer_name"),
        F.col("latest.prosthesis_model").alias("prosthesis_model"),
        F.col("movements").alias("total_movements"),
        F.col("successful").alias("total_successful"),
        success_rate(F.col("successful"), F.col("movements")).alias("daily_success_rate"),
        mean("response_sum", "response_n").alias("avg_response_time"),
        F.col("battery_min").alias("min_battery"),
        F.col("temp_max").alias("max_temp"),
        F.col("errors").alias("total_errors"),
        day_mask_hours(F.col("hours")).alias("active_hours"),
    ]
    if weighted:
        columns.append(mean("response_weighted", "movements").alias("weighted_response_time"))
    return parts.select(*columns)


def daily(mart: DataFrame, weighted: bool = False, as_of=None) -> DataFrame:
    """Daily rollup straight from mart rows, in one shuffle; stamped only when `as_of` is given."""
    result = finish_daily(daily_partials(mart), weighted)
    return result if as_of is None else stamp(result, as_of)


def stamp(rows: DataFrame, as_of=None) -> DataFrame:
    return rows.withColumn("etl_processed_at", moment(as_of))


def daily_user(mart: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """Partials by user and day over all devices: the pre-aggregate behind lists, summaries and fleet reports."""
    return partials(mart, DAY_KEYS, DAY_NAMES, HOUR_ORDER, extra)


def sketches(lg_k: int = SKETCH_LG_K) -> list[Column]:
    """Sketches of distinct users and devices, for `extra` of `partials`; `merge` unites them, `estimate` reads them."""
    return [F.hll_sketch_agg(counted, lg_k).alias(name) for name, counted in SKETCHES.items()]


def estimate(sketch: str) -> Column:
    """The distinct count a sketch stands for: off by more than SKETCH_ERROR of it about once in 300 times."""
    return F.hll_sketch_estimate(sketch)


def fleet_days(mart: DataFrame) -> DataFrame:
    """Stored form of the fleet report: partials by date with sketches of users and devices.

    A distinct count of a week can't be had from those of its days, a sketch can: any span of days is merged from one
    small row a day, without going back to the mart.
    """
    return partials(mart, ["report_date"], extra=sketches())


def finish_fleet(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Fleet totals with estimated users and devices; `report.fleet_daily` counts them exactly, from the mart."""
    return parts.select(
        *keys,
        estimate("users_sketch").alias("users"),
        estimate("devices_sketch").alias("devices"),
        F.col("hour_rows"),
        F.col("movements").alias("total_movements"),
        F.col("errors").alias("total_errors"),
        mean("response_sum", "response_n").alias("avg_response"),
    )


def touched_days(delta: DataFrame) -> DataFrame:
    return delta.select("report_date").distinct()


def refresh(mart: DataFrame, delta: DataFrame, how=daily_partials) -> DataFrame:
    """Rollup partials (by `how`) of the days a load touched, recomputed from the mart.

    Recomputing whole days keeps the rollup right when hours are loaded again, which adding the delta would not;
    the semi-join prunes the mart scan to the touched date partitions.
    """
    return how(mart.join(touched_days(delta), "report_date", "left_semi"))
