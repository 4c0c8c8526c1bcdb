"""Report queries over the mart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import day_mask_hours, month_key, stable_round
from ..operators import cdc, monitor, publish, report, rollup, upsert
from ..sources import sample_tables as st
from .oracle import n, r, rate, sql
from .registry import query, rounded

_DAY_TOTALS = f"""{n("sum(movements_count)")} AS total_movements, {n("sum(successful_movements)")} AS total_successful"""


def _mart(spark, folder):
    return st.mart_rows(spark, folder)


# -- daily -------------------------------------------------------------------------------------------------

_DAILY = sql(
    f"""SELECT user_id, prosthesis_id, report_date, arg_max(customer_name, report_hour) AS customer_name,
          arg_max(prosthesis_model, report_hour) AS prosthesis_model, {_DAY_TOTALS},
          {rate("sum(successful_movements)", "sum(movements_count)")} AS daily_success_rate,
          {r("avg(avg_response_time)", 6)} AS avg_response_time, min(min_battery_level) AS min_battery,
          max(max_actuator_temp) AS max_temp, {n("sum(error_count)")} AS total_errors,
          CAST(count(DISTINCT report_hour) AS INTEGER) AS active_hours
        FROM mart GROUP BY user_id, prosthesis_id, report_date""",
    "mart",
)


@query("daily_rollup", _DAILY)
def daily_rollup(spark, folder):
    """Daily rollup by user, device and date."""
    return rounded(rollup.daily(_mart(spark, folder)), 6, "avg_response_time")


@query("daily_rollup_merged", _DAILY)
def daily_rollup_merged(spark, folder):
    """The same rollup from the merged partials of separate loads."""
    mart = _mart(spark, folder)
    loads = [
        mart.filter(F.col("report_hour") < 8),
        mart.filter((F.col("report_hour") >= 8) & (F.col("report_hour") < 16)),
        mart.filter(F.col("report_hour") >= 16),
    ]
    parts = [rollup.daily_partials(load) for load in loads]
    merged = rollup.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]), rollup.DAILY_KEYS)
    return rounded(rollup.finish_daily(merged), 6, "avg_response_time")


@query(
    "daily_weighted_response",
    sql(
        f"""SELECT user_id, prosthesis_id, report_date,
              CASE WHEN sum(movements_count) > 0
                THEN {r("sum(avg_response_time * movements_count) / sum(movements_count)", 6)} END AS weighted_response_time
            FROM mart GROUP BY user_id, prosthesis_id, report_date""",
        "mart",
    ),
)
def daily_weighted_response(spark, folder):
    """Response time per device day, weighted by movements."""
    daily = rollup.daily(_mart(spark, folder), weighted=True)
    return rounded(daily.select(*rollup.DAILY_KEYS, "weighted_response_time"), 6, "weighted_response_time")


@query(
    "user_day_totals",
    sql(
        f"""SELECT user_id, report_date, {n("sum(movements_count)")} AS total_movements,
              {r("avg(avg_response_time)", 6)} AS avg_response_time, {r("avg(avg_battery_level)", 6)} AS avg_battery_level
            FROM mart GROUP BY user_id, report_date""",
        "mart",
    ),
)
def user_day_totals(spark, folder):
    """The pre-aggregate by user and day."""
    days = rollup.daily_user(_mart(spark, folder)).select(
        "user_id",
        "report_date",
        F.col("movements").alias("total_movements"),
        rollup.mean("response_sum", "response_n").alias("avg_response_time"),
        rollup.mean("battery_sum", "battery_n").alias("avg_battery_level"),
    )
    return rounded(days, 6, "avg_response_time", "avg_battery_level")


def _user_day_sql(source: str, cap: bool) -> str:
    return f"""SELECT user_id, customer_name, prosthesis_model, prosthesis_serial, customer_region, report_date,
      {n("sum(movements_count)")} AS daily_movements, {n("sum(successful_movements)")} AS daily_successful,
      {rate("sum(successful_movements)", "sum(movements_count)", "NULL", cap)} AS daily_success_rate,
      {r("avg(avg_response_time)", 2)} AS avg_response_time_ms, {r("avg(avg_battery_level)", 1)} AS avg_battery_percent,
      {r("avg(avg_actuator_temp)", 1)} AS avg_temp_celsius, min(min_battery_level) AS min_battery_percent,
      max(max_actuator_temp) AS max_temp_celsius, {n("sum(error_count)")} AS daily_errors,
      {r("avg(avg_connection_quality)", 1)} AS avg_connection_quality,
      CAST(count(DISTINCT report_hour) AS INTEGER) AS active_hours
    FROM {source} GROUP BY ALL"""


@query("user_daily", sql(_user_day_sql("mart", True), "mart"))
def user_daily(spark, folder):
    """A user's day by device, rate capped at 100."""
    return report.user_daily(_mart(spark, folder))


@query(
    "user_daily_capped",
    sql(
        _user_day_sql("(SELECT * REPLACE (movements_count * 2 AS successful_movements) FROM mart)", True),
        "mart",
    ),
)
def user_daily_capped(spark, folder):
    """The cap at work: a source that reports twice as many successes as movements."""
    return report.user_daily(_mart(spark, folder).withColumn("successful_movements", F.col("movements_count") * 2))


@query(
    "user_daily_cdc",
    sql(
        _user_day_sql(
            """(SELECT t.* EXCLUDE (customer_name, prosthesis_model, prosthesis_serial, customer_region), c.customer_name,
                  c.prosthesis_model, c.prosthesis_serial, c.customer_region
                FROM mart t LEFT JOIN customer_data c ON t.chip_id = c.chip_id)""",
            False,
        ),
        "mart",
        "customer_data",
    ),
)
def user_daily_cdc(spark, folder):
    """A user's day by device, named from the change-fed customer data."""
    logs = st.change_logs(spark, folder)
    dimension = cdc.customer_data(logs["customers"], logs["prostheses"], logs["models"])
    return report.user_daily_cdc(_mart(spark, folder), dimension)


_DETAIL = f"""SELECT user_id, report_date, l.customer_name, l.prosthesis_id, l.prosthesis_model, l.prosthesis_serial,
    l.customer_region, d.* EXCLUDE (user_id, report_date)
  FROM (SELECT user_id, report_date, {_DAY_TOTALS},
          {rate("sum(successful_movements)", "sum(movements_count)")} AS daily_success_rate,
          {r("avg(avg_response_time)", 2)} AS avg_response_time, {r("avg(avg_battery_level)", 1)} AS avg_battery_level,
          min(min_battery_level) AS min_battery_level, max(max_actuator_temp) AS max_actuator_temp,
          {n("sum(error_count)")} AS total_errors, CAST(count(DISTINCT report_hour) AS INTEGER) AS active_hours
        FROM mart GROUP BY user_id, report_date) d
    JOIN day_last l USING (user_id, report_date)"""


@query("daily_detail", sql(_DETAIL, "day_last"))
def daily_detail(spark, folder):
    """A user's day over all devices."""
    return report.daily_detail(_mart(spark, folder))


_DOCUMENT_ROWS = """SELECT d.user_id, d.report_date, d.customer_name, d.total_movements, d.daily_success_rate,
    h.report_hour AS hour, h.movements_count, h.successful_movements, h.success_rate AS hour_success_rate,
    h.avg_response_time AS hour_avg_response_time, h.avg_battery_level AS hour_avg_battery_level, h.error_count,
    h.prosthesis_id, h.position
  FROM detail d JOIN hours h USING (user_id, report_date)"""


def _unnested(documents):
    opened = documents.select(
        "user_id",
        "report_date",
        "customer_name",
        "total_movements",
        "daily_success_rate",
        "prosthesis_id",
        F.posexplode("hourly_stats").alias("position", "h"),
    )
    fields = [
        F.col("h.hour").alias("hour"),
        F.col("h.movements_count").alias("movements_count"),
        F.col("h.successful_movements").alias("successful_movements"),
        F.col("h.success_rate").alias("hour_success_rate"),
        F.col("h.avg_response_time").alias("hour_avg_response_time"),
        F.col("h.avg_battery_level").alias("hour_avg_battery_level"),
        F.col("h.error_count").alias("error_count"),
    ]
    head = ["user_id", "report_date", "customer_name", "total_movements", "daily_success_rate", "prosthesis_id", "position"]
    return opened.select(*head, *fields)


@query(
    "daily_document",
    sql(
        _DOCUMENT_ROWS,
        "day_last",
        detail=_DETAIL,
        hours="""SELECT *, CAST(row_number() OVER (PARTITION BY user_id, report_date, prosthesis_id
                   ORDER BY report_hour) - 1 AS INTEGER) AS position FROM mart""",
    ),
)
def daily_document(spark, folder):
    """Daily documents, opened again to show every nested hour and its place."""
    return _unnested(report.daily_document(_mart(spark, folder)))


@query(
    "hourly_breakdown",
    sql(
        """SELECT user_id, report_date, report_hour AS hour, prosthesis_id, movements_count, successful_movements,
             success_rate, avg_response_time, avg_battery_level, error_count FROM mart""",
        "mart",
    ),
)
def hourly_breakdown(spark, folder):
    """The hourly breakdown, flat."""
    return report.hourly_rows(_mart(spark, folder)).orderBy("user_id", "report_date", "hour", "prosthesis_id")


@query(
    "day_ranking",
    sql(
        f"""SELECT user_id, report_date, count(*) AS hours, {n("sum(movements_count)")} AS total_movements
            FROM mart GROUP BY user_id, report_date""",
        "mart",
    ),
)
def day_ranking(spark, folder):
    """Users of each day by movements."""
    return report.day_ranking(_mart(spark, folder))


_FLEET = f"""SELECT report_date, count(DISTINCT user_id) AS users, {n("sum(movements_count)")} AS total_movements,
    {r("avg(avg_response_time)", 6)} AS avg_response FROM mart GROUP BY report_date"""


@query("fleet_daily", sql(_FLEET, "mart"))
def fleet_daily(spark, folder):
    """Fleet statistics of every day."""
    return rounded(report.fleet_daily(_mart(spark, folder), days=None), 6, "avg_response")


@query("fleet_last_days", sql(_FLEET + " ORDER BY report_date DESC LIMIT 7", "mart"))
def fleet_last_days(spark, folder):
    """Fleet statistics of the last seven days with data."""
    return rounded(report.fleet_daily(_mart(spark, folder)), 6, "avg_response")


# -- per user ----------------------------------------------------------------------------------------------


def _summary_sql(empty: str, response: str, battery: str) -> str:
    return sql(
        f"""SELECT user_id, l.customer_name, l.prosthesis_model, l.prosthesis_serial, l.customer_region,
              s.* EXCLUDE (user_id)
            FROM (SELECT user_id, min(report_date) AS first_activity_date, max(report_date) AS last_activity_date,
                    CAST(max(report_date) - min(report_date) + 1 AS INTEGER) AS total_days,
                    count(DISTINCT report_date) AS active_days, {_DAY_TOTALS},
                    {rate("sum(successful_movements)", "sum(movements_count)", empty)} AS overall_success_rate,
                    {r("avg(avg_response_time)", 2)} AS {response}, {r("avg(avg_battery_level)", 1)} AS {battery},
                    {n("sum(error_count)")} AS total_errors,
                    {r("CAST(sum(error_count) AS DOUBLE) / count(DISTINCT report_date)", 2)} AS avg_errors_per_day
                  FROM mart GROUP BY user_id) s JOIN user_last l USING (user_id)""",
        "user_last",
    )


@query("user_summary", _summary_sql("0.0", "avg_response_time", "avg_battery_level"))
def user_summary(spark, folder):
    """All-time summary of every user."""
    return report.user_summary(_mart(spark, folder))


@query("user_summary_view", _summary_sql("NULL", "avg_response_time_ms", "avg_battery_percent"))
def user_summary_view(spark, folder):
    """All-time summary of every user, NULL rate without movements."""
    return report.user_summary_view(_mart(spark, folder))


_HEADER = """SELECT user_id, l.customer_name, l.prosthesis_model, h.total_reports, h.first_date, h.last_date
  FROM (SELECT user_id, count(DISTINCT report_date) AS total_reports, min(report_date) AS first_date,
          max(report_date) AS last_date FROM mart GROUP BY user_id) h JOIN user_last l USING (user_id)"""


@query("list_header", sql(_HEADER, "user_last"))
def list_header(spark, folder):
    """Head of every user's report list."""
    return report.list_header(_mart(spark, folder))


_LIST_DAYS = f"""SELECT user_id, report_date, {n("sum(movements_count)")} AS total_movements,
    {n("sum(error_count)")} AS total_errors, CAST(count(DISTINCT report_hour) AS INTEGER) AS active_hours,
    row_number() OVER (PARTITION BY user_id ORDER BY report_date DESC) AS rank
  FROM mart GROUP BY user_id, report_date"""


@query(
    "report_list",
    sql("SELECT * EXCLUDE (rank) FROM days WHERE rank <= 30", "mart", days=_LIST_DAYS),
)
def report_list(spark, folder):
    """First page of every user's report list."""
    return report.report_list(_mart(spark, folder))


@query(
    "report_list_next_page",
    sql("SELECT * EXCLUDE (rank) FROM days WHERE rank > 10 AND rank <= 20", "mart", days=_LIST_DAYS),
)
def report_list_next_page(spark, folder):
    """Second page of ten of every user's report list."""
    return report.report_list(_mart(spark, folder), limit=10, offset=10)


@query(
    "list_document",
    sql(
        """SELECT user_id, h.customer_name, h.prosthesis_model, h.total_reports, h.first_date, h.last_date,
             CAST(d.rank - 1 AS INTEGER) AS position, d.report_date, d.total_movements, d.total_errors, d.active_hours
           FROM header h JOIN days d USING (user_id) WHERE d.rank <= 30""",
        "user_last",
        days=_LIST_DAYS,
        header=_HEADER,
    ),
)
def list_document(spark, folder):
    """Report-list documents, opened again to show every nested day and its place."""
    return (
        report.list_document(_mart(spark, folder))
        .select("*", F.posexplode("reports").alias("position", "d"))
        .select(
            "user_id",
            "customer_name",
            "prosthesis_model",
            "total_reports",
            "date_range.first_date",
            "date_range.last_date",
            "position",
            "d.report_date",
            "d.total_movements",
            "d.total_errors",
            "d.active_hours",
        )
    )


@query(
    "requested_days",
    sql(
        """SELECT * FROM (SELECT *, max(report_date) OVER (PARTITION BY user_id) AS last_date FROM detail)
           WHERE report_date = last_date""",
        "day_last",
        detail=_DETAIL,
    ),
)
def requested_days(spark, folder):
    """Daily reports for a table of requests: here every user's last day."""
    mart = _mart(spark, folder)
    requests = mart.groupBy("user_id").agg(F.max("report_date").alias("report_date"))
    details = report.daily_detail(report.for_requests(mart, requests))
    return details.withColumn("last_date", F.col("report_date"))


@query(
    "scoped_usage",
    sql(
        f"""SELECT principal, count(*) AS visible_rows, {n("sum(movements_count)")} AS total_movements
            FROM (SELECT n_name AS principal, c_name AS user_id FROM customer JOIN nation ON c_nationkey = n_nationkey
                  UNION ALL SELECT c_name, c_name FROM customer) e JOIN mart USING (user_id) GROUP BY principal""",
        "mart",
    ),
)
def scoped_usage(spark, folder):
    """What every principal may see: customers their own rows, branches those of their customers."""
    customers = st.customers(spark, folder)
    branch = customers.select(F.col("branch").alias("principal"), F.col("external_id").alias("user_id"))
    own = customers.select(F.col("external_id").alias("principal"), F.col("external_id").alias("user_id"))
    # one row per user before rows are repeated for every principal who may see them
    users = (
        _mart(spark, folder)
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("movements_count").alias("movements"))
    )
    return (
        report.scope_each(users, branch.unionByName(own))
        .groupBy("principal")
        .agg(F.sum("rows").alias("visible_rows"), F.sum("movements").alias("total_movements"))
    )


@query(
    "report_bands",
    sql(
        """SELECT user_id, report_date, daily_success_rate, avg_battery_level, total_errors,
             CASE WHEN daily_success_rate >= 95 THEN 'good' WHEN daily_success_rate >= 85 THEN 'warn' ELSE 'bad' END
               AS success_band,
             CASE WHEN avg_battery_level >= 50 THEN 'good' WHEN avg_battery_level >= 20 THEN 'warn' ELSE 'bad' END
               AS battery_band,
             CASE WHEN total_errors = 0 THEN 'good' WHEN total_errors < 5 THEN 'warn' ELSE 'bad' END AS error_band
           FROM detail""",
        "day_last",
        detail=_DETAIL,
    ),
)
def report_bands(spark, folder):
    """Traffic lights of every user's day."""
    columns = ["user_id", "report_date", "daily_success_rate", "avg_battery_level", "total_errors"]
    return report.bands(report.daily_detail(_mart(spark, folder)).select(*columns))


@query(
    "distinct_counts",
    sql(
        """SELECT user_id, CAST(count(DISTINCT report_hour) AS INTEGER) AS hours_of_day,
             count(DISTINCT report_date) AS days FROM mart GROUP BY user_id""",
        "mart",
    ),
)
def distinct_counts(spark, folder):
    """Hours of day and days a user was active: hours from a merged mask, days from day rows."""
    return (
        rollup.daily_user(_mart(spark, folder))
        .groupBy("user_id")
        .agg(day_mask_hours(F.bit_or("hours")).alias("hours_of_day"), F.count(F.lit(1)).alias("days"))
    )


def _around(column: str) -> Column:
    """Whether an estimate is as near its exact count as sketches promise."""
    exact = F.col(column)
    return (F.abs(F.col(f"{column}_estimate") - exact) <= F.greatest(exact * rollup.SKETCH_ERROR, F.lit(1))).alias(f"{column}_near")


@query(
    "fleet_months",
    sql(
        f"""SELECT CAST(year(report_date) * 100 + month(report_date) AS INTEGER) AS report_month,
              count(DISTINCT user_id) AS users, count(DISTINCT prosthesis_id) AS devices, count(*) AS hour_rows,
              {_DAY_TOTALS.split(" AS total_movements")[0]} AS total_movements, {n("sum(error_count)")} AS total_errors,
              true AS users_near, true AS devices_near
            FROM mart GROUP BY 1""",
        "mart",
    ),
)
def fleet_months(spark, folder):
    """Months merged from stored days, whose sketches of users and devices are set against exact counts of the mart."""
    mart = _mart(spark, folder)
    month = month_key(F.col("report_date")).alias("report_month")
    days = rollup.fleet_days(mart).withColumn("report_month", month_key(F.col("report_date")))
    merged = rollup.finish_fleet(rollup.merge(days, ["report_month"]), ["report_month"])
    estimated = merged.withColumnsRenamed({"users": "users_estimate", "devices": "devices_estimate"})
    exact = mart.groupBy(month).agg(
        F.count_distinct("user_id").alias("users"), F.count_distinct("prosthesis_id").alias("devices")
    )
    return estimated.join(exact, "report_month").select(
        "report_month", "users", "devices", "hour_rows", "total_movements", "total_errors", _around("users"), _around("devices")
    )


# -- loads and published documents -------------------------------------------------------------------------


@query(
    "load_metrics",
    sql(
        """SELECT count(*) AS records_count, count(DISTINCT user_id) AS unique_users,
             min(report_date) AS min_date, max(report_date) AS max_date FROM mart""",
        "mart",
    ),
)
def load_metrics(spark, folder):
    """Record count, users and date range of a load."""
    return monitor.load_metrics(_mart(spark, folder))


@query(
    "load_check",
    sql(
        """SELECT user_id, count(*) AS total_records, min(report_date) AS first_date, max(report_date) AS last_date
           FROM mart GROUP BY user_id""",
        "mart",
    ),
)
def load_check(spark, folder):
    """Rows and date range per user."""
    return monitor.load_check(_mart(spark, folder))


_WEEK = "report_date > DATE '2024-01-31' - 7"


def _last_week(mart):
    return upsert.retain(mart, "report_date", 7, st.AS_OF)


@query("affected_users", sql(f"SELECT DISTINCT user_id FROM mart WHERE {_WEEK}", "mart"))
def affected_users(spark, folder):
    """Users touched by the load of the last week."""
    return publish.affected(_last_week(_mart(spark, folder)))


@query(
    "missing_reports",
    sql(
        f"""SELECT DISTINCT user_id, report_date FROM mart WHERE {_WEEK} AND (user_id, report_date) NOT IN
              (SELECT (user_id, report_date) FROM mart WHERE report_hour < 12)""",
        "mart",
    ),
)
def missing_reports(spark, folder):
    """Days of the last week not published yet, when documents exist for days with a morning."""
    mart = _mart(spark, folder)
    published = mart.filter(F.col("report_hour") < 12).select("user_id", "report_date")
    return publish.missing(_last_week(mart).select("user_id", "report_date"), published)


@query(
    "refreshed_documents",
    sql(
        f"""SELECT 'summary' AS kind, user_id || '/summary/summary.json' AS object_key, user_id,
              CAST(NULL AS DATE) AS report_date FROM (SELECT DISTINCT user_id FROM mart WHERE {_WEEK})
            UNION ALL
            SELECT 'list', user_id || '/list/reports.json', user_id, NULL
              FROM (SELECT DISTINCT user_id FROM mart WHERE {_WEEK})
            UNION ALL
            SELECT DISTINCT 'daily', user_id || '/daily/' || report_date || '/report.json', user_id, report_date
              FROM mart WHERE user_id IN (SELECT user_id FROM mart WHERE {_WEEK})
            UNION ALL
            SELECT DISTINCT 'daily', user_id || '/daily/' || report_date || '/hours-' || prosthesis_id || '.json', user_id,
              report_date FROM mart WHERE user_id IN (SELECT user_id FROM mart WHERE {_WEEK})""",
        "mart",
    ),
)
def refreshed_documents(spark, folder):
    """Documents rebuilt after a load of the last week: all kinds, only for affected users."""
    mart = _mart(spark, folder)
    rebuilt = publish.refreshed(mart, publish.affected(_last_week(mart)))
    return rebuilt.select("kind", "object_key", "user_id", "report_date")


@query(
    "published_summaries",
    sql(
        f"""SELECT user_id || '/summary/summary.json' AS object_key, user_id, active_days, total_movements,
              overall_success_rate, first_activity_date FROM summary""",
        summary=_summary_sql("0.0", "avg_response_time", "avg_battery_level"),
    ),
)
def published_summaries(spark, folder):
    """Summary documents read back from their JSON form."""
    rows = publish.all_documents(_mart(spark, folder), kinds=("summary",))
    schema = "user_id STRING, active_days BIGINT, total_movements BIGINT, overall_success_rate DOUBLE, first_activity_date DATE"
    return rows.select("object_key", F.from_json("body", schema).alias("d")).select(
        "object_key",
        "d.user_id",
        "d.active_days",
        "d.total_movements",
        stable_round(F.col("d.overall_success_rate"), 2).alias("overall_success_rate"),
        "d.first_activity_date",
    )
