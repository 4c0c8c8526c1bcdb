"""Building blocks of the comparison SQL: the derived tables as common table expressions."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
SNAPSHOT_AT = "TIMESTAMP '1990-01-01 00:00:00'"


def r(expression: str, digits: int) -> str:
    """Half-up rounding after removing float noise."""
    return f"CAST(round(CAST({expression} AS DECIMAL(38,9)), {digits}) AS DOUBLE)"


def rate(done: str, total: str, empty: str = "0.0", cap: bool = False) -> str:
    value = f"CAST({done} AS DOUBLE) / {total} * 100"
    if cap:
        value = f"least({value}, CAST(100 AS DOUBLE))"
    return f"CASE WHEN {total} > 0 THEN {r(value, 2)} ELSE CAST({empty} AS DOUBLE) END"


def n(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


_CTES: dict[str, tuple[list[str], str]] = {
    "raw": (
        [],
        """SELECT event_id AS telemetry_id, CAST(user_id AS VARCHAR) AS chip_id, ts, value AS myo1, value / 2 AS myo2,
             CASE WHEN k % 7 <> 0 THEN CAST(k AS DOUBLE) END AS myo3,
             CASE WHEN event_type <> 'error' THEN event_type END AS movement_type,
             CASE WHEN k % 10 <> 0 THEN CAST(floor(value) AS INTEGER) END AS response_time_ms,
             CASE WHEN k <> 13 THEN event_type <> 'view' END AS movement_success,
             CAST(35 AS DOUBLE) + k / CAST(10 AS DOUBLE) AS actuator_temp,
             k AS battery_level, 99 - k % 20 AS connection_quality,
             CASE WHEN event_type = 'error' THEN 'ERR_SENSOR' END AS error_code,
             CASE WHEN k % 20 = 0 THEN 1 ELSE 0 END AS warning_flags,
             CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS session_id
           FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)""",
    ),
    "hourly": (
        ["raw"],
        f"""SELECT chip_id, date_trunc('hour', ts) AS hour_start,
             count(*) FILTER (WHERE movement_type IS NOT NULL) AS movements_count,
             count(*) FILTER (WHERE movement_type IS NOT NULL AND movement_success) AS successful_movements,
             avg(response_time_ms) AS avg_response_time, min(response_time_ms) AS min_response_time,
             max(response_time_ms) AS max_response_time, avg(battery_level) AS avg_battery_level,
             min(battery_level) AS min_battery_level, max(battery_level) AS max_battery_level,
             avg(actuator_temp) AS avg_actuator_temp, max(actuator_temp) AS max_actuator_temp,
             count(*) FILTER (WHERE error_code IS NOT NULL) AS error_count,
             count(*) FILTER (WHERE warning_flags > 0) AS warning_count,
             avg(sqrt(pow(coalesce(myo1, 0), 2) + pow(coalesce(myo2, 0), 2) + pow(coalesce(myo3, 0), 2)))
               AS avg_myo_amplitude,
             avg(connection_quality) AS avg_connection_quality, {AS_OF} AS updated_at
           FROM raw GROUP BY ALL""",
    ),
    "present": (
        ["hourly"],
        f"""SELECT chip_id, hour_start, CAST(hour_start AS DATE) AS report_date,
             CAST(hour(hour_start) AS INTEGER) AS report_hour, movements_count, successful_movements,
             {rate("successful_movements", "movements_count")} AS success_rate,
             {r("avg_response_time", 2)} AS avg_response_time, min_response_time, max_response_time,
             {r("avg_battery_level", 2)} AS avg_battery_level, min_battery_level, max_battery_level,
             {r("avg_actuator_temp", 2)} AS avg_actuator_temp, max_actuator_temp, error_count, warning_count,
             {r("avg_myo_amplitude", 2)} AS avg_myo_amplitude,
             {r("avg_connection_quality", 2)} AS avg_connection_quality, updated_at
           FROM hourly""",
    ),
    "customers": (
        [],
        """SELECT c_custkey AS customer_id, c_name AS external_id, c_mktsegment AS first_name,
             'Last' || (c_custkey % 100) AS last_name,
             CASE WHEN c_custkey % 5 < 3 THEN 'M' || (c_custkey % 5) END AS middle_name,
             lower(c_name) || '@example.com' AS email, CAST(NULL AS VARCHAR) AS phone,
             r_name AS region, n_name AS branch,
             TIMESTAMP '2024-01-02 00:00:00' + to_minutes(CAST(c_custkey % 1000 AS INTEGER)) AS updated_at
           FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "models": (
        [],
        """SELECT p_partkey AS model_id, 'MODEL-' || p_partkey AS model_code, p_name AS model_name,
             p_type AS category FROM part""",
    ),
    "prostheses": (
        [],
        """SELECT c_custkey AS prosthesis_id, 'SN-' || c_custkey AS serial_number, c_custkey AS model_id,
             CASE WHEN c_custkey % 97 = 50 THEN NULL WHEN c_custkey % 5 = 4 THEN c_custkey - 1 ELSE c_custkey END
               AS customer_id,
             CASE WHEN c_custkey % 23 = 7 THEN NULL WHEN c_custkey % 23 = 8 THEN '' ELSE CAST(c_custkey AS VARCHAR) END
               AS chip_id,
             CASE WHEN c_custkey % 10 = 9 THEN 'retired' ELSE 'active' END AS status,
             DATE '2023-02-01' + CAST(c_custkey % 300 AS INTEGER) AS sold_date,
             DATE '2025-02-01' + CAST(c_custkey % 300 AS INTEGER) AS warranty_end_date,
             'v2.' || (c_custkey % 4) AS firmware_version,
             TIMESTAMP '2024-01-02 12:00:00' + to_minutes(CAST(c_custkey % 777 AS INTEGER)) AS updated_at
           FROM customer""",
    ),
    "owners": (
        ["customers", "models", "prostheses"],
        """SELECT c.customer_id, c.external_id AS user_id, c.first_name, c.last_name, c.middle_name,
             c.last_name || ' ' || c.first_name || coalesce(' ' || c.middle_name, '') AS customer_full_name,
             c.email AS customer_email, c.phone, c.region AS customer_region, c.branch AS customer_branch,
             p.prosthesis_id, p.serial_number AS prosthesis_serial, p.chip_id, p.status AS prosthesis_status,
             p.firmware_version, m.model_code, m.model_name AS prosthesis_model, m.category AS prosthesis_category,
             p.sold_date, p.warranty_end_date, c.updated_at AS customer_updated_at,
             p.updated_at AS prosthesis_updated_at, greatest(c.updated_at, p.updated_at) AS last_updated_at
           FROM customers c JOIN prostheses p ON c.customer_id = p.customer_id
             JOIN models m ON p.model_id = m.model_id
           WHERE p.status = 'active'""",
    ),
    "mart": (
        ["present", "owners"],
        """SELECT o.user_id, o.prosthesis_id, t.chip_id, t.report_date, t.report_hour,
             o.customer_full_name AS customer_name, o.customer_email, o.customer_region, o.customer_branch,
             o.prosthesis_model, o.prosthesis_category, o.prosthesis_serial,
             t.movements_count, t.successful_movements, t.success_rate,
             coalesce(t.avg_response_time, 0) AS avg_response_time,
             CAST(coalesce(t.min_response_time, 0) AS BIGINT) AS min_response_time,
             CAST(coalesce(t.max_response_time, 0) AS BIGINT) AS max_response_time,
             coalesce(t.avg_battery_level, 0) AS avg_battery_level,
             coalesce(t.min_battery_level, 0) AS min_battery_level,
             coalesce(t.max_battery_level, 0) AS max_battery_level,
             coalesce(t.avg_actuator_temp, 0) AS avg_actuator_temp,
             coalesce(t.max_actuator_temp, 0) AS max_actuator_temp, t.error_count, t.warning_count,
             coalesce(t.avg_connection_quality, 0) AS avg_connection_quality,
             coalesce(t.avg_myo_amplitude, 0) AS avg_myo_amplitude, t.updated_at AS source_updated_at
           FROM present t JOIN owners o ON t.chip_id = o.chip_id WHERE o.chip_id <> ''""",
    ),
    "customer_log": (
        [],
        f"""SELECT c_custkey AS customer_id, c_name AS external_id, c_mktsegment AS first_name,
             'Last' || (c_custkey % 100) AS last_name, CAST(NULL AS VARCHAR) AS middle_name,
             lower(c_name) || '@example.com' AS email, 'REGION_' || (c_nationkey % 5) AS region,
             'NATION_' || c_nationkey AS branch, {SNAPSHOT_AT} AS updated_at, 'r' AS _op,
             CAST(0 AS BIGINT) AS _version, CAST(-1 AS BIGINT) AS _seq, false AS _deleted
           FROM customer
           UNION ALL
           SELECT o_custkey, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0'), o_orderpriority,
             'Last' || (o_custkey % 100), CASE WHEN o_orderkey % 2 = 0 THEN 'M' || (o_orderkey % 7) END,
             'customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '@example.com',
             'REGION_' || (o_orderkey % 5), 'NATION_' || (o_orderkey % 25), CAST(o_orderdate AS TIMESTAMP),
             CASE o_orderstatus WHEN 'F' THEN 'd' WHEN 'O' THEN 'u' ELSE 'c' END,
             epoch_ms(o_orderdate), o_orderkey, o_orderstatus = 'F'
           FROM orders""",
    ),
    "prosthesis_log": (
        [],
        """SELECT l_partkey AS prosthesis_id, 'SN-' || l_partkey AS serial_number, l_suppkey AS model_id,
             l_partkey AS customer_id,
             CASE l_linenumber WHEN 7 THEN NULL WHEN 6 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS chip_id,
             CASE WHEN l_returnflag = 'R' THEN 'maintenance' ELSE 'active' END AS status,
             'v' || l_linenumber AS firmware_version, CAST(l_shipdate AS TIMESTAMP) AS updated_at,
             CASE WHEN l_linestatus = 'F' AND l_discount > 0.07 THEN 'd' ELSE 'u' END AS _op,
             epoch_ms(l_shipdate) AS _version, l_orderkey * 10 + l_linenumber AS _seq,
             l_linestatus = 'F' AND l_discount > 0.07 AS _deleted
           FROM lineitem""",
    ),
    "model_log": (
        [],
        """SELECT s_suppkey AS model_id, 'MODEL-' || s_suppkey AS model_code, s_name AS model_name,
             CASE s_nationkey % 4 WHEN 0 THEN 'arm' WHEN 1 THEN 'leg' WHEN 2 THEN 'hand' ELSE 'finger' END AS category,
             'r' AS _op, CAST(0 AS BIGINT) AS _version, CAST(0 AS BIGINT) AS _seq, false AS _deleted FROM supplier
           UNION ALL
           SELECT s_suppkey, 'MODEL-' || s_suppkey, s_name || ' v2',
             CASE s_nationkey % 4 WHEN 0 THEN 'arm' WHEN 1 THEN 'leg' WHEN 2 THEN 'hand' ELSE 'finger' END,
             'u', 1000, 1000, false FROM supplier WHERE s_suppkey % 3 = 0
           UNION ALL
           SELECT s_suppkey, 'MODEL-' || s_suppkey, s_name,
             CASE s_nationkey % 4 WHEN 0 THEN 'arm' WHEN 1 THEN 'leg' WHEN 2 THEN 'hand' ELSE 'finger' END,
             'd', 2000, 2000, true FROM supplier WHERE s_suppkey % 10 = 4""",
    ),
    **{
        f"{entity}_latest": (
            [f"{entity}_log"],
            f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key}
                  ORDER BY _version DESC, _seq DESC) AS rn FROM {entity}_log) WHERE rn = 1""",
        )
        for entity, key in (("customer", "customer_id"), ("prosthesis", "prosthesis_id"), ("model", "model_id"))
    },
    "customer_data": (
        ["customer_latest", "prosthesis_latest", "model_latest"],
        """SELECT c.external_id AS user_id, c.customer_id,
             c.last_name || ' ' || c.first_name || coalesce(' ' || c.middle_name, '') AS customer_name,
             c.email AS customer_email, c.region AS customer_region, c.branch AS customer_branch, p.prosthesis_id,
             p.serial_number AS prosthesis_serial, p.chip_id, m.model_name AS prosthesis_model,
             m.category AS prosthesis_category, p.firmware_version,
             greatest(c.updated_at, p.updated_at) AS last_updated_at,
             greatest(c._version, p._version, m._version) AS _version
           FROM customer_latest c JOIN prosthesis_latest p ON c.customer_id = p.customer_id
             JOIN model_latest m ON p.model_id = m.model_id
           WHERE p.status = 'active' AND p.chip_id IS NOT NULL
             AND NOT c._deleted AND NOT p._deleted AND NOT m._deleted""",
    ),
    "consent": (
        [],
        """SELECT event_id AS id, user_id AS user_profile_id, event_type,
             CASE WHEN event_type = 'error' THEN 'revoked' ELSE 'granted' END AS action, ts AS created_at
           FROM events""",
    ),
    # newest hour per user and day, and the totals of that day
    "day_last": (
        ["mart"],
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, report_date
             ORDER BY report_hour DESC, prosthesis_id DESC) AS rn FROM mart) WHERE rn = 1""",
    ),
    "user_last": (
        ["mart"],
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id
             ORDER BY report_date DESC, report_hour DESC, prosthesis_id DESC) AS rn FROM mart) WHERE rn = 1""",
    ),
}


def _needed(names: tuple[str, ...]) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        for other in _CTES[name][0]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return order


def sql(select: str, *names: str, **extra: str) -> str:
    """`select` with the named derived tables (and what they need) and `extra` tables in front."""
    ctes = [f"{name} AS ({_CTES[name][1]})" for name in _needed(names)]
    ctes += [f"{name} AS ({body})" for name, body in extra.items()]
    return (f"WITH {', '.join(ctes)} " if ctes else "") + select
