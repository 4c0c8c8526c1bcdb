"""Queries over the change feed, versioned rows, profiles and consent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import month_key
from ..operators import cdc, monitor, profiles, report, upsert
from ..sources import sample_tables as st
from .oracle import sql
from .registry import query

_CUSTOMER = "customer_id, external_id, first_name, last_name, middle_name, email, region, branch, updated_at, _op, _version, _deleted"
_DEVICE = "prosthesis_id, serial_number, model_id, customer_id, chip_id, status, firmware_version, updated_at, _op, _version, _deleted"
_MODEL = "model_id, model_code, model_name, category, _op, _version, _deleted"


def _names(columns: str) -> list[str]:
    return columns.split(", ")


def _logs(spark, folder):
    return st.change_logs(spark, folder)




# -- feed --------------------------------------------------------------------------------------------------


@query(
    "decoded_customer_changes",
    sql(f"SELECT {_CUSTOMER}, _seq FROM customer_log WHERE (_seq % 101 + 101) % 101 <> 0", "customer_log"),
)
def decoded_customer_changes(spark, folder):
    """Customer messages decoded to typed, versioned rows; cut-off messages are left out."""
    good, _ = cdc.split_corrupt(cdc.decode(st.messages(st.customer_log(spark, folder)), "customers"))
    return good.select(*_names(_CUSTOMER), "_seq").withColumn("customer_id", F.col("customer_id").cast("long"))


@query(
    "decoded_device_changes",
    sql(
        f"""SELECT {_DEVICE}, _seq, DATE '2020-01-01' AS manufactured_date FROM prosthesis_log
            WHERE (_seq % 101 + 101) % 101 <> 0""",
        "prosthesis_log",
    ),
)
def decoded_device_changes(spark, folder):
    """Device messages decoded to typed, versioned rows."""
    good, _ = cdc.split_corrupt(cdc.decode(st.messages(st.prosthesis_log(spark, folder)), "prostheses"))
    ids = {c: F.col(c).cast("long") for c in ("prosthesis_id", "model_id", "customer_id")}
    return good.select(*_names(_DEVICE), "_seq", "manufactured_date").withColumns(ids)


@query(
    "dead_letters",
    sql("SELECT _seq, 'malformed' AS _reason FROM customer_log WHERE (_seq % 101 + 101) % 101 = 0", "customer_log"),
)
def dead_letters(spark, folder):
    """Messages that could not be decoded, kept with the reason."""
    _, bad = cdc.split_corrupt(cdc.decode(st.messages(st.customer_log(spark, folder)), "customers"))
    return bad.select("_seq", "_reason")


@query(
    "decoded_model_changes",
    sql(f"SELECT {_MODEL}, _seq FROM model_log WHERE _seq % 101 <> 0", "model_log"),
)
def decoded_model_changes(spark, folder):
    """Model messages decoded to typed, versioned rows."""
    good, _ = cdc.split_corrupt(cdc.decode(st.messages(st.model_log(spark, folder)), "models"))
    return good.select(*_names(_MODEL), "_seq").withColumn("model_id", F.col("model_id").cast("long"))


def _faults(entity: str, log: str) -> str:
    """SQL for the reasons that the faults of `faulty_messages` must get."""
    text, needed, time = st.FAULTY_COLUMNS[entity]
    k = "(_seq % 16 + 16) % 16"
    return f"""SELECT '{entity}' AS entity, _seq, CASE WHEN (_seq % 101 + 101) % 101 = 0 THEN 'malformed'
        WHEN {k} = 1 THEN 'unknown operation' WHEN _deleted THEN NULL WHEN {k} = 2 THEN 'wrong type: {time}'
        WHEN {k} = 3 THEN 'missing column: {needed}' WHEN {k} = 4 THEN 'out of range: {time}'
        WHEN {k} = 5 THEN 'wrong type: {text}' END AS _reason FROM {log}"""


_LOG_NAMES = {"customers": "customer_log", "prostheses": "prosthesis_log", "models": "model_log"}


@query(
    "message_faults",
    sql(
        "SELECT * FROM ("
        + " UNION ALL ".join(_faults(entity, log) for entity, log in _LOG_NAMES.items())
        + ") WHERE _reason IS NOT NULL",
        *_LOG_NAMES.values(),
    ),
)
def message_faults(spark, folder):
    """What is wrong with each message of the three topics that can't be taken as it stands."""
    parts = []
    for entity, log in _logs(spark, folder).items():
        _, bad = cdc.split_corrupt(cdc.decode(st.faulty_messages(log, entity), entity))
        parts.append(bad.select(F.lit(entity).alias("entity"), "_seq", "_reason"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "fault_counts",
    sql(
        "SELECT entity, _reason AS reason, count(*) AS messages FROM ("
        + " UNION ALL ".join(_faults(entity, log) for entity, log in _LOG_NAMES.items())
        + ") WHERE _reason IS NOT NULL GROUP BY ALL",
        *_LOG_NAMES.values(),
    ),
)
def fault_counts(spark, folder):
    """How many messages of each topic are set aside for each reason."""
    return monitor.fault_counts({e: cdc.decode(st.faulty_messages(log, e), e) for e, log in _logs(spark, folder).items()})


# -- current state -----------------------------------------------------------------------------------------


@query("latest_customers", sql(f"SELECT {_CUSTOMER} FROM customer_latest", "customer_latest"))
def latest_customers(spark, folder):
    """Last version of every customer, deleted ones included."""
    log = st.customer_log(spark, folder)
    return upsert.latest(log, ["customer_id"], cdc.VERSION_ORDER).select(*_names(_CUSTOMER))


@query("latest_devices", sql(f"SELECT {_DEVICE} FROM prosthesis_latest", "prosthesis_latest"))
def latest_devices(spark, folder):
    """Last version of every device, deleted ones included."""
    log = st.prosthesis_log(spark, folder)
    return upsert.latest(log, ["prosthesis_id"], cdc.VERSION_ORDER).select(*_names(_DEVICE))


@query("live_models", sql(f"SELECT {_MODEL} FROM model_latest WHERE NOT _deleted", "model_latest"))
def live_models(spark, folder):
    """Models that still exist."""
    return cdc.current(st.model_log(spark, folder), "models").select(*_names(_MODEL))


@query("live_devices", sql(f"SELECT {_DEVICE} FROM prosthesis_latest WHERE NOT _deleted", "prosthesis_latest"))
def live_devices(spark, folder):
    """Devices that still exist."""
    return cdc.current(st.prosthesis_log(spark, folder), "prostheses").select(*_names(_DEVICE))


@query(
    "merged_device_state",
    sql(f"SELECT {_DEVICE} FROM prosthesis_latest", "prosthesis_latest"),
)
def merged_device_state(spark, folder):
    """State kept batch by batch, with batches out of version order, equals the state of the whole log."""
    log = st.prosthesis_log(spark, folder)
    late, early = log.filter(F.col("firmware_version") > "v4"), log.filter(F.col("firmware_version") <= "v4")
    state = upsert.latest(late, ["prosthesis_id"], cdc.VERSION_ORDER)
    merged = upsert.merge_latest(state, early, ["prosthesis_id"], cdc.VERSION_ORDER)
    return merged.select(*_names(_DEVICE))


@query(
    "cdc_customer_prosthesis",
    sql(
        """SELECT c.customer_id, c.external_id AS user_id,
             c.last_name || ' ' || c.first_name || coalesce(' ' || c.middle_name, '') AS customer_full_name,
             c.email AS customer_email, c.region AS customer_region, c.branch AS customer_branch, p.prosthesis_id,
             p.serial_number AS prosthesis_serial, p.chip_id, p.status AS prosthesis_status, p.firmware_version,
             m.model_code, m.model_name AS prosthesis_model, m.category AS prosthesis_category,
             greatest(c.updated_at, p.updated_at) AS last_updated_at
           FROM customer_latest c JOIN prosthesis_latest p ON c.customer_id = p.customer_id
             JOIN model_latest m ON p.model_id = m.model_id
           WHERE p.status = 'active' AND NOT c._deleted AND NOT p._deleted AND NOT m._deleted""",
        "customer_latest",
        "prosthesis_latest",
        "model_latest",
    ),
)
def cdc_customer_prosthesis(spark, folder):
    """Active devices with owner and model, from the change logs."""
    logs = _logs(spark, folder)
    view = cdc.customer_prosthesis(logs["customers"], logs["prostheses"], logs["models"])
    return view.select(
        "customer_id",
        "user_id",
        "customer_full_name",
        "customer_email",
        "customer_region",
        "customer_branch",
        "prosthesis_id",
        "prosthesis_serial",
        "chip_id",
        "prosthesis_status",
        "firmware_version",
        "model_code",
        "prosthesis_model",
        "prosthesis_category",
        "last_updated_at",
    )


@query("customer_data", sql("SELECT * FROM customer_data", "customer_data"))
def customer_data(spark, folder):
    """Customer dimension from the change logs."""
    logs = _logs(spark, folder)
    return cdc.customer_data(logs["customers"], logs["prostheses"], logs["models"])


@query("refreshed_customer_data", sql("SELECT * FROM customer_data", "customer_data"))
def refreshed_customer_data(spark, folder):
    """The dimension of an earlier state, refreshed for what changed since, equals the one built anew."""
    logs = _logs(spark, folder)
    cut = 946684800000
    before = {e: log.filter(F.col("_version") < cut) for e, log in logs.items()}
    changed = {e: log.filter(F.col("_version") >= cut) for e, log in logs.items() if e != "models"}
    old = cdc.customer_data(before["customers"], before["prostheses"], before["models"])
    now = {e: cdc.current(log, e) for e, log in logs.items()}
    return cdc.refresh_dimension(old, now["customers"], now["prostheses"], now["models"], changed)


# -- status ------------------------------------------------------------------------------------------------


@query(
    "cdc_status",
    sql(
        """SELECT 'customers' AS entity, count(*) AS total, count(*) FILTER (WHERE NOT _deleted) AS active FROM customer_latest
           UNION ALL SELECT 'prostheses', count(*), count(*) FILTER (WHERE NOT _deleted) FROM prosthesis_latest
           UNION ALL SELECT 'models', count(*), count(*) FILTER (WHERE NOT _deleted) FROM model_latest""",
        "customer_latest",
        "prosthesis_latest",
        "model_latest",
    ),
)
def cdc_status(spark, folder):
    """Known and live keys per entity."""
    return monitor.cdc_status(_logs(spark, folder))


@query(
    "cdc_health",
    sql(
        """SELECT *, 'healthy' AS status FROM (
             SELECT 'crm_customers' AS table_name, count(*) AS row_count, max(_version) AS last_version
               FROM customer_latest WHERE NOT _deleted
             UNION ALL SELECT 'crm_prostheses', count(*), max(_version) FROM prosthesis_latest WHERE NOT _deleted
             UNION ALL SELECT 'crm_prosthesis_models', count(*), max(_version) FROM model_latest WHERE NOT _deleted)""",
        "customer_latest",
        "prosthesis_latest",
        "model_latest",
    ),
)
def cdc_health(spark, folder):
    """Live rows and newest version per table, with the state of the feed."""
    return monitor.cdc_health(_logs(spark, folder))


@query(
    "dimension_readiness",
    sql(
        """SELECT count(*) AS mart_records, count(*) > 0 AS mart_ready,
             CASE WHEN count(*) > 0 THEN 'ready' ELSE 'initializing' END AS status FROM customer_data""",
        "customer_data",
    ),
)
def dimension_readiness(spark, folder):
    """Whether the customer dimension can serve."""
    logs = _logs(spark, folder)
    return monitor.readiness(cdc.customer_data(logs["customers"], logs["prostheses"], logs["models"]))


@query(
    "recent_device_changes",
    sql(
        f"SELECT {_DEVICE} FROM prosthesis_latest ORDER BY _version DESC, _seq DESC, prosthesis_id LIMIT 10",
        "prosthesis_latest",
    ),
)
def recent_device_changes(spark, folder):
    """The ten devices changed last."""
    return monitor.recent_changes(st.prosthesis_log(spark, folder), "prostheses").select(*_names(_DEVICE))


@query(
    "feed_lag",
    """SELECT topic, CAST(sum(greatest(end_offset - committed_offset, 0)) AS BIGINT) AS lag,
         CASE WHEN sum(greatest(end_offset - committed_offset, 0)) > 1000 THEN 'degraded' ELSE 'healthy' END AS status
       FROM (SELECT o_orderpriority AS topic, o_orderkey % 8 AS part, count(*) AS end_offset,
               count(*) FILTER (WHERE o_orderstatus <> 'P' OR o_orderpriority = '5-LOW') AS committed_offset
             FROM orders GROUP BY ALL) GROUP BY topic""",
)
def feed_lag(spark, folder):
    """Lag per topic: orders as messages of a topic per priority, pending ones not yet consumed."""
    done = (F.col("o_orderstatus") != "P") | (F.col("o_orderpriority") == "5-LOW")
    progress = (
        st.table(spark, folder, "orders")
        .groupBy(F.col("o_orderpriority").alias("topic"), (F.col("o_orderkey") % 8).alias("partition"))
        .agg(F.count(F.lit(1)).alias("end_offset"), F.count_if(done).alias("committed_offset"))
    )
    return monitor.lag(progress)


# -- inserts, deletes, retention ---------------------------------------------------------------------------


@query(
    "insert_if_absent",
    """SELECT * FROM (SELECT o_custkey AS customer_id, o_orderkey AS first_order, o_orderpriority AS priority,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders
         WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'))
       WHERE rn = 1""",
)
def insert_if_absent(spark, folder):
    """First order row of customers that are not in the existing table yet."""
    existing = (
        st.table(spark, folder, "customer")
        .filter(F.col("c_mktsegment") == "MACHINERY")
        .select(F.col("c_custkey").alias("customer_id"))
    )
    new = st.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderkey").alias("first_order"),
        F.col("o_orderpriority").alias("priority"),
    )
    return upsert.insert_if_absent(existing, new, ["customer_id"], ["first_order"]).withColumn("rn", F.lit(1).cast("long"))


_EVENING = "report_hour >= 18 AND report_date < DATE '2024-01-05'"


@query(
    "load_new_users",
    sql(
        f"""SELECT user_id, prosthesis_id, report_date, report_hour FROM mart
            WHERE user_id NOT IN (SELECT user_id FROM mart WHERE {_EVENING})""",
        "mart",
    ),
)
def load_new_users(spark, folder):
    """Rows of users who had none in an earlier, partial load."""
    mart = st.mart_rows(spark, folder).select("user_id", "prosthesis_id", "report_date", "report_hour")
    return upsert.insert_for_new_groups(mart.filter(_EVENING), mart, ["user_id"])


@query(
    "delete_users",
    sql(
        """SELECT user_id, prosthesis_id, report_date, report_hour FROM mart
           WHERE user_id NOT IN (SELECT c_name FROM customer WHERE c_mktsegment = 'FURNITURE')""",
        "mart",
    ),
)
def delete_users(spark, folder):
    """The mart without the users of one market segment."""
    gone = (
        st.table(spark, folder, "customer")
        .filter(F.col("c_mktsegment") == "FURNITURE")
        .select(F.col("c_name").alias("user_id"))
    )
    mart = st.mart_rows(spark, folder).select("user_id", "prosthesis_id", "report_date", "report_hour")
    return upsert.delete(mart, gone)


@query(
    "users_in_list",
    sql(
        """SELECT user_id, prosthesis_id, report_date, report_hour FROM mart
           WHERE user_id IN (SELECT c_name FROM customer WHERE c_mktsegment = 'FURNITURE')""",
        "mart",
    ),
)
def users_in_list(spark, folder):
    """The mart rows of a long list of users."""
    wanted = (
        st.table(spark, folder, "customer")
        .filter(F.col("c_mktsegment") == "FURNITURE")
        .select(F.col("c_name").alias("user_id"))
    )
    mart = st.mart_rows(spark, folder).select("user_id", "prosthesis_id", "report_date", "report_hour")
    return report.for_requests(mart, wanted)


@query(
    "retained_mart",
    sql(
        """SELECT user_id, prosthesis_id, report_date, report_hour FROM mart
           WHERE report_date > DATE '2025-01-15' - 365""",
        "mart",
    ),
)
def retained_mart(spark, folder):
    """Mart rows inside the retention of a year, a year later."""
    mart = st.mart_rows(spark, folder).select("user_id", "prosthesis_id", "report_date", "report_hour")
    return upsert.retain(mart, "report_date", 365, "2025-01-15 00:00:00")


@query(
    "order_months",
    "SELECT CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS month, count(*) AS rows FROM orders GROUP BY ALL",
)
def order_months(spark, folder):
    """Rows per monthly partition value."""
    month = month_key(F.col("o_orderdate"))
    return st.table(spark, folder, "orders").groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "touched_devices",
    sql(
        """SELECT n.prosthesis_id, n.status, n.firmware_version,
             CASE WHEN o.prosthesis_id IS NOT NULL AND n.status IS NOT DISTINCT FROM o.status
                    AND n.firmware_version IS NOT DISTINCT FROM o.firmware_version
               THEN o.updated_at ELSE TIMESTAMP '2024-01-31' END AS updated_at
           FROM new_state n LEFT JOIN old_state o USING (prosthesis_id)""",
        "prosthesis_log",
        old_state="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prosthesis_id ORDER BY _version DESC, _seq DESC) AS rn
                       FROM prosthesis_log WHERE _version < 946684800000) WHERE rn = 1""",
        new_state="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prosthesis_id ORDER BY _version DESC, _seq DESC) AS rn
                       FROM prosthesis_log) WHERE rn = 1""",
    ),
)
def touched_devices(spark, folder):
    """Change times kept up by an upsert: only rows whose values differ are stamped."""
    columns = ["prosthesis_id", "status", "firmware_version", "updated_at"]
    log = st.prosthesis_log(spark, folder)
    old = upsert.latest(log.filter(F.col("_version") < 946684800000), ["prosthesis_id"], cdc.VERSION_ORDER).select(*columns)
    new = upsert.latest(log, ["prosthesis_id"], cdc.VERSION_ORDER).select(*columns)
    return upsert.touch(old, new, ["prosthesis_id"], st.AS_OF)


# -- profiles and consent ----------------------------------------------------------------------------------


@query(
    "merged_profiles",
    """SELECT CAST(user_id AS VARCHAR) AS keycloak_user_id,
         last(CASE WHEN k % 5 <> 0 THEN event_type END ORDER BY ts) AS identity_provider,
         arg_max('u' || k || '@example.com', ts) FILTER (WHERE k % 3 = 0) AS email,
         arg_max('First' || k, ts) FILTER (WHERE k % 4 = 0) AS first_name,
         arg_max('+7' || k, ts) FILTER (WHERE k % 50 = 0) AS phone, max(ts) AS last_login_at
       FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events) GROUP BY user_id""",
)
def merged_profiles(spark, folder):
    """One profile per user from all logins; missing fields keep older values."""
    return profiles.merge_profiles(st.logins(spark, folder))


@query(
    "consent_history",
    sql(
        """SELECT user_profile_id, 'app' AS client_id, 'profile,' || event_type AS scopes, action, created_at
           FROM (SELECT *, row_number() OVER (PARTITION BY user_profile_id ORDER BY created_at DESC, id DESC) AS rn FROM consent)
           WHERE rn <= 50""",
        "consent",
    ),
)
def consent_history(spark, folder):
    """The newest fifty consent events of every profile."""
    rows = profiles.consent_history(st.consent_events(spark, folder))
    return rows.withColumn("scopes", F.array_join("scopes", ","))


@query(
    "current_consent",
    sql(
        """SELECT l.user_profile_id, l.action = 'granted' AS consent_given, g.consent_given_at,
             CASE WHEN l.action = 'granted' THEN 'profile,' || l.event_type END AS consent_scopes
           FROM (SELECT *, row_number() OVER (PARTITION BY user_profile_id ORDER BY created_at DESC, id DESC) AS rn FROM consent) l
             JOIN (SELECT user_profile_id, max(created_at) FILTER (WHERE action = 'granted') AS consent_given_at
                   FROM consent GROUP BY user_profile_id) g USING (user_profile_id)
           WHERE l.rn = 1""",
        "consent",
    ),
)
def current_consent(spark, folder):
    """Consent of every profile as of its last event."""
    rows = profiles.current_consent(st.consent_events(spark, folder))
    return rows.withColumn("consent_scopes", F.array_join("consent_scopes", ","))
