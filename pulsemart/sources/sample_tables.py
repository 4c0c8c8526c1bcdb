"""Reads the generic order/event tables as device data.

The tables have no devices, so devices are derived: event users are chips, customers own one device each
(some own a second one), parts are models. Rows with missing chips, inactive devices, unowned devices and
missing measurements are derived as well, since every operator has to treat them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import wall_clock
from ..operators import crm, hourly, mart
from ..schemas import struct

AS_OF = "2024-01-31 00:00:00"


SCHEMAS = {
    "region": struct("r_regionkey INT, r_name STRING"),
    "nation": struct("n_nationkey INT, n_name STRING, n_regionkey INT"),
    "customer": struct("c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"),
    "supplier": struct("s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE"),
    "part": struct(
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"
    ),
    "orders": struct(
        """o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate WALLCLOCK,
           o_orderpriority STRING"""
    ),
    "lineitem": struct(
        """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,
           l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,
           l_shipdate WALLCLOCK"""
    ),
    "events": struct(
        "event_id BIGINT, ts WALLCLOCK, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    ),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table in its known schema: nothing is inferred, so opening it runs no job."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def raw_telemetry(
    spark: SparkSession,
    folder: str,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
) -> DataFrame:
    """Events as samples. The range is applied to the stored column so that it reaches the file scan."""
    events = table(spark, folder, "events")
    if start is not None:
        events = events.filter(F.col("ts") >= wall_clock(start))
    if end is not None:
        events = events.filter(F.col("ts") < wall_clock(end))
    k = F.col("k")
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("int")).select(
        F.col("event_id").alias("telemetry_id"),
        F.col("user_id").cast("string").alias("chip_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("value").alias("myo_channel_1"),
        (F.col("value") / 2).alias("myo_channel_2"),
        F.when(k % 7 != 0, k.cast("double")).alias("myo_channel_3"),
        F.lit(None).cast("double").alias("myo_channel_4"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("movement_type"),
        F.when(k % 10 != 0, F.floor("value").cast("int")).alias("response_time_ms"),
        F.when(k != 13, F.col("event_type") != "view").alias("movement_success"),
        (F.lit(35.0) + k / F.lit(10.0)).alias("actuator_temp"),
        k.alias("battery_level"),
        (F.lit(99) - k % 20).alias("connection_quality"),
        F.when(F.col("event_type") == "error", F.lit("ERR_SENSOR")).alias("error_code"),
        F.when(k % 20 == 0, 1).otherwise(0).alias("warning_flags"),
        F.concat_ws("-", F.col("user_id"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            key.alias("customer_id"),
            F.col("c_name").alias("external_id"),
            F.col("c_mktsegment").alias("first_name"),
            F.concat(F.lit("Last"), (key % 100).cast("string")).alias("last_name"),
            F.when(key % 5 < 3, F.concat(F.lit("M"), (key % 5).cast("string"))).alias("middle_name"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
            F.lit(None).cast("string").alias("phone"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("branch"),
            _minutes_after("2024-01-01 00:00:00", key % 1000).alias("created_at"),
            _minutes_after("2024-01-02 00:00:00", key % 1000).alias("updated_at"),
        )
    )


def models(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        key.alias("model_id"),
        F.concat(F.lit("MODEL-"), key.cast("string")).alias("model_code"),
        F.col("p_name").alias("model_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
        (F.lit(12) + F.col("p_size") % 3 * 12).alias("warranty_months"),
        (key % 11 != 0).alias("is_active"),
    )


def prostheses(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias("prosthesis_id"),
        F.concat(F.lit("SN-"), key.cast("string")).alias("serial_number"),
        key.alias("model_id"),
        F.when(key % 97 == 50, F.lit(None)).when(key % 5 == 4, key - 1).otherwise(key).alias("customer_id"),
        F.when(key % 23 == 7, F.lit(None))
        .when(key % 23 == 8, F.lit(""))
        .otherwise(key.cast("string"))
        .alias("chip_id"),
        F.when(key % 10 == 9, F.lit("retired")).otherwise(F.lit("active")).alias("status"),
        F.date_add(F.lit("2023-01-01").cast("date"), (key % 300).cast("int")).alias("manufactured_date"),
        F.date_add(F.lit("2023-02-01").cast("date"), (key % 300).cast("int")).alias("sold_date"),
        F.date_add(F.lit("2025-02-01").cast("date"), (key % 300).cast("int")).alias("warranty_end_date"),
        F.concat(F.lit("v2."), (key % 4).cast("string")).alias("firmware_version"),
        _minutes_after("2024-01-01 12:00:00", key % 777).alias("created_at"),
        _minutes_after("2024-01-02 12:00:00", key % 777).alias("updated_at"),
    )


def _minutes_after(start: str, minutes):
    return F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + minutes * 60)


# -- derived change logs: a snapshot first, then changes ---------------------------------------------------

SNAPSHOT_AT = "1990-01-01 00:00:00"


def _no_text(name: str):
    return F.lit(None).cast("string").alias(name)


def customer_log(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshot rows from customers, changes from their orders; finished orders are deletes."""
    snapshot = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("external_id"),
        F.col("c_mktsegment").alias("first_name"),
        F.concat(F.lit("Last"), (F.col("c_custkey") % 100).cast("string")).alias("last_name"),
        _no_text("middle_name"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        _no_text("phone"),
        F.lit(None).cast("date").alias("birth_date"),
        F.concat(F.lit("REGION_"), (F.col("c_nationkey") % 5).cast("string")).alias("region"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("branch"),
        F.lit(SNAPSHOT_AT).cast("timestamp").alias("created_at"),
        F.lit(SNAPSHOT_AT).cast("timestamp").alias("updated_at"),
        F.lit("r").alias("_op"),
        F.lit(0).cast("long").alias("_version"),
        F.lit(-1).cast("long").alias("_seq"),
        F.lit(False).alias("_deleted"),
    )
    key, order = F.col("o_custkey"), F.col("o_orderkey")
    name = F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))
    op = F.when(F.col("o_orderstatus") == "F", "d").when(F.col("o_orderstatus") == "O", "u").otherwise("c")
    at = F.col("o_orderdate").cast("timestamp")
    changes = table(spark, folder, "orders").select(
        key.alias("customer_id"),
        name.alias("external_id"),
        F.col("o_orderpriority").alias("first_name"),
        F.concat(F.lit("Last"), (key % 100).cast("string")).alias("last_name"),
        F.when(order % 2 == 0, F.concat(F.lit("M"), (order % 7).cast("string"))).alias("middle_name"),
        F.concat(F.lower(name), F.lit("@example.com")).alias("email"),
        _no_text("phone"),
        F.lit(None).cast("date").alias("birth_date"),
        F.concat(F.lit("REGION_"), (order % 5).cast("string")).alias("region"),
        F.concat(F.lit("NATION_"), (order % 25).cast("string")).alias("branch"),
        F.lit(SNAPSHOT_AT).cast("timestamp").alias("created_at"),
        at.alias("updated_at"),
        op.alias("_op"),
        F.unix_millis(at).alias("_version"),
        order.alias("_seq"),
        (op == "d").alias("_deleted"),
    )
    return snapshot.unionByName(changes)


def prosthesis_log(spark: SparkSession, folder: str) -> DataFrame:
    """Every order line is a change of the device with the part's number."""
    key, line = F.col("l_partkey"), F.col("l_linenumber")
    op = F.when((F.col("l_linestatus") == "F") & (F.col("l_discount") > 0.07), "d").otherwise("u")
    at = F.col("l_shipdate").cast("timestamp")
    return table(spark, folder, "lineitem").select(
        key.alias("prosthesis_id"),
        F.concat(F.lit("SN-"), key.cast("string")).alias("serial_number"),
        F.col("l_suppkey").alias("model_id"),
        key.alias("customer_id"),
        F.when(line == 7, F.lit(None)).when(line == 6, F.lit("")).otherwise(key.cast("string")).alias("chip_id"),
        F.when(F.col("l_returnflag") == "R", F.lit("maintenance")).otherwise(F.lit("active")).alias("status"),
        F.lit("2020-01-01").cast("date").alias("manufactured_date"),
        F.lit(None).cast("date").alias("sold_date"),
        F.lit(None).cast("date").alias("warranty_end_date"),
        F.concat(F.lit("v"), line.cast("string")).alias("firmware_version"),
        F.lit(SNAPSHOT_AT).cast("timestamp").alias("created_at"),
        at.alias("updated_at"),
        op.alias("_op"),
        F.unix_millis(at).alias("_version"),
        (F.col("l_orderkey") * 10 + line).alias("_seq"),
        (op == "d").alias("_deleted"),
    )


def model_log(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as models: all in the snapshot, every third renamed later, some deleted at the end."""
    key = F.col("s_suppkey")
    categories = F.array(F.lit("arm"), F.lit("leg"), F.lit("hand"), F.lit("finger"))
    base = table(spark, folder, "supplier").select(
        key.alias("model_id"),
        F.concat(F.lit("MODEL-"), key.cast("string")).alias("model_code"),
        F.col("s_name").alias("model_name"),
        F.element_at(categories, (F.col("s_nationkey") % 4 + 1).cast("int")).alias("category"),
        _no_text("description"),
        F.col("s_acctbal").cast("decimal(12,2)").alias("price"),
        F.lit(24).alias("warranty_months"),
        F.lit(True).alias("is_active"),
        F.lit(SNAPSHOT_AT).cast("timestamp").alias("created_at"),
    )

    def event(rows: DataFrame, op: str, version: int) -> DataFrame:
        return (
            rows.withColumn("_op", F.lit(op))
            .withColumn("_version", F.lit(version).cast("long"))
            .withColumn("_seq", F.lit(version).cast("long"))
            .withColumn("_deleted", F.lit(op == "d"))
        )

    renamed = base.filter(F.col("model_id") % 3 == 0).withColumn("model_name", F.concat("model_name", F.lit(" v2")))
    gone = base.filter(F.col("model_id") % 10 == 4)
    return event(base, "r", 0).unionByName(event(renamed, "u", 1000)).unionByName(event(gone, "d", 2000))


def change_logs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "customers": customer_log(spark, folder),
        "prostheses": prosthesis_log(spark, folder),
        "models": model_log(spark, folder),
    }


def messages(log: DataFrame, broken_every: int = 101) -> DataFrame:
    """A change log as feed messages: JSON text with feed metadata, dates as days and times as milliseconds in
    even positions, as ISO text in odd ones. Every `broken_every`-th message is cut off in the middle."""
    even = F.col("_seq") % 2 == 0
    fields = []
    for f in log.schema.fields:
        c = F.col(f.name)
        if f.name.startswith("_"):
            continue
        if f.dataType.typeName() == "date":
            c = F.when(even, F.unix_date(c).cast("string")).otherwise(c.cast("string"))
        elif f.dataType.typeName() == "timestamp":
            c = F.when(even, F.unix_millis(c).cast("string")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        fields.append(c.alias(f.name))
    body = F.to_json(
        F.struct(*fields, F.col("_op").alias("__op"), F.lit("t").alias("__table"), F.col("_version").alias("__source_ts_ms"))
    )
    broken = F.pmod(F.col("_seq"), F.lit(broken_every)) == 0
    whole = log.select(body.alias("value"), F.col("_seq").alias("seq"), broken.alias("_broken"))
    return whole.select(F.when(F.col("_broken"), F.substring("value", 1, 20)).otherwise(F.col("value")).alias("value"), "seq")


#: For each entity, a column of text, one that its table needs, and a time.
FAULTY_COLUMNS = {
    "customers": ("first_name", "email", "updated_at"),
    "prostheses": ("firmware_version", "serial_number", "updated_at"),
    "models": ("category", "model_code", "created_at"),
}


def faulty_messages(log: DataFrame, entity: str, every: int = 16) -> DataFrame:
    """A change log as feed messages, of every 16 positions five with a fault: an operation that is none, a time that is
    no time, a column left out, a time far beyond all calendars, an object in place of a text."""
    text, needed, time = FAULTY_COLUMNS[entity]
    fault = F.pmod(F.col("seq"), F.lit(every))
    body = F.col("value")
    faulty = (
        F.when(fault == 1, F.regexp_replace(body, '"__op":"."', '"__op":"z"'))
        .when(fault == 2, F.regexp_replace(body, f'"{time}":"[^"]*"', f'"{time}":"soon"'))
        .when(fault == 3, F.regexp_replace(body, f'"{needed}":"[^"]*",?', ""))
        .when(fault == 4, F.regexp_replace(body, f'"{time}":"[^"]*"', f'"{time}":99999999999999999'))
        .when(fault == 5, F.regexp_replace(body, f'"{text}":"[^"]*"', f'"{text}":{{"a":[1]}}'))
        .otherwise(body)
    )
    return messages(log).select(faulty.alias("value"), "seq")


# -- derived logs of profiles, consent and access ----------------------------------------------------------


def _events_with_k(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def consent_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("user_profile_id"),
        F.lit("app").alias("client_id"),
        F.array(F.lit("profile"), F.col("event_type")).alias("scopes"),
        F.when(F.col("event_type") == "error", F.lit("revoked")).otherwise(F.lit("granted")).alias("action"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def logins(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("k")
    return _events_with_k(spark, folder).select(
        F.col("user_id").cast("string").alias("keycloak_user_id"),
        F.when(k % 5 != 0, F.col("event_type")).alias("identity_provider"),
        F.when(k % 3 == 0, F.concat(F.lit("u"), k.cast("string"), F.lit("@example.com"))).alias("email"),
        F.when(k % 4 == 0, F.concat(F.lit("First"), k.cast("string"))).alias("first_name"),
        F.when(k % 50 == 0, F.concat(F.lit("+7"), k.cast("string"))).alias("phone"),
        F.col("ts").cast("timestamp").alias("last_login_at"),
    )


def service_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as request lines of the report service, with every 1000th line being something else."""
    status = F.when(F.col("event_type") == "error", "500").when(F.col("event_type") == "view", "404").otherwise("200")
    line = F.concat_ws(
        " ",
        F.concat(F.lit("request_id="), F.col("event_id")),
        F.concat(F.lit("user="), F.col("user_id")),
        F.concat(F.lit("ip=10.0.0."), F.col("user_id") % 256),
        F.lit("method=GET"),
        F.concat(F.lit("path=/api/reports/"), F.col("event_type")),
        F.concat(F.lit("status="), status),
        F.concat(F.lit("duration_ms="), F.col("value").cast("decimal(18,2)").cast("string")),
    )
    return table(spark, folder, "events").select(
        F.when(F.col("event_id") % 1000 == 999, F.lit("worker started")).otherwise(line).alias("line")
    )


def edge_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as lines of the edge cache."""
    cache = F.when(F.col("event_type") == "error", "-").when(F.col("event_type") == "view", "MISS").otherwise("HIT")
    return table(spark, folder, "events").select(
        F.concat(
            F.lit('10.0.0.1 - - [01/Jan/2024:00:00:00 +0000] "GET /reports/'),
            F.col("user_id").cast("string"),
            F.lit('/summary/summary.json HTTP/1.1" 200 512 "-" "agent/1.0" "-" cache_status='),
            cache,
            F.lit(" rt="),
            (F.col("value") / 1000).cast("decimal(18,3)").cast("string"),
        ).alias("line")
    )


# -- the assembled tables most queries start from ----------------------------------------------------------


def hourly_stats(spark: SparkSession, folder: str, start=None, end=None) -> DataFrame:
    return hourly.aggregate(raw_telemetry(spark, folder, start, end), AS_OF)


def customer_view(spark: SparkSession, folder: str) -> DataFrame:
    return crm.customer_prosthesis(
        customers(spark, folder), prostheses(spark, folder), models(spark, folder)
    )


def mart_rows(spark: SparkSession, folder: str) -> DataFrame:
    owners = crm.mart_source(customer_view(spark, folder), allow_empty_chip=False)
    return mart.build(hourly.present(hourly_stats(spark, folder)), owners)
