"""Change feed of the customer database: decoding, current state, customer dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import defaults, schemas
from ..functions import epoch_or_iso_date, epoch_or_iso_timestamp
from . import crm, upsert

VERSION_ORDER = ["_version", "_seq"]
CORRUPT = "_corrupt"
REASON = "_reason"


def _typed(text: Column, kind: T.DataType) -> Column:
    """One text field in its table type; a value that does not fit becomes NULL instead of failing the job."""
    if isinstance(kind, T.DateType):
        return epoch_or_iso_date(text)
    if isinstance(kind, T.TimestampType):
        return epoch_or_iso_timestamp(text)
    if isinstance(kind, T.BooleanType):
        flag = F.lower(text)
        return F.when(flag.isin("true", "1"), True).when(flag.isin("false", "0"), False)
    return text.try_cast(kind)


def _once(value: Column) -> Column:
    """`value` by way of a one-element explode: filters on its fields then stay above it, instead of being
    pushed down with a copy of the parser for every field they read."""
    return F.explode_outer(F.array(value))


def _wrong_type(name: str, kind: T.DataType) -> Column:
    """Why a field that is present has no value in its table type; NULL where it has, or is absent.

    Text takes any scalar. Only where a text looks like an object or array does the message itself decide, parsed as a
    variant, since text that merely starts with a brace is as good as any other.
    """
    text = F.col(f"m.{name}")
    if isinstance(kind, T.StringType):
        held = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), f"$.{name}", "variant"))
        return F.when(F.substring(text, 1, 1).isin("{", "["), F.when(held.rlike("^(OBJECT|ARRAY)"), F.lit(f"wrong type: {name}")))
    reason = F.lit(f"wrong type: {name}")
    if isinstance(kind, T.TimestampType):
        reason = F.when(text.try_cast("long").isNotNull(), F.lit(f"out of range: {name}")).otherwise(reason)
    return F.when(text.isNotNull() & F.col(name).isNull(), reason)


def _reason(entity: str) -> Column:
    """The first thing wrong with a decoded message, NULL for a good one.

    A delete needs its key and version alone; whatever else it carries is of no use.
    """
    keys = schemas.CHANGE_KEYS[entity]
    fields = [f for f in schemas.CHANGE_TABLES[entity].fields if f.name not in keys]
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    stamp = F.col("m.__source_ts_ms")
    content = [_wrong_type(f.name, f.dataType) for f in fields]
    content += [F.when(F.col(f"m.{f.name}").isNull(), F.lit(f"missing column: {f.name}")) for f in fields if not f.nullable]
    return (
        F.when(F.col(CORRUPT), "malformed")
        .when(no_key, "missing key")
        .when(F.col("_version").isNull(), F.when(stamp.isNull(), "missing version").otherwise("wrong type: __source_ts_ms"))
        .when(~F.coalesce(F.col("_op").isin(*defaults.CHANGE_OPERATIONS), F.lit(False)), "unknown operation")
        .when(~F.col("_deleted"), F.coalesce(*content))
    )


def decode(messages: DataFrame, entity: str) -> DataFrame:
    """Typed, versioned rows from JSON messages in column `value` (one object per message).

    `seq`, if present, is the position in the feed (topic offset) and settles equal versions. Whatever can't be taken
    as it stands gets a `_reason` and keeps its text (see `_reason` and `split_corrupt`): a value that does not fit its
    column would otherwise become NULL and take the place of a good one.
    """
    wire = T.StructType([*schemas.CHANGE_MESSAGES[entity].fields, T.StructField(CORRUPT, T.StringType())])
    seq = F.col("seq") if "seq" in messages.columns else F.lit(None)
    parsed = messages.select(
        "value",
        seq.cast("long").alias("_seq"),
        _once(F.from_json("value", wire, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})).alias("m"),
    )
    columns = [_typed(F.col(f"m.{f.name}"), f.dataType).alias(f.name) for f in schemas.CHANGE_TABLES[entity].fields]
    rows = parsed.select(
        *columns,
        F.col("m.__op").alias("_op"),
        F.col("m.__source_ts_ms").try_cast("long").alias("_version"),
        "_seq",
        upsert.deleted_flag(F.col("m.__op")).alias("_deleted"),
        "value",
        "m",
        (F.col("m").isNull() | F.col(f"m.{CORRUPT}").isNotNull()).alias(CORRUPT),
    )
    # the reason as a row of its own: a filter on it would otherwise take a copy of all checks below this projection
    return rows.withColumn(REASON, _reason(entity)).drop(CORRUPT, "m").withColumn(REASON, _once(F.col(REASON)))


def split_corrupt(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows for the log, messages for the dead-letter table)."""
    good = decoded.filter(F.col(REASON).isNull()).drop(REASON, "value")
    bad = decoded.filter(F.col(REASON).isNotNull()).select("value", "_seq", REASON)
    return good, bad


def current(log: DataFrame, entity: str) -> DataFrame:
    """Live rows of one entity: latest version per key, without deleted keys."""
    return upsert.live(upsert.latest(log, schemas.CHANGE_KEYS[entity], VERSION_ORDER))


def customer_prosthesis(customers: DataFrame, prostheses: DataFrame, models: DataFrame) -> DataFrame:
    """The customer view over change logs; logs are reduced to live rows before they are joined."""
    return crm.customer_prosthesis(
        current(customers, "customers"), current(prostheses, "prostheses"), current(models, "models")
    )


def customer_data_of(customers: DataFrame, prostheses: DataFrame, models: DataFrame) -> DataFrame:
    """Customer dimension from live rows: one row per active device bound to a chip.

    Its version is the newest of the three sources, so a change of any of them counts.
    """
    joined = crm.customer_prosthesis(customers, prostheses, models, version="_version")
    return crm.mart_source(joined, keep=["_version"]).select(*schemas.CUSTOMER_DATA.fieldNames())


def customer_data(customers: DataFrame, prostheses: DataFrame, models: DataFrame) -> DataFrame:
    """Customer dimension from change logs."""
    return customer_data_of(current(customers, "customers"), current(prostheses, "prostheses"), current(models, "models"))


def affected_devices(prostheses: DataFrame, changed: dict[str, DataFrame]) -> DataFrame:
    """Devices whose dimension row a batch of changes can alter: changed themselves, or whose owner or model
    did. `prostheses` is the current state; `changed` maps entities to changed rows."""
    parts = []
    if "prostheses" in changed:
        parts.append(changed["prostheses"].select("prosthesis_id"))
    for entity, column in (("customers", "customer_id"), ("models", "model_id")):
        if entity in changed:
            keys = changed[entity].select(column).distinct()
            parts.append(prostheses.join(keys, column, "left_semi").select("prosthesis_id"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.distinct()


def refresh_dimension(
    dimension: DataFrame,
    customers: DataFrame,
    prostheses: DataFrame,
    models: DataFrame,
    changed: dict[str, DataFrame],
) -> DataFrame:
    """The dimension after a batch of changes: rows of affected devices are taken out and recomputed from the
    current state (live rows), so deletes, deactivations and renamed models are seen as well."""
    affected = affected_devices(prostheses, changed)
    kept = dimension.join(affected, "prosthesis_id", "left_anti").select(*dimension.columns)
    redone = customer_data_of(customers, prostheses.join(affected, "prosthesis_id", "left_semi"), models)
    return kept.unionByName(redone.select(*dimension.columns))
