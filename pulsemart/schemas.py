"""Explicit schemas of every table and message; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "INT": T.IntegerType(),
    "SMALLINT": T.ShortType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
    "WALLCLOCK": T.TimestampNTZType(),
    "MONEY": T.DecimalType(12, 2),
    "STRINGS": T.ArrayType(T.StringType()),
}


def struct(columns: str) -> T.StructType:
    """A schema from `name TYPE[!], ...`; `!` marks NOT NULL. Needs no running session, unlike DDL parsing."""
    fields = []
    for column in columns.split(","):
        name, kind = column.split()
        fields.append(T.StructField(name, _TYPES[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


CUSTOMERS = struct(
    """customer_id INT!, external_id STRING!, first_name STRING!,
       last_name STRING!, middle_name STRING, email STRING!, phone STRING,
       birth_date DATE, region STRING!, branch STRING, created_at TIMESTAMP, updated_at TIMESTAMP"""
)

MODELS = struct(
    """model_id INT!, model_code STRING!, model_name STRING!,
       category STRING!, description STRING, price MONEY!,
       warranty_months INT, is_active BOOLEAN, created_at TIMESTAMP"""
)

PROSTHESES = struct(
    """prosthesis_id INT!, serial_number STRING!, model_id INT!, customer_id INT,
       chip_id STRING, status STRING!, manufactured_date DATE!, sold_date DATE,
       warranty_end_date DATE, firmware_version STRING, created_at TIMESTAMP, updated_at TIMESTAMP"""
)

RAW_TELEMETRY = struct(
    """telemetry_id BIGINT!, chip_id STRING!, timestamp TIMESTAMP!,
       myo_channel_1 DOUBLE, myo_channel_2 DOUBLE, myo_channel_3 DOUBLE, myo_channel_4 DOUBLE,
       movement_type STRING, movement_intensity DOUBLE, response_time_ms INT, movement_success BOOLEAN,
       accelerometer_x DOUBLE, accelerometer_y DOUBLE, accelerometer_z DOUBLE,
       gyroscope_x DOUBLE, gyroscope_y DOUBLE, gyroscope_z DOUBLE,
       actuator_temp DOUBLE, grip_pressure DOUBLE, battery_level SMALLINT, battery_voltage DOUBLE,
       connection_quality SMALLINT, error_code STRING, warning_flags INT, firmware_version STRING,
       session_id STRING, created_at TIMESTAMP"""
)

HOURLY_STATS = struct(
    """chip_id STRING!, hour_start TIMESTAMP!, movements_count BIGINT,
       successful_movements BIGINT, avg_response_time DOUBLE, min_response_time INT, max_response_time INT,
       avg_battery_level DOUBLE, min_battery_level INT, max_battery_level INT, avg_actuator_temp DOUBLE,
       max_actuator_temp DOUBLE, error_count BIGINT, warning_count BIGINT, avg_myo_amplitude DOUBLE,
       avg_connection_quality DOUBLE, updated_at TIMESTAMP"""
)

MART = struct(
    """user_id STRING, prosthesis_id BIGINT, chip_id STRING, report_date DATE, report_hour INT,
       customer_name STRING, customer_email STRING, customer_region STRING, customer_branch STRING,
       prosthesis_model STRING, prosthesis_category STRING, prosthesis_serial STRING,
       movements_count BIGINT, successful_movements BIGINT, success_rate DOUBLE,
       avg_response_time DOUBLE, min_response_time BIGINT, max_response_time BIGINT,
       avg_battery_level DOUBLE, min_battery_level INT, max_battery_level INT,
       avg_actuator_temp DOUBLE, max_actuator_temp DOUBLE, error_count BIGINT, warning_count BIGINT,
       avg_connection_quality DOUBLE, avg_myo_amplitude DOUBLE,
       source_updated_at TIMESTAMP, etl_processed_at TIMESTAMP"""
)

# What one change message carries, per entity. Dates and times stay text here because the feed sends
# either ISO text or epoch numbers; `operators.cdc.decode` settles them into the table types above.
CHANGE_META = "__op STRING, __table STRING, __source_ts_ms STRING"

CHANGE_MESSAGES = {
    entity: struct(", ".join(f"{field.name} STRING" for field in schema.fields) + ", " + CHANGE_META)
    for entity, schema in {"customers": CUSTOMERS, "prostheses": PROSTHESES, "models": MODELS}.items()
}

CHANGE_TABLES = {"customers": CUSTOMERS, "prostheses": PROSTHESES, "models": MODELS}
CHANGE_KEYS = {"customers": ["customer_id"], "prostheses": ["prosthesis_id"], "models": ["model_id"]}


def change_state(entity: str) -> T.StructType:
    """Schema of the versioned log kept for one entity."""
    fields = [T.StructField(f.name, f.dataType, True) for f in CHANGE_TABLES[entity].fields]
    return T.StructType(
        fields
        + [
            T.StructField("_op", T.StringType()),
            T.StructField("_version", T.LongType()),
            T.StructField("_seq", T.LongType()),
            T.StructField("_deleted", T.BooleanType()),
        ]
    )


CUSTOMER_DATA = struct(
    """user_id STRING, customer_id INT, customer_name STRING, customer_email STRING, customer_region STRING,
       customer_branch STRING, prosthesis_id INT, prosthesis_serial STRING, chip_id STRING,
       prosthesis_model STRING, prosthesis_category STRING, firmware_version STRING,
       last_updated_at TIMESTAMP, _version BIGINT"""
)

PUBLISHED = struct("kind STRING, day STRING, bucket INT, object_key STRING, user_id STRING, report_date DATE, prosthesis_id BIGINT, body STRING")
