"""Small hand-written inputs in the true schemas, with the edge rows every operator has to treat."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from pulsemart import schemas

T0 = dt.datetime(2024, 3, 1)


def table(spark, schema, rows):
    """Rows given as dicts; absent columns are NULL."""
    return spark.createDataFrame([tuple(r.get(n) for n in schema.fieldNames()) for r in rows], schema)


def customers(spark):
    def row(i, user, first, last, middle, region):
        return dict(
            customer_id=i,
            external_id=user,
            first_name=first,
            last_name=last,
            middle_name=middle,
            email=f"{user}@example.com",
            region=region,
            branch="North" if region == "russia" else None,
            created_at=T0,
            updated_at=T0 + dt.timedelta(hours=i),
        )

    return table(
        spark,
        schemas.CUSTOMERS,
        [
            row(1, "ada", "Ada", "Stone", "June", "russia"),
            row(2, "ben", "Ben", "Rivers", None, "europe"),
            row(3, "cleo", "Cleo", "Hill", "May", "russia"),
            row(4, "dan", "Dan", "Wood", None, "europe"),
            row(5, "eve", "Eve", "Lake", None, "europe"),
        ],
    )


def models(spark):
    names = [(1, "Arm L", "arm"), (2, "Arm S", "arm"), (3, "Hand", "hand"), (4, "Leg L", "leg"), (5, "Leg S", "leg")]
    return table(
        spark,
        schemas.MODELS,
        [
            dict(model_id=i, model_code=f"M{i}", model_name=n, category=c, price=Decimal("100.50") * i, warranty_months=24, is_active=True, created_at=T0)
            for i, n, c in names
        ],
    )


def prostheses(spark):
    def row(i, customer, chip, status="active", model=None, updated=0):
        return dict(
            prosthesis_id=i,
            serial_number=f"S{i}",
            model_id=model or min(i, 5),
            customer_id=customer,
            chip_id=chip,
            status=status,
            manufactured_date=dt.date(2024, 1, 1),
            firmware_version="v1",
            created_at=T0,
            updated_at=T0 + dt.timedelta(days=updated),
        )

    return table(
        spark,
        schemas.PROSTHESES,
        [
            row(1, 1, "chip-1"),
            row(2, 2, "chip-2"),
            row(3, 3, "chip-3", updated=2),
            row(4, 1, "chip-4", model=4),  # second device of the first customer
            row(5, 5, None),  # no chip
            row(6, 5, ""),  # empty chip
            row(7, 4, "chip-7", status="retired"),
            row(8, None, "chip-8"),  # not sold
        ],
    )


def sample(chip, at, **values):
    row = dict(
        telemetry_id=0,
        chip_id=chip,
        timestamp=at,
        myo_channel_1=3.0,
        myo_channel_2=4.0,
        movement_type="grip",
        response_time_ms=100,
        movement_success=True,
        actuator_temp=40.0,
        battery_level=80,
        connection_quality=90,
        warning_flags=0,
        session_id="s1",
    )
    row.update(values)
    return row


def raw(spark):
    at = dt.datetime(2024, 3, 5, 10, 0)
    minute = dt.timedelta(minutes=1)
    return table(
        spark,
        schemas.RAW_TELEMETRY,
        [
            sample("chip-1", at),  # on the hour: belongs to 10:00
            sample("chip-1", at + 5 * minute, movement_success=None, response_time_ms=None),  # moved, not a success
            sample("chip-1", at + 9 * minute, movement_type=None, error_code="E1", warning_flags=3, battery_level=20),
            sample("chip-1", at + 60 * minute, response_time_ms=50, myo_channel_1=None, myo_channel_2=None),
            sample("chip-2", at + 10 * minute, movement_type=None, response_time_ms=None, session_id="s2"),  # no movement
            sample("chip-4", at + 10 * minute, movement_success=False, session_id="s3"),
            sample("chip-9", at, session_id=None),  # chip of nobody
        ],
    )


def mart_row(user, device, date, hour, **values):
    row = dict(
        user_id=user,
        prosthesis_id=device,
        chip_id=f"chip-{device}",
        report_date=date,
        report_hour=hour,
        customer_name=user.title(),
        customer_email=f"{user}@example.com",
        customer_region="europe",
        customer_branch="North",
        prosthesis_model=f"Model {device}",
        prosthesis_category="arm",
        prosthesis_serial=f"S{device}",
        movements_count=10,
        successful_movements=9,
        success_rate=90.0,
        avg_response_time=100.0,
        min_response_time=50,
        max_response_time=150,
        avg_battery_level=80.0,
        min_battery_level=70,
        max_battery_level=90,
        avg_actuator_temp=40.0,
        max_actuator_temp=45.0,
        error_count=1,
        warning_count=0,
        avg_connection_quality=95.0,
        avg_myo_amplitude=5.0,
        source_updated_at=T0,
        etl_processed_at=T0,
    )
    row.update(values)
    return row


def mart(spark, rows):
    return table(spark, schemas.MART, rows)


# -- larger inputs: values follow from a hash of the row's keys, so every run has the same ----------------------


def _spread(keys, number, n):
    return F.pmod(F.xxhash64(*keys, F.lit(number)), F.lit(n))


def _every_hour(devices, as_of, days, first, hours):
    return devices.selectExpr("*", f"explode(sequence(date'{as_of}' - {days - 1}, date'{as_of}')) report_date").selectExpr(
        "*", f"explode(sequence({first}, {first + hours - 1})) report_hour"
    )


def busy_mart(devices, as_of, days=5):
    """Mart rows of devices (the mart's customer side) for 14 hours of each day; quarters, so that sums are exact."""
    keys = ["prosthesis_id", "report_date", "report_hour"]
    names = [c for c in schemas.MART.fieldNames() if c in devices.columns or c in keys]
    rest = [f for f in schemas.MART.fields if f.name not in names and f.name not in ("source_updated_at", "etl_processed_at")]
    values = [(_spread(keys, k, 40 + k) / (4 if f.dataType.simpleString() == "double" else 1)).cast(f.dataType).alias(f.name) for k, f in enumerate(rest)]
    rows = _every_hour(devices, as_of, days, 5, 14).withColumn("prosthesis_id", F.col("prosthesis_id").cast("long"))
    return rows.select(*names, *values, F.lit(T0).alias("source_updated_at"))


def busy_samples(chips, as_of, days=7):
    """Raw samples of chips (chip_id): three in each of 15 hours of a day."""
    keys = ["chip_id", "report_date", "report_hour", "minute"]
    rows = _every_hour(chips.select("chip_id"), as_of, days, 6, 15).selectExpr("*", "explode(array(1, 22, 43)) minute")
    at = F.unix_timestamp(F.col("report_date").cast("timestamp")) + F.col("report_hour") * 3600 + F.col("minute") * 60
    known = {
        "chip_id": F.col("chip_id"),
        "timestamp": F.timestamp_seconds(at),
        "movement_type": F.when(_spread(keys, 50, 9) > 0, "grip"),
        "movement_success": _spread(keys, 51, 7) > 0,
        "error_code": F.when(_spread(keys, 52, 11) == 0, "E1"),
        "session_id": F.concat_ws("-", "chip_id", "report_date"),
    }
    values = [
        known.get(f.name, _spread(keys, k, 30 + k)).cast(f.dataType).alias(f.name)
        for k, f in enumerate(schemas.RAW_TELEMETRY.fields)
        if f.name != "telemetry_id"
    ]
    return rows.select(*values)
