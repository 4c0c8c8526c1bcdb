from __future__ import annotations

import datetime as dt
import decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsemart.functions import (
    day_mask_hours,
    epoch_or_iso_date,
    epoch_or_iso_timestamp,
    error_rate,
    full_name,
    hours_before,
    hours_mask,
    month_key,
    stable_round,
    success_rate,
)


def column(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def results(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def test_ties_round_up_despite_noise(spark):
    values = [1.0149999999999999, 1.015, -1.015, 2.675, 0.0, -0.001, None, 1e300, 1.0049, 123456789.125]
    got = results(column(spark, values, "double"), stable_round(F.col("x"), 2))
    assert got == [1.02, 1.02, -1.02, 2.68, 0.0, 0.0, None, 1e300, 1.0, 123456789.13]
    assert str(got[5]) == "0.0"


def test_large_ties(spark):
    values = [270664135.335, 999999.995, 1000000.005, -270664135.335]
    got = results(column(spark, values, "double"), stable_round(F.col("x"), 2))
    assert got == [270664135.34, 1000000.0, 1000000.01, -270664135.34]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(10**12), 10**12) | st.integers(-(10**9), 10**9), min_size=1, max_size=30), st.sampled_from([1, 2, 6]))
def test_rounding_against_decimals(spark, thousandths, digits):
    values = [t / 1000 for t in thousandths]
    step = decimal.Decimal(1).scaleb(-digits)
    expected = [
        float((decimal.Decimal(t) / 1000).quantize(step, rounding=decimal.ROUND_HALF_UP)) + 0.0 for t in thousandths
    ]
    assert results(column(spark, values, "double"), stable_round(F.col("x"), digits)) == expected


def test_rate_policies(spark):
    df = spark.createDataFrame([(9, 10), (12, 10), (0, 0), (3, None)], "done long, total long")
    done, total = F.col("done"), F.col("total")
    assert results(df, success_rate(done, total)) == [90.0, 120.0, 0.0, 0.0]
    assert results(df, success_rate(done, total, empty="null")) == [90.0, 120.0, None, None]
    assert results(df, success_rate(done, total, empty="null", cap=True)) == [90.0, 100.0, None, None]
    assert results(df, error_rate(done, total)) == [0.9, 1.2, None, None]


def test_hour_masks_merge(spark):
    df = spark.createDataFrame([("a", 0), ("a", 23), ("a", 23), ("b", 5)], "k string, hour int")
    masks = df.groupBy("k").agg(hours_mask(F.col("hour")).alias("m"))
    assert {r.k: r.n for r in masks.select("k", day_mask_hours(F.col("m")).alias("n")).collect()} == {"a": 2, "b": 1}
    assert masks.select(day_mask_hours(F.bit_or("m"))).first()[0] == 3


def test_names(spark):
    df = spark.createDataFrame([("L", "F", "M"), ("L", "F", None)], "l string, f string, m string")
    assert results(df, full_name(F.col("l"), F.col("f"), F.col("m"))) == ["L F M", "L F"]


def test_epoch_or_iso(spark):
    df = column(spark, ["19723", "2024-01-01", "-1", "x", None, "99999999999999999999"], "string")
    assert results(df, epoch_or_iso_date(F.col("x"))) == [
        dt.date(2024, 1, 1), dt.date(2024, 1, 1), dt.date(1969, 12, 31), None, None, None,
    ]
    times = ["1709251200123", "2024-03-01T00:00:00.123Z", "2024-03-01T03:00:00.123+03:00", "x", None, "9" * 18]
    at = dt.datetime(2024, 3, 1, 0, 0, 0, 123000)
    assert results(column(spark, times, "string"), epoch_or_iso_timestamp(F.col("x"))) == [at, at, at, None, None, None]


def test_moments_are_read_in_the_session_zone(spark):
    df = spark.range(1)
    assert results(df, hours_before(dt.datetime(2024, 3, 1, 5), 2)) == [dt.datetime(2024, 3, 1, 3)]
    assert results(df, hours_before("2024-03-01 05:00:00", 2)) == [dt.datetime(2024, 3, 1, 3)]
    assert results(df, month_key(F.lit("2024-03-01").cast("date"))) == [202403]
