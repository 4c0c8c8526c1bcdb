"""Dates and times; "now" is always an argument of the caller."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(as_of: dt.datetime | str | Column | None) -> Column:
    """`as_of` as a timestamp column; the wall clock only when the caller gives nothing.

    A time without zone is read in the session's zone, not in that of the machine the driver runs on.
    """
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    text = as_of if isinstance(as_of, str) else as_of.isoformat(sep=" ")
    return F.lit(text).cast("timestamp")


def wall_clock(at: dt.datetime | str) -> Column:
    """A time without zone, for comparison with columns stored without one."""
    return F.lit(at if isinstance(at, str) else at.isoformat(sep=" ")).cast("timestamp_ntz")


def hours_before(as_of: dt.datetime | str | Column | None, hours: int) -> Column:
    return moment(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS")


def days_before(as_of: dt.datetime | str | Column | None, days: int) -> Column:
    return F.date_sub(F.to_date(moment(as_of)), int(days))


def month_key(date: Column) -> Column:
    """Month of a date as an integer such as 202401, the coarse partition value."""
    return (F.year(date) * 100 + F.month(date)).cast("int")


# Milliseconds beyond this are no times but garbage, and would overflow.
MILLIS_LIMIT = 10**16


def _is_iso(text: Column) -> Column:
    """Whether a date or time is text like 2024-03-01 rather than an epoch number; cheaper than trying both."""
    return F.substring(text, 5, 1) == "-"


def epoch_or_iso_date(text: Column) -> Column:
    """A date sent as days since the epoch or as ISO text; anything else gives NULL."""
    return F.when(_is_iso(text), text.try_cast("date")).otherwise(F.date_from_unix_date(text.try_cast("int")))


def epoch_or_iso_timestamp(text: Column) -> Column:
    """A timestamp sent as milliseconds since the epoch or as ISO text; anything else gives NULL."""
    millis = text.try_cast("long")
    sane = F.when(millis.between(-MILLIS_LIMIT, MILLIS_LIMIT), millis)
    return F.when(_is_iso(text), text.try_cast("timestamp")).otherwise(F.timestamp_millis(sane))
