"""Ratios with the three treatments of an empty denominator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .aggregates import stable_round


def success_rate(done: Column, total: Column, empty: str = "zero", cap: bool = False) -> Column:
    """`done / total` in percent, two digits.

    `empty` says what no movements at all give: "zero" or "null". `cap` limits the rate to 100, for sources
    that report more successes than movements.
    """
    if empty not in ("zero", "null"):
        raise ValueError(f"empty must be 'zero' or 'null', not {empty!r}")
    rate = done.cast("double") / total * 100
    if cap:
        rate = F.least(rate, F.lit(100.0))
    # the guard also keeps least() from turning a missing rate into 100
    rate = F.when(total > 0, stable_round(rate, 2))
    return F.coalesce(rate, F.lit(0.0)) if empty == "zero" else rate


def error_rate(errors: Column, movements: Column) -> Column:
    """Errors per movement, unrounded; NULL without movements."""
    return F.try_divide(errors.cast("double"), movements.cast("double"))
