"""Aggregate expressions that merge: each can be computed in parts and combined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half of the last of nine digits: more than float noise reaches, less than any report shows.
NOISE = 5e-10
NOISE_DIGITS = 9
# Up to here the noise allowance exceeds the error of scaling a double; larger values are rounded the slow way.
PLAIN_LIMIT = 1e6


def stable_round(value: Column, digits: int) -> Column:
    """Half-up rounding (up to six digits) that does not depend on the order in which floats were added.

    A sum of doubles differs in its last bits between partitionings, so a mean such as 1.015 may arrive as
    1.0149999999999999. Values within noise of a tie count as the tie, which makes the result repeatable. Plain
    arithmetic stays in generated code; `round` would go through a decimal object per value.
    """
    scale = 10.0**digits
    magnitude = F.floor(F.abs(value) * scale + (0.5 + NOISE * scale)).cast("double") / scale
    # adding zero turns a negative zero into a plain one
    plain = F.signum(value) * magnitude + 0.0
    return F.when(F.abs(value) < PLAIN_LIMIT, plain).otherwise(F.round(F.round(value, NOISE_DIGITS), digits))


def hours_mask(hour: Column) -> Column:
    """Hours of day seen, as the bits of one integer. Masks merge with `bit_or`, unlike a distinct count."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1), hour.cast("int")))


def day_mask_hours(mask: Column) -> Column:
    """Number of hours in a mask."""
    return F.bit_count(mask).cast("int")


def newest(order: list[str], values: list[str]) -> Column:
    """The `values` of the row that is last by `order`; equal order falls back to the values themselves,
    so the choice never depends on row placement."""
    return F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *values))


def newest_field(packed: str, name: str) -> Column:
    return F.col(packed)[name].alias(name)
