from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_name(last: Column, first: Column, middle: Column) -> Column:
    """`last first [middle]`; a missing middle name leaves no trailing blank."""
    return F.concat_ws(" ", last, first, middle)
