"""Column expressions shared by the operators; all of them stay inside generated code."""

from .aggregates import day_mask_hours, hours_mask, newest, newest_field, stable_round
from .ratios import error_rate, success_rate
from .text import full_name
from .times import epoch_or_iso_date, epoch_or_iso_timestamp, hours_before, month_key

__all__ = [
    "day_mask_hours",
    "epoch_or_iso_date",
    "epoch_or_iso_timestamp",
    "error_rate",
    "full_name",
    "hours_before",
    "hours_mask",
    "month_key",
    "newest",
    "newest_field",
    "stable_round",
    "success_rate",
]
