"""Column expressions shared by the analyses."""

from clientele.functions.dates import calendar_month, month_offset
from clientele.functions.numeric import (
    MONEY,
    UNITS_PER_AMOUNT,
    WHOLE,
    cents,
    money,
    money_units,
    rounded_ratio,
    row_ratio,
    wide_sum,
    whole_division,
)

__all__ = [
    "MONEY",
    "UNITS_PER_AMOUNT",
    "WHOLE",
    "calendar_month",
    "cents",
    "money",
    "money_units",
    "month_offset",
    "rounded_ratio",
    "row_ratio",
    "whole_division",
    "wide_sum",
]
