"""Calendar arithmetic on order timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_month(timestamp: Column) -> Column:
    """First day of the wall-clock month of a timestamp, as a date.

    The timestamp becomes a date before it is truncated: truncating a
    zone-less timestamp would turn it into one with a zone.
    """
    return F.trunc(F.to_date(timestamp), "month")


def month_offset(later: Column, earlier: Column) -> Column:
    """Whole calendar months from one month's first day to another's."""
    return (
        (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
    ).cast("int")
