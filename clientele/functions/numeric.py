"""Exact decimal arithmetic.

Amounts are computed as whole ten-thousandths in 64 bits, which sums far faster
than wide decimals do; in ANSI mode an overflow (beyond 900 trillion) is an
error, never a wrong number.  Ratios are never taken in binary floating point:
they stay a pair of whole numbers until one division rounds them, half away from
zero, so that any engine with wide integers can reproduce every digit.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS_PER_AMOUNT = 10_000
# Amounts as they are shown: 20 digits before the point and 4 after it.
MONEY = "decimal(24,4)"
# Whole numbers wider than 64 bits.
WHOLE = "decimal(38,0)"
# Bits of the low part of a number in a wide sum.
_LOW_BITS = 20
_LOW_PART = 1 << _LOW_BITS


def money_units(amount: Column) -> Column:
    """An amount as a 64-bit number of ten-thousandths."""
    return (amount.cast(MONEY) * UNITS_PER_AMOUNT).cast("bigint")


def wide_sum(units: Column) -> Column:
    """Sum of 64-bit numbers as a whole number that may be wider.

    The high and the low part are summed in 64 bits each, so the cost is that of two
    plain sums; the parts overflow only beyond 10^24.
    """
    low = units.bitwiseAND(F.lit(_LOW_PART - 1))
    high = F.sum(F.shiftright(units, _LOW_BITS)).cast("decimal(19,0)")
    return high * F.lit(_LOW_PART) + F.sum(low).cast("decimal(19,0)")


def money(units: Column) -> Column:
    """The amount of a number of ten-thousandths."""
    return (units.cast(WHOLE) * F.lit(Decimal(1) / UNITS_PER_AMOUNT)).cast(MONEY)


def cents(units: Column) -> Column:
    """The same, rounded to two decimals."""
    return F.round(money(units), 2)


def whole_division(dividend: Column, divisor: Column) -> Column:
    """Exact quotient without remainder, for non-negative whole numbers.

    The remainder goes first, so that the decimal division has nothing to round;
    unlike SQL ``div`` the quotient may exceed 64 bits.
    """
    a, b = dividend.cast(WHOLE), divisor.cast(WHOLE)
    return ((a - a % b) / b).cast(WHOLE)


def rounded_ratio(dividend: Column, divisor: Column, places: int) -> Column:
    """``dividend / divisor`` at ``places`` decimals, for wide whole numbers.

    NULL where the divisor is 0 or either side is NULL.
    """
    a = dividend.cast(WHOLE) * F.lit(Decimal(10) ** places)
    b = F.nullif(divisor.cast(WHOLE), F.lit(0).cast(WHOLE))
    size = F.abs(b)
    quotient = whole_division(F.abs(a) * 2 + size, size * 2)
    signed = F.when((a < 0) != (b < 0), -quotient).otherwise(quotient)
    return (signed * F.lit(Decimal(1).scaleb(-places))).cast(f"decimal(38,{places})")


def row_ratio(
    dividend: Column, divisor: Column, places: int, divisor_digits: int = 16
) -> Column:
    """``rounded_ratio`` for every row of a large table: one decimal division.

    Takes whole numbers: a positive divisor of at most ``divisor_digits`` digits
    and a dividend of at most 38 - places - divisor_digits; longer ones are an
    error.  The quotient is first rounded past the divisor's number of digits,
    which cannot create or hide a tie at ``places``: a ratio that is no tie lies
    at least half of 10^(-places) / divisor away from one.
    """
    # Decimal division keeps the dividend's scale plus the divisor's digits plus 1.
    digits = 38 - places - divisor_digits
    a = dividend.cast(f"decimal({digits + places - 1},{places - 1})")
    return F.round(a / divisor.cast(f"decimal({divisor_digits},0)"), places)
