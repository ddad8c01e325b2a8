"""Historical and projected customer lifetime value.

With ``a/b`` days per month and ``s`` days between a person's first and last
order, the observed frequency is ``orders * a / (s*b + a)`` per month.  Average
order value times frequency makes the order count cancel, so ``k`` months on the
value is ``revenue * (s*b + a + k*a) / (s*b + a)``: a straight line, computed per
person without iterating over months.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.config import AnalysisConfig
from clientele.functions import UNITS_PER_AMOUNT, WHOLE, cents, rounded_ratio, row_ratio
from clientele.operators import Banding, assign_bands
from clientele.plans.orders import PERSON

# The name of each band, best first.
TIERS = ("Top CLV", "High CLV", "Mid CLV", "Low CLV")

# Days from the first to the last date there is.
_LONGEST_SPAN = (date.max - date.min).days

# Digits the projection keeps behind its unit, for ranking and adding up.
_KEPT_DIGITS = 12
_KEPT_PER_UNIT = 10**_KEPT_DIGITS


def _line(config: AnalysisConfig) -> tuple[Column, Column]:
    """Numerator of one month (``a``) and common divisor (``s*b + a``)."""
    month = config.month_fraction
    span = F.datediff("last_order_date", "first_order_date").cast("bigint")
    step = F.lit(month.numerator).cast("bigint")
    return step, span * month.denominator + step


def _divisor_digits(config: AnalysisConfig) -> int:
    """Digits of the divisor for any span between the years 1 and 9999."""
    month = config.month_fraction
    return len(str(month.denominator * _LONGEST_SPAN + month.numerator))


def _wide_product(units: Column, factor: Column) -> Column:
    return units.cast("decimal(19,0)") * factor.cast("decimal(19,0)")


def _at_horizon(config: AnalysisConfig) -> tuple[Column, Column]:
    """The projected value as a ratio; money lost so far is not projected."""
    step, divisor = _line(config)
    revenue = F.col("revenue_units")
    months = F.when(revenue < 0, F.lit(0)).otherwise(F.lit(config.projection_months))
    return _wide_product(revenue, divisor + step * months), divisor


def _with_projection(summary: DataFrame, config: AnalysisConfig) -> DataFrame:
    dividend, divisor = _at_horizon(config)
    # The decimals of a quotient follow from the digits of its divisor.
    kept = dividend.cast("decimal(26,0)") / divisor.cast(f"decimal({_KEPT_DIGITS - 1},0)")
    return summary.withColumn("projected_units", kept)


def clv_projection_path(summary: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Projected cumulative value per person for every month of the horizon."""
    step, divisor = _line(config)
    months = F.sequence(F.lit(0), F.lit(config.projection_months))
    return summary.select(
        "*", F.explode(months).alias("projection_month")
    ).select(
        PERSON,
        "projection_month",
        row_ratio(
            _wide_product(F.col("revenue_units"), divisor + step * F.col("projection_month")),
            divisor * UNITS_PER_AMOUNT,
            2,
            _divisor_digits(config) + 4,
        ).alias("cumulative_projected_clv"),
    )


def _ranked(summary: DataFrame, config: AnalysisConfig) -> DataFrame:
    projected = _with_projection(summary, config)
    quartile = Banding(
        "clv_quartile", "projected_units", config.clv_bands, descending=True
    )
    return assign_bands(projected, PERSON, [quartile])


def _tier() -> Column:
    """Name of the band; NULL beyond the named ones."""
    return F.get(F.array(*[F.lit(name) for name in TIERS]), F.col("clv_quartile") - 1)


def customer_clv(summary: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Value so far, observed rhythm, projected value, and tier of each person."""
    step, divisor = _line(config)
    (at_horizon, _), digits = _at_horizon(config), _divisor_digits(config)
    revenue, orders = F.col("revenue_units"), F.col("order_count")
    return _ranked(summary, config).select(
        PERSON,
        "order_count",
        "first_order_date",
        "last_order_date",
        cents(revenue).alias("historical_revenue"),
        row_ratio(revenue, orders * UNITS_PER_AMOUNT, 2).alias("average_order_value"),
        row_ratio(orders * step, divisor, 4, digits).alias("monthly_order_frequency"),
        row_ratio(
            _wide_product(revenue, step), divisor * UNITS_PER_AMOUNT, 2, digits + 4
        ).alias("projected_monthly_revenue"),
        row_ratio(at_horizon, divisor * UNITS_PER_AMOUNT, 2, digits + 4).alias(
            "projected_12_month_clv"
        ),
        "clv_quartile",
        _tier().alias("clv_tier"),
    )


def clv_tier_summary(summary: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Number of persons and their unrounded projected value, per tier."""
    one = F.lit(_KEPT_PER_UNIT * UNITS_PER_AMOUNT).cast(WHOLE)
    return (
        _ranked(summary, config)
        .groupBy("clv_quartile")
        .agg(
            F.count("*").alias("customer_count"),
            F.sum("projected_units").alias("units"),
        )
        .withColumn("kept", (F.col("units") * F.lit(_KEPT_PER_UNIT)).cast(WHOLE))
        .select(
            "clv_quartile",
            _tier().alias("clv_tier"),
            "customer_count",
            rounded_ratio(F.col("kept"), one, 2).alias("projected_clv_total"),
            rounded_ratio(F.col("kept"), F.col("customer_count") * one, 2).alias(
                "projected_clv_average"
            ),
        )
    )
