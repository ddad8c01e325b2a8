"""Churn flags from each person's own ordering rhythm.

The gaps between consecutive orders add up to the days between the first and the
last one, and there is one gap less than orders.  The average gap therefore
needs no ordered window over the orders, just two dates and a count.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.config import AnalysisConfig
from clientele.functions import WHOLE, cents, rounded_ratio, row_ratio
from clientele.plans.orders import PERSON
from clientele.plans.rfm import score_customers, with_analysis_date

# The three states, by growing silence.
ACTIVE, AT_RISK, CHURNED = "Active", "At Risk", "Churned"


def _gaps() -> tuple[Column, Column]:
    """Days in all gaps and number of gaps; NULL for a person with one order."""
    repeated = F.col("order_count") > 1
    days = F.datediff("last_order_date", "first_order_date")
    return F.when(repeated, days), F.when(repeated, F.col("order_count") - 1)


def _expected_gap(config: AnalysisConfig, fixed_days: int | None) -> tuple[Column, Column]:
    """The expected gap as dividend and divisor."""
    if fixed_days is not None:
        return F.lit(fixed_days), F.lit(1)
    days, gaps = _gaps()
    return F.coalesce(days, F.lit(config.single_order_gap_days)), F.coalesce(gaps, F.lit(1))


def churn_status(config: AnalysisConfig, fixed_days: int | None = None) -> Column:
    """State by recency_days; both limits are inclusive and compared exactly."""
    days, gaps = _expected_gap(config, fixed_days)

    def silent_for_at_most(multiple: Fraction) -> Column:
        silence = F.col("recency_days") * gaps * multiple.denominator
        return silence <= days.cast("long") * multiple.numerator

    return (
        F.when(silent_for_at_most(Fraction(1)), ACTIVE)
        .when(silent_for_at_most(config.at_risk_fraction), AT_RISK)
        .otherwise(CHURNED)
    )


def churn_flags(
    summary: DataFrame, config: AnalysisConfig, fixed_days: int | None = None
) -> DataFrame:
    """Churn state of each person.

    ``fixed_days`` replaces everybody's own expected gap by one for all.
    """
    days, gaps = _gaps()
    return with_analysis_date(summary).select(
        PERSON,
        "order_count",
        "last_order_date",
        "analysis_date",
        F.col("recency_days").alias("days_since_last_order"),
        row_ratio(*_expected_gap(config, fixed_days), 1).alias("expected_gap_days"),
        row_ratio(days, gaps, 1).alias("average_gap_days"),
        cents(F.col("revenue_units")).alias("monetary_value"),
        churn_status(config, fixed_days).alias("churn_status"),
    )


def customer_status(summary: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Segment and churn state of each person side by side."""
    return score_customers(summary, config, frequency="order_count").select(
        PERSON,
        "customer_segment",
        churn_status(config).alias("churn_status"),
        "rfm_score",
        "recency_days",
        F.col("order_count").alias("frequency"),
        cents(F.col("revenue_units")).alias("monetary_value"),
    )


def churn_by_segment(summary: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Persons, revenue, and mean recency per segment and churn state."""
    return (
        score_customers(summary, config, frequency="order_count")
        .groupBy("customer_segment", churn_status(config).alias("churn_status"))
        .agg(
            F.count("*").alias("customer_count"),
            F.sum(F.col("revenue_units").cast(WHOLE)).alias("units"),
            F.sum("recency_days").alias("days"),
        )
        .select(
            "customer_segment",
            "churn_status",
            "customer_count",
            cents(F.col("units")).alias("segment_revenue"),
            rounded_ratio(F.col("days"), F.col("customer_count"), 1).alias(
                "average_recency_days"
            ),
        )
    )
