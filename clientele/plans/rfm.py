"""Recency, frequency, and monetary segmentation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientele.config import AnalysisConfig
from clientele.functions import UNITS_PER_AMOUNT, WHOLE, cents, rounded_ratio
from clientele.operators import Banding, assign_bands
from clientele.plans.orders import PERSON

# Segments by inclusive (lowest, highest) recency, frequency, and
# monetary score.  The first rule that fits decides; everybody else is OTHERS.
SEGMENTS: tuple[tuple[str, dict[str, tuple[int | None, int | None]]], ...] = (
    ("Champions", {"recency": (4, None), "frequency": (4, None), "monetary": (4, None)}),
    ("Loyal Customers", {"recency": (3, None), "frequency": (4, None)}),
    ("New Customers", {"recency": (4, None), "frequency": (None, 2)}),
    ("At Risk", {"recency": (None, 2), "frequency": (3, None), "monetary": (3, None)}),
    ("Lost Customers", {"recency": (None, 1), "frequency": (None, 2), "monetary": (None, 2)}),
)
OTHERS = "Potential Loyalists"


def customer_segment() -> Column:
    """Segment by the three score columns."""

    def fits(limits: dict[str, tuple[int | None, int | None]]) -> Column:
        tests = []
        for measure, (lowest, highest) in limits.items():
            score = F.col(f"{measure}_score")
            if lowest is not None:
                tests.append(score >= lowest)
            if highest is not None:
                tests.append(score <= highest)
        return reduce(Column.__and__, tests)

    rules = [F.when(fits(limits), F.lit(name)) for name, limits in SEGMENTS]
    return F.coalesce(*rules, F.lit(OTHERS))


def with_analysis_date(summary: DataFrame) -> DataFrame:
    """Add the latest qualified order date and each person's distance from it.

    The date comes from the data, never from the clock.  It is one value, read
    from the settled summary by a scalar subquery.
    """
    latest = summary.agg(F.max("last_order_date")).scalar()
    return summary.withColumn("analysis_date", latest).withColumn(
        "recency_days", F.datediff("analysis_date", "last_order_date")
    )


def score_customers(summary: DataFrame, config: AnalysisConfig, frequency: str = "distinct_orders") -> DataFrame:
    """Add the three scores, their sum, and the segment to the summary."""
    if config.rfm_scoring not in ("ntile", "percent_rank"):
        raise ValueError(f"unknown rfm_scoring: {config.rfm_scoring!r}")
    split_ties = config.rfm_scoring == "ntile"
    high = config.best_is_high

    def score(output: str, value: str, descending: bool) -> Banding:
        return Banding(output, value, config.rfm_bands, descending, split_ties)

    scored = assign_bands(
        with_analysis_date(summary),
        PERSON,
        [
            score("recency_score", "recency_days", descending=high),
            score("frequency_score", frequency, descending=not high),
            score("monetary_score", "revenue_units", descending=not high),
        ],
    )
    total = F.col("recency_score") + F.col("frequency_score") + F.col("monetary_score")
    return scored.withColumns({"rfm_score": total, "customer_segment": customer_segment()})


def rfm_customers(summary: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Scores and segment of each person."""
    return score_customers(summary, config).select(
        PERSON,
        "recency_days",
        F.col("distinct_orders").alias("frequency"),
        cents(F.col("revenue_units")).alias("monetary_value"),
        "recency_score",
        "frequency_score",
        "monetary_score",
        "rfm_score",
        "customer_segment",
    )


def rfm_segment_summary(summary: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Size of each segment and its share of persons and revenue."""
    segments = (
        score_customers(summary, config)
        .groupBy("customer_segment")
        .agg(
            F.count("*").alias("customer_count"),
            F.sum(F.col("revenue_units").cast(WHOLE)).alias("units"),
        )
    )
    # There is one row per segment by now.
    everyone = Window.partitionBy()
    units, all_units = F.col("units"), F.col("all_units")
    totals = segments.withColumns(
        {
            "all_customers": F.sum("customer_count").over(everyone),
            "all_units": F.sum("units").over(everyone),
        }
    )
    return totals.select(
        "customer_segment",
        "customer_count",
        rounded_ratio(F.col("customer_count") * 100, F.col("all_customers"), 2).alias(
            "customer_share_pct"
        ),
        cents(units).alias("segment_revenue"),
        rounded_ratio(units * 100, all_units, 2).alias("revenue_contribution_pct"),
        rounded_ratio(units, F.col("customer_count") * UNITS_PER_AMOUNT, 2).alias(
            "average_customer_revenue"
        ),
    )
