"""Monthly cohort retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientele.config import AnalysisConfig
from clientele.functions import month_offset, rounded_ratio
from clientele.plans.orders import PERSON, known_persons, months_per_customer
from clientele.sources.schemas import Tables


def person_months(tables: Tables) -> DataFrame:
    """One row per person with the set of months the person ordered in."""
    return (
        months_per_customer(tables)
        .join(known_persons(tables), "customer_id")
        .select(PERSON, F.explode("months").alias("month"))
        .groupBy(PERSON)
        .agg(F.collect_set("month").alias("months"))
    )


def cohort_retention_long(tables: Tables) -> DataFrame:
    """Share of each first-order month's persons who order k months later.

    Orders of any state count.  Months without an order have no row.
    """
    activity = (
        person_months(tables)
        .select(
            F.array_min("months").alias("cohort_month"),
            F.explode("months").alias("order_month"),
        )
        .groupBy("cohort_month", "order_month")
        .agg(F.count("*").alias("retained_customers"))
        .withColumn(
            "months_since_cohort", month_offset(F.col("order_month"), F.col("cohort_month"))
        )
    )
    # Everyone is active in the first month, so offset 0 holds the cohort size.
    # A cohort has one row per calendar month here.
    first = F.when(F.col("months_since_cohort") == 0, F.col("retained_customers"))
    size = F.max(first).over(Window.partitionBy("cohort_month"))
    return activity.withColumn("cohort_customers", size).select(
        "cohort_month",
        "months_since_cohort",
        "cohort_customers",
        "retained_customers",
        rounded_ratio(
            F.col("retained_customers") * 100, F.col("cohort_customers"), 2
        ).alias("retention_rate_pct"),
    )


def cohort_retention_matrix(tables: Tables, config: AnalysisConfig) -> DataFrame:
    """The same rates with one row per cohort and one column per month offset."""
    return (
        cohort_retention_long(tables)
        .groupBy("cohort_month")
        .agg(
            *[
                F.max(
                    F.when(F.col("months_since_cohort") == k, F.col("retention_rate_pct"))
                ).alias(f"month_{k}")
                for k in range(config.retention_horizon + 1)
            ]
        )
    )
