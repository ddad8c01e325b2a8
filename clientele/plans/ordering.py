"""Row order of the finished reports.

Analyses return unordered rows, because a total order costs a shuffle that a
further query or a file sink does not need.  ``in_report_order`` adds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.plans.churn import AT_RISK, CHURNED


def _churn_priority() -> Column:
    status = F.col("churn_status")
    return F.when(status == CHURNED, 1).when(status == AT_RISK, 2).otherwise(3)


def report_order(report: str) -> list[Column]:
    """Sort keys of a report; amounts sort as shown, that is, rounded."""
    person = F.col("customer_unique_id")
    growth = [F.asc_nulls_last("revenue_month"), F.asc_nulls_last("product_category")]
    orders: dict[str, list[Column]] = {
        "customer_orders": [person, F.col("order_date"), F.col("order_id")],
        "customer_monthly_orders": [F.col("customer_id"), F.col("order_month")],
        "cohort_retention_long": [F.col("cohort_month"), F.col("months_since_cohort")],
        "cohort_retention_matrix": [F.col("cohort_month")],
        "customer_running_revenue": [person, F.col("order_date"), F.col("order_id")],
        "order_gaps": [person, F.col("order_date"), F.col("order_id")],
        "clv_projection_path": [person, F.col("projection_month")],
        "customer_clv": [F.desc("projected_12_month_clv"), person],
        "clv_tier_summary": [F.col("clv_quartile")],
        "rfm_customers": [F.desc("rfm_score"), F.desc("monetary_value"), person],
        "rfm_segment_summary": [F.desc("segment_revenue"), F.col("customer_segment")],
        "churn_flags": [_churn_priority(), F.desc("days_since_last_order"), person],
        "churn_by_segment": [F.col("customer_segment"), F.col("churn_status")],
        "customer_status": [_churn_priority(), F.desc("rfm_score"), person],
        "growth_rollup": growth,
        "growth_cube": growth,
        "month_extremes": [F.col("revenue_month")],
        "category_extremes": [F.col("product_category")],
        "table_row_counts": [F.col("table_name")],
        "check_tables": [F.col("table_name"), F.col("rule")],
        "key_candidates": [F.col("table_name"), F.col("key_columns")],
        "key_inclusions": [F.col(c) for c in ("child_table", "child_columns", "parent_table", "parent_columns")],
    }
    return orders[report]


def in_report_order(report: str, rows: DataFrame) -> DataFrame:
    return rows.orderBy(*report_order(report))
