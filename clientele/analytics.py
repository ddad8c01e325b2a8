"""All analyses of one data set behind one object."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from clientele.config import AnalysisConfig
from clientele.operators import discard_settled, settled_so_far
from clientele.plans import churn, clv, growth, keys, orders, quality, retention, rfm
from clientele.plans.ordering import in_report_order
from clientele.session import PLAN_SETTINGS, apply_settings
from clientele.sources.schemas import Tables


# Reports with a documented row order, as accepted by ``Analytics.report``.
REPORTS = (
    "table_row_counts",
    "check_tables",
    "key_candidates",
    "key_inclusions",
    "customer_orders",
    "customer_monthly_orders",
    "cohort_retention_long",
    "cohort_retention_matrix",
    "customer_running_revenue",
    "order_gaps",
    "clv_projection_path",
    "customer_clv",
    "clv_tier_summary",
    "rfm_customers",
    "rfm_segment_summary",
    "churn_flags",
    "churn_by_segment",
    "customer_status",
    "growth_rollup",
    "growth_cube",
    "month_extremes",
    "category_extremes",
)


class Analytics:
    """Reports on six base tables.

    The per-person summary behind value, segments, and churn is computed on
    first use, written to the shared folder, and shared by the reports.  Reports
    come unordered; ``report`` returns one by name in its documented order.

    The plan settings, ANSI mode among them, are applied to the session of the
    tables.  Used as a context (``with Analytics(tables) as shop:``), it puts the
    settings back at the end and deletes the intermediate tables that its reports
    have written; their rows must have been read or written by then.
    """

    def __init__(self, tables: Tables, config: AnalysisConfig | None = None):
        self._spark = tables.orders.sparkSession
        self._settings = apply_settings(self._spark, PLAN_SETTINGS)
        self._mark = settled_so_far()
        self.tables = tables
        self.config = config or AnalysisConfig()

    def __enter__(self) -> Analytics:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def close(self) -> None:
        """Delete what was settled since the start and restore the settings."""
        discard_settled(self._spark, self._mark)
        self.__dict__.pop("summary", None)
        apply_settings(self._spark, self._settings)

    @cached_property
    def summary(self) -> DataFrame:
        return orders.customer_summary(self.tables, self.config)

    def report(self, name: str) -> DataFrame:
        return in_report_order(name, getattr(self, name)())

    def order_revenue(self) -> DataFrame:
        return orders.order_revenue(self.tables)

    def customer_orders(self) -> DataFrame:
        return orders.customer_orders(self.tables, self.config)

    def customer_monthly_orders(self) -> DataFrame:
        return orders.customer_monthly_orders(self.tables)

    def active_customer_months(self) -> DataFrame:
        return orders.active_customer_months(self.tables)

    def customer_running_revenue(self) -> DataFrame:
        return orders.customer_running_revenue(self.tables, self.config)

    def order_gaps(self) -> DataFrame:
        return orders.order_gaps(self.tables, self.config)

    def cohort_retention_long(self) -> DataFrame:
        return retention.cohort_retention_long(self.tables)

    def cohort_retention_matrix(self) -> DataFrame:
        return retention.cohort_retention_matrix(self.tables, self.config)

    def clv_projection_path(self) -> DataFrame:
        return clv.clv_projection_path(self.summary, self.config)

    def customer_clv(self) -> DataFrame:
        return clv.customer_clv(self.summary, self.config)

    def clv_tier_summary(self) -> DataFrame:
        return clv.clv_tier_summary(self.summary, self.config)

    def rfm_customers(self) -> DataFrame:
        return rfm.rfm_customers(self.summary, self.config)

    def rfm_segment_summary(self) -> DataFrame:
        return rfm.rfm_segment_summary(self.summary, self.config)

    def churn_flags(self, fixed_days: int | None = None) -> DataFrame:
        return churn.churn_flags(self.summary, self.config, fixed_days)

    def churn_by_segment(self) -> DataFrame:
        return churn.churn_by_segment(self.summary, self.config)

    def customer_status(self) -> DataFrame:
        return churn.customer_status(self.summary, self.config)

    def growth_rollup(self) -> DataFrame:
        return growth.growth_rollup(self.tables, self.config)

    def growth_cube(self) -> DataFrame:
        return growth.growth_cube(self.tables, self.config)

    def month_extremes(self) -> DataFrame:
        return growth.month_extremes(self.tables, self.config)

    def category_extremes(self) -> DataFrame:
        return growth.category_extremes(self.tables, self.config)

    def table_row_counts(self) -> DataFrame:
        return quality.table_row_counts(self.tables)

    def check_tables(self) -> DataFrame:
        return quality.check_tables(self.tables)

    def key_candidates(self) -> DataFrame:
        return keys.key_candidates(self.tables)

    def key_inclusions(self) -> DataFrame:
        return keys.key_inclusions(self.tables)
