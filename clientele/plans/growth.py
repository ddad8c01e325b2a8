"""Revenue by month and category, with subtotals and month-over-month growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientele.config import AnalysisConfig
from clientele.functions import calendar_month, cents, money_units, rounded_ratio, wide_sum
from clientele.operators import settle
from clientele.plans.orders import qualified_orders
from clientele.sources.schemas import Tables

MONTH, CATEGORY = "revenue_month", "product_category"


def _item_revenue(tables: Tables, config: AnalysisConfig, by_category: bool) -> DataFrame:
    """Items of qualified orders with their month, and category if asked for.

    The join with the orders comes last: it leaves the rows partitioned by
    order, so counting distinct orders needs no shuffle of its own.
    """
    items = tables.order_items.select(
        "order_id",
        "product_id",
        money_units(F.col("price") + F.col("freight_value")).alias("units"),
    )
    if by_category:
        products = tables.products.select("product_id", "product_category_name")
        items = items.join(products, "product_id", "left").select(
            "order_id",
            "units",
            F.coalesce("product_category_name", F.lit(config.unknown_category)).alias(CATEGORY),
        )
    orders = qualified_orders(tables, config).select(
        "order_id", calendar_month(F.col("order_purchase_timestamp")).alias(MONTH)
    )
    return items.join(orders, "order_id")


def _totals(items: DataFrame, *keys: str) -> DataFrame:
    return items.groupBy(*keys).agg(
        F.count_distinct("order_id").alias("order_count"),
        wide_sum(F.col("units")).alias("units"),
    )


def _with_growth(totals: DataFrame, *partition: str) -> DataFrame:
    """Add the growth over the previous month that has any revenue row.

    The window sees one row per month, within a category if one is given.
    """
    months = Window.partitionBy(*partition).orderBy(MONTH)
    before = F.col("units_before")
    change = (F.col("units") - before) * 100
    return (
        totals.withColumn("units_before", F.lag("units").over(months))
        .withColumn("mom_growth_pct", rounded_ratio(change, before, 2))
        .drop("units_before")
    )


def monthly_category_revenue(tables: Tables, config: AnalysisConfig) -> DataFrame:
    """Orders, revenue, and growth per month and category."""
    totals = _totals(_item_revenue(tables, config, True), MONTH, CATEGORY)
    return _with_growth(totals, CATEGORY).select(
        MONTH, CATEGORY, "order_count", cents(F.col("units")).alias("revenue"), "mom_growth_pct"
    )


# Summary level by grouping id of (category, month).
LEVELS = {
    0: "Monthly Category",
    1: "Category Subtotal",
    2: "Monthly Total",
    3: "Grand Total",
}


def _summarised(grouped) -> DataFrame:
    """Rows of all levels.  Subtotals add up the rounded rows, and an order with
    several categories counts once in each; growth exists on detail rows only.
    """
    level = F.create_map(*[F.lit(part) for item in LEVELS.items() for part in item])
    rows = grouped.agg(
        F.grouping_id().alias("level"),
        F.sum("order_count").alias("order_count"),
        F.sum("revenue").alias("revenue"),
        F.max("mom_growth_pct").alias("mom_growth_pct"),
    )
    return rows.select(
        MONTH,
        CATEGORY,
        level[F.col("level").cast("int")].alias("summary_level"),
        "order_count",
        "revenue",
        F.when(F.col("level") == 0, F.col("mom_growth_pct")).alias("mom_growth_pct"),
    )


def growth_rollup(tables: Tables, config: AnalysisConfig) -> DataFrame:
    """Month and category detail, category subtotals, and the grand total."""
    return _summarised(monthly_category_revenue(tables, config).rollup(CATEGORY, MONTH))


def growth_cube(tables: Tables, config: AnalysisConfig) -> DataFrame:
    """The rollup plus a total per month over all categories."""
    return _summarised(monthly_category_revenue(tables, config).cube(CATEGORY, MONTH))


def _extremes(totals: DataFrame, what: str, *columns: str) -> DataFrame:
    """Rows with the highest and the lowest revenue, all of them on a tie.

    Comparing with the two limits ranks nothing, so the number of rows does not
    matter; the totals are settled because they are read three times.
    """
    totals = settle(totals)
    limits = {
        "highest": totals.agg(F.max("units")).scalar(),
        "lowest": totals.agg(F.min("units")).scalar(),
    }
    flag = F.when(F.col("units") == F.col("highest"), f"Best Revenue {what}").when(
        F.col("units") == F.col("lowest"), f"Lowest Revenue {what}"
    )
    return (
        totals.withColumns(limits)
        .withColumn("performance_flag", flag)
        .filter(F.col("performance_flag").isNotNull())
        .select(
            columns[0],
            "order_count",
            cents(F.col("units")).alias("revenue"),
            *columns[1:],
            "performance_flag",
        )
    )


def month_extremes(tables: Tables, config: AnalysisConfig) -> DataFrame:
    """Best and worst month by revenue, with growth over the month before."""
    months = _totals(_item_revenue(tables, config, False), MONTH)
    return _extremes(_with_growth(months), "Month", MONTH, "mom_growth_pct")


def category_extremes(tables: Tables, config: AnalysisConfig) -> DataFrame:
    """Best and worst category by revenue over all months."""
    categories = _totals(_item_revenue(tables, config, True), CATEGORY)
    return _extremes(categories, "Category", CATEGORY)
