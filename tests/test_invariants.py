"""Relations between reports that hold on any data."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clientele import Analytics, star_tables
from clientele.functions import cents, money_units
from clientele.plans.growth import monthly_category_revenue
from clientele.sources.star import STAR_CONFIG


@pytest.fixture(scope="module")
def shop(spark):
    return Analytics(star_tables(spark, "/root/testdata/sf0.001", 2), STAR_CONFIG)


def total(frame, column):
    return frame.agg(F.sum(column)).first()[0]


def test_first_month_is_complete(shop):
    first = shop.cohort_retention_long().filter("months_since_cohort = 0")
    assert first.filter("retention_rate_pct <> 100").count() == 0
    matrix = shop.cohort_retention_matrix()
    assert matrix.filter("month_0 <> 100").count() == 0
    assert matrix.count() == first.count()


def test_cohort_activity_is_the_distinct_person_months(shop):
    months = shop.active_customer_months().first()[0]
    assert total(shop.cohort_retention_long(), "retained_customers") == months


def test_every_person_once_in_every_report(shop):
    persons = shop.summary.count()
    assert persons == shop.customer_orders().select("customer_unique_id").distinct().count()
    for report in ("customer_clv", "rfm_customers", "churn_flags", "customer_status"):
        frame = getattr(shop, report)()
        assert frame.count() == frame.select("customer_unique_id").distinct().count() == persons
    for report in ("clv_tier_summary", "rfm_segment_summary", "churn_by_segment"):
        assert total(getattr(shop, report)(), "customer_count") == persons
    assert shop.clv_projection_path().count() == 13 * persons


def test_last_running_total_is_the_revenue(shop):
    last = shop.customer_running_revenue().groupBy("customer_unique_id").agg(
        F.max("cumulative_revenue").alias("last")
    )
    clv = shop.customer_clv().select("customer_unique_id", "historical_revenue")
    different = last.join(clv, "customer_unique_id").filter(
        F.round("last", 2) != F.col("historical_revenue")
    )
    assert different.count() == 0


def test_path_runs_from_revenue_to_projection(shop):
    path = shop.clv_projection_path()
    clv = shop.customer_clv()
    for month, column in ((0, "historical_revenue"), (12, "projected_12_month_clv")):
        ends = path.filter(F.col("projection_month") == month).join(clv, "customer_unique_id")
        assert ends.filter(F.col("cumulative_projected_clv") != F.col(column)).count() == 0


def test_churn_and_segments_agree(shop):
    flags = shop.churn_flags().select(
        "customer_unique_id", "days_since_last_order", "churn_status", "monetary_value"
    )
    status = shop.customer_status().select(
        "customer_unique_id",
        F.col("recency_days").alias("days_since_last_order"),
        "churn_status",
        "monetary_value",
    )
    assert flags.exceptAll(status).count() == status.exceptAll(flags).count() == 0


def test_gaps_add_up_to_the_average(shop):
    """The gaps between neighbours against the average taken from two dates."""
    gaps = shop.order_gaps().groupBy("customer_unique_id").agg(
        F.round(F.avg(F.col("days_since_previous").cast("decimal(20,0)")), 1).alias("mean")
    )
    flags = shop.churn_flags().join(gaps, "customer_unique_id")
    assert flags.filter(~F.col("mean").eqNullSafe(F.col("average_gap_days"))).count() == 0


def test_grand_total_reconciles_the_items(shop):
    rollup = shop.growth_rollup()
    detail = rollup.filter("summary_level = 'Monthly Category'")
    grand = rollup.filter("summary_level = 'Grand Total'").first()
    assert grand.revenue == total(detail, "revenue")
    subtotals = rollup.filter("summary_level = 'Category Subtotal'")
    assert grand.revenue == total(subtotals, "revenue")
    # Up to the rounding of each cell, this is the revenue of the items.
    orders = shop.tables.orders.filter("order_status <> 'P'").select("order_id")
    items = shop.tables.order_items.join(orders, "order_id").agg(
        F.sum(money_units(F.col("price") + F.col("freight_value"))).alias("units")
    )
    exact = items.select(cents(F.col("units"))).first()[0]
    assert abs(exact - grand.revenue) <= detail.count() * Decimal("0.005")


def test_first_month_of_a_category_has_no_growth(shop):
    detail = monthly_category_revenue(shop.tables, STAR_CONFIG)
    first = detail.groupBy("product_category").agg(F.min("revenue_month").alias("revenue_month"))
    rows = detail.join(first, ["product_category", "revenue_month"])
    assert rows.count() == rows.filter("mom_growth_pct IS NULL").count() == first.count()


def test_cube_is_rollup_plus_months(shop):
    cube, rollup = shop.growth_cube(), shop.growth_rollup()
    assert cube.filter("summary_level <> 'Monthly Total'").exceptAll(rollup).count() == 0
    months = cube.filter("summary_level = 'Monthly Total'")
    assert months.count() == rollup.select("revenue_month").dropna().distinct().count()
    grand = rollup.filter("summary_level = 'Grand Total'").first()
    assert total(months, "revenue") == grand.revenue
