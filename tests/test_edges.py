"""One fixture per rule that the sample data does not exercise."""

from datetime import date, timedelta
from decimal import Decimal

import pytest
from helpers import by_key, make_tables

from clientele import AnalysisConfig, Analytics


def dates(*days, customer="c", month="2024-01"):
    return [(f"{customer}{i}", customer, f"{month}-{d:02d}T12:00") for i, d in enumerate(days)]


def test_one_person_with_two_customer_records(spark):
    tables = make_tables(
        spark,
        [("o1", "c1", "2024-01-05"), ("o2", "c2", "2024-01-20"), ("o3", "c2", "2024-02-01")],
        customers=[("c1", "u"), ("c2", "u")],
        payments=[("o1", 1, "10.00"), ("o2", 1, "5.00"), ("o3", 1, "1.00")],
    )
    analytics = Analytics(tables)
    assert analytics.active_customer_months().first()[0] == 2
    cohorts = analytics.report("cohort_retention_long").collect()
    assert [r.retained_customers for r in cohorts] == [1, 1]
    assert by_key(analytics.customer_clv(), "customer_unique_id", "order_count") == {"u": 3}
    # The monthly count stays with the customer record.
    assert analytics.customer_monthly_orders().count() == 3


def test_order_states(spark):
    states = ["delivered", "unavailable", "canceled", None, "Canceled", "shipped"]
    tables = make_tables(
        spark, [(f"o{i}", "c", f"2024-0{i + 1}-01", s) for i, s in enumerate(states)]
    )
    analytics = Analytics(tables)
    kept = {r.order_id for r in analytics.customer_orders().collect()}
    assert kept == {"o0", "o4", "o5"}
    # Retention looks at orders of any state.
    assert analytics.cohort_retention_long().count() == 6


def test_missing_time_person_or_customer(spark):
    tables = make_tables(
        spark,
        [("o1", "c1", None), ("o2", "c2", "2024-01-01"), ("o3", "nobody", "2024-01-01")],
        customers=[("c1", "u1"), ("c2", None)],
    )
    analytics = Analytics(tables)
    assert analytics.customer_orders().count() == 0
    assert analytics.cohort_retention_long().count() == 0
    for report in ("customer_clv", "rfm_customers", "rfm_segment_summary", "churn_flags"):
        assert analytics.report(report).count() == 0


def test_unpaid_and_twice_paid_orders(spark):
    tables = make_tables(
        spark,
        [("o1", "c", "2024-01-01"), ("o2", "c", "2024-01-02")],
        payments=[("o2", 1, "1.10"), ("o2", 2, "2.20")],
    )
    revenue = by_key(Analytics(tables).customer_orders(), "order_id", "order_revenue")
    assert revenue == {"o1": Decimal(0), "o2": Decimal("3.30")}


def test_repeated_rows_do_not_count_twice(spark):
    tables = make_tables(
        spark,
        [("o1", "c", "2024-01-01")] * 2 + [("o2", "c", "2024-01-03")],
        customers=[("c", "u")] * 3,
        payments=[("o1", 1, "4.00")],
    )
    analytics = Analytics(tables)
    assert analytics.customer_orders().count() == 2
    clv = analytics.customer_clv()
    assert by_key(clv, "customer_unique_id", "order_count", "historical_revenue") == {
        "u": (2, Decimal("4.00"))
    }


def growth_tables(spark):
    return make_tables(
        spark,
        [("o1", "c", "2024-01-01"), ("o2", "c", "2024-03-01"), ("o3", "c", "2024-04-01")],
        products=[("p1", "toys"), ("p2", None)],
        items=[
            ("o1", 1, "p1", "10.00", "0.00"),
            ("o1", 2, "p2", "5.00", "0.00"),
            ("o1", 3, "p1", "1.00", "0.00"),
            ("o2", 1, "p1", "22.00", "0.00"),
            ("o3", 1, "lost", "7.00", "0.50"),
        ],
    )


def test_categories_and_skipped_months(spark):
    rows = {
        (str(r.revenue_month), r.product_category): r
        for r in Analytics(growth_tables(spark)).growth_rollup().collect()
    }
    # A product without a category and an unknown product share a label.
    assert rows["2024-01-01", "Unknown"].revenue == 5
    assert rows["2024-04-01", "Unknown"].revenue == Decimal("7.50")
    # Growth refers to the last month with revenue, here two months back.
    assert rows["2024-03-01", "toys"].mom_growth_pct == 100
    assert rows["2024-01-01", "toys"].order_count == 1
    # An order in two categories counts in both.
    assert rows["None", None].order_count == 4
    assert rows["None", None].revenue == Decimal("45.50")


def test_growth_from_zero_and_from_a_loss(spark):
    def growth(*amounts):
        tables = make_tables(
            spark,
            [(f"o{i}", "c", f"2024-0{i + 1}-01") for i in range(len(amounts))],
            products=[("p", "toys")],
            items=[(f"o{i}", 1, "p", a, "0.00") for i, a in enumerate(amounts)],
        )
        detail = Analytics(tables).report("growth_rollup").filter("revenue_month IS NOT NULL")
        return [r.mom_growth_pct for r in detail.collect()]

    assert growth("0.00", "5.00") == [None, None]
    assert growth("-8.00", "4.00") == [None, Decimal("-150.00")]


def extremes(spark, *amounts):
    tables = make_tables(
        spark,
        [(f"o{i}", "c", f"2024-0{i + 1}-01") for i in range(len(amounts))],
        items=[(f"o{i}", 1, "p", a, "0.00") for i, a in enumerate(amounts)],
    )
    rows = Analytics(tables).report("month_extremes").collect()
    return [(r.revenue_month.month, r.performance_flag.split()[0]) for r in rows]


def test_extremes_with_ties_and_with_one_month(spark):
    assert extremes(spark, "9.00", "1.00", "9.00", "4.00") == [
        (1, "Best"), (2, "Lowest"), (3, "Best"),
    ]
    assert extremes(spark, "9.00") == [(1, "Best")]


def test_offsets_beyond_the_matrix(spark):
    tables = make_tables(
        spark, [("o1", "c", "2023-01-31"), ("o2", "c", "2024-01-01"), ("o3", "c", "2024-02-01")]
    )
    analytics = Analytics(tables)
    offsets = [r.months_since_cohort for r in analytics.report("cohort_retention_long").collect()]
    assert offsets == [0, 12, 13]
    row = analytics.cohort_retention_matrix().first().asDict()
    assert row["month_12"] == 100 and row["month_11"] is None and "month_13" not in row


def test_month_comes_from_the_wall_clock(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        tables = make_tables(spark, [("o1", "c", "2024-01-31T23:59:59")])
        row = Analytics(tables).cohort_retention_long().first()
        assert str(row.cohort_month) == "2024-01-01"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def churn_states(spark, silence, days, config=None):
    """State of a person with orders on these days, ``silence`` days later."""

    def on(day):
        return str(date(2023, 1, 1) + timedelta(days=day))

    orders = [(f"o{i}", "c", on(d)) for i, d in enumerate(days)]
    orders.append(("z", "other", on(max(days) + silence)))
    flags = Analytics(make_tables(spark, orders), config).churn_flags()
    return by_key(flags, "customer_unique_id", "churn_status")["c"]


@pytest.mark.parametrize(
    "silence, days, state",
    [
        # Gaps 1, 1, and 2: the average is 4/3 and 1.5 times that exactly 2.
        (1, (0, 1, 2, 4), "Active"),
        (2, (0, 1, 2, 4), "At Risk"),
        (3, (0, 1, 2, 4), "Churned"),
        (10, (0, 10), "Active"),
        (11, (0, 10), "At Risk"),
        (15, (0, 10), "At Risk"),
        (16, (0, 10), "Churned"),
        # One order: 180 days are expected.
        (180, (0,), "Active"),
        (181, (0,), "At Risk"),
        (270, (0,), "At Risk"),
        (271, (0,), "Churned"),
        # Two orders on one day: the gap is 0 and stays 0.
        (0, (3, 3), "Active"),
        (1, (3, 3), "Churned"),
    ],
)
def test_churn_limits(spark, silence, days, state):
    assert churn_states(spark, silence, days) == state


def test_churn_settings(spark):
    config = AnalysisConfig(at_risk_multiple=Decimal("2.25"), single_order_gap_days=4)
    assert churn_states(spark, 9, (0,), config) == "At Risk"
    assert churn_states(spark, 10, (0,), config) == "Churned"


def test_negative_revenue_is_not_projected(spark):
    tables = make_tables(
        spark,
        [("o1", "c", "2024-01-01"), ("o2", "d", "2024-01-01")],
        payments=[("o1", 1, "-10.05"), ("o2", 1, "2.00")],
    )
    clv = by_key(
        Analytics(tables).customer_clv(),
        "customer_unique_id",
        "projected_12_month_clv",
        "projected_monthly_revenue",
    )
    assert clv == {"c": (Decimal("-10.05"), Decimal("-10.05")), "d": (26, 2)}


def test_same_day_orders_run_by_order_id(spark):
    tables = make_tables(
        spark,
        [("b", "c", "2024-01-01T08:00"), ("a", "c", "2024-01-01T20:00"), ("d", "c", "2024-01-04")],
        payments=[("a", 1, "1.00"), ("b", 1, "2.00"), ("d", 1, "4.00")],
    )
    analytics = Analytics(tables)
    running = by_key(analytics.customer_running_revenue(), "order_id", "cumulative_revenue")
    assert running == {"a": 1, "b": 3, "d": 7}
    gaps = by_key(analytics.order_gaps(), "order_id", "days_since_previous", "days_to_next")
    assert gaps == {"a": (None, 0), "b": (0, 3), "d": (3, None)}


def test_unknown_scoring_is_refused(spark):
    with pytest.raises(ValueError, match="rfm_scoring"):
        Analytics(
            make_tables(spark, dates(1)), AnalysisConfig(rfm_scoring="median")
        ).rfm_customers()


def test_orders_under_two_records_of_a_person_and_with_two_dates(spark):
    """DISTINCT is by person, order, date and revenue; frequency counts order ids."""
    tables = make_tables(
        spark,
        orders=[
            ("o1", "c1", "2024-01-01"), ("o1", "c2", "2024-01-01"),
            ("o2", "c1", "2024-02-01"), ("o2", "c1", "2024-02-05"), ("o3", "d", "2024-03-01"),
        ],
        customers=[("c1", "u"), ("c2", "u"), ("d", "v")],
        payments=[("o1", 1, "10.00"), ("o2", 1, "5.00")],
    )
    analytics = Analytics(tables)
    assert analytics.customer_orders().count() == 4
    clv = by_key(analytics.customer_clv(), "customer_unique_id", "order_count", "historical_revenue")
    assert {k: (n, str(v)) for k, (n, v) in clv.items()} == {"u": (3, "20.00"), "v": (1, "0.00")}
    rfm = by_key(analytics.rfm_customers(), "customer_unique_id", "frequency", "monetary_value")
    assert {k: (n, str(v)) for k, (n, v) in rfm.items()} == {"u": (2, "20.00"), "v": (1, "0.00")}
    assert by_key(analytics.customer_status(), "customer_unique_id", "frequency") == {"u": 3, "v": 1}
