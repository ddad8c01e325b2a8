"""Golden results on the sample data, in report order."""

import pytest
from helpers import text_rows

from clientele import Analytics
from clientele.sources.seed import load_seed


@pytest.fixture(scope="module")
def seed(spark):
    return Analytics(load_seed(spark))


def lines(text):
    """Cells separated by blanks or, where they contain some, by bars; - is NULL."""
    rows = []
    for line in text.strip().splitlines():
        cells = line.split("|") if "|" in line else line.split()
        rows.append(tuple(None if c.strip() == "-" else c.strip() for c in cells))
    return rows


def check(frame, text, *columns):
    assert text_rows(frame.select(*columns) if columns else frame) == lines(text)


def test_row_counts(seed):
    check(
        seed.report("table_row_counts"),
        "customers 8\norder_items 15\norders 15\npayments 15\nproducts 5\nreviews 14",
    )


def test_customer_months(seed):
    assert seed.active_customer_months().first()[0] == 13
    rows = text_rows(seed.report("customer_monthly_orders"))
    assert len(rows) == 13
    assert [r for r in rows if r[2] != "1"] == [
        ("c003", "2024-02-01", "2"),
        ("c008", "2024-05-01", "2"),
    ]


def test_retention_long(seed):
    check(
        seed.report("cohort_retention_long"),
        """
        2024-01-01 0 2 2 100.00
        2024-01-01 1 2 1 50.00
        2024-01-01 2 2 1 50.00
        2024-01-01 3 2 1 50.00
        2024-02-01 0 1 1 100.00
        2024-02-01 3 1 1 100.00
        2024-03-01 0 2 2 100.00
        2024-03-01 1 2 1 50.00
        2024-04-01 0 2 2 100.00
        2024-05-01 0 1 1 100.00
        """,
    )


def test_retention_matrix(seed):
    matrix = seed.report("cohort_retention_matrix")
    assert matrix.columns == ["cohort_month", *[f"month_{k}" for k in range(13)]]
    rest = " -" * 9
    check(
        matrix,
        f"""
        2024-01-01 100.00 50.00 50.00 50.00{rest}
        2024-02-01 100.00 - - 100.00{rest}
        2024-03-01 100.00 50.00 - -{rest}
        2024-04-01 100.00 - - -{rest}
        2024-05-01 100.00 - - -{rest}
        """,
    )


def test_running_revenue(seed):
    check(
        seed.report("customer_running_revenue"),
        """
        u001 110.0000
        u001 198.0000
        u001 363.0000
        u002 57.0000
        u002 189.0000
        u003 46.0000
        u003 145.0000
        u003 363.0000
        u004 83.0000
        u005 67.0000
        u005 187.0000
        u006 51.0000
        u007 78.0000
        u008 142.0000
        """,
        "customer_unique_id",
        "cumulative_revenue",
    )


def test_customer_clv(seed):
    check(
        seed.report("customer_clv"),
        """
        u008|1|2024-05-09|2024-05-09|142.00|142.00|1.0000|142.00|1846.00|1|Top CLV
        u003|3|2024-02-05|2024-05-02|363.00|121.00|0.7775|94.08|1491.99|1|Top CLV
        u001|3|2024-01-10|2024-04-20|363.00|121.00|0.6947|84.06|1371.74|2|High CLV
        u005|2|2024-03-19|2024-04-22|187.00|93.50|0.9447|88.33|1246.97|2|High CLV
        u004|1|2024-03-11|2024-03-11|83.00|83.00|1.0000|83.00|1079.00|3|Mid CLV
        u007|1|2024-04-10|2024-04-10|78.00|78.00|1.0000|78.00|1014.00|3|Mid CLV
        u002|2|2024-01-15|2024-03-18|189.00|94.50|0.6515|61.57|927.81|4|Low CLV
        u006|1|2024-04-03|2024-04-03|51.00|51.00|1.0000|51.00|663.00|4|Low CLV
        """,
    )


def test_clv_tiers(seed):
    check(
        seed.report("clv_tier_summary"),
        """
        1|Top CLV|2|3337.99|1668.99
        2|High CLV|2|2618.71|1309.35
        3|Mid CLV|2|2093.00|1046.50
        4|Low CLV|2|1590.81|795.40
        """,
    )


def test_clv_path(seed):
    path = seed.report("clv_projection_path").filter("customer_unique_id = 'u003'")
    values = [r.cumulative_projected_clv for r in path.collect()]
    assert len(values) == 13
    assert (str(values[0]), str(values[1]), str(values[-1])) == ("363.00", "457.08", "1491.99")


def test_rfm(seed):
    check(
        seed.report("rfm_customers"),
        """
        u004|59|1|83.00|5|3|3|11|Potential Loyalists
        u007|29|1|78.00|3|4|4|11|Loyal Customers
        u006|36|1|51.00|3|3|5|11|Potential Loyalists
        u008|0|1|142.00|1|5|3|9|At Risk
        u002|52|2|189.00|4|2|2|8|New Customers
        u005|17|2|187.00|2|2|2|6|Potential Loyalists
        u001|19|3|363.00|2|1|1|4|Potential Loyalists
        u003|7|3|363.00|1|1|1|3|Lost Customers
        """,
    )


def test_rfm_with_best_scores_high(spark):
    from clientele import AnalysisConfig

    analytics = Analytics(load_seed(spark), AnalysisConfig(best_is_high=True))
    check(
        analytics.rfm_customers().orderBy("customer_unique_id"),
        """
        u001|3|4|4|Loyal Customers
        u002|1|3|3|At Risk
        u003|4|5|5|Champions
        u004|1|1|2|Lost Customers
        u005|3|3|3|Potential Loyalists
        u006|2|1|1|Potential Loyalists
        u007|2|2|1|Potential Loyalists
        u008|5|2|2|New Customers
        """,
        "customer_unique_id",
        "recency_score",
        "frequency_score",
        "monetary_score",
        "customer_segment",
    )


def test_segments(seed):
    check(
        seed.report("rfm_segment_summary"),
        """
        Potential Loyalists|4|50.00|684.00|46.98|171.00
        Lost Customers|1|12.50|363.00|24.93|363.00
        New Customers|1|12.50|189.00|12.98|189.00
        At Risk|1|12.50|142.00|9.75|142.00
        Loyal Customers|1|12.50|78.00|5.36|78.00
        """,
    )


def test_churn(seed):
    check(
        seed.report("churn_flags"),
        """
        u004 59 180.0 - Active
        u002 52 63.0 63.0 Active
        u006 36 180.0 - Active
        u007 29 180.0 - Active
        u001 19 50.5 50.5 Active
        u005 17 34.0 34.0 Active
        u003 7 43.5 43.5 Active
        u008 0 180.0 - Active
        """,
        "customer_unique_id",
        "days_since_last_order",
        "expected_gap_days",
        "average_gap_days",
        "churn_status",
    )
    assert {str(r.analysis_date) for r in seed.churn_flags().collect()} == {"2024-05-09"}


def test_churn_by_segment(seed):
    check(
        seed.report("churn_by_segment"),
        """
        At Risk|Active|1|142.00|0.0
        Lost Customers|Active|1|363.00|7.0
        Loyal Customers|Active|1|78.00|29.0
        New Customers|Active|1|189.00|52.0
        Potential Loyalists|Active|4|684.00|32.8
        """,
    )


def test_growth_rollup(seed):
    check(
        seed.report("growth_rollup"),
        """
        2024-01-01|electronics|Monthly Category|1|110.00|-
        2024-01-01|health_beauty|Monthly Category|1|57.00|-
        2024-02-01|bed_bath_table|Monthly Category|1|88.00|-
        2024-02-01|sports_leisure|Monthly Category|1|99.00|-
        2024-02-01|toys|Monthly Category|1|46.00|-
        2024-03-01|bed_bath_table|Monthly Category|1|83.00|-5.68
        2024-03-01|electronics|Monthly Category|1|132.00|20.00
        2024-03-01|health_beauty|Monthly Category|1|67.00|17.54
        2024-04-01|health_beauty|Monthly Category|1|120.00|79.10
        2024-04-01|sports_leisure|Monthly Category|2|243.00|145.45
        2024-04-01|toys|Monthly Category|1|51.00|10.87
        2024-05-01|electronics|Monthly Category|2|360.00|172.73
        -|bed_bath_table|Category Subtotal|2|171.00|-
        -|electronics|Category Subtotal|4|602.00|-
        -|health_beauty|Category Subtotal|3|244.00|-
        -|sports_leisure|Category Subtotal|3|342.00|-
        -|toys|Category Subtotal|2|97.00|-
        -|-|Grand Total|14|1456.00|-
        """,
    )


def test_extremes(seed):
    check(
        seed.report("month_extremes"),
        """
        2024-01-01|2|167.00|-|Lowest Revenue Month
        2024-04-01|4|414.00|46.81|Best Revenue Month
        """,
    )
    check(
        seed.report("category_extremes"),
        """
        electronics|4|602.00|Best Revenue Category
        toys|2|97.00|Lowest Revenue Category
        """,
    )


def test_sample_data_breaks_no_rule(seed):
    assert seed.check_tables().filter("violations > 0").count() == 0


def test_loading_twice_changes_nothing(spark):
    once = load_seed(spark)
    twice = load_seed(spark, into=once)
    for name, frame in once.named().items():
        assert sorted(map(str, frame.collect())) == sorted(
            map(str, twice.named()[name].collect())
        )
