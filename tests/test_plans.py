"""Physical plans: what is read, what is shuffled, what must not appear."""

import re

import pytest

from __spark_entry__ import QUERIES
from clientele import Analytics, star_tables
from clientele.analytics import REPORTS
from clientele.plans import orders
from clientele.plans.measure import plan_nodes, plan_text
from clientele.plans.ordering import in_report_order, report_order
from clientele.sources.star import STAR_CONFIG

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def unsettled(monkeypatch):
    monkeypatch.setattr(orders, "settle", lambda frame: frame)


def read_columns(plan):
    return [
        {column.split(":")[0] for column in schema.split(",")}
        for schema in re.findall(r"ReadSchema: struct<(.*?)>", plan)
    ]


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_text(orders.customer_orders(star_tables(spark, DATA), STAR_CONFIG))
    assert {"o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"} in read_columns(plan)
    assert {"l_orderkey", "l_extendedprice", "l_discount"} in read_columns(plan)
    pushed = r"PushedFilters: .*IsNotNull\(o_orderdate\).*Not\(EqualTo\(o_orderstatus,P\)\)"
    assert re.search(pushed, plan)


def test_summary_shuffles(spark, no_broadcast, unsettled):
    """Payments, orders, customer totals, customers, persons: one shuffle each."""
    summary = orders.customer_summary(star_tables(spark, DATA), STAR_CONFIG)
    assert plan_nodes(summary, "Exchange") == 5


def test_retention_shuffles(spark, no_broadcast):
    """Order months and customers, persons, the counts, and their window."""
    frame = Analytics(star_tables(spark, DATA)).cohort_retention_long()
    assert plan_nodes(frame, "Exchange") == 5
    assert read_columns(plan_text(frame)) == [{"o_custkey", "o_orderdate"}, {"c_custkey"}]


def test_distinct_orders_need_no_shuffle_of_their_own(spark, no_broadcast):
    """Items by product, products, items by order, orders, cells, categories."""
    frame = Analytics(star_tables(spark, DATA), STAR_CONFIG).growth_rollup()
    assert plan_nodes(frame, "Exchange") == 7


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_unbounded_step(spark, name):
    frame = QUERIES[name](spark, DATA)
    assert not re.search(r"Python|Pandas|ArrowEval|CartesianProduct", plan_text(frame))
    # All joins are by equality.
    assert plan_nodes(frame, "BroadcastNestedLoopJoin") == 0


def test_cuts_leave_no_single_task_step(spark):
    frame = QUERIES["rfm_customers"](spark, DATA)
    assert plan_nodes(frame, "Window") == plan_nodes(frame, "Exchange") == 0
    # The analysis date is all that is brought together.
    assert plan_text(frame).count("Arguments: SinglePartition") == 1


def test_every_ordered_report_sorts(spark):
    analytics = Analytics(star_tables(spark, DATA), STAR_CONFIG)
    for name in REPORTS:
        rows = in_report_order(name, getattr(analytics, name)())
        assert len(report_order(name)) >= 1
        assert plan_nodes(rows, "Sort") >= 1


def test_checks_read_each_table_once_per_key(spark):
    """Six key families and keys, and one scan per table for its values."""
    frame = Analytics(star_tables(spark, DATA), STAR_CONFIG).check_tables()
    assert plan_nodes(frame, "Scan") <= 17
