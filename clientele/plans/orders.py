"""Order-level building blocks: revenue per order, order history, person totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.config import AnalysisConfig
from clientele.functions import calendar_month, money, money_units
from clientele.operators import ordered_history, range_cuts, settle
from clientele.sources.schemas import Tables

PERSON = "customer_unique_id"


def has_purchase_time() -> Column:
    return F.col("order_purchase_timestamp").isNotNull()


def qualified_orders(tables: Tables, config: AnalysisConfig) -> DataFrame:
    """Orders that count; one without a state does not."""
    return tables.orders.filter(
        has_purchase_time() & ~F.col("order_status").isin(*config.excluded_statuses)
    )


def known_persons(tables: Tables) -> DataFrame:
    """Which person stands behind a customer record."""
    return tables.customers.filter(F.col(PERSON).isNotNull()).select("customer_id", PERSON)


def _order_units(tables: Tables) -> DataFrame:
    return tables.payments.groupBy("order_id").agg(
        F.sum(money_units(F.col("payment_value"))).alias("order_units")
    )


def order_revenue(tables: Tables) -> DataFrame:
    """What was paid for each order, over all its payments."""
    return _order_units(tables).select(
        "order_id", money(F.col("order_units")).alias("order_revenue")
    )


def _person_orders(tables: Tables, config: AnalysisConfig) -> DataFrame:
    """Distinct (person, order, date, revenue) of the qualified orders.

    Payments are summed before the join, so an order never multiplies.  That join comes
    last and leaves the rows partitioned by order, which DISTINCT reuses; it ends repeated
    rows, repeated customer records, and orders under several records of one person.
    """
    return (
        qualified_orders(tables, config)
        .select(
            "order_id",
            "customer_id",
            F.to_date("order_purchase_timestamp").alias("order_date"),
        )
        .join(known_persons(tables), "customer_id")
        .join(_order_units(tables), "order_id", "left")
        .select(
            PERSON,
            "order_id",
            "order_date",
            F.coalesce("order_units", F.lit(0)).alias("order_units"),
        )
        .distinct()
    )


def customer_orders(tables: Tables, config: AnalysisConfig) -> DataFrame:
    """The qualified order history of every person; unpaid orders are worth 0."""
    return _person_orders(tables, config).select(
        PERSON, "order_id", "order_date", money(F.col("order_units")).alias("order_revenue")
    )


def customer_summary(tables: Tables, config: AnalysisConfig) -> DataFrame:
    """One settled row per person: order_count, first and last date, revenue_units.

    ``order_count`` counts rows of the history, ``distinct_orders`` order ids: they differ
    where an id stands for several orders.  A person's orders are totalled by order first,
    where DISTINCT has left them, and then partly before the shuffle by person, so a person
    with a large share of all orders leaves each task as one row.

    CLV, segments, and churn all start from this table, so it is written once.
    """
    per_order = (
        _person_orders(tables, config)
        .groupBy(PERSON, "order_id")
        .agg(
            F.count("*").alias("rows"),
            F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("last_order_date"),
            F.sum("order_units").alias("revenue_units"),
        )
    )
    return settle(
        per_order.groupBy(PERSON).agg(
            F.sum("rows").alias("order_count"),
            F.count("*").alias("distinct_orders"),
            F.min("first_order_date").alias("first_order_date"),
            F.max("last_order_date").alias("last_order_date"),
            F.sum("revenue_units").alias("revenue_units"),
        )
    )


def _history(tables: Tables, config: AnalysisConfig) -> DataFrame:
    return ordered_history(
        _person_orders(tables, config),
        person=PERSON,
        date="order_date",
        tie_break="order_id",
        amount="order_units",
        cuts=range_cuts(tables.orders, "order_id"),
    )


def customer_running_revenue(tables: Tables, config: AnalysisConfig) -> DataFrame:
    """Every order with the person's revenue up to and including it."""
    return _history(tables, config).select(
        PERSON,
        "order_id",
        "order_date",
        money(F.col("order_units")).alias("order_revenue"),
        money(F.col("cumulative_amount")).alias("cumulative_revenue"),
    )


def order_gaps(tables: Tables, config: AnalysisConfig) -> DataFrame:
    """Every order with the dates of, and days to, its neighbours in time."""
    return _history(tables, config).select(
        PERSON,
        "order_id",
        "order_date",
        F.col("previous_date").alias("previous_order_date"),
        F.col("next_date").alias("next_order_date"),
        F.datediff("order_date", "previous_date").alias("days_since_previous"),
        F.datediff("next_date", "order_date").alias("days_to_next"),
    )


def months_per_customer(tables: Tables) -> DataFrame:
    """The set of months in which a customer record has an order of any state.

    A set has at most one entry per calendar month whatever the number of
    orders, and it is combined before the shuffle: a customer with a large share
    of all orders leaves every map task as one short row.
    """
    months = F.collect_set(calendar_month(F.col("order_purchase_timestamp")))
    return (
        tables.orders.filter(has_purchase_time())
        .groupBy("customer_id")
        .agg(months.alias("months"))
    )


def customer_monthly_orders(tables: Tables) -> DataFrame:
    """Orders of any state per customer record (not person) and month."""
    return (
        tables.orders.filter(has_purchase_time())
        .groupBy(
            "customer_id",
            calendar_month(F.col("order_purchase_timestamp")).alias("order_month"),
        )
        .agg(F.count("*").alias("order_count"))
    )


def active_customer_months(tables: Tables) -> DataFrame:
    """Number of distinct (person, month) pairs with an order of any state."""
    return (
        months_per_customer(tables)
        .join(tables.customers.select("customer_id", PERSON), "customer_id")
        .select(PERSON, F.explode("months").alias("order_month"))
        .distinct()
        .agg(F.count("*").alias("active_customer_months"))
    )
