"""One key holding a third of all rows: same results, and the key is split."""

import random
import re
from collections import Counter
from dataclasses import replace

import pytest
from helpers import make_tables
from pyspark.sql import Window
from pyspark.sql import functions as F

from clientele import AnalysisConfig, Analytics
from clientele.operators import chunk_count, ordered_history, range_cuts
from clientele.operators.sequences import CHUNKS, chunk_of
from clientele.plans import growth, orders
from clientele.plans.measure import plan_text


@pytest.fixture(scope="module")
def skewed(spark):
    """9,000 orders; a third by one customer, and a third of items of one order."""
    rng = random.Random(5)
    placed, items, payments = [], [], []
    for i in range(9000):
        customer = "hot" if i % 3 == 0 else f"c{rng.randrange(900):03d}"
        day = f"2023-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
        state = "canceled" if rng.random() < 0.1 else "delivered"
        placed.append((f"o{i:05d}", customer, day, state if i else "delivered"))
        order = "o00000" if i % 3 == 0 else f"o{i:05d}"
        product = f"p{min(rng.randrange(12), 7)}"
        amount = f"{rng.randint(100, 90000) / 100:.2f}"
        items.append((order, i, product, amount, "1.00"))
        payments.append((order, i, amount))
    products = [(f"p{i}", f"category {i % 3}") for i in range(7)]
    return make_tables(spark, placed, items=items, payments=payments, products=products)


@pytest.fixture
def small_skew_limits(spark):
    """Adaptive execution takes partitions of some kilobytes for skewed."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "5KB",
    }
    before = {key: spark.conf.get(key, None) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def rows_and_skew_joins(frame):
    rows = sorted(frame.collect())
    return rows, len(re.findall(r"skew=true", plan_text(frame).split("Initial Plan")[0]))


CONFIG = AnalysisConfig()


def spread(tables):
    """The same tables, written by several tasks as on a cluster."""
    return replace(
        tables, **{name: frame.repartition(6) for name, frame in tables.named().items()}
    )


@pytest.mark.parametrize(
    "query, expected",
    [
        (lambda t: orders.customer_orders(t, CONFIG), 1),
        (lambda t: growth.monthly_category_revenue(t, CONFIG), 2),
    ],
    ids=["hot customer", "hot product and hot order"],
)
def test_join_on_a_hot_key_is_split(spark, skewed, small_skew_limits, query, expected):
    tables = spread(skewed)
    rows, splits = rows_and_skew_joins(query(tables))
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        plain, none = rows_and_skew_joins(query(tables))
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    assert rows == plain
    assert splits == expected and none == 0


def test_summary_of_a_hot_customer_equals_its_orders(spark, skewed):
    counts = Counter(
        r.customer_unique_id for r in orders.customer_orders(skewed, CONFIG).collect()
    )
    summary = orders.customer_summary(skewed, CONFIG).collect()
    assert {r.customer_unique_id: r.order_count for r in summary} == counts


def test_a_hot_person_is_spread_over_days(spark, skewed):
    """Rows are ordered within a person's day; over days there is a row per day."""
    tables = spread(skewed)
    plan = plan_text(Analytics(tables).customer_running_revenue())
    keys = re.findall(r"Arguments: hashpartitioning\(([^)]*), \d+\)", plan)
    assert any("customer_unique_id" in k and "order_date" in k for k in keys)
    history = Analytics(tables).order_gaps().collect()
    assert len(history) == Analytics(tables).customer_orders().count()


def test_history_equals_plain_windows(spark):
    rng = random.Random(9)
    data = [
        (rng.choice(["a", "a", "a", "b", "c"]), i, rng.randrange(40), rng.randrange(-9, 100))
        for i in range(3000)
    ]
    rows = spark.createDataFrame(data, "person string, id int, day int, amount int").select(
        "person",
        "id",
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).alias("date"),
        F.col("amount").cast("decimal(12,2)").alias("amount"),
    )
    cuts = range_cuts(rows, "id", chunks=7, sample=100)
    found = ordered_history(rows, "person", "date", "id", "amount", cuts)
    sequence = Window.partitionBy("person").orderBy("date", "id")
    plain = rows.select(
        "*",
        F.sum("amount").over(sequence.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative_amount"),
        F.lag("date").over(sequence).alias("previous_date"),
        F.lead("date").over(sequence).alias("next_date"),
    )
    names = plain.columns
    assert sorted(map(str, found.select(names).collect())) == sorted(map(str, plain.collect()))


def test_a_hot_day_of_a_person_is_ordered_in_chunks(spark):
    """Half of all rows on one day of one person: no group to order holds more than a chunk."""
    day = F.to_date(F.lit("2024-01-01"))
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("person"),
        F.concat(F.lit("o"), F.xxhash64("id").cast("string")).alias("order"),
        F.when(F.col("id") % 2 == 0, day).otherwise(F.date_add(day, (F.col("id") % 9).cast("int"))).alias("date"),
        (F.col("id") % 10).cast("decimal(12,2)").alias("amount"),
    )
    cuts = range_cuts(rows, "order")
    assert len(cuts) == CHUNKS - 1
    groups = rows.groupBy("person", "date", chunk_of(F.col("order"), cuts).alias("chunk")).count()
    assert groups.agg(F.max("count")).first()[0] < 2 * 10_000 / CHUNKS
    found = ordered_history(rows, "person", "date", "order", "amount", cuts)
    keys = re.findall(r"Arguments: hashpartitioning\(([^)]*), \d+\)", plan_text(found))
    assert any("__chunk" in k and "date" in k for k in keys)
    hot = found.filter("person = 'hot'").orderBy("order").collect()
    total, previous = 0, None
    for i, r in enumerate(hot):
        total += r.amount
        assert (r.cumulative_amount, r.previous_date) == (total, previous)
        assert (r.next_date is None) == (i == len(hot) - 1)
        previous = r.date


def test_cuts_of_few_or_no_keys(spark):
    none = spark.createDataFrame([], "k string")
    assert range_cuts(none, "k") == []
    few = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "k string")
    cuts = range_cuts(few, "k", chunks=2)
    assert [r[0] for r in few.select(chunk_of(F.col("k"), cuts)).collect()] == [1, 0, 1, 1]


def test_results_do_not_depend_on_partitioning(spark, skewed):
    def results():
        analytics = Analytics(spread(skewed))
        return [
            sorted(map(str, getattr(analytics, report)().collect()))
            for report in ("customer_clv", "rfm_customers", "churn_by_segment", "growth_rollup")
        ]

    first = results()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert results() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_chunks_do_not_depend_on_the_session():
    assert [chunk_count(n) for n in (0, 1, 10**6, 10**6 + 1)] == [1, 1, 1, 2]
    assert chunk_count(10**12) == 10**6
