"""Amounts beyond 64 bits, sentinel dates, whole output, and tables that go away."""

from decimal import Decimal
from pathlib import Path

from pyspark.sql import functions as F

from clientele import Analytics
from clientele.__main__ import print_rows
from clientele.functions import wide_sum
from clientele.operators import settling
from helpers import by_key, make_tables

PRICE = 9_000_000_000


def rich_tables(spark, rows=200_000):
    """Items whose revenue does not fit 64 bits of ten-thousandths."""
    tables = make_tables(
        spark,
        orders=[("o1", "c1", "2024-01-05T10:00:00"), ("o2", "c1", "2024-02-05T10:00:00")],
        items=[("o2", 1, "p2", "10.00", "0.00")],
        products=[("p1", "toys"), ("p2", "books")],
    )
    many = spark.range(rows).select(
        F.lit("o1").alias("order_id"),
        F.col("id").cast("int").alias("order_item_id"),
        F.lit("p1").alias("product_id"),
        F.lit(PRICE).cast("decimal(12,2)").alias("price"),
        F.lit(0).cast("decimal(12,2)").alias("freight_value"),
    )
    items = tables.order_items
    many = many.select(*[F.col(c).cast(items.schema[c].dataType).alias(c) for c in items.columns])
    return type(tables)(**(tables.named() | {"order_items": items.unionByName(many)}))


def test_growth_beyond_64_bits(spark):
    shop = Analytics(rich_tables(spark))
    total = Decimal(PRICE) * 200_000
    for report in (shop.growth_rollup(), shop.growth_cube()):
        rows = {(r.revenue_month, r.product_category): r for r in report.collect()}
        assert rows[(None, None)].revenue == total + 10
        assert rows[(None, "toys")].revenue == total
    months = {r.performance_flag: r for r in shop.month_extremes().collect()}
    assert months["Best Revenue Month"].revenue == total
    assert months["Lowest Revenue Month"].mom_growth_pct == Decimal("-100.00")
    best = by_key(shop.category_extremes(), "performance_flag", "revenue")
    assert best == {"Best Revenue Category": total, "Lowest Revenue Category": Decimal(10)}


def test_wide_sum_of_both_signs(spark):
    values = [2**63 - 1, 2**63 - 1, -(2**63), -5, 7, None, 2**20, -(2**20) - 1]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    assert int(rows.agg(wide_sum(F.col("v"))).first()[0]) == sum(v for v in values if v is not None)
    assert rows.filter("v is null").agg(wide_sum(F.col("v"))).first()[0] is None


def test_value_with_sentinel_dates(spark):
    orders = [
        ("o1", "c1", "0001-01-01T00:00:00"), ("o2", "c1", "9999-12-31T00:00:00"),
        ("o3", "c2", "2024-01-01T00:00:00"),
    ]
    payments = [("o1", 1, "100.00"), ("o2", 1, "50.00"), ("o3", 1, "70.00")]
    shop = Analytics(make_tables(spark, orders=orders, payments=payments))
    value = by_key(shop.customer_clv(), "customer_unique_id", "projected_12_month_clv")
    span = 3_652_058
    months = Decimal(span) / Decimal("30.4375") + 1
    assert value["c1"] == (150 + 12 * (150 / months)).quantize(Decimal("0.01"))
    assert value["c2"] == 70 * 13
    path = shop.clv_projection_path().collect()
    assert len(path) == 26
    assert sum(r.customer_count for r in shop.clv_tier_summary().collect()) == 2


def test_shell_prints_all_rows(spark, capsys):
    print_rows("numbers", spark.range(120).select("id", F.lit(None).alias("empty")))
    lines = capsys.readouterr().out.splitlines()
    assert lines[:3] == ["# numbers", "id\tempty", "0\t"] and len(lines) == 122
    print_rows("numbers", spark.range(120), 5)
    assert len(capsys.readouterr().out.splitlines()) == 7


def test_nothing_is_left_after_the_context(spark, monkeypatch):
    monkeypatch.setattr(settling, "_written", [])
    tables = make_tables(
        spark,
        orders=[(f"o{i}", f"c{i % 7}", f"2024-0{1 + i % 6}-05T10:00:00") for i in range(40)],
        payments=[(f"o{i}", 1, "10.00") for i in range(40)],
    )
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "false")
    try:
        with Analytics(tables) as shop:
            assert spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "true"
            for report in ("customer_clv", "rfm_customers", "churn_flags", "customer_running_revenue", "month_extremes"):
                getattr(shop, report)().collect()
            folders = [Path(p.removeprefix("file:")) for p in settling._written]
            assert folders and all(f.exists() for f in folders)
        assert not settling._written and not any(f.exists() for f in folders)
        assert spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "false"
    finally:
        spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
