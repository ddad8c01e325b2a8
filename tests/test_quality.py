from helpers import make_tables

from clientele import Analytics
from clientele.plans import quality
from clientele.sources.seed import load_seed


def test_broken_rules_are_counted(spark):
    tables = make_tables(
        spark,
        [
            ("o1", "c1", "2024-01-01"),
            ("o1", "c1", "2024-01-02"),
            ("o1", "c1", "2024-01-03"),
            ("o2", "gone", None, None),
        ],
        customers=[("c1", None), (None, "u2")],
        items=[("o1", 1, "p", "1.00", "0.00"), ("o9", 1, None, "1.00", "0.00")],
        payments=[("o1", 1, "1.00"), ("o1", 2, "1.00")],
        products=[("p", None)],
        reviews=[("r1", "o1", 0), ("r2", "o1", 6), ("r3", "o2", 5), ("r4", "o8", None)],
    )
    found = {
        (r.table_name, r.rule): r.violations
        for r in Analytics(tables).check_tables().filter("violations > 0").collect()
    }
    assert found == {
        ("orders", "primary key (order_id)"): 2,
        ("orders", "foreign key (customer_id) to customers"): 1,
        ("orders", "not null (order_status)"): 1,
        ("orders", "not null (order_purchase_timestamp)"): 1,
        ("customers", "not null (customer_id)"): 1,
        ("customers", "not null (customer_unique_id)"): 1,
        ("order_items", "foreign key (order_id) to orders"): 1,
        ("order_items", "not null (product_id)"): 1,
        ("reviews", "foreign key (order_id) to orders"): 1,
        # 0 and 6; a missing score passes.
        ("reviews", "range (review_score) 1 to 5"): 2,
    }
    keys = quality.repeated_keys(tables.orders, ["order_id"]).collect()
    assert [(r.order_id, r.rows) for r in keys] == [("o1", 3)]
    lost = quality.orphaned_keys(tables.order_items, tables.orders, "order_id").collect()
    assert [(r.order_id, r.rows) for r in lost] == [("o9", 1)]


def test_schema_report(spark):
    frames = load_seed(spark).named()
    del frames["reviews"]
    frames["products"] = frames["products"].drop("product_category_name")
    frames["payments"] = frames["payments"].withColumn(
        "payment_value", frames["payments"].payment_value.cast("double")
    )
    report = quality.schema_report(spark, frames).filter("status <> 'ok'").collect()
    found = {(r.table_name, r.column_name, r.status) for r in report}
    assert {row for row in found if row[0] != "reviews"} == {
        ("products", "product_category_name", "missing column"),
        ("payments", "payment_value", "wrong type"),
    }
    assert {r.status for r in report if r.table_name == "reviews"} == {"missing table"}


def test_declared_keys(spark):
    keys = quality.declared_keys(spark).groupBy("constraint_type").count().collect()
    assert {r.constraint_type: r["count"] for r in keys} == {"PRIMARY KEY": 6, "FOREIGN KEY": 5}
