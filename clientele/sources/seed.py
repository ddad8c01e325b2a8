"""A small deterministic data set for smoke tests."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from clientele.config import AnalysisConfig
from clientele.operators.inserts import insert_ignore
from clientele.sources.derived import payments_from_items, reviews_from_orders
from clientele.sources.schemas import PRIMARY_KEYS, SCHEMAS, Tables

# The rows of the sample data set, columns in the order of the schemas.
CUSTOMERS = [
    ("c001", "u001", None, "sao paulo", "SP"),
    ("c002", "u002", None, "rio de janeiro", "RJ"),
    ("c003", "u003", None, "curitiba", "PR"),
    ("c004", "u004", None, "salvador", "BA"),
    ("c005", "u005", None, "belo horizonte", "MG"),
    ("c006", "u006", None, "recife", "PE"),
    ("c007", "u007", None, "fortaleza", "CE"),
    ("c008", "u008", None, "campinas", "SP"),
]
PRODUCTS = [
    ("p001", "electronics"),
    ("p002", "bed_bath_table"),
    ("p003", "sports_leisure"),
    ("p004", "health_beauty"),
    ("p005", "toys"),
]
ORDERS = [
    ("o001", "c001", "delivered", datetime(2024, 1, 10, 9, 0), None, None),
    ("o002", "c001", "delivered", datetime(2024, 2, 12, 10, 0), None, None),
    ("o003", "c001", "delivered", datetime(2024, 4, 20, 11, 0), None, None),
    ("o004", "c002", "delivered", datetime(2024, 1, 15, 12, 0), None, None),
    ("o005", "c002", "delivered", datetime(2024, 3, 18, 13, 0), None, None),
    ("o006", "c003", "delivered", datetime(2024, 2, 5, 14, 0), None, None),
    ("o007", "c003", "delivered", datetime(2024, 2, 25, 15, 0), None, None),
    ("o008", "c003", "delivered", datetime(2024, 5, 2, 16, 0), None, None),
    ("o009", "c004", "delivered", datetime(2024, 3, 11, 9, 30), None, None),
    ("o010", "c005", "delivered", datetime(2024, 3, 19, 10, 30), None, None),
    ("o011", "c005", "delivered", datetime(2024, 4, 22, 11, 30), None, None),
    ("o012", "c006", "delivered", datetime(2024, 4, 3, 12, 30), None, None),
    ("o013", "c007", "delivered", datetime(2024, 4, 10, 13, 30), None, None),
    ("o014", "c008", "delivered", datetime(2024, 5, 9, 14, 30), None, None),
    ("o015", "c008", "canceled", datetime(2024, 5, 20, 15, 30), None, None),
]
ORDER_ITEMS = [
    ("o001", 1, "p001", Decimal("100.00"), Decimal("10.00")),
    ("o002", 1, "p002", Decimal("80.00"), Decimal("8.00")),
    ("o003", 1, "p003", Decimal("150.00"), Decimal("15.00")),
    ("o004", 1, "p004", Decimal("50.00"), Decimal("7.00")),
    ("o005", 1, "p001", Decimal("120.00"), Decimal("12.00")),
    ("o006", 1, "p005", Decimal("40.00"), Decimal("6.00")),
    ("o007", 1, "p003", Decimal("90.00"), Decimal("9.00")),
    ("o008", 1, "p001", Decimal("200.00"), Decimal("18.00")),
    ("o009", 1, "p002", Decimal("75.00"), Decimal("8.00")),
    ("o010", 1, "p004", Decimal("60.00"), Decimal("7.00")),
    ("o011", 1, "p004", Decimal("110.00"), Decimal("10.00")),
    ("o012", 1, "p005", Decimal("45.00"), Decimal("6.00")),
    ("o013", 1, "p003", Decimal("70.00"), Decimal("8.00")),
    ("o014", 1, "p001", Decimal("130.00"), Decimal("12.00")),
    ("o015", 1, "p002", Decimal("90.00"), Decimal("9.00")),
]


def seed_rows() -> dict[str, list[tuple]]:
    return {
        "customers": CUSTOMERS,
        "products": PRODUCTS,
        "orders": ORDERS,
        "order_items": ORDER_ITEMS,
    }


def empty_tables(spark: SparkSession) -> Tables:
    return Tables(**{name: spark.createDataFrame([], s) for name, s in SCHEMAS.items()})


def load_seed(spark: SparkSession, into: Tables | None = None) -> Tables:
    """Insert the sample rows into ``into`` (default: empty tables).

    Rows whose key is already present are left as they are, so loading twice
    changes nothing.
    """
    tables = (into or empty_tables(spark)).named()

    def insert(name: str, batch: DataFrame) -> None:
        batch = batch.select(
            *[batch[field.name].cast(field.dataType).alias(field.name) for field in SCHEMAS[name]]
        )
        tables[name] = insert_ignore(tables[name], batch, PRIMARY_KEYS[name])

    for name, rows in seed_rows().items():
        insert(name, spark.createDataFrame(rows, SCHEMAS[name]))
    insert("payments", payments_from_items(tables["order_items"]))
    insert("reviews", reviews_from_orders(tables["orders"], AnalysisConfig()))
    return Tables(**tables)
