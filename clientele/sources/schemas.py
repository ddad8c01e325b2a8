"""The six base tables: columns, types, keys, and value ranges."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    DecimalType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_TEXT, _INT, _TIME, _AMOUNT = (
    StringType(),
    IntegerType(),
    TimestampNTZType(),
    DecimalType(12, 2),
)


def _table(**columns) -> StructType:
    """Columns as ``name=(type, required)``."""
    return StructType(
        [StructField(name, kind, not required) for name, (kind, required) in columns.items()]
    )


# Table and column names, types, and which columns are required.
SCHEMAS: dict[str, StructType] = {
    "customers": _table(
        customer_id=(_TEXT, True),
        customer_unique_id=(_TEXT, True),
        customer_zip_code_prefix=(_INT, False),
        customer_city=(_TEXT, False),
        customer_state=(_TEXT, False),
    ),
    "orders": _table(
        order_id=(_TEXT, True),
        customer_id=(_TEXT, True),
        order_status=(_TEXT, True),
        order_purchase_timestamp=(_TIME, True),
        order_delivered_customer_date=(_TIME, False),
        order_estimated_delivery_date=(_TIME, False),
    ),
    "products": _table(
        product_id=(_TEXT, True),
        product_category_name=(_TEXT, False),
    ),
    "order_items": _table(
        order_id=(_TEXT, True),
        order_item_id=(_INT, True),
        product_id=(_TEXT, True),
        price=(_AMOUNT, True),
        freight_value=(_AMOUNT, True),
    ),
    "payments": _table(
        order_id=(_TEXT, True),
        payment_sequential=(_INT, True),
        payment_type=(_TEXT, False),
        payment_installments=(_INT, False),
        payment_value=(_AMOUNT, True),
    ),
    "reviews": _table(
        review_id=(_TEXT, True),
        order_id=(_TEXT, True),
        review_score=(_INT, False),
        review_comment_title=(_TEXT, False),
        review_comment_message=(_TEXT, False),
    ),
}

PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "customers": ("customer_id",),
    "orders": ("order_id",),
    "products": ("product_id",),
    "order_items": ("order_id", "order_item_id"),
    "payments": ("order_id", "payment_sequential"),
    "reviews": ("review_id",),
}

# (child table, child column, parent table); the parent column has the same name.
FOREIGN_KEYS: tuple[tuple[str, str, str], ...] = (
    ("orders", "customer_id", "customers"),
    ("order_items", "order_id", "orders"),
    ("order_items", "product_id", "products"),
    ("payments", "order_id", "orders"),
    ("reviews", "order_id", "orders"),
)

# (table, column, smallest, largest)
VALUE_RANGES: tuple[tuple[str, str, int, int], ...] = (
    ("reviews", "review_score", 1, 5),
)


@dataclass(frozen=True)
class Tables:
    """The six base tables as DataFrames."""

    customers: DataFrame
    orders: DataFrame
    products: DataFrame
    order_items: DataFrame
    payments: DataFrame
    reviews: DataFrame

    def named(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def create_views(self) -> None:
        """Make the tables known to ``spark.sql`` under their names."""
        for name, frame in self.named().items():
            frame.createOrReplaceTempView(name)
