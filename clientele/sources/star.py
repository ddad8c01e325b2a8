"""The six tables as views of a sales star schema.

Customers, orders, line items, and parts stand for the base tables, so every
analysis can run on them.  Keys stay 64-bit numbers and line amounts keep four
decimals.  Order states keep their one-letter codes; see ``STAR_CONFIG``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from clientele.config import AnalysisConfig
from clientele.sources.derived import reviews_from_orders
from clientele.sources.schemas import Tables

# P plays the part of a canceled order, F that of a delivered one.
STAR_CONFIG = AnalysisConfig(excluded_statuses=("P",), delivered_status="F")

# The columns in use; the files hold more.
_COLUMNS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_orderdate timestamp_ntz",
    "part": "p_partkey bigint, p_type string",
    "lineitem": "l_orderkey bigint, l_linenumber int, l_partkey bigint, "
    "l_extendedprice double, l_discount double, l_tax double",
}

_PRICE = "CAST(l_extendedprice AS DECIMAL(12, 2))"


def star_tables(spark: SparkSession, folder: str, customers_per_person: int = 1) -> Tables:
    """Map the star schema in ``folder``.

    With ``customers_per_person`` above 1, that many consecutive customer
    records belong to one person.
    """

    def view(name: str, *columns: str):
        path = f"{folder.rstrip('/')}/{name}.parquet"
        return spark.read.schema(_COLUMNS[name]).parquet(path).selectExpr(*columns)

    orders = view(
        "orders",
        "o_orderkey AS order_id",
        "o_custkey AS customer_id",
        "o_orderstatus AS order_status",
        "o_orderdate AS order_purchase_timestamp",
        "CAST(NULL AS TIMESTAMP_NTZ) AS order_delivered_customer_date",
        "CAST(NULL AS TIMESTAMP_NTZ) AS order_estimated_delivery_date",
    )
    person = f"c_custkey DIV {customers_per_person}" if customers_per_person > 1 else "c_custkey"
    return Tables(
        customers=view(
            "customer",
            "c_custkey AS customer_id",
            f"{person} AS customer_unique_id",
            "c_nationkey AS customer_zip_code_prefix",
            "c_name AS customer_city",
            "c_mktsegment AS customer_state",
        ),
        orders=orders,
        products=view(
            "part",
            "p_partkey AS product_id",
            # One type stands for products without a category.
            "nullif(p_type, 'PROMO') AS product_category_name",
        ),
        order_items=view(
            "lineitem",
            "l_orderkey AS order_id",
            "l_linenumber AS order_item_id",
            "l_partkey AS product_id",
            f"{_PRICE} AS price",
            f"{_PRICE} * CAST(l_tax AS DECIMAL(12, 2)) AS freight_value",
        ),
        payments=view(
            "lineitem",
            "l_orderkey AS order_id",
            "l_linenumber AS payment_sequential",
            "'credit_card' AS payment_type",
            "1 AS payment_installments",
            f"{_PRICE} * (1 - CAST(l_discount AS DECIMAL(12, 2))) AS payment_value",
        ),
        reviews=reviews_from_orders(orders, STAR_CONFIG),
    )
