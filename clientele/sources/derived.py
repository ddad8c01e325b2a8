"""Tables that a sample load derives from others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.config import AnalysisConfig
from clientele.operators.inserts import keep_first


def payments_from_items(items: DataFrame) -> DataFrame:
    """One card payment per order, worth the first item with its freight.

    Payments are keyed by order and sequence number, and all derived rows have
    number 1: of an order with several items only the first row is inserted.
    """
    rows = items.select(
        "order_id",
        F.lit(1).alias("payment_sequential"),
        F.lit("credit_card").alias("payment_type"),
        F.lit(1).alias("payment_installments"),
        (F.col("price") + F.col("freight_value")).alias("payment_value"),
        "order_item_id",
    )
    return keep_first(rows, ["order_id", "payment_sequential"], ["order_item_id"]).drop(
        "order_item_id"
    )


def reviews_from_orders(orders: DataFrame, config: AnalysisConfig) -> DataFrame:
    """A five-point review without text for every delivered order."""
    return orders.filter(F.col("order_status") == config.delivered_status).select(
        F.concat(F.lit("r"), F.col("order_id").cast("string")).alias("review_id"),
        "order_id",
        F.lit(5).alias("review_score"),
        F.lit(None).cast("string").alias("review_comment_title"),
        F.lit(None).cast("string").alias("review_comment_message"),
    )
