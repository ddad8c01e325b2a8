"""Reading and writing the six tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.sources.csv_records import csv_fields, typed_and_rejected
from clientele.sources.schemas import SCHEMAS, Tables


def read_tables(
    spark: SparkSession, folder: str, format: str = "parquet", names: dict[str, str] | None = None
) -> Tables:
    """All six tables from ``folder``, each under its own name.

    ``names`` overrides the file or folder name of a table, as in
    ``{"orders": "orders_dataset.csv"}``.  The schema is declared, never guessed.
    """
    frames = {}
    for table, schema in SCHEMAS.items():
        path = f"{folder.rstrip('/')}/{(names or {}).get(table, table)}"
        if format == "csv":
            frames[table] = read_csv(spark, path, table)
        else:
            frames[table] = spark.read.schema(schema).format(format).load(path)
    return Tables(**frames)


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A CSV file with a header; columns are matched by name and then typed.

    Published files carry further columns and their own column order, which a
    declared schema would match by position.  A malformed value is an error.
    """
    # Only free text may contain line breaks.
    if table == "reviews":
        text = csv_fields(spark, path)
    else:
        text = spark.read.option("header", True).option("escape", '"').csv(path)
    return text.select(
        *[F.col(field.name).cast(field.dataType).alias(field.name) for field in SCHEMAS[table]]
    )


def read_csv_with_rejects(spark: SparkSession, path: str, table: str) -> tuple[DataFrame, DataFrame]:
    """The good rows of a CSV file, and (file, record, cause) of those that are not.

    Nothing fails on a bad record, and none is lost: the two results hold all records.
    """
    return typed_and_rejected(csv_fields(spark, path), SCHEMAS[table])


def write_tables(tables: Tables, folder: str, format: str = "parquet") -> None:
    for name, frame in tables.named().items():
        frame.write.format(format).save(f"{folder.rstrip('/')}/{name}")


# Bucket and sort columns of the saved layout.  Orders are saved twice: with the
# child tables by order, and with the customers by customer and time.
LAYOUT: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "customers": ("customers", "customer_id", ("customer_id",)),
    "orders": ("orders", "order_id", ("order_id",)),
    "orders_by_customer": (
        "orders",
        "customer_id",
        ("customer_id", "order_purchase_timestamp"),
    ),
    "order_items": ("order_items", "order_id", ("order_id",)),
    "payments": ("payments", "order_id", ("order_id",)),
    "reviews": ("reviews", "order_id", ("order_id",)),
    "products": ("products", "product_id", ("product_id",)),
}


def save_bucketed(tables: Tables, database: str, buckets: int) -> None:
    """Save the tables so that joins on their keys need no shuffle.

    A bucket is written by one task, which keeps the files few; one that is much
    larger than the others, as with a customer who has a large share of all
    orders, is split by adaptive execution over several tasks and files.
    """
    frames = tables.named()
    for table, (source, bucket, order) in LAYOUT.items():
        (
            frames[source]
            .hint("rebalance", buckets, bucket)
            .write.bucketBy(buckets, bucket)
            .sortBy(*order)
            .mode("overwrite")
            .saveAsTable(f"{database}.{table}")
        )


def saved_tables(spark: SparkSession, database: str, by_customer: bool = False) -> Tables:
    """The saved tables; ``by_customer`` picks the order copy for cohort work."""
    frames = {name: spark.table(f"{database}.{name}") for name in SCHEMAS}
    if by_customer:
        frames["orders"] = spark.table(f"{database}.orders_by_customer")
    return Tables(**frames)


def refresh_statistics(spark: SparkSession, database: str) -> None:
    """Row counts and column statistics for the cost-based optimizer."""
    for table in LAYOUT:
        spark.sql(f"ANALYZE TABLE {database}.{table} COMPUTE STATISTICS FOR ALL COLUMNS")
