"""Rule checks on the base tables: schema, keys, required values, ranges.

Spark enforces no keys when rows are written, so the rules are checked on the
rows.  ``violations`` counts the rows that break a rule: rows beyond the first of
a primary key, rows without their parent, rows with a missing or an
out-of-range value.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.sources.schemas import (
    FOREIGN_KEYS,
    PRIMARY_KEYS,
    SCHEMAS,
    VALUE_RANGES,
    Tables,
)


def _together(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _finding(table: str, rule: str, violations: Column) -> list[Column]:
    return [
        F.lit(table).alias("table_name"),
        F.lit(rule).alias("rule"),
        F.coalesce(violations, F.lit(0)).cast("bigint").alias("violations"),
    ]


def table_row_counts(tables: Tables) -> DataFrame:
    """Rows per table."""
    return _together(
        frame.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, frame in tables.named().items()
    )


def repeated_keys(frame: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with the number of rows."""
    return frame.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")


def orphaned_keys(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Key values of ``child`` that ``parent`` lacks, with the number of rows.

    Child rows are counted per key before the join, so a frequent key is one row
    in it; DISTINCT on the parent uses the shuffle of the join.
    """
    counted = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
    return counted.join(parent.select(key).distinct(), key, "left_anti")


def _children() -> dict[str, list[tuple[str, str]]]:
    """Parent table: its child tables and the column they share."""
    found: dict[str, list[tuple[str, str]]] = {}
    for child, key, parent in FOREIGN_KEYS:
        found.setdefault(parent, []).append((child, key))
    return found


def _key_family(frames: dict[str, DataFrame], parent: str, primary: bool) -> DataFrame:
    """Rules of one key in its table and in all tables that refer to it.

    Each of these tables is read once: their keys are put together with a count of
    one for the table they come from, and the counts are summed by key.  A frequent
    key is combined before the shuffle, and no join can be skewed by it.  A missing
    value refers to nothing, so it is no orphan.
    """
    children = _children()[parent]
    key = children[0][1]
    names = [parent, *(child for child, _ in children)]
    rows = _together(
        frames[name]
        .filter(F.lit(name == parent) | F.col(key).isNotNull())
        .select(F.col(key).alias("key"), *[F.lit(int(name == n)).cast("bigint").alias(n) for n in names])
        for name in names
    )
    per_key = rows.groupBy("key").agg(*[F.sum(name).alias(name) for name in names])
    extra = F.sum(F.greatest(F.col(parent) - 1, F.lit(0)))
    findings = [_finding(parent, f"primary key ({key})", extra)] if primary else []
    for child, _ in children:
        orphans = F.sum(F.when(F.col(parent) == 0, F.col(child)))
        findings.append(_finding(child, f"foreign key ({key}) to {parent}", orphans))
    return per_key.agg(F.array(*[F.struct(f) for f in findings]).alias("findings")).select(
        F.inline("findings")
    )


def _primary_key(frames: dict[str, DataFrame], name: str) -> DataFrame:
    key = PRIMARY_KEYS[name]
    extra = repeated_keys(frames[name], key).agg(F.sum(F.col("rows") - 1).alias("extra"))
    return extra.select(_finding(name, f"primary key ({', '.join(key)})", F.col("extra")))


def pk_violations(tables: Tables) -> DataFrame:
    frames = tables.named()
    return _together(_primary_key(frames, name) for name in PRIMARY_KEYS)


def fk_violations(tables: Tables) -> DataFrame:
    frames = tables.named()
    return _together(_key_family(frames, parent, primary=False) for parent in _children())


def key_violations(tables: Tables) -> DataFrame:
    """Primary and foreign keys together, with one scan per table and key."""
    frames, families = tables.named(), _children()
    others = [_primary_key(frames, name) for name in PRIMARY_KEYS if name not in families]
    return _together([_key_family(frames, parent, primary=True) for parent in families] + others)


def null_and_range_violations(tables: Tables) -> DataFrame:
    """All value rules of a table are counted in one scan of it."""
    frames = tables.named()
    reports = []
    for name, schema in SCHEMAS.items():
        broken = {
            f"not null ({field.name})": F.col(field.name).isNull()
            for field in schema
            if not field.nullable
        }
        for table, column, low, high in VALUE_RANGES:
            if table == name:
                # A missing value is neither in nor out of range.
                broken[f"range ({column}) {low} to {high}"] = ~F.col(column).between(low, high)
        findings = frames[name].agg(
            F.array(
                *[
                    F.struct(_finding(name, rule, F.count_if(test)))
                    for rule, test in broken.items()
                ]
            ).alias("findings")
        )
        reports.append(findings.select(F.inline("findings")))
    return _together(reports)


def check_tables(tables: Tables) -> DataFrame:
    """All row-level rules; a clean data set has 0 violations throughout."""
    return _together([key_violations(tables), null_and_range_violations(tables)])


def schema_report(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """Declared against actual columns; reads schemas only, no rows."""
    rows = []
    for table, schema in SCHEMAS.items():
        actual = frames[table].schema if table in frames else None
        types = {f.name: f.dataType.simpleString() for f in actual} if actual else {}
        for field in schema:
            expected, found = field.dataType.simpleString(), types.get(field.name)
            if actual is None:
                status = "missing table"
            elif found is None:
                status = "missing column"
            else:
                status = "ok" if found == expected else "wrong type"
            rows.append((table, field.name, expected, found, status))
    return spark.createDataFrame(
        rows, "table_name string, column_name string, expected string, found string, status string"
    )


def declared_keys(spark: SparkSession) -> DataFrame:
    """The primary and foreign keys the checks go by."""
    rows = [(t, "PRIMARY KEY", ", ".join(key), None) for t, key in PRIMARY_KEYS.items()]
    rows += [(child, "FOREIGN KEY", key, parent) for child, key, parent in FOREIGN_KEYS]
    return spark.createDataFrame(
        rows, "table_name string, constraint_type string, columns string, parent string"
    )
