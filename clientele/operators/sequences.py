"""Per-person sequences (running sum, previous and next row) without hot tasks.

A window partitioned by person puts each person into one task, and one person, or one
person's day, may own a large share of all rows.  So the sequence is scanned at two
levels.  Cuts through the keys that order the rows of a day divide every day into
chunks, and rows are put in order within a person's day and chunk only; a chunk is a
fixed share of all keys, so no person's day can fill a task.  One row per person, day
and chunk then carries totals and neighbouring dates on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Chunks of all keys, and the keys that the cuts between them are chosen from.
CHUNKS = 64
SAMPLE = 8192


def range_cuts(keys: DataFrame, key: str, chunks: int = CHUNKS, sample: int = SAMPLE) -> list:
    """Cuts that divide the values of ``key`` into about equal chunks.

    They come from ``sample`` values, chosen by their hash; that many rows of one column
    reach the driver, whatever the size of ``keys``.
    """
    known = keys.select(key).filter(F.col(key).isNotNull())
    chosen = sorted(row[0] for row in known.orderBy(F.xxhash64(key), key).limit(sample).collect())
    places = {len(chosen) * i // chunks for i in range(1, chunks)} if chosen else set()
    return sorted({chosen[place] for place in places})


def chunk_of(key: Column, cuts: list) -> Column:
    """The number of cuts up to and including a key, by bisection."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < F.lit(cuts[middle]), between(low, middle)).otherwise(between(middle + 1, high))

    return between(0, len(cuts))


def ordered_history(
    rows: DataFrame, person: str, date: str, tie_break: str, amount: str, cuts: list
) -> DataFrame:
    """Add cumulative_amount, previous_date and next_date to every row.

    The sequence of a person runs by ``date``, which is never NULL, and then by
    ``tie_break``; together they are unique per person.  ``cuts`` are those of
    ``range_cuts`` for the values of ``tie_break``; the result does not depend on them.
    """
    rows = rows.withColumn("__chunk", chunk_of(F.col(tie_break), cuts))
    group = [person, date, "__chunk"]
    chunks = rows.groupBy(*group).agg(F.sum(amount).alias("total"), F.count("*").alias("rows_of_chunk"))
    by_chunk = Window.partitionBy(person).orderBy(date, "__chunk")
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(
        *group,
        "rows_of_chunk",
        F.sum("total").over(before).alias("amount_before"),
        F.lag(date).over(by_chunk).alias("date_before"),
        F.lead(date).over(by_chunk).alias("date_after"),
    )
    in_chunk = Window.partitionBy(*group).orderBy(tie_break)
    inside = F.sum(amount).over(in_chunk.rowsBetween(Window.unboundedPreceding, 0))
    place, last = F.row_number().over(in_chunk), F.col("rows_of_chunk")
    whole = inside + F.coalesce("amount_before", F.lit(0))
    kind = rows.select(F.sum(amount).alias("total")).schema["total"].dataType
    columns = [column for column in rows.columns if column != "__chunk"]
    return rows.join(carried, group).select(
        *columns,
        whole.cast(kind).alias("cumulative_amount"),
        F.when(place > 1, F.col(date)).otherwise(F.col("date_before")).alias("previous_date"),
        F.when(place < last, F.col(date)).otherwise(F.col("date_after")).alias("next_date"),
    )
