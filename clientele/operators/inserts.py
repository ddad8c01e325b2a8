"""Insert-if-absent on a key, for append-only tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(batch: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the smallest by ``order``, then by all other columns.

    ``min`` of a struct combines before the shuffle, so a key with very many
    copies leaves each map task as a single row.
    """
    rest = [c for c in batch.columns if c not in key]
    if not rest:
        return batch.distinct()
    ranking = [*order, *[c for c in rest if c not in order]]
    # A key column may be asked for in the order; it adds nothing within a key.
    ranking = [c for c in ranking if c not in key]
    kept = batch.groupBy(*key).agg(F.min(F.struct(*ranking)).alias("kept"))
    return kept.select(*[c if c in key else f"kept.{c}" for c in batch.columns])


def insert_ignore(
    existing: DataFrame,
    batch: DataFrame,
    key: Sequence[str],
    order: Sequence[str] = (),
) -> DataFrame:
    """``existing`` plus the rows of ``batch`` whose key it does not hold yet.

    Existing rows always win; of several new rows with one key, the first stays.
    """
    return existing.unionByName(new_rows(existing, batch, key, order))


def new_rows(
    existing: DataFrame,
    batch: DataFrame,
    key: Sequence[str],
    order: Sequence[str] = (),
) -> DataFrame:
    """Only the part of ``batch`` that an append to ``existing`` should write."""
    # DISTINCT uses the shuffle of the join and collapses copies before it.
    present = existing.select(*key).distinct()
    return keep_first(batch, key, order).join(present, list(key), "left_anti")
