"""Equal-sized bands (NTILE, PERCENT_RANK) over a whole table.

A window without PARTITION BY sends every row to one task.  A band, however, is
fixed by a handful of cut rows: five bands have four cuts.  So the table is
range-sorted once as narrow (value, key) pairs to find the rows at the cut
ranks, and each row then gets its band by comparing it with those cuts.  The
wide rows are neither sorted nor shuffled nor joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from clientele.operators.settling import chunk_count, settle


@dataclass(frozen=True)
class Banding:
    """One band column: which numeric column to order by, and how to cut it."""

    output: str
    value: str
    bands: int
    descending: bool = False
    # True splits equal values by key (NTILE); False keeps them together and
    # cuts on the percent rank of the value.
    split_ties: bool = True

    def sort_value(self, kind: str) -> Column:
        """The value in a type shared with other bandings, ascending."""
        value = F.col(self.value).cast(kind)
        return -value if self.descending else value

    def cut_ranks(self, rows: int) -> list[int]:
        """Rank of the last row before each cut, counting from 1."""
        if self.split_ties:
            size, larger = divmod(rows, self.bands)
            ends = [j * size + min(j, larger) for j in range(1, self.bands)]
            return [end for end in ends if end < rows]
        if rows < 2:
            return []
        # Percent rank reaches j/bands once this many rows lie strictly below.
        return [-(-j * (rows - 1) // self.bands) for j in range(1, self.bands)]


def assign_bands(
    frame: DataFrame,
    key: str,
    bandings: Sequence[Banding],
    rows_per_chunk: int = 1_000_000,
) -> DataFrame:
    """Add the band columns to ``frame``; ``key`` is unique and breaks ties.

    ``frame`` is scanned more than once, so settle it first.
    """
    rows = frame.count()
    cuts = _find_cuts(frame, key, bandings, rows, rows_per_chunk)
    columns = {}
    for number, banding in enumerate(bandings):
        # Comparing in the column's own type is far cheaper than in a wide one.
        value, kind = F.col(banding.value), frame.schema[banding.value].dataType
        band = F.lit(1)
        for cut in cuts.get(number, []):
            cut_value = F.lit(-cut["value"] if banding.descending else cut["value"]).cast(kind)
            after = value < cut_value if banding.descending else value > cut_value
            if banding.split_ties:
                after = after | ((value == cut_value) & (F.col(key) > F.lit(cut["key"])))
            band = band + after.cast("int")
        columns[banding.output] = band
    return frame.withColumns(columns)


def _find_cuts(
    frame: DataFrame, key: str, bandings: Sequence[Banding], rows: int, rows_per_chunk: int
) -> dict[int, list[Row]]:
    """The rows at every cut rank, by number of the banding."""
    # All bandings share one sort: their number leads the sort key.
    kinds = [frame.schema[banding.value].dataType for banding in bandings]
    whole = all(isinstance(kind, IntegralType) for kind in kinds)
    shared_kind = "bigint" if whole else "decimal(38,12)"
    pairs = frame.select(
        F.col(key).alias("key"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(number).alias("banding"),
                        banding.sort_value(shared_kind).alias("value"),
                    )
                    for number, banding in enumerate(bandings)
                ]
            )
        ).alias("pair"),
    ).select("pair.banding", "pair.value", "key")
    # The key is unique, so no value can fill a chunk beyond its share.  The
    # written copy pins the chunks: sampling them again would move the bounds.
    count = chunk_count(rows * len(bandings), rows_per_chunk)
    chunks = settle(
        pairs.repartitionByRange(count, "banding", "value", "key").withColumn(
            "chunk", F.spark_partition_id()
        )
    )
    # At most one row per chunk plus one per banding.
    sizes = sorted(chunks.groupBy("banding", "chunk").count().collect())
    wanted: list[tuple[int, int, int]] = []
    for number, group in groupby(sizes, key=lambda size: size["banding"]):
        ranks, start = bandings[number].cut_ranks(rows), 0
        for size in group:
            end = start + size["count"]
            wanted += [(number, size["chunk"], r - start) for r in ranks if start < r <= end]
            start = end
    if not wanted:
        return {}

    place = Window.partitionBy("banding", "chunk").orderBy("value", "key")
    targets = {(n, chunk, index) for n, chunk, index in wanted}
    is_target = F.struct("banding", "chunk", "place").isin(
        [F.struct(F.lit(n), F.lit(c), F.lit(i)) for n, c, i in sorted(targets)]
    )
    found = (
        chunks.filter(F.col("chunk").isin(sorted({chunk for _, chunk, _ in targets})))
        .withColumn("place", F.row_number().over(place))
        .filter(is_target)
        .collect()
    )
    at = {(row["banding"], row["chunk"], row["place"]): row for row in found}
    cuts: dict[int, list[Row]] = {}
    for target in wanted:
        cuts.setdefault(target[0], []).append(at[target])
    return cuts
