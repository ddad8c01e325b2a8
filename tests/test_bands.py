"""Distributed cuts against plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clientele.operators import Banding, assign_bands, settle


def make(spark, rows, distinct, text_keys=False, seed=0):
    rng = random.Random(seed)
    data = [
        (f"p{i:06d}" if text_keys else i, rng.randrange(distinct), rng.randrange(10 * distinct))
        for i in range(rows)
    ]
    rng.shuffle(data)
    key = "string" if text_keys else "bigint"
    return settle(spark.createDataFrame(data, f"person {key}, a int, b bigint").repartition(5))


BANDINGS = [
    Banding("up4", "a", 4),
    Banding("down5", "a", 5, descending=True),
    Banding("up7", "b", 7),
    Banding("rank5", "a", 5, split_ties=False),
    Banding("rank_down5", "b", 5, descending=True, split_ties=False),
]


def windows(frame):
    """The bands by plain windows over the whole table."""
    rows = frame.count()
    columns = {}
    for b in BANDINGS:
        order = F.desc(b.value) if b.descending else F.asc(b.value)
        if b.split_ties:
            columns[b.output] = F.ntile(b.bands).over(Window.orderBy(order, "person"))
        else:
            below = F.rank().over(Window.orderBy(order)) - 1
            band = F.call_function("div", below * b.bands, F.lit(max(rows - 1, 1)))
            columns[b.output] = F.least(band + 1, F.lit(b.bands)).cast("int")
    return frame.withColumns(columns)


@pytest.mark.parametrize(
    "rows, distinct, text_keys",
    [(0, 1, False), (1, 1, False), (3, 2, False), (6, 1, True), (997, 3, False), (1500, 40, True)],
)
def test_cuts_equal_windows(spark, rows, distinct, text_keys):
    frame = make(spark, rows, distinct, text_keys)
    names = ["person", *[b.output for b in BANDINGS]]
    by_cuts = assign_bands(frame, "person", BANDINGS, rows_per_chunk=700)
    assert sorted(windows(frame).select(names).collect()) == sorted(by_cuts.select(names).collect())


def test_cuts_over_many_chunks(spark):
    frame = make(spark, 5000, 2)
    by_cuts, plain = assign_bands(frame, "person", BANDINGS, rows_per_chunk=400), windows(frame)
    assert by_cuts.exceptAll(plain).count() == plain.exceptAll(by_cuts).count() == 0


def test_ntile_band_sizes_differ_by_at_most_one(spark):
    banded = assign_bands(make(spark, 1003, 1), "person", BANDINGS[:3])
    for banding in BANDINGS[:3]:
        sizes = [r["count"] for r in banded.groupBy(banding.output).count().collect()]
        assert len(sizes) == banding.bands
        assert max(sizes) - min(sizes) <= 1


def test_fewer_rows_than_bands(spark):
    banded = assign_bands(make(spark, 3, 1), "person", [Banding("band", "a", 5)])
    assert [r.band for r in banded.orderBy("person").collect()] == [1, 2, 3]


def test_equal_values_share_a_percent_rank_band(spark):
    banded = assign_bands(make(spark, 400, 6), "person", [BANDINGS[3]])
    bands = banded.groupBy("a").agg(F.count_distinct("rank5").alias("bands"))
    assert bands.filter("bands > 1").count() == 0
