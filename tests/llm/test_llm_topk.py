"""Top-k search against a full sort."""

import math
import random

import pytest
from pyspark.sql import functions as F

from clientele.llm import topk
from clientele.llm.topk import exact_top_k


def by_sort(rows, k=5):
    good = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in good:
        if q % 50:
            continue
        scores = sorted(
            ((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))
        )
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def make_rows():
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(220)]
    same = [0.5, -0.25, 1.0, 0.0, 0.0, 2.0]
    rows += [(i, same) for i in range(300, 420)]  # ties of a third of all rows
    rows += [
        (450, None), (451, [None] * 6), (452, [math.nan] * 6), (453, [math.inf] + [0.0] * 5),
        (500, [0.0] * 6), (None, same), (7, rows[7][1]), (50, rows[50][1]), (600, [1.0, 2.0]), (601, [3.0, 4.0]),
        (650, [5.0] * 3), (700, [1e6] * 6), (701, [-1e6] * 6),
    ]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("portion, bins", [(8192, 1024), (3, 4)])
def test_equal_to_a_sort(spark, monkeypatch, portion, bins):
    monkeypatch.setattr(topk, "QUERY_ROWS", portion)
    monkeypatch.setattr(topk, "BINS", bins)
    monkeypatch.setattr(topk, "SCORE_ROWS", 50)
    rows = make_rows()
    if portion == 3:
        rows = [r for r in rows if r[0] is None or r[0] < 320 or r[0] > 550][:90]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, rank int")
    got = exact_top_k(table.repartition(4), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == by_sort(rows)


def test_no_rows_and_no_candidates(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_top_k(empty, F.col("vec_id") % 50 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert exact_top_k(one, F.col("vec_id") % 50 == 0).collect() == []
