import random
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from clientele.functions import (
    cents,
    money,
    money_units,
    rounded_ratio,
    row_ratio,
    whole_division,
)


def exact(n, d, places):
    if not d:
        return None
    with localcontext() as context:
        context.prec = 80
        return (Decimal(n) / Decimal(d)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)


@pytest.mark.parametrize("places", [0, 1, 2, 4])
def test_rounded_ratio(spark, places):
    rng = random.Random(places)
    pairs = [(1, 8), (-1, 8), (1, -8), (-1, -8), (5, 1000), (-5, 1000), (1005, 1000), (7, 0)]
    pairs += [(0, 5), (0, -5)]
    pairs += [(rng.randint(-(10**20), 10**20), rng.randint(-(10**9), 10**9)) for _ in range(500)]
    # Ties, on both sides of zero.
    pairs += [((2 * k + 1) * s, 2 * 10**places) for k in range(50) for s in (1, -1)]
    frame = spark.createDataFrame(
        [(i, Decimal(n), Decimal(d)) for i, (n, d) in enumerate(pairs)],
        "i int, n decimal(38,0), d decimal(38,0)",
    )
    rows = frame.select("i", rounded_ratio(F.col("n"), F.col("d"), places).alias("r")).collect()
    for row in rows:
        assert row.r == exact(*pairs[row.i], places), pairs[row.i]


def test_whole_division_beyond_64_bits(spark):
    frame = spark.createDataFrame(
        [(Decimal(10**30 + 7), Decimal(8))], "a decimal(38,0), b decimal(38,0)"
    )
    quotient = frame.select(whole_division(F.col("a"), F.col("b"))).first()[0]
    assert int(quotient) == (10**30 + 7) // 8


@pytest.mark.parametrize("digits", [8, 11, 16])
@pytest.mark.parametrize("places", [1, 2, 4])
def test_row_ratio(spark, places, digits):
    rng = random.Random(places)
    limit, most = 10**digits - 1, 10 ** (38 - places - digits) - 1
    pairs = [(1, 8), (-1, 8), (0, 5), (most, limit), (-most, limit), (most, 1), (-most, 7)]
    pairs += [(rng.randint(-most, most), rng.randint(1, limit)) for _ in range(300)]
    pairs += [(rng.randint(-(10**6), 10**6), rng.randint(1, 10**4)) for _ in range(300)]
    # Ties and their closest neighbours, for small and for the largest divisors.
    for d in (2 * 10**places, 10 ** (places + 2), limit - limit % (2 * 10**places)):
        for k in range(20):
            tie = (2 * k + 1) * d // (2 * 10**places)
            pairs += [(s * (tie + e), d) for s in (1, -1) for e in (-1, 0, 1)]
    frame = spark.createDataFrame(
        [(i, Decimal(n), Decimal(d)) for i, (n, d) in enumerate(pairs)],
        "i int, n decimal(38,0), d decimal(38,0)",
    )
    ratio = row_ratio(F.col("n"), F.col("d"), places, digits)
    for row in frame.select("i", ratio.alias("r")).collect():
        assert row.r == exact(*pairs[row.i], places), pairs[row.i]


def test_row_ratio_refuses_what_it_cannot_round(spark):
    for n, d in ((10**20, 1), (1, 10**16)):
        frame = spark.createDataFrame(
            [(Decimal(n), Decimal(d))], "n decimal(38,0), d decimal(38,0)"
        )
        with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
            frame.select(row_ratio(F.col("n"), F.col("d"), 2)).collect()


def test_money_units(spark):
    frame = spark.createDataFrame([(Decimal("-12.3450"),), (None,)], "a decimal(12,4)")
    units = frame.select(money_units(F.col("a")).alias("u"))
    assert [r.u for r in units.collect()] == [-123450, None]
    shown = units.select(money(F.col("u")), cents(F.col("u"))).collect()
    assert [tuple(r) for r in shown] == [(Decimal("-12.345"), Decimal("-12.35")), (None, None)]


def test_too_large_a_sum_is_an_error(spark):
    frame = spark.createDataFrame([(Decimal(9 * 10**14),)] * 2, "a decimal(24,4)")
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        frame.select(F.sum(money_units(F.col("a")))).collect()
