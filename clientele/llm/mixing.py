"""Mixing sources to target weights by a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm.common import WORD, Scratch, text_or_empty

# Words of a block, and blocks that a source has at least.
BLOCK_WORDS = 1024
LEAST_BLOCKS = 512
BUCKETS = 4096
# Fractional part of the golden ratio in 1/2**31, an odd number.
GOLDEN = 1_327_217_885


def word_count(text: str | Column = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...], share: float, most: float, scratch: Scratch
) -> DataFrame:
    """Targets of the sources; ``sizes`` has source (with null) and source_size.

    Source number i by code point, null last, has weight ``weights[i % len]``.  The
    targets share ``share`` times all sizes by weight, but none exceeds ``most``
    times its source's size; what that cuts off is shared among the others.  The
    one level at which everything is shared out is found by lifting it while some
    source is above its limit; only sums reach the driver.  The sources, a row each,
    are numbered by one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*map(F.lit, map(float, weights))),
        ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"),
    )
    limits = scratch.store(
        sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("limit"))
    )
    total = limits.agg(F.sum("source_size")).first()[0] or 0
    amount, level, capped = share * total, 0.0, -1
    while True:
        is_capped = F.col("limit") <= F.col("weight") * F.lit(level)
        row = limits.agg(
            F.count_if(is_capped).alias("n"),
            F.sum(F.when(is_capped, F.col("limit"))).alias("used"),
            F.sum(F.when(~is_capped, F.col("weight"))).alias("open"),
        ).first()
        if row.n == capped or not row.open:
            break
        capped = row.n
        level = max(level, (amount - (row.used or 0.0)) / row.open)
    target = F.least("limit", F.col("weight") * F.lit(level))
    return limits.select("source", "source_size", target.alias("target"))


def mix_schedule(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per row: id, size, source, source_size, target, taken, visits.

    Size is the number of words.  The documents of a source stand in a random
    order that depends on their ids alone; its words are cut into blocks of equal
    size (within one word), which may begin and end within documents.  Slot number
    j of the schedule is the point j * golden ratio modulo 1; the cumulative shares
    of the sources map it to a source.  The slots of a source are ranked, and rank r
    takes its block r modulo the number of its blocks, so all blocks are taken
    equally often but for one.  ``taken`` is the number of words taken, with
    repeats; ``visits`` how often the block with the first word was taken.

    A source gets as many slots as its target has blocks, rounded: surplus ranks
    are cut and missing ones appended, so its words are within one block of its
    target.  No document is taken more than ``most`` times its size.  Null text
    has size 0, a null source is a source of its own, rows that repeat an id stand
    side by side; documents without words, and sources without any, take 0.
    """
    scratch = Scratch(docs.sparkSession)
    with scratch:
        rows = scratch.store(
            docs.select(
                F.col(id_col).alias("id"),
                F.col(source_col).alias("source"),
                word_count(text_col).alias("size"),
            )
            # A null source must meet itself in joins: an array tells it from any text.
            .withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
            .withColumn("place", F.xxhash64(F.col("id"), F.lit(17)))
        )
        per_source = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
        targets = source_targets(
            per_source.select("source", "source_size"), weights, share, most, scratch
        ).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        blocks = F.greatest(
            F.ceil(F.col("source_size") / BLOCK_WORDS), F.least(F.col("source_size"), F.lit(LEAST_BLOCKS))
        ).cast("long")
        plan = targets.withColumn("blocks", blocks).withColumn(
            "slots",
            F.when(
                F.col("blocks") > 0,
                F.least(
                    F.round(F.col("target") * F.col("blocks") / F.col("source_size")),
                    F.floor(F.lit(float(most)) * F.col("blocks")),
                ),
            )
            .otherwise(0)
            .cast("long"),
        )
        order = Window.orderBy("key")
        plan = scratch.store(
            plan.withColumn("to", F.sum("slots").over(order)).withColumn(
                "from", F.col("to") - F.col("slots")
            )
        )
        length = plan.agg(F.max("to")).first()[0] or 0
        visits = _visits(docs.sparkSession, plan, length)
        spans = _spans(rows, plan)
        # Every document meets the blocks that it touches.
        touched = spans.withColumn("block", F.explode(F.sequence("first_block", "last_block")))
        begin = F.expr("block * source_size div blocks")
        end = F.expr("(block + 1) * source_size div blocks")
        overlap = F.least(F.col("start") + F.col("size"), end) - F.greatest("start", begin)
        met = touched.join(visits, ["key", "block"], "left").select(
            "row", (F.coalesce("times", F.lit(0)) * overlap).alias("taken"),
            F.when(F.col("block") == F.col("first_block"), F.coalesce("times", F.lit(0))).alias("times"),
        )
        sums = met.groupBy("row").agg(F.sum("taken").alias("taken"), F.max("times").alias("visits"))
        # A document is known by its source and start there; those without words by
        # nothing, as they take nothing.
        placed = spans.select("row", "id", "size", "key").join(sums, "row")
        none = rows.filter("size = 0").select(
            "id", "size", "key", F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("visits")
        )
        result = placed.drop("row").unionByName(none).join(
            plan.select("key", "source", "source_size", "target"), "key"
        )
        return scratch.keep(
            result.select(
                F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size",
                "target", F.col("taken").cast("long").alias("taken"), F.col("visits").cast("long").alias("visits"),
            )
        )


def _visits(spark, plan: DataFrame, length: int) -> DataFrame:
    """(key, block, times): how often the schedule takes each block.

    Slot j stands at the point (j * GOLDEN) mod 2**31 of the shares.  Slots of a
    source are ranked in the order of the schedule in two steps, within stretches
    of the schedule and over the stretches' counts, so no task ranks a whole source.
    """
    stretch = 65_536
    slots = spark.range(length).select(
        F.col("id").alias("slot"),
        F.expr(f"id div {stretch}").alias("stretch"),
        (F.pmod(F.pmod(F.col("id"), F.lit(1 << 31)) * GOLDEN, F.lit(1 << 31)) / float(1 << 31)).alias("point"),
    )
    # Shares are cut into cells, so that a point finds its source by equality.
    cells = 4096
    size = F.lit(float(max(length, 1)))
    low, high = F.col("from") / size, F.col("to") / size
    bounds = plan.filter("slots > 0").select(
        "key", low.alias("low"), high.alias("high"),
        F.explode(F.sequence(F.floor(low * cells).cast("int"), F.least(F.floor(high * cells).cast("int"), F.lit(cells - 1)))).alias("cell"),
    )
    drawn = (
        slots.withColumn("cell", F.floor(F.col("point") * cells).cast("int"))
        .join(bounds, "cell")
        .filter("point >= low and point < high")
        .select("slot", "stretch", "key")
    )
    counts = drawn.groupBy("key", "stretch").agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("key", "stretch", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    within = Window.partitionBy("key", "stretch").orderBy("slot")
    ranked = (
        drawn.select("key", "stretch", (F.row_number().over(within) - 1).alias("place"))
        .join(before, ["key", "stretch"])
        .select("key", (F.col("before") + F.col("place")).alias("rank"))
    )
    quota = plan.select("key", "slots", "blocks")
    kept = ranked.join(quota, "key").filter("rank < slots").select("key", "rank", "blocks")
    drawn_n = counts.groupBy("key").agg(F.sum("n").alias("drawn"))
    missing = (
        quota.join(drawn_n, "key", "left")
        .filter("slots > coalesce(drawn, 0)")
        .select("key", F.explode(F.expr("sequence(coalesce(drawn, 0L), slots - 1)")).alias("rank"), "blocks")
    )
    return (
        kept.unionByName(missing)
        .groupBy("key", F.expr("rank % blocks").alias("block"))
        .agg(F.count(F.lit(1)).alias("times"))
    )


def _spans(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Where each document with words starts in its source, and its blocks.

    The random order is cut into buckets by its leading bits; documents are summed
    up within a bucket, and buckets within a source.
    """
    bucket = F.expr(f"shiftrightunsigned(place, {64 - (BUCKETS.bit_length() - 1)})")
    dealt = rows.filter("size > 0").withColumn("bucket", bucket)
    sums = dealt.groupBy("key", "bucket").agg(F.sum("size").alias("n"))
    over = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("key", "bucket", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    within = Window.partitionBy("key", "bucket").orderBy("place", "id", "size")
    started = (
        dealt.withColumn(
            "inner", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
        )
        .join(before, ["key", "bucket"])
        .withColumn("start", F.col("before") + F.col("inner"))
        .join(plan.select("key", "source_size", "blocks"), "key")
    )
    # Block of word w: the last whose first word, block * source_size div blocks, is <= w.
    block = "((({w} + 1) * blocks - 1) div source_size)"
    return started.select(
        "id", "size", "key", "start", "source_size", "blocks",
        F.struct("key", "start").alias("row"),
        F.expr(block.format(w="start")).alias("first_block"),
        F.expr(block.format(w="(start + size - 1)")).alias("last_block"),
    )


def take_mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents of the mix, with their columns: each as often as the block with
    its first word is taken.

    Rows that repeat an id are taken alike.
    """
    taken = mix_schedule(docs, id_col=id_col, **options)
    times = taken.groupBy(id_col).agg(F.max("visits").alias("__visits")).filter("__visits > 0")
    times = times.withColumnRenamed(id_col, "__id")
    rows = docs.join(times, docs[id_col].eqNullSafe(F.col("__id")))
    copies = F.explode(F.sequence(F.lit(1), F.col("__visits").cast("int")))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return rows.withColumn("__copy", copies).select(*names)
