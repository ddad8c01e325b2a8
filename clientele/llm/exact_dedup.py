"""Exact deduplication in three combining steps, each comparing whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import Scratch, ascii_lower, text_or_empty


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    text = ascii_lower(text_or_empty(text_col))
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("__text"), *more)
    return rows.withColumn("__sha", F.unhex(F.sha2(F.col("__text").cast("binary"), 256)))


def _winners(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """A row per different text: digest, text, largest id, number of rows.

    1. Every task combines its own rows with equal digest and text.
    2. Tasks are dealt over ``salts`` salts; each (digest, salt) group combines
       what its tasks have found.  A text that a third of all rows share is thus
       at most one row per task, spread over the salts.
    3. The winners of the salts meet by digest, at most ``salts`` rows per text.

    Grouping is by digest *and* text throughout, so no two different texts are
    ever merged, even if their digests agreed.
    """
    best = (F.max("__id").alias("__id"), F.sum("__n").alias("__n"))
    local = _keyed(docs, id_col, text_col).select(
        "*", F.lit(1).cast("long").alias("__n"), (F.spark_partition_id() % salts).alias("__salt")
    )
    salted = local.groupBy("__sha", "__salt", "__text").agg(*best)
    return salted.repartition("__sha").groupBy("__sha", "__text").agg(*best)


def _attach(docs, winners, id_col, text_col, *more) -> DataFrame:
    """Every row of ``docs`` with the winner of its text.

    Rows meet their winner by digest.  Only where two texts share one, which the
    stored winners show, is the text itself part of the key.
    """
    keyed = _keyed(docs, id_col, text_col, *more)
    names = [c for c in keyed.columns if c != "__text"]
    found = winners.withColumnsRenamed({"__id": "__keep", "__n": "__size"})
    plain = found.filter("__variants = 1").select("__sha", "__keep", "__size")
    rows = keyed.select(*names).join(plain, "__sha")
    shared = found.filter("__variants > 1").drop("__variants")
    if not shared.isEmpty():
        rows = rows.unionByName(keyed.join(shared, ["__sha", "__text"]).drop("__text"))
    return rows


def _stored_winners(scratch: Scratch, docs, id_col, text_col, salts) -> DataFrame:
    from pyspark.sql import Window

    per_digest = Window.partitionBy("__sha")
    rows = _winners(docs, id_col, text_col, salts).withColumn(
        "__variants", F.count(F.lit(1)).over(per_digest)
    )
    text = F.when(F.col("__variants") > 1, F.col("__text")).alias("__text")
    return scratch.keep(rows.select("__sha", text, "__id", "__n", "__variants"))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    The row with the largest id stays.  Rows that repeat an id and its text are
    all marked as kept, as nothing tells them apart; a null id is the smallest,
    and where all ids of a group are null, keep_id is null and all are kept.
    Other columns, whatever their names, are not read.
    """
    scratch = Scratch(docs.sparkSession)
    winners = _stored_winners(scratch, docs, id_col, text_col, salts)
    return _attach(docs, winners, id_col, text_col).select(
        F.col("__id").alias(id_col),
        F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def drop_exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16
) -> DataFrame:
    """The documents that stay, with all their columns and their text unchanged.

    Rows that repeat an id and its text are reduced to one.
    """
    scratch = Scratch(docs.sparkSession)
    winners = _stored_winners(scratch, docs, id_col, text_col, salts)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    rows = _attach(docs, winners, id_col, text_col, whole)
    stay = rows.filter(F.col("__id").eqNullSafe(F.col("__keep")))
    once = stay.dropDuplicates(["__sha", "__id"])
    return once.select(*(F.col(f"__row.`{c}`").alias(c) for c in docs.columns))
