"""From documents to packed training sequences, in five stages.

Every stage takes (session, documents, data folder) and works on all that the stage
before has kept.  ``run`` writes each stage's result and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.llm.common import Scratch
from clientele.llm.exact_dedup import drop_exact_copies
from clientele.llm.mixing import take_mix
from clientele.llm.packing import pack_documents
from clientele.llm.queries import tokenizer_path
from clientele.llm.shingle_join import near_duplicates
from clientele.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below one half."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Documents without words are copies of nothing and stay, as do rows without an id.
    """
    groups = near_duplicates(docs.select("doc_id", "text"))
    copies = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix; one that it takes twice is on two rows."""
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place there."""
    return pack_documents(docs.select("doc_id", "text"), tokenizer_path)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("packing", packing),
]

# The learned, tokenizing and scheduling stages are beyond SQL; tests/llm compares the
# stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; returns the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    with scratch:
        for _, stage in STAGES[:-1]:
            docs = scratch.store(stage(spark, docs, sf_dir))
        return scratch.keep(STAGES[-1][1](spark, docs, sf_dir).select(F.col("*")))
