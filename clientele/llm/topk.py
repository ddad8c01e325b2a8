"""Exact top-k search by inner product: score histograms locate each k-th value."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm.common import Scratch

# Queries that the driver holds at once, and candidate rows scored at once.
QUERY_ROWS = 8192
SCORE_ROWS = 2048
BINS = 1024


def integer_components(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component x, as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )


def _scored(batches, queries: np.ndarray, query_ids: np.ndarray):
    """Per slice of candidates: ids, scores by (query, candidate), own ones masked."""
    width = queries.shape[1]
    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        vectors = batch.column("vector")
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
        values = vectors.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(lengths) - lengths
        same = np.flatnonzero(lengths == width)
        for at in range(0, len(same), SCORE_ROWS):
            rows = same[at : at + SCORE_ROWS]
            matrix = values[starts[rows][:, None] + np.arange(width)]
            exact = np.abs(matrix).max(initial=0) * np.abs(queries).sum(1).max(initial=0) < 2**53
            if exact:
                scores = (queries @ matrix.T).astype(np.int64)
            else:
                scores = queries.astype(np.int64) @ matrix.T.astype(np.int64)
            yield ids[rows], scores, query_ids[:, None] == ids[rows][None, :]


_LOWEST = np.iinfo(np.int64).min


def _histograms(queries, query_ids, low, width, k):
    """Counts per query and bin of each task's k best scores.

    Whatever is among the k best of all is among the k best of its task, so these
    are all scores that can be the k-th.
    """

    def run(batches):
        import pyarrow as pa

        best = np.full((len(queries), k), _LOWEST)
        for _, scores, own in _scored(batches, queries, query_ids):
            scores[own] = _LOWEST
            best = np.partition(np.concatenate([best, scores], axis=1), -k, axis=1)[:, -k:]
        place = (best - low[:, None]) // width[:, None]
        # Scores beyond the range of a later round are counted as its top bin.
        valid = (best != _LOWEST) & (place >= 0)
        place = np.minimum(place, BINS)
        query, _ = np.nonzero(valid)
        pairs, counts = np.unique(np.stack([query, place[valid]]), axis=1, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pairs[0]), pa.array(pairs[1]), pa.array(counts.astype(np.int64))],
            ["query", "bin", "n"],
        )

    return run


def _winners(queries, query_ids, least, k):
    """Each task's k best candidates that reach the k-th score, ties to smaller ids."""

    def run(batches):
        import pyarrow as pa

        held_score = np.full((len(queries), 0), 0, np.int64)
        held_id = held_score.copy()
        for ids, scores, own in _scored(batches, queries, query_ids):
            scores[own] = _LOWEST
            held_score = np.concatenate([held_score, scores], axis=1)
            held_id = np.concatenate([held_id, np.broadcast_to(ids, scores.shape)], axis=1)
            if held_score.shape[1] > k:
                order = np.lexsort((held_id, ~held_score), axis=1)[:, :k]
                held_score = np.take_along_axis(held_score, order, 1)
                held_id = np.take_along_axis(held_id, order, 1)
        query, place = np.nonzero((held_score != _LOWEST) & (held_score >= least[:, None]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(held_id[query, place]), pa.array(held_score[query, place])],
            ["query", "vec_id", "score"],
        )

    return run


def _search(vectors: DataFrame, queries, query_ids, most: float, k: int) -> DataFrame:
    """The k best candidates of a bounded number of queries of one length."""
    spark = vectors.sparkSession
    bound = np.abs(queries).sum(1) * most + 1
    low = -bound.astype(np.int64)
    width = np.maximum(1, -(-2 * bound.astype(np.int64) // BINS))
    by_query = Window.partitionBy("query").orderBy(F.desc("bin"))
    while True:
        counted = vectors.mapInArrow(
            _histograms(queries, query_ids, low, width, k), "query long, bin long, n long"
        )
        total = counted.groupBy("query", "bin").agg(F.sum("n").alias("n"))
        reached = total.withColumn("above", F.sum("n").over(by_query)).filter(F.col("above") >= k)
        # A row per query of this portion: the bin that holds the k-th score.
        found = reached.groupBy("query").agg(F.max("bin").alias("bin")).toPandas()
        at = np.full(len(queries), 0, np.int64)
        at[found["query"].to_numpy()] = found["bin"].to_numpy()
        low = low + np.minimum(at, BINS - 1) * width
        if (width == 1).all():
            break
        width = np.maximum(1, -(-width // BINS))
    # Too few candidates: all of them are taken.
    low[np.setdiff1d(np.arange(len(queries)), found["query"].to_numpy())] = _LOWEST
    hits = vectors.mapInArrow(
        _winners(queries, query_ids, low, k), "query long, vec_id long, score long"
    )
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    names = spark.createDataFrame(pd.DataFrame({"query": range(len(queries)), "query_id": query_ids}))
    top = hits.withColumn("rank", place).filter(F.col("rank") <= k)
    return top.join(names, "query").select("query_id", "rank", "vec_id", "score")


SCHEMA = "query_id long, rank int, vec_id long, score long"


def exact_top_k(
    table: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query row.

    The score is the inner product of the components floor(256 * x).  Candidates are
    all rows but those with the query's id; ties go to smaller ids, rows that repeat
    an id are candidates of their own, and a repeated query row is answered again.
    Vectors that are null, or hold null or non-finite components, and rows without
    an id take no part; vectors of different lengths are not compared.

    Queries pass in portions of QUERY_ROWS, against which every task scores its
    candidates.  A first round counts scores in BINS bins over the range that the
    components allow; each further round cuts the bin with the k-th score into BINS
    finer ones, until a bin is a single score.  Then every task hands over its
    candidates that reach it.
    """
    # Names of other columns, whatever they are, do not matter from here on.
    vectors = table.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("raw"), is_query.alias("asks")
    ).filter(F.col("id").isNotNull() & _usable(F.col("raw")))
    vectors = vectors.select("id", integer_components(F.col("raw")).alias("vector"), "asks")
    candidates = vectors.select("id", "vector")
    most = vectors.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0] or 0.0
    scratch = Scratch(table.sparkSession)
    waiting: dict[int, list] = {}

    def answer(rows):
        ids = np.array([r.id for r in rows], np.int64)
        matrix = np.array([r.vector for r in rows], float).reshape(len(rows), -1)
        scratch.append(_search(candidates, matrix, ids, most, k))

    for row in vectors.filter("asks").select("id", "vector").toLocalIterator():
        rows = waiting.setdefault(len(row.vector), [])
        rows.append(row)
        if len(rows) == QUERY_ROWS:
            answer(waiting.pop(len(row.vector)))
    for rows in waiting.values():
        answer(rows)
    from pyspark.sql.types import StructType

    return scratch.kept(StructType.fromDDL(SCHEMA))
