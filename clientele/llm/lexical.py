"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds the documents in blocks of like length.  A block is a matrix of bits: a
column for each document, a row (slice) for each hash value.  A document sets four slices
for each of its terms, and four more for every doubling of a term's frequency, so the
slices of a term tell which documents may hold it, and how often at most.

A query adds the weights of its terms over their slices.  A false bit can only add, so the
sum is an upper bound of a document's score.  The documents with the highest bounds are
scored exactly, which gives a score that the k-th result reaches at least; then every
document whose bound reaches it is scored exactly.  All others are provably excluded.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm.common import (
    NOT_ALPHANUMERIC,
    Scratch,
    mix,
    text_slices,
    word_hashes,
    with_texts,
)

K = 50
# The k-th score is first sought among this many times k documents.
SEEDS = 4
# Slices of a block for each term of its largest document.  With four set for each term,
# one document in 400 seems to hold a term that it does not.
SLICES_A_TERM = 16
# A term is entered once more when it occurs 2, 4 and 8 times.
LEVELS = 4
# Documents of a block, bits of its matrix, slices of a block at most (fuller slices only
# raise the bounds of texts with more than 80,000 different terms).
BLOCK_DOCS = 2048
BLOCK_BITS = 1 << 25
MOST_SLICES = 1 << 20
# Documents and entries that wait for their block, and counted terms that wait to be sent.
WAITING_DOCS = 16_384
WAITING_ENTRIES = 2_000_000
WAITING_TERMS = 1_000_000
SLICE_BYTES = 4_000_000
# Weighted terms of the queries that are answered together.
PORTION_TERMS = 100_000
# Candidates that a task sends in one batch.
FOUND_AT_ONCE = 100_000

_LEVEL_STEP = 0xD6E8FEB86659FD93
_HALF = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)

_INDEX = "docs int, slices int, words long, keys binary, sizes binary, tops binary, bits binary, terms array<long>, counts array<long>"


def _counted(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different terms of a text, sorted, and how often each occurs."""
    terms = np.sort(terms)
    starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
    return terms[starts], np.diff(np.r_[starts, len(terms)])


def _slice_rows(terms: np.ndarray, level: int, slices: int) -> list[np.ndarray]:
    """The four slices of each term at a level of frequency."""
    one = mix(terms + np.uint64(level * _LEVEL_STEP % 2**64))
    two = mix(one + np.uint64(_LEVEL_STEP))
    n = np.uint64(slices)
    return [(h * n >> _HALF).astype(np.int64) for h in (one >> _HALF, one & _LOW, two >> _HALF, two & _LOW)]


def _blocks(waiting):
    """Index rows of the documents (key, words, terms, counts), by number of entries."""
    sized = []
    for key, n, terms, counts in waiting:
        # A level of its own for every doubling.
        entries = sum(int((counts >= 1 << level).sum()) for level in range(LEVELS))
        sized.append((entries, key, n, terms, counts))
    sized.sort(key=lambda d: d[0])
    at = 0
    while at < len(sized):
        to = at + 1
        smallest = sized[at][0]
        while to < len(sized) and to - at < BLOCK_DOCS:
            entries = sized[to][0]
            if entries > 1.5 * smallest + 16 or entries * SLICES_A_TERM * (to - at + 1) > BLOCK_BITS:
                break
            to += 1
        part = sized[at:to]
        slices = min(MOST_SLICES, max(64, part[-1][0] * SLICES_A_TERM))
        matrix = np.zeros((slices, -(-len(part) // 8) * 8), bool)
        for column, (_, _, _, terms, counts) in enumerate(part):
            for level in range(LEVELS):
                held = terms if not level else terms[counts >= 1 << level]
                if len(held):
                    for rows in _slice_rows(held, level, slices):
                        matrix[rows, column] = True
        yield {
            "docs": len(part), "slices": slices, "words": sum(d[2] for d in part),
            "keys": np.array([d[1] for d in part], np.int64).tobytes(),
            "sizes": np.array([d[2] for d in part], np.int64).tobytes(),
            "tops": np.array([d[4].max() for d in part], np.int64).tobytes(),
            "bits": np.packbits(matrix, axis=1).tobytes(), "terms": None, "counts": None,
        }
        at = to


def _term_row(parts):
    terms = np.concatenate([t for t, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(terms, kind="stable")
    terms, counts = terms[order], counts[order]
    starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
    return terms[starts], np.add.reduceat(counts, starts)


def _index(batches):
    """Tasks turn texts into blocks, and into documents per term."""
    import pyarrow as pa

    schema = pa.schema(
        [("docs", pa.int32()), ("slices", pa.int32()), ("words", pa.int64())]
        + [(c, pa.binary()) for c in ("keys", "sizes", "tops", "bits")]
        + [(c, pa.list_(pa.int64())) for c in ("terms", "counts")]
    )

    def row(values):
        return pa.RecordBatch.from_pylist([values], schema)

    def terms_row(parts):
        terms, counts = _term_row(parts)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(1, f.type) for f in schema][:-2]
            + [pa.ListArray.from_arrays([0, len(x)], pa.array(x.view(np.int64))) for x in (terms, counts.astype(np.int64))],
            schema=schema,
        )

    waiting, entries, seen, seen_terms = [], 0, [], 0
    for batch in batches:
        for part in text_slices(batch, SLICE_BYTES):
            hashes, first = word_hashes(part.column("__text"), NOT_ALPHANUMERIC)
            distinct = []
            for key, begin, end in zip(part.column("__key").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                if begin == end:
                    continue
                terms, counts = _counted(hashes[begin:end])
                waiting.append((key, end - begin, terms, counts))
                entries += len(terms)
                distinct.append(terms)
            if distinct:
                seen.append(_counted(np.concatenate(distinct)))
                seen_terms += len(seen[-1][0])
            if seen_terms > WAITING_TERMS:
                seen = [_term_row(seen)]
                seen_terms = len(seen[0][0])
                if seen_terms > WAITING_TERMS // 2:
                    yield terms_row(seen)
                    seen, seen_terms = [], 0
            if len(waiting) >= WAITING_DOCS or entries >= WAITING_ENTRIES:
                for block in _blocks(waiting):
                    yield row(block)
                waiting, entries = [], 0
    for block in _blocks(waiting):
        yield row(block)
    if seen:
        yield terms_row(seen)


def _item_terms(batches):
    import pyarrow as pa

    for batch in batches:
        hashes, first = word_hashes(batch.column("__text"), NOT_ALPHANUMERIC)
        item = batch.column("__id").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(first))))
        yield pa.RecordBatch.from_arrays([item, pa.array(hashes.view(np.int64))], ["__id", "term"])


class Portion:
    """Weighted terms of some queries: for each query sorted terms and their weights."""

    def __init__(self, rows):
        self.terms, place = np.unique(np.array([r.term for r in rows], np.int64).view(np.uint64), return_inverse=True)
        number = np.array([r.query for r in rows], np.int64)
        weight = np.array([r.weight for r in rows], np.int64)
        order = np.lexsort((place, number))
        place, weight = place[order], weight[order]
        self.queries, starts = np.unique(number[order], return_index=True)
        cuts = starts.tolist()[1:]
        self.places, self.weights = np.split(place, cuts), np.split(weight, cuts)
        self.place_of = {int(q): i for i, q in enumerate(self.queries)}


def _factors(sizes: np.ndarray, tops: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term of weight 1 adds at most, by level of its slices and document."""
    length = 50 + (50 * sizes * n) // total
    above = np.zeros(len(sizes), np.int64)
    added = []
    for level in range(LEVELS):
        most = tops if level == LEVELS - 1 else np.minimum(tops, (2 << level) - 1)
        reach = (1_000_000_000 * most) // (1000 * most + 20 * length)
        added.append(reach - above)
        above = reach
    return np.array(added)


def block_bounds(block: dict, portion: Portion, n: int, total: int):
    """(number of the query in the portion, upper bounds of the block's documents)."""
    docs, slices = block["docs"], block["slices"]
    bits = np.frombuffer(block["bits"], np.uint8).reshape(slices, -1)
    sizes, tops = (np.frombuffer(block[c], np.int64) for c in ("sizes", "tops"))
    factors = _factors(sizes, tops, n, total)
    levels = []
    for level in range(LEVELS):
        if level and not factors[level].any():
            continue
        held = reduce(np.bitwise_and, (bits[rows] for rows in _slice_rows(portion.terms, level, slices)))
        some = held.any(axis=1)
        levels.append((held[some], np.where(some, np.cumsum(some) - 1, -1), factors[level]))
    for q, (places, weights) in enumerate(zip(portion.places, portion.weights, strict=True)):
        bound = np.zeros(docs, np.int64)
        for held, row_of, factor in levels:
            rows = row_of[places]
            use = rows >= 0
            if use.any():
                columns = np.unpackbits(held[rows[use]], axis=1, count=docs)
                # Sums of whole numbers below 2**53 are exact.
                bound += (weights[use].astype(np.float64) @ columns).astype(np.int64) * factor
        yield q, bound


def _rows_of(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _highest_bounds(portion: Portion, n: int, total: int, k: int):
    """Of each query the k highest bounds of a task."""

    def run(batches):
        import pyarrow as pa

        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in portion.queries]
        least = np.zeros(len(portion.queries), np.int64)
        for block in _rows_of(batches):
            keys = np.frombuffer(block["keys"], np.int64)
            for q, bound in block_bounds(block, portion, n, total):
                over = np.flatnonzero(bound > least[q])
                if len(over):
                    bounds, held = np.r_[best[q][0], bound[over]], np.r_[best[q][1], keys[over]]
                    if len(bounds) > k:
                        top = np.argpartition(-bounds, k - 1)[:k]
                        bounds, held = bounds[top], held[top]
                        least[q] = bounds.min()
                    best[q] = bounds, held
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(portion.queries, [len(b) for b, _ in best])),
                pa.array(np.concatenate([h for _, h in best]) if best else np.zeros(0, np.int64)),
                pa.array(np.concatenate([b for b, _ in best]) if best else np.zeros(0, np.int64)),
            ],
            ["query", "key", "bound"],
        )

    return run


def _not_excluded(portion: Portion, n: int, total: int, least: dict[int, int]):
    """All documents whose bound reaches what the k-th result reaches at least."""
    floors = [max(1, least.get(int(q), 0)) for q in portion.queries]

    def run(batches):
        import pyarrow as pa

        for block in _rows_of(batches):
            keys = np.frombuffer(block["keys"], np.int64)
            query, key, found = [], [], 0
            for q, bound in block_bounds(block, portion, n, total):
                over = np.flatnonzero(bound >= floors[q])
                query.append(np.full(len(over), portion.queries[q]))
                key.append(keys[over])
                found += len(over)
                if found > FOUND_AT_ONCE or q == len(floors) - 1:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(query)), pa.array(np.concatenate(key))], ["query", "key"]
                    )
                    query, key, found = [], [], 0

    return run


def _exact_scores(portion: Portion, n: int, total: int):
    """Scores of whole texts for the queries they are candidates of."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in text_slices(batch, SLICE_BYTES):
                hashes, first = word_hashes(part.column("__text"), NOT_ALPHANUMERIC)
                wanted = part.column("queries")
                row, query, score = [], [], []
                for i in range(part.num_rows):
                    own = hashes[first[i] : first[i + 1]]
                    if not len(own):
                        continue
                    terms, counts = _counted(own)
                    at = np.minimum(np.searchsorted(portion.terms, terms), len(portion.terms) - 1)
                    known = portion.terms[at] == terms
                    at, tf = at[known], counts[known]
                    length = 50 + (50 * len(own) * n) // total
                    worth = np.zeros(len(portion.terms), np.int64)
                    worth[at] = (1_000_000_000 * tf) // (1000 * tf + 20 * length)
                    for q in wanted[i].as_py():
                        j = portion.place_of[q]
                        row.append(i)
                        query.append(q)
                        score.append(int((portion.weights[j] * worth[portion.places[j]]).sum()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(query, pa.int64()),
                        part.column("__id").take(pa.array(row, pa.int64())),
                        pa.array(score, pa.int64()),
                    ],
                    ["query", "__id", "score"],
                )

    return run


def _best(scores: DataFrame, k: int, *order) -> DataFrame:
    place = Window.partitionBy("query").orderBy(*order)
    return scores.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(item, rank, id, score) of the k best documents for every item.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.
    Of N documents with terms, L terms in all, a term that df of them hold weighs
    floor(1000 ln((2N + 2) / (2 df + 1))), and one that occurs tf times among a document's n
    terms adds its weight times (10**9 tf) div (1000 tf + 20 (50 + (50 n N) div L)).

    Null texts are empty; a document without terms is not counted and no result.  Scores
    of 0 are no results.  Ties go to the smaller id, a null id last.  Rows that repeat are
    documents of their own.  An item on several rows, or a null item, is one query with
    all their terms; an item without known terms has no results.  Other columns are not
    read.  Terms are told apart by 64-bit numbers.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_col].dataType.simpleString()
    texts = with_texts(docs, text_col, id_col).withColumn("__key", F.xxhash64("__id", "__text"))
    scratch = Scratch(spark)
    with scratch:
        index = scratch.store(texts.select("__key", "__text").mapInArrow(_index, _INDEX))
        blocks = index.filter("docs is not null").select("docs", "slices", "keys", "sizes", "tops", "bits")
        size = index.agg(F.sum("docs").alias("n"), F.sum("words").alias("total")).first()
        n, total = size.n or 0, size.total or 0
        asked = with_texts(items, item_text_col, item_col).mapInArrow(
            _item_terms, f"__id {item_kind}, term long"
        )
        asked = scratch.store(asked.distinct())
        held = index.filter("terms is not null").select(F.inline(F.arrays_zip("terms", "counts")))
        held = (
            held.withColumnsRenamed({"terms": "term", "counts": "df"})
            .join(asked.select("term").distinct(), "term", "left_semi")
            .groupBy("term")
            .agg(F.sum("df").alias("df"))
        )
        weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long")
        # A number for each item: hashes could clash, ids may be null or of any type.
        numbers = scratch.store(
            asked.select("__id").distinct().withColumn("query", F.monotonically_increasing_id())
        )
        same = F.col("a.__id").eqNullSafe(F.col("i.__id"))
        weighted = scratch.store(
            asked.alias("a").join(held, "term").join(numbers.alias("i"), same)
            .select("query", "term", weight.alias("weight")).filter("weight > 0")
        )
        portions = math.ceil(weighted.count() / PORTION_TERMS)
        portion_of = F.pmod(F.xxhash64("query"), F.lit(max(1, portions)))
        for p in range(portions):
            portion = Portion(weighted.filter(portion_of == p).collect())
            if not len(portion.queries):
                continue

            def scored(candidates: DataFrame, portion: Portion = portion) -> DataFrame:
                # At most as many queries as the portion has.
                wanted = candidates.groupBy(F.col("key").alias("__key")).agg(F.collect_set("query").alias("queries"))
                return (
                    texts.join(wanted, "__key")
                    .select("__id", "__text", "queries")
                    .mapInArrow(_exact_scores(portion, n, total), f"query long, __id {kind}, score long")
                    .filter("score > 0")
                )

            highest = blocks.mapInArrow(
                _highest_bounds(portion, n, total, SEEDS * k), "query long, key long, bound long"
            )
            seeds = scored(_best(highest, SEEDS * k, F.desc("bound"), "key"))
            reached = _best(seeds, k, F.desc("score")).groupBy("query").agg(
                F.count(F.lit(1)).alias("found"), F.min("score").alias("score")
            )
            least = {r.query: r.score for r in reached.filter(F.col("found") == k).collect()}
            left = blocks.mapInArrow(_not_excluded(portion, n, total, least), "query long, key long")
            scratch.append(_best(scored(left), k, F.desc("score"), F.asc_nulls_last("__id")))
        kept = scratch.kept(f"query long, __id {kind}, score long, rank int")
        named = kept.join(numbers.withColumnRenamed("__id", "__item"), "query").select(
            F.col("__item").alias(item_col), "rank", F.col("__id").alias(id_col), "score"
        )
        return Scratch(spark).keep(named)
