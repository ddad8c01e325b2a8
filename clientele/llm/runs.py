"""Runs (maximal repetitions of words) by online dyadic square catching.

A text is read word by word.  Whenever a block of m = 2, 4, 8, ... words is complete it
becomes a catcher: it waits until the distance p at which squares of its level begin and
then compares itself with each suffix of m words, until the last distance of its level
has passed.  Any square of p words can be caught this way:

* in a run of period p, len(run) - p >= p words in a row equal the word p places later,
  and among 2m - 1 such words there is a whole block of m words that starts at a
  multiple of m;
* so level m covers 2m - 1 <= p < 4m - 1 (level 2 all p < 7, as runs have five words or
  more), and at every word exactly two catchers of a level are awake (three of level 2),
  whatever the text.

A block that equals a suffix tells the distance p; catches of neighbouring blocks at one
distance are one stretch, which the words around it extend by fewer than m places on each
side.  A stretch of p words or more is a square, and reported; as long as words go on to
match it stays one run.  Periods that are multiples of a smaller one give a run of equal
borders and are merged into that.

The steps of all words of a batch of texts are taken together, level by level, by numpy.
Suffixes of m words are told apart by a number that is mixed from the numbers of their
halves, so no pattern of a text makes different ones alike.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import mix, text_or_empty, text_slices, word_hashes, with_texts

# Shortest run, in words.
LEAST = 12
# Text whose words are worked on together.
SLICE_BYTES = 1_500_000

_LEFT = np.uint64(0x9E3779B97F4A7C15)
_RIGHT = np.uint64(0xC2B2AE3D27D4EB4F)
_TOP = np.uint64(1 << 63)


def _joined(names: np.ndarray, half: int) -> np.ndarray:
    """Numbers of all suffixes of twice as many words."""
    return mix(names[: len(names) - half] * _LEFT + (names[half:] ^ _RIGHT))


def _extend(levels: list[np.ndarray], x: np.ndarray, p: np.ndarray, half: int, back: bool) -> np.ndarray:
    """How many words before (or from) x on equal those p places later, under 2 * half."""
    done = np.zeros(len(x), np.int64)
    step, k = half, half.bit_length() - 1
    while step:
        names = levels[k]
        at = x - done - step if back else x + done
        inside = (at >= 0) & (at + p < len(names))
        low = np.where(inside, at, 0)
        equal = inside & (names[low] == names[np.where(inside, at + p, 0)])
        done += np.where(equal, step, 0)
        step, k = step // 2, k - 1
    return done


def _caught(names: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of the block, distance) wherever a catcher equals the suffix it sees."""
    count = len(names)
    blocks = names[::m]
    nearest = 1 if m == 2 else 2 * m - 1
    found_at, found_p = [], []
    # The latest catcher awake, and the one (level 2: two) before it.
    for back in range(3 if m == 2 else 2):
        first = nearest + back * m
        seen = min(len(blocks) * m, count - first)
        if seen <= 0:
            continue
        hit = np.flatnonzero(np.repeat(blocks, m)[:seen] == names[first : first + seen])
        found_at.append(hit - hit % m)
        found_p.append(first + hit % m)
    if not found_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_at), np.concatenate(found_p)


def find_runs(words: np.ndarray, first: np.ndarray, least: int = LEAST):
    """Runs of several texts: arrays (text, start, length, period), in this order.

    ``words``: numbers of all words; ``first``: where each text begins, and the end.
    Starts count from the text's first word; a run is at least ``least`` (five or more)
    words and twice its period long.
    """
    if least < 5:
        raise ValueError("runs of fewer than five words are not caught")
    sizes = np.diff(first)
    # Longest texts first: the texts of a level are then a beginning of the array.
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    texts = len(order)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    total = int(sizes.sum()) + texts
    line = np.empty(total, np.uint64)
    is_end = np.zeros(total, bool)
    is_end[begin + sizes] = True
    # A number of its own ends each text; nothing equals it.
    line[is_end] = np.arange(texts, dtype=np.uint64) | _TOP
    source = np.arange(int(sizes.sum())) + np.repeat(first[:-1][order] - (np.cumsum(sizes) - sizes), sizes)
    line[~is_end] = words[source] & ~_TOP

    levels = [line]
    starts, lengths, periods = [], [], []
    m = 2
    while True:
        # A level's smallest square has 2 * (2m - 1) words.
        fits = int(np.searchsorted(-sizes, -max(least, 4 * m - 2 if m > 2 else 2), side="right"))
        if not fits:
            break
        end = int(begin[fits - 1] + sizes[fits - 1]) + 1
        names = _joined(levels[-1][: max(0, end - m // 2 + 1)], m // 2)
        levels.append(names)
        block, p = _caught(names, m)
        if len(block):
            chain = np.lexsort((block, p))
            block, p = block[chain], p[chain]
            head = np.ones(len(block), bool)
            head[1:] = (p[1:] != p[:-1]) | (block[1:] != block[:-1] + m)
            tail = np.append(head[1:], True)
            p = p[head]
            left = block[head] - _extend(levels, block[head], p, m // 2, True)
            right = block[tail] + m
            right = right + _extend(levels, right, p, m // 2, False)
            long = (right - left >= p) & (right - left + p >= least)
            starts.append(left[long])
            lengths.append((right - left + p)[long])
            periods.append(p[long])
        m *= 2
    if not starts:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    start, length, period = (np.concatenate(x) for x in (starts, lengths, periods))
    # Of runs with equal borders the smallest period stands.
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[keep], length[keep], period[keep]
    place = np.searchsorted(begin, start, side="right") - 1
    text, start = order[place], start - begin[place]
    by = np.lexsort((period, start, text))
    return text[by], start[by], length[by], period[by]


def _collapsed(text: bytes, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run repeats, joined by one space."""
    words = text.split()
    if not len(start):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    keep = np.cumsum(change[:-1]) == 0
    return b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def _scan(least: int, digest: bool):
    """Tasks turn texts into runs; with ``digest`` hashes stand for runs and text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in text_slices(batch, SLICE_BYTES):
                column = part.column("__text")
                words, first = word_hashes(column, lower=False)
                text, *runs = find_runs(words, first, least)
                cut = np.searchsorted(text, np.arange(part.num_rows + 1))
                texts = column.cast(pa.binary()).to_pylist()
                best, listed, collapsed = [], [], []
                for i in range(part.num_rows):
                    own = slice(cut[i], cut[i + 1])
                    start, length, period = (x[own] for x in runs)
                    rest = _collapsed(texts[i], start, length, period)
                    if len(start):
                        top = np.lexsort((period, start, -length))[0]
                        best.append((int(start[top]), int(length[top]), int(period[top])))
                    else:
                        best.append((None, None, None))
                    if digest:
                        lines = "".join(
                            f"{s},{n},{p}\n"
                            for s, n, p in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)
                        )
                        listed.append(hashlib.sha256(lines.encode()).hexdigest())
                        collapsed.append(hashlib.sha256(rest).hexdigest())
                    else:
                        listed.append(
                            [
                                {"start": s, "length": n, "period": p, "found_at": s + max(2 * p, least) - 1}
                                for s, n, p in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)
                            ]
                        )
                        collapsed.append(rest.decode())
                long = pa.int64()
                one = pa.list_(pa.struct([(c, long) for c in ("start", "length", "period", "found_at")]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("__id"),
                        pa.array(np.diff(cut), long),
                        *[pa.array([b[k] for b in best], long) for k in range(3)],
                        pa.array(listed, pa.string() if digest else one),
                        pa.array(collapsed, pa.string()),
                    ],
                    ["__id", "n_runs", "start", "length", "period", "runs", "collapsed"],
                )

    return run


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST,
    digest: bool = False,
) -> DataFrame:
    """(id, n_runs, start, length, period, runs, collapsed) of every row.

    ``runs`` lists all runs as (start, length, period, found_at), by start, then period;
    found_at is the word that completes the run's first square of ``least`` words or
    more.  start, length and period are those of the longest run (ties: smallest start,
    then period), null without any.  ``collapsed`` is the text without the words that a
    run repeats, joined by one space.  With ``digest``, ``runs`` and ``collapsed`` are
    sha256 (hex) of the lines ``start,length,period`` and of the text.

    Null texts count as empty; texts without words have no runs and an empty rest; rows
    that repeat, also ids, are judged each; a null id stays null.  Other columns are not
    read.  Nothing is shuffled; a task needs memory for its longest text, in proportion to
    n log n words.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    listed = "string" if digest else "array<struct<start:long,length:long,period:long,found_at:long>>"
    schema = f"__id {kind}, n_runs long, start long, length long, period long, runs {listed}, collapsed string"
    found = with_texts(docs, text_col, id_col).mapInArrow(_scan(least, digest), schema)
    return found.withColumnRenamed("__id", id_col)


def with_periodic_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text), where each tenth text by crc32 of its id gets a periodic end.

    With h = crc32(id), g = h div 10 and n words, every word from a = g % n on is replaced:
    the words from there repeat the first p = 1 + (n - a) div (3 + g % 8) of them.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(text_or_empty(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select(
        F.col(id_col), text_or_empty(text_col).alias("__text"),
        F.when(h % 10 == 0, words).alias("__words"), F.floor(h / 10).alias("__g"),
    )
    n = F.size("__words")
    chosen = chosen.withColumn("__a", F.when(n > 0, F.col("__g") % n).cast("int"))
    chosen = chosen.withColumn(
        "__p", (1 + F.floor((n - F.col("__a")) / (3 + F.col("__g") % 8))).cast("int")
    )
    rest = n - F.col("__a")
    unit = F.slice("__words", F.col("__a") + 1, F.col("__p"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil(rest / F.col("__p")).cast("int"))), F.lit(1), rest)
    made = F.array_join(F.concat(F.slice("__words", F.lit(1), F.col("__a")), tail), " ")
    return chosen.select(id_col, F.coalesce(F.when(F.col("__a").isNotNull(), made), "__text").alias(text_col))


def run_digests(docs: DataFrame) -> DataFrame:
    """The query's columns: runs of documents, a tenth of them with periodic ends."""
    found = periodic_runs(with_periodic_tails(docs), digest=True)
    return found.select(
        "doc_id", "n_runs", "start", "length", "period",
        F.floor(1000 * F.col("length") / F.col("period")).alias("exponent_milli"),
        F.col("runs").alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"),
    )
