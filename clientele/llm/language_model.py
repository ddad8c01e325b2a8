"""Hashed maximum-entropy language model with a class-factored softmax."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import Scratch, mix, text_bytes, text_or_empty, word_hashes, word_spans

# Classes: the most frequent words, one each, then endings of all other words.
TOP_WORDS = 32
ENDINGS = 64
CLASSES = TOP_WORDS + ENDINGS
# Hash values of each of the three features: word before, word before that, both.
BUCKETS = 4096
FEATURES = 3
# Weight of each feature's evidence before training, and gradient rounds.
START = (0.6, 0.2, 0.4)
ROUNDS = 2
STEP = 0.4
SMOOTHING = 20.0
# Hash values of the word before and of the word itself, for the choice within a class.
BEFORE = 512
SLOTS = 64
# Its gradient rounds, which need no pass over the texts, their step, and the prior's weight.
WORD_ROUNDS = 12
WORD_STEP = 0.6
RIDGE = 2.0
# Marks words without training tokens, beside their context.
UNKNOWN = np.uint16(0x8000)
BLOCK_TOKENS = 2_000_000
SLICE_BYTES = 8_000_000
TASK_TOKENS = 4_000_000
# Contexts whose probabilities are held at once.
FORWARD_TOKENS = 4_096
RANGE_BYTES = 48_000_000
END = np.uint64(0x5851F42D4C957F2D)


def _tokens(column):
    """Word numbers and endings of a batch with an end after every row; row lengths."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_spans(data, offsets)
    hashes, _ = word_hashes(column)
    last = data[ends - 1].astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0) if len(ends) else last
    endings = ((last | 32) * 131 + (before | 32) * 31) % ENDINGS
    lengths = np.diff(first)
    place = np.arange(len(hashes)) + np.repeat(np.arange(len(lengths)), lengths)
    out = np.full(len(hashes) + len(lengths), END)
    kind = np.zeros(len(out), np.uint8)
    out[place] = hashes
    kind[place] = endings
    return out, kind, lengths + 1


def _context(hashes: np.ndarray) -> np.ndarray:
    """Hash value of a word as a context; 0 is the beginning of a text."""
    return (1 + mix(hashes) % np.uint64(BUCKETS - 1)).astype(np.uint16)


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


_BLOCKS = (
    "range int, block long, ids array<bigint>, held binary, lengths binary, words binary, "
    "vocabulary binary, endings binary, counts binary"
)


def _to_blocks(ranges: int):
    """Texts as numbers of a vocabulary of their block; its words go to their ranges."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["range", "block", "ids", "held", "lengths", "words", "vocabulary", "endings", "counts"]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64())] + [pa.binary()] * 6
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        base, count = TaskContext.get().partitionId() << 32, 0
        ids, held, parts, tokens = [], [], [], 0

        def flush(block):
            hashes, endings, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
            learn = np.repeat(~np.array(held, bool), lengths)
            values, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            # Frequent words get small numbers, which are stored in less space.
            order = np.argsort(-np.bincount(inverse), kind="stable")
            number = np.empty(len(order), np.uint32)
            number[order] = np.arange(len(order))
            counts = np.bincount(inverse[learn], minlength=len(values))
            yield dict(zip(names, (
                -1, block, ids, np.array(held, np.uint8).tobytes(), lengths.astype(np.int64).tobytes(),
                number[inverse].tobytes(), values[order].tobytes(), endings[first][order].tobytes(), None,
            ), strict=True))
            owner = _range_of(values, ranges)
            cuts = np.r_[0, np.flatnonzero(owner[1:] != owner[:-1]) + 1, len(owner)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                yield dict(zip(names, (
                    int(owner[s]), block, None, None, None, None, values[s:e].tobytes(),
                    endings[first[s:e]].tobytes(), counts[s:e].astype(np.uint32).tobytes(),
                ), strict=True))

        for batch in batches:
            sizes = np.cumsum(np.diff(text_bytes(batch.column("text"))[1]))
            at = 0
            while at < batch.num_rows:
                done = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, side="right")))
                part = batch.slice(at, to - at)
                at = to
                parts.append(_tokens(part.column("text")))
                ids += part.column("id").to_pylist()
                held += part.column("held").to_pylist()
                tokens += len(parts[-1][0])
                if tokens >= BLOCK_TOKENS:
                    yield pa.RecordBatch.from_pylist(list(flush(base + count)), schema)
                    ids, held, parts, tokens, count = [], [], [], 0, count + 1
        if ids:
            yield pa.RecordBatch.from_pylist(list(flush(base + count)), schema)

    return run


def _count_words(rows: pd.DataFrame) -> pd.DataFrame:
    """Corpus counts of a range's words, for each block that has them, and sums.

    The row with block -1 holds the range's tokens and distinct words by ending, its
    distinct words by ending and slot, and its most frequent words.
    """
    values = [np.frombuffer(v, np.uint64) for v in rows["vocabulary"]]
    counts = np.concatenate([np.frombuffer(c, np.uint32) for c in rows["counts"]]).astype(np.int64)
    endings = np.concatenate([np.frombuffer(e, np.uint8) for e in rows["endings"]])
    words, first, inverse = np.unique(np.concatenate(values), return_index=True, return_inverse=True)
    total = np.zeros(len(words), np.int64)
    np.add.at(total, inverse, counts)
    cuts = np.cumsum([len(v) for v in values])[:-1]
    per_block = [x.tobytes() for x in np.split(total[inverse], cuts)]
    top = np.argsort(-total, kind="stable")[:TOP_WORDS]
    by_ending = endings[first]
    sums = np.stack(
        [np.bincount(by_ending, total, ENDINGS), np.bincount(by_ending, total > 0, ENDINGS)]
    ).astype(np.int64)
    known = total > 0
    cells = np.bincount(_cell(by_ending[known], _context(words[known])), minlength=ENDINGS * SLOTS)
    out = pd.DataFrame({"block": rows["block"], "range": rows["range"], "counts": per_block})
    out["top"], out["cells"] = None, None
    head = np.stack([words[top].view(np.int64), total[top], by_ending[top].astype(np.int64)])
    return pd.concat(
        [
            out,
            pd.DataFrame(
                [(-1, int(rows["range"].iloc[0]), sums.tobytes(), head.tobytes(), cells.astype(np.int64).tobytes())],
                columns=out.columns,
            ),
        ]
    )


def _cell(endings: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Number of an ending and the slot of a word in it."""
    return endings.astype(np.int64) * SLOTS + contexts % SLOTS


def _add_cells(frames):
    """Sums of many ranges' cells, a row per task."""
    total = np.zeros(ENDINGS * SLOTS, np.int64)
    for frame in frames:
        for cells in frame["cells"]:
            total += np.frombuffer(cells, np.int64)
    yield pd.DataFrame({"cells": [total.tobytes()]})


class Vocabulary:
    """What holds for all words: counts of tokens and words, classes."""

    def __init__(self, summaries: list, cells: list):
        sums = np.zeros((2, ENDINGS), np.int64)
        heads = []
        for row in summaries:
            sums += np.frombuffer(row.counts, np.int64).reshape(2, ENDINGS)
            heads.append(np.frombuffer(row.top, np.int64).reshape(3, -1))
        self.tokens, self.distinct = (int(x) for x in sums.sum(1))
        heads = np.concatenate(heads, axis=1) if heads else np.zeros((3, 0), np.int64)
        heads = heads[:, heads[1] > 0]
        best = heads[:, np.lexsort((heads[0], -heads[1]))[:TOP_WORDS]]
        # Distinct words by ending and slot, without those that are classes of their own.
        self.cell_words = sum((np.frombuffer(row.cells, np.int64) for row in cells), np.zeros(ENDINGS * SLOTS, np.int64))
        np.subtract.at(self.cell_words, _cell(best[2], _context(best[0].view(np.uint64))), 1)
        order = np.argsort(best[0].view(np.uint64))
        self.top = best[0].view(np.uint64)[order]
        self.top_class = order.astype(np.int64)

    def classes(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        out = TOP_WORDS + endings.astype(np.int64)
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, hashes), len(self.top) - 1)
            is_top = self.top[at] == hashes
            out[is_top] = self.top_class[at[is_top]]
        return out

    def log_weight(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of a word's weight in the softmax of its class, whatever stands before it.

        Counts plus one are the weights that fit without a context; an unknown word has 1.
        """
        return np.where(classes < TOP_WORDS, 0.0, np.log10(counts + 1))


_DOCS = (
    "ids array<bigint>, held binary, lengths binary, known binary, base binary, within binary, "
    "classes binary, contexts binary"
)


def _resolve(vocabulary: Vocabulary):
    """Classes, contexts and unigram scores of a block, from the counts of its words."""

    def run(blocks: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        out = []
        per_word = np.concatenate(
            [np.frombuffer(c, np.int64) for c in counts.sort_values("range")["counts"]]
        )
        for row in blocks.itertuples():
            hashes = np.frombuffer(row.vocabulary, np.uint64)
            seen = np.empty(len(hashes), np.int64)
            seen[np.argsort(hashes)] = per_word
            kind = vocabulary.classes(hashes, np.frombuffer(row.endings, np.uint8))
            whole = vocabulary.tokens + vocabulary.distinct + 1
            base = np.log10((seen + 1) / whole)
            within = vocabulary.log_weight(kind, seen)
            context = _context(hashes) | np.where(seen > 0, np.uint16(0), UNKNOWN)
            words = np.frombuffer(row.words, np.uint32)
            lengths = np.frombuffer(row.lengths, np.int64)
            starts = np.cumsum(lengths) - lengths
            sums = [np.add.reduceat(x[words], starts).astype(float).tobytes() for x in (seen > 0, base, within)]
            out.append((
                row.ids, row.held, row.lengths, *sums,
                kind.astype(np.uint8)[words].tobytes(), context[words].tobytes(),
            ))
        columns = ["ids", "held", "lengths", "known", "base", "within", "classes", "contexts"]
        return pd.DataFrame(out, columns=columns)

    return run


def _features(contexts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashed features of every token, by kind; 0 stands before a text begins."""
    one = np.r_[np.uint16(0), contexts[:-1]].astype(np.int64)
    two = np.r_[np.zeros(2, np.uint16), contexts[:-2]][: len(contexts)].astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    one[starts] = 0
    two[starts] = 0
    second = starts[lengths > 1] + 1
    two[second] = 0
    both = (one * 40_503 + two * 30_011 + 7) % BUCKETS
    return np.stack([one, two, both])


def _portions(row):
    """Classes, features, slots and training marks of a block, a bounded number of tokens at once."""
    lengths = np.frombuffer(row.lengths, np.int64)
    classes = np.frombuffer(row.classes, np.uint8).astype(np.int64)
    contexts = np.frombuffer(row.contexts, np.uint16)
    slots = np.where(contexts & UNKNOWN, SLOTS, contexts % SLOTS)
    found = _features(contexts & ~UNKNOWN, lengths)
    learn = np.repeat(np.frombuffer(row.held, np.uint8) == 0, lengths)
    for at in range(0, len(classes), BLOCK_TOKENS):
        to = at + BLOCK_TOKENS
        yield classes[at:to], found[:, at:to], slots[at:to], learn[at:to]


def _choices(classes: np.ndarray, found: np.ndarray, slots: np.ndarray):
    """Tokens whose class has several words, and the weights that choose among these."""
    at = np.flatnonzero(classes >= TOP_WORDS)
    row = found[0][at] % BEFORE * ENDINGS + classes[at] - TOP_WORDS
    return at, row * (SLOTS + 1) + slots[at]


def _contexts(found: np.ndarray):
    """Different contexts, ordered by the word before: features, and who has them.

    The third feature follows from the other two, so tokens that agree in those share
    one softmax.  Yields, for FORWARD_TOKENS contexts at once, their features, how many
    tokens have each, and the places of these tokens, context by context.
    """
    key = (found[0] * BUCKETS + found[1]).astype(np.uint32)
    order = np.argsort(key, kind="stable")
    key = key[order]
    borders = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)] if len(key) else [0]
    for at in range(0, len(borders) - 1, FORWARD_TOKENS):
        part = borders[at : at + FORWARD_TOKENS + 1]
        yield found[:, order[part[:-1]]], np.diff(part), order[part[0] : part[-1]]


def _observed(frames):
    """How often each feature meets each class, and each word before each word, in training texts."""
    total = np.zeros((FEATURES, BUCKETS * CLASSES))
    words = np.zeros(WORD_WEIGHTS, np.int64)
    for frame in frames:
        for row in frame.itertuples():
            for classes, found, slots, learn in _portions(row):
                words += np.bincount(_choices(classes[learn], found[:, learn], slots[learn])[1], minlength=WORD_WEIGHTS)
                for k in range(FEATURES):
                    at = found[k][learn] * CLASSES + classes[learn]
                    total[k] += np.bincount(at, minlength=BUCKETS * CLASSES)
    yield from _send(total.reshape(FEATURES, BUCKETS, CLASSES))
    yield from _send_words(words)


def _logits(weights: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Scores of all classes, the best one 0; the bias is in the first feature's weights."""
    z = weights[0].take(found[0], axis=0)
    for k in range(1, FEATURES):
        z += weights[k].take(found[k], axis=0)
    z -= z.max(1, keepdims=True)
    return z


def log_probabilities(weights: np.ndarray, found: np.ndarray) -> np.ndarray:
    """log P(class | features) of every context."""
    z = _logits(weights, found)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def probabilities(weights: np.ndarray, found: np.ndarray, times: np.ndarray) -> np.ndarray:
    """P(class | features), times how many tokens have the context."""
    z = _logits(weights, found)
    np.exp(z, out=z)
    z *= (times / z.sum(1)).astype(z.dtype)[:, None]
    return z


def _add_rows(total: np.ndarray, owners: np.ndarray, rows: np.ndarray) -> None:
    """total[owner] += row, for rows that are sorted by their owner.

    The first rows of all owners are added at once, then their second rows, and so
    on; what long runs have left is summed run by run.
    """
    starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
    lengths = np.diff(np.r_[starts, len(owners)])
    ids = owners[starts]
    for done in range(8):
        total[ids] += rows[starts + done]
        longer = lengths > done + 1
        starts, lengths, ids = starts[longer], lengths[longer], ids[longer]
    for i, start, length in zip(ids.tolist(), starts.tolist(), lengths.tolist(), strict=True):
        total[i] += rows[start + 8 : start + length].sum(0)


def _expected(model):
    """Sums of P(class) and of P(class)(1 - P(class)) by feature: the gradient's other half."""

    def run(frames):
        weights = model.value
        total = np.zeros((FEATURES, BUCKETS, CLASSES))
        for frame in frames:
            for row in frame.itertuples():
                for _, found, _, learn in _portions(row):
                    # A portion's sums are short enough for 32 bits.
                    first = np.zeros((FEATURES, BUCKETS, CLASSES), np.float32)
                    for kinds, times, _ in _contexts(found[:, learn]):
                        p = probabilities(weights, kinds, times)
                        _add_rows(first[0], kinds[0], p)
                        for k in range(1, FEATURES):
                            order = np.argsort(kinds[k], kind="stable")
                            _add_rows(first[k], kinds[k][order], p[order])
                    total += first
        yield from _send(total)

    return run


_CHUNK = 256
# Words before x endings x slots, the last one for an unknown word.
WORD_WEIGHTS = BEFORE * ENDINGS * (SLOTS + 1)
_WORD_CHUNK = WORD_WEIGHTS // 16


def _send(total: np.ndarray):
    """Sums of a task as rows, a stretch of feature values each."""
    out = [
        (k, at, total[k, at : at + _CHUNK].astype(np.float32).tobytes())
        for k in range(FEATURES)
        for at in range(0, BUCKETS, _CHUNK)
    ]
    yield pd.DataFrame(out, columns=["kind", "at", "sums"])


def _send_words(total: np.ndarray):
    """Counts of a task that are not 0, with their places, as rows of a stretch of places each."""
    out = []
    for at in range(0, WORD_WEIGHTS, _WORD_CHUNK):
        part = total[at : at + _WORD_CHUNK]
        places = np.flatnonzero(part)
        out.append((FEATURES, at, np.stack([places, part[places]]).astype(np.uint32).tobytes()))
    yield pd.DataFrame(out, columns=["kind", "at", "sums"])


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    first = rows.iloc[0]
    if first.kind == FEATURES:
        total = np.zeros(_WORD_CHUNK)
        for sums in rows["sums"]:
            places, counts = np.frombuffer(sums, np.uint32).reshape(2, -1)
            total[places] += counts
        return pd.DataFrame([(first.kind, first["at"], total.tobytes())], columns=rows.columns)
    total = np.zeros(_CHUNK * CLASSES)
    for sums in rows["sums"]:
        total += np.frombuffer(sums, np.float32)
    return pd.DataFrame([(first.kind, first["at"], total.tobytes())], columns=rows.columns)


def _summed(rows: DataFrame, task) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all tasks by feature and class, and by words; their size is that of the model."""
    kind = "kind int, at int, sums binary"
    parts = rows.mapInPandas(task, kind).groupBy("kind", "at").applyInPandas(_add, kind).collect()
    out = np.zeros((FEATURES, BUCKETS, CLASSES))
    words = np.zeros(WORD_WEIGHTS)
    for part in parts:
        sums = np.frombuffer(part.sums)
        if part.kind == FEATURES:
            words[part["at"] : part["at"] + _WORD_CHUNK] = sums
        else:
            out[part.kind, part["at"] : part["at"] + _CHUNK] = sums.reshape(_CHUNK, CLASSES)
    return out, words


def _with_bias(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    whole = weights.astype(np.float32)
    whole[0] += bias.astype(np.float32)
    return whole


def train_words(observed: np.ndarray, cell_words: np.ndarray) -> np.ndarray:
    """What the context adds to the log of a word's weight, less the log of its class's sum.

    P(word | class, word before) is a softmax over all words of the class and an unknown
    one.  Its features are the word, whose weight is its count plus one, and the word
    before with the word, hashed: words of a slot share a weight, so a sum over slots is
    the sum over all words.  The gradient (observed less expected, less the prior's pull)
    needs only how often each word before meets each slot.
    """
    observed = observed.reshape(BEFORE, ENDINGS, SLOTS + 1)
    mass = np.ones((ENDINGS, SLOTS + 1))
    mass[:, :SLOTS] = observed.sum(0)[:, :SLOTS] + cell_words.reshape(ENDINGS, SLOTS)
    with np.errstate(divide="ignore"):
        base = np.log(mass)
    seen = observed.sum(2, keepdims=True)
    weights = np.zeros(observed.shape)
    for step in range(WORD_ROUNDS + 1):
        z = weights + base
        top = z.max(2, keepdims=True)
        whole = top + np.log(np.exp(z - top).sum(2, keepdims=True))
        if step == WORD_ROUNDS:
            return (weights - whole).astype(np.float32).ravel()
        share = np.exp(z - whole)
        expected = seen * share
        curve = expected * np.maximum(1 - share, 0.05) + RIDGE
        # The unknown word has no feature with the word before.
        move = WORD_STEP * np.clip((observed - expected - RIDGE * weights) / curve, -2, 2)
        weights[:, :, :SLOTS] += move[:, :, :SLOTS]


def train(rows: DataFrame, cell_words: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x buckets x classes) and those of words, from all training texts.

    Every token has one value of the first feature, whose weights hold the bias.

    Observed counts of features and classes give the start; then each round sums the
    expected counts of all tasks, and every weight takes a step along its gradient
    (observed less expected), scaled by its curvature.
    """
    observed, words = _summed(rows, _observed)
    of_words = train_words(words, cell_words)
    per_class = observed[0].sum(0) + 0.5
    prior = per_class / per_class.sum()
    bias = np.log(prior)
    seen = observed.sum(2, keepdims=True)
    likely = np.log((observed + SMOOTHING * prior) / (seen + SMOOTHING)) - bias
    weights = likely * np.array(START)[:, None, None]
    context = rows.sparkSession.sparkContext
    for _ in range(rounds):
        model = context.broadcast(_with_bias(weights, bias))
        expected, _ = _summed(rows, _expected(model))
        share = expected / np.maximum(seen, 1)
        curve = expected * np.maximum(1 - share, 0.05) + SMOOTHING
        weights = weights + STEP * np.clip((observed - expected) / curve, -2, 2)
        model.destroy()
    return _with_bias(weights, bias), of_words


_SCORES = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(model):
    def run(frames):
        weights, of_words = model.value
        for frame in frames:
            for row in frame.itertuples():
                parts = []
                for classes, found, slots, _ in _portions(row):
                    values = np.empty(len(classes))
                    for kinds, times, places in _contexts(found):
                        logp = log_probabilities(weights, kinds)
                        values[places] = logp[np.repeat(np.arange(len(times)), times), classes[places]]
                    several, choice = _choices(classes, found, slots)
                    values[several] += of_words[choice]
                    parts.append(values)
                lengths = np.frombuffer(row.lengths, np.int64)
                chosen = np.add.reduceat(np.concatenate(parts), np.cumsum(lengths) - lengths)
                yield pd.DataFrame(
                    {
                        "id": pd.array(list(row.ids), "Int64"),
                        "held_out": np.frombuffer(row.held, np.uint8) > 0,
                        "n_tokens": lengths,
                        "n_known": np.frombuffer(row.known).astype(np.int64),
                        "base_score": np.frombuffer(row.base),
                        "score": chosen / math.log(10) + np.frombuffer(row.within),
                    }
                )

    return run


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are the words (A-Z lower-cased) and one end.  The base is the add-one
    unigram model of all texts that are not held out.  The score is the model's log10
    probability: P(class | the two words before) * P(word | class, the word before),
    where a class is one of the most frequent words or an ending, the first factor a
    softmax over hashed n-gram and skip features, and the second one over all words of
    the class and an unknown one, by the word itself and hashed word pairs.

    Null texts are empty (the end alone), a null id is not held out, rows that repeat
    count and are scored each; without training texts every word is unknown.  Words
    are told apart by 64-bit numbers.

    1. Blocks of texts are numbered by a vocabulary of their own; its words go to
       ranges of hash values, which answer with counts over the whole corpus.
    2. Blocks, now classes and contexts, train both softmaxes by summed gradients.
    3. Every block is scored, a softmax per different context.
    """
    spark = docs.sparkSession
    mark = held_out(F.col(id_col)) if held is None else held
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"), mark.alias("held")
    )
    scratch = Scratch(spark)
    with scratch:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE_BYTES))
        made = scratch.store(rows.mapInArrow(_to_blocks(ranges), _BLOCKS), compression="zstd")
        words = made.filter("range >= 0").select("range", "block", "vocabulary", "endings", "counts")
        counted = scratch.store(
            words.groupBy("range").applyInPandas(
                _count_words, "block long, range int, counts binary, top binary, cells binary"
            )
        )
        # A row per range, each of fixed size.
        summaries = counted.filter("block = -1")
        cells = summaries.select("cells").mapInPandas(_add_cells, "cells binary").collect()
        vocabulary = Vocabulary(summaries.select("counts", "top").collect(), cells)
        blocks = made.filter("range = -1").select(
            "block", "ids", "held", "lengths", "words", "vocabulary", "endings"
        )
        answers = counted.filter("block >= 0").select("block", "range", "counts")
        ready = scratch.store(
            blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_resolve(vocabulary), _DOCS),
            compression="zstd",
        )
        tasks = max(1, math.ceil(size / 6 / TASK_TOKENS))
        model = spark.sparkContext.broadcast(train(ready.coalesce(tasks), vocabulary.cell_words))
        scored = ready.mapInPandas(_score(model), _SCORES)
        return scratch.keep(
            scored.select(
                F.col("id").alias(id_col), "held_out", "n_tokens", "n_known",
                F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score",
            )
        )
