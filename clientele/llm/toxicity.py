"""Toxicity of texts after undoing leetspeak, spacing and repetition."""

from __future__ import annotations

import math
import os
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import text_or_empty

# Labelled rows that the classifier learns from, at most.
TRAINING_ROWS = 20_000
# Words whose weight a task remembers at once.
CACHED_WORDS = 200_000
# Words whose trigrams a task counts at once: the arrays take about 1 kB a word.
FOLDED_WORDS = 30_000

# What a sign may stand for in disguised words.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
WILDCARDS = "*#%"
SEPARATORS = ".-_'~,·"
EDGE = ".,;:?!\"'()[]{}<>*#%&$…-_|~"
OPENING = ".,;:?\"'()[]{}<>*#%&-_~"
# Punctuation that stands for no letter and joins none.
MARKS = "".join(c for c in EDGE if c not in LEET and c not in WILDCARDS)
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){3,}(?!\S)")
SIGNS = re.escape("".join(LEET) + WILDCARDS + SEPARATORS)
LETTER = re.compile(r"[^\W\d_]")
SIGN = re.compile(f"[{SIGNS}]")
ONLY_SIGNS = re.compile(f"^[{SIGNS}]{{3,}}$")
PAIR = re.compile(r"([^\W\d_])\1")
TRIPLE = re.compile(r"([^\W\d_])\1\1")

# Logarithms of what the writer of a disguised word does to one sign.
SWAP, DROP, DOUBLE, BREAK, ANY = -1.0, -1.5, -3.0, -2.0, -2.5


# Letters below are of Latin scripts.
LATIN_END = 0x250


def _class(c: str) -> str:
    """Letters of Latin scripts are themselves; all other signs are one class."""
    return c if c.isalpha() and ord(c) < LATIN_END else "?"


def trigram_counts(batches):
    """Counts of letter trigrams in the words of a task's texts."""
    import pyarrow as pa

    words: Counter = Counter()
    grams: Counter = Counter()

    def fold():
        # All words in one string, each with two spaces before and one behind it.
        kept = [(w, n) for w, n in ((w.strip(EDGE).lower(), n) for w, n in words.items()) if w.isalpha()]
        words.clear()
        signs = np.frombuffer("".join(f"  {w} " for w, _ in kept).encode("utf-32-le"), "<u4").astype(np.int64)
        signs = np.where(signs < LATIN_END, signs, ord("?"))
        sizes = np.array([len(w) + 3 for w, _ in kept], np.int64)
        weights = np.repeat(np.array([n for _, n in kept], np.int64), sizes)
        # A trigram that begins at a word's last two signs would reach into the next word.
        inside = np.ones(len(signs), bool)
        ends = np.cumsum(sizes)
        inside[ends - 1] = inside[ends - 2] = False
        at = np.flatnonzero(inside)
        keys = (signs[at] * LATIN_END + signs[at + 1]) * LATIN_END + signs[at + 2]
        keys, which = np.unique(keys, return_inverse=True)
        for key, n in zip(keys.tolist(), np.bincount(which, weights[at]).tolist(), strict=True):
            first, rest = divmod(key, LATIN_END * LATIN_END)
            grams[chr(first) + chr(rest // LATIN_END) + chr(rest % LATIN_END)] += int(n)

    for batch in batches:
        for text in batch.column("text"):
            words.update(text.as_py().split())
            if len(words) >= FOLDED_WORDS:
                fold()
    fold()
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["gram", "n"]
    )


class CharacterModel:
    """Letter trigrams, backed off to bigrams and single letters."""

    def __init__(self, grams: dict[str, int], weight: float = 5.0):
        self.weight = weight
        self.three = grams
        self.two, self.one = Counter(), Counter()
        self.pair, self.single = Counter(), Counter()
        for g, n in grams.items():
            self.pair[g[:2]] += n
            self.two[g[1:]] += n
            self.single[g[1]] += n
            self.one[g[2]] += n
        self.total = sum(self.one.values())
        self.cache: dict[str, float] = {}

    def logp(self, gram: str) -> float:
        """log P(last letter | the two before)."""
        known = self.cache.get(gram)
        if known is None:
            w = self.weight
            p = (self.one[gram[2]] + 0.5) / (self.total + 300)
            p = (self.two[gram[1:]] + w * p) / (self.single[gram[1]] + w)
            p = (self.three.get(gram, 0) + w * p) / (self.pair[gram[:2]] + w)
            known = self.cache[gram] = math.log(p)
        return known


def _arcs(word: str, i: int, spaced: bool):
    """What the sign at i may stand for: (letters, logarithm of the channel)."""
    c = word[i]
    inner = 0 < i < len(word) - 1
    if c.isalpha():
        yield c, 0.0
        if i and word[i - 1] == c:
            yield "", DOUBLE if word[i - 2 : i - 1] != c else 0.0
    else:
        for letter in LEET.get(c, ""):
            yield letter, SWAP
        if c in WILDCARDS:
            for letter in LETTERS:
                yield letter, ANY
        if c in SEPARATORS or c in WILDCARDS or c in "!$|" and not inner:
            yield "", DROP
        yield "?", -6.0
    if spaced and inner and c.isalpha():
        yield " " + c, BREAK


def decode(word: str, model: CharacterModel, spaced: bool = False) -> str:
    """The likeliest original of a disguised word, by Viterbi's algorithm.

    A state of the lattice is the last two letters of the original; arcs weigh the
    letter model against the channel.  ``spaced``: signs that were written apart,
    between which the original may have had spaces.
    """
    states = {"  ": (0.0, "")}
    settled: list[str] = []
    tail = len(word.rstrip(SEPARATORS + WILDCARDS))
    bound = -math.inf
    for i in range(len(word)):
        # From here on all signs may be left out; what is worse already cannot win.
        if i >= tail:
            left = DROP * (len(word) - i) - 1e-9
            bound = max(v + left + model.logp(s + " ") for s, (v, _) in states.items())
        following: dict[str, tuple[float, str]] = {}
        for letters, cost in _arcs(word, i, spaced):
            for state, (score, made) in states.items():
                value, last = score + cost, state
                for letter in letters:
                    value += model.logp(last + (letter if letter == " " else _class(letter)))
                    last = (last + _class(letter))[-2:] if letter != " " else "  "
                if last not in following or following[last][0] < value:
                    following[last] = (value, made + letters)
        # Far worse beginnings cannot win any more.
        top = max(v for v, _ in following.values())
        least = max(top - 15, bound)
        states = {s: x for s, x in following.items() if x[0] > least}
        # What all states have in common is settled, so a path stays short on a long word.
        if i % 64 == 63:
            common = len(os.path.commonprefix([made for _, made in states.values()]))
            settled.append(next(iter(states.values()))[1][:common])
            states = {s: (v, made[common:]) for s, (v, made) in states.items()}
    ends = ((v + model.logp(s + " "), made) for s, (v, made) in states.items())
    return "".join(settled) + max(ends)[1]


def _odd(form: str) -> bool:
    """Whether a token may be disguised.

    It has a letter and, at any place, a sign that may stand for something, or consists of
    three such signs or more, or repeats letters: one three times, or more than two twice.
    """
    if SIGN.search(form) and (LETTER.search(form) or ONLY_SIGNS.search(form)):
        return True
    return bool(PAIR.search(form)) and (bool(TRIPLE.search(form)) or len(PAIR.findall(form)) > 2)


def restored_words(
    token: str, model: CharacterModel, wanted: Callable[[str], bool] = lambda form: True
) -> list[str]:
    """The words that a token may stand for: as written, and decoded where it looks odd.

    Signs at its ends may be punctuation or stand for letters, so it is decoded with and
    without them.  Forms that are not ``wanted`` are left as written.
    """
    low = token.lower().strip(MARKS)
    if low.isalpha() and not PAIR.search(low):
        return [low]
    plain = low.strip(EDGE)
    found = [plain] if plain else []
    for form in {back.lstrip(at_front) for back in (low, low.rstrip(EDGE)) for at_front in ("", OPENING)}:
        if _odd(form) and wanted(form):
            found += [w for w in decode(form, model).split() if w not in found]
    return found


def features(word: str) -> list[str]:
    """The word and its beginnings, by which inflected forms are known."""
    return ["=" + word] + [word[:n] for n in (4, 5, 6) if len(word) > n]


class Scorer:
    """Statistics of a text: weights of its most toxic words."""

    def __init__(self, model: CharacterModel, weights: dict[str, float]):
        self.model, self.weights = model, weights
        self.cache: dict[str, float] = {}
        # A trie of all weighty words and beginnings, as the set of what they begin with.
        self.whole = {f[1:] for f in weights if f[:1] == "="}
        self.opening = {f for f in weights if f[:1] != "="}
        self.begun = {w[:n] for w in self.whole | self.opening for n in range(len(w) + 1)}

    def may_weigh(self, word: str) -> bool:
        """Whether any path through the lattice of a word spells something weighty.

        All that ``decode`` can return is among these paths; most words end after a letter
        or two, as nothing weighty begins like that.
        """
        spelt = {""}
        for i, sign in enumerate(word):
            further = set()
            if sign.isalpha() and word[i - 1 : i] != sign:
                arcs = ((sign, 0.0),)
            else:
                arcs = _arcs(word, i, False)
            for letters, _ in arcs:
                for made in spelt:
                    made += letters
                    if made in self.begun:
                        if made in self.opening:
                            return True
                        further.add(made)
            if not further:
                return False
            spelt = further
        return not spelt.isdisjoint(self.whole)

    def weight(self, token: str) -> float:
        get = self.weights.get
        words = restored_words(token, self.model, self.may_weigh)
        return max((get(f, 0.0) for w in words for f in features(w)), default=0.0)

    def statistics(self, text: str) -> tuple[float, float, float]:
        """Largest weight, sum of the five largest, share of weighty words."""
        cache = self.cache
        if len(cache) > CACHED_WORDS:
            cache.clear()
        tokens = text.split()
        found = []
        for token in set(tokens):
            w = cache.get(token)
            if w is None:
                w = cache[token] = self.weight(token)
            if w:
                found.append(w)
        for run in SPACED.findall(text):
            for word in decode(re.sub(r"\s", "", run).lower(), self.model, True).split():
                w = self.weight(word)
                if w:
                    found.append(w)
        found.sort(reverse=True)
        return (
            found[0] if found else 0.0,
            sum(found[:5]),
            math.log1p(100 * sum(found) / (len(tokens) + 20)),
        )


def _feature_counts(model: CharacterModel):
    def run(batches):
        import pyarrow as pa

        counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                text = text.as_py()
                words = {w for t in set(text.split()) for w in restored_words(t, model)}
                for run_ in SPACED.findall(text):
                    words.update(decode(re.sub(r"\s", "", run_).lower(), model, True).split())
                for f in {f for w in words for f in features(w)}:
                    counts[f][toxic] += 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(counts), pa.string()),
                pa.array([c[1] for c in counts.values()], pa.int64()),
                pa.array([c[0] for c in counts.values()], pa.int64()),
            ],
            ["feature", "toxic", "clean"],
        )

    return run


def _statistics(model, weights, calibration=None):
    def run(batches):
        import pyarrow as pa

        scorer = Scorer(model, weights)
        for batch in batches:
            rows = [scorer.statistics(t.as_py()) for t in batch.column("text")]
            rows = np.array(rows).reshape(-1, 3)
            names = list(batch.schema.names)
            columns = list(batch.columns)
            text = names.index("text")
            del names[text], columns[text]
            if calibration is None:
                added = {f"x{i}": rows[:, i] for i in range(3)}
            else:
                added = {"score": predict(rows, calibration)}
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(v) for v in added.values()], names + list(added)
            )

    return run


def predict(rows: np.ndarray, calibration: np.ndarray) -> np.ndarray:
    z = np.c_[rows, rows[:, 0] > 0] @ calibration[1:] + calibration[0]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_calibration(rows: np.ndarray, labels: np.ndarray, steps: int = 60, decay: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton's method with a penalty; the constant comes first."""
    x = np.c_[np.ones(len(rows)), rows, rows[:, 0] > 0]
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [decay] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (labels - p) - penalty @ w
        curve = (x.T * (p * (1 - p))) @ x + penalty
        w = w + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return w


class ToxicityModel:
    """What training gives: letter model, word weights, calibration."""

    def __init__(self, letters: CharacterModel, weights: dict[str, float], calibration: np.ndarray):
        self.letters, self.weights, self.calibration = letters, weights, calibration


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> ToxicityModel:
    """Learn from labelled documents: docs (id, text), labels (id, toxic of 0 or 1).

    The letter model counts all words of all documents.  Word weights and their
    calibration come from a sample of at most ``rows`` labelled rows, chosen by a
    hash of the id; three quarters count words, the rest calibrates.  The driver gets
    letter trigrams (bounded by the alphabet) and what the sample yields.
    """
    text = docs.select("id", text_or_empty("text").alias("text"))
    grams = (
        text.select("text").mapInArrow(trigram_counts, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    )
    letters = CharacterModel({r.gram: r.n for r in grams.collect()})
    known = labels.filter("toxic in (0, 1) and id is not null").groupBy("id").agg(F.max("toxic").cast("long").alias("toxic"))
    sample = known.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(rows)
    # At most `rows` rows of two numbers, whatever the input.
    marked = text.join(F.broadcast(sample), "id")
    fold = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(4))
    counted = marked.filter(fold != 0).select("text", "toxic").mapInArrow(
        _feature_counts(letters), "feature string, toxic long, clean long"
    )
    classes = {r.toxic: r["count"] for r in sample.filter(fold != 0).groupBy("toxic").count().collect()}
    positive, negative = classes.get(1, 0) + 0.2, classes.get(0, 0) + 0.2
    few = 0.1
    a, b = F.col("toxic") + few, F.col("clean") + few
    # How much likelier a toxic text has the word, less what chance may add.
    weight = F.log(a / positive) - F.log(b / negative) - 1.64 * F.sqrt(1 / a + 1 / b)
    weights = (
        counted.groupBy("feature")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .withColumn("weight", weight)
        .filter("weight > 0.5")
    )
    weights = {r.feature: r.weight for r in weights.select("feature", "weight").collect()}
    rest = marked.filter(fold == 0).select("toxic", "text").mapInArrow(
        _statistics(letters, weights), "toxic long, x0 double, x1 double, x2 double"
    )
    rest = rest.toPandas()
    if len(rest) and 0 < rest.toxic.sum() < len(rest):
        calibration = fit_calibration(rest[["x0", "x1", "x2"]].to_numpy(), rest.toxic.to_numpy())
    else:
        calibration = np.array([-3.0, 1.0, 0.0, 0.0, 0.0])
    return ToxicityModel(letters, weights, calibration)


def score_texts(texts: DataFrame, model: ToxicityModel) -> DataFrame:
    """Adds ``score`` (0 to 1) in place of the column ``text``; null text is empty."""
    rows = texts.withColumn("text", text_or_empty("text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "text") + ", score double"
    return rows.mapInArrow(_statistics(model.letters, model.weights, model.calibration), schema)


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    rows: int = TRAINING_ROWS,
) -> DataFrame:
    """(id, held_out, score, predicted) of every document.

    Rows whose crc32 of the id, as text, is divisible by 5 are held out: their labels
    are not used.  Null texts count as empty; empty texts get the score of a text
    without any weighty word; a null id is not held out; rows that repeat are scored
    each.  Without labels of both kinds the score rests on constants.
    """
    rows_in = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col("doc_id").alias("id"), "toxic").filter(~held_out(F.col("id")))
    model = train(rows_in, known, rows)
    scored = score_texts(rows_in, model)
    return scored.select(
        F.col("id").alias(id_col),
        F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def _is_clean(model: ToxicityModel):
    @F.pandas_udf("boolean")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model.letters, model.weights)
        for part in texts:
            found = np.array([scorer.statistics(t) for t in part]).reshape(-1, 3)
            yield pd.Series(predict(found, model.calibration) < 0.5)

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with a score below 0.5, with all their columns.

    Rows are scored as in ``toxicity``; tasks get the texts only, and rows stay in Spark.
    """
    known = labels.select(F.col("doc_id").alias("id"), "toxic").filter(~held_out(F.col("id")))
    model = train(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), known)
    return docs.filter(_is_clean(model)(text_or_empty(text_col)))
