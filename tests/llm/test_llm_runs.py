"""Runs of words against a search through all starts and periods."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from clientele.llm import runs as module
from clientele.llm.runs import find_runs, periodic_runs, run_digests, with_periodic_tails

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(words, least=12):
    """Maximal stretches of equal words p places apart, of their smallest period."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i >= p and j - i + p >= least:
                found.setdefault((i, j - i + p), p)
            i = j
    return sorted((s, length, p) for (s, length), p in found.items())


def rewritten(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def slow_digests(doc_id, text):
    words = rewritten(doc_id, WORDS.findall(text or ""))
    found = slow_runs(words)
    drop = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    rest = " ".join(w for i, w in enumerate(words) if i not in drop)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, rest)]
    exponent = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(found), *best, exponent, *sha)


def some_text(rng):
    kind = rng.randrange(6)
    letters = "abcdefg"[: rng.choice([1, 2, 3, 7])]
    n = rng.choice([0, 1, 11, 12, 13, 30, 70, 150])
    words = [rng.choice(letters) for _ in range(n)]
    if kind == 1:
        unit = words[: rng.randrange(1, 40)] or ["x"]
        words = words + unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit))] + words[:3]
    if kind == 2:  # no cube, many squares
        words = ["a"]
        while len(words) < n:
            words = [x for w in words for x in ({"a": "ab", "b": "ba"}[w])]
    if kind == 3:
        x, y = "a", "ab"
        while len(y) < n:
            x, y = y, y + x
        words = list(y)
    if kind == 4:
        words = [f"w{rng.randrange(1000)}" for _ in range(n)]
        words += words
    return words


def test_equal_to_the_search_through_all_periods():
    rng = random.Random(5)
    for _ in range(60):
        texts = [some_text(rng) for _ in range(rng.randrange(1, 12))]
        number = {w: np.uint64(hash(w) & (2**64 - 1)) for t in texts for w in t}
        words = np.array([number[w] for t in texts for w in t], np.uint64)
        first = np.cumsum([0] + [len(t) for t in texts])
        least = rng.choice([5, 8, 12])
        text, start, length, period = (x.tolist() for x in find_runs(words, first, least))
        got = list(zip(text, start, length, period, strict=True))
        assert got == [(i, *r) for i, t in enumerate(texts) for r in slow_runs(t, least)]


@pytest.mark.parametrize("slice_bytes", [1_500_000, 300])
def test_query_columns(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(module, "SLICE_BYTES", slice_bytes)
    rng = random.Random(6)
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(some_text(rng))) for i in range(300)]
    rows += [(None, "A a " * 20), (None, None), (7, None), (8, ""), (9, " \n"), (8, "a b " * 13), (10, "É é " * 9), (10, "É é " * 9)]
    docs = spark.createDataFrame([(i, t, 5, "c") for i, t in rows], "doc_id long, text string, start long, runs string")
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    got = sorted((tuple(r) for r in run_digests(docs.repartition(3)).collect()), key=key)
    assert got == sorted((slow_digests(i, t) for i, t in rows), key=key)
    assert run_digests(docs.limit(0)).collect() == []


def test_runs_and_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "x " + "one two three " * 5 + "one end"), (2, "no run here")], "id long, body string")
    first, second = periodic_runs(docs, "id", "body").orderBy("id").collect()
    assert [tuple(r) for r in first.runs] == [(1, 16, 3, 12)] and first.collapsed == "x one two three end"
    assert second.runs == [] and second.start is None and second.collapsed == "no run here"


def test_periodic_tails_repeat_words(spark):
    docs = spark.createDataFrame([(i, "a b  c d e f g h i j k l m") for i in range(60)], "doc_id long, text string")
    for r in with_periodic_tails(docs).collect():
        assert r.text.split() == rewritten(r.doc_id, "a b c d e f g h i j k l m".split())


def test_a_very_long_text_of_one_word_and_of_two(spark):
    rows = [(3, "z " * 150_000), (4, "y z " * 60_000 + "x " + "z y " * 60_000)]
    began = time.time()
    got = periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()
    assert [(r.n_runs, r.start, r.length, r.period) for r in sorted(got, key=lambda r: r.doc_id)] == [
        (1, 0, 150_000, 1), (2, 0, 120_000, 2)]
    assert time.time() - began < 60
