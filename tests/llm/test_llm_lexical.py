"""Ranked search against scores of all documents, and its bounds against the scores."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from clientele.llm import lexical as module
from clientele.llm.common import NOT_ALPHANUMERIC, word_hashes
from clientele.llm.lexical import Portion, _blocks, _counted, block_bounds, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def slow_search(docs, items, k=50):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of(text))
    rows = []
    for item, terms in asked.items():
        found = []
        for doc, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total
            score = 0
            for t in terms:
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score:
                found.append((-score, doc is None, doc or 0, doc))
        found.sort(key=lambda f: f[:3])
        rows += [(item, rank, f[3], -f[0]) for rank, f in enumerate(found[:k], 1)]
    return rows


def some_rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Über", "É", "ß9", "The", "tHE"]
    weights = [1 / (i + 1) for i in range(len(words))]

    def text(n):
        return rng.choice([" ", "-", "\n", "_"]).join(rng.choices(words, weights, k=n))

    docs = [(i, text(rng.choice([0, 1, 3, 20, 60, 300]))) for i in range(150)]
    docs += [(3, "w1 w1 w1"), (3, "w1 w1 w1"), (None, "w1 w2"), (None, None), (900, None), (901, " .,! "), (902, "w2 " * 40_000)]
    items = [(i, text(rng.choice([1, 2, 8, 30]))) for i in range(12)]
    items += [(3, "w5 W6"), (20, None), (21, ""), (22, "unknown"), (None, "w1 w7"), (23, "w1 w1 W1")]
    return docs, items


def as_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize("seed,k,portion,block", [(1, 50, 100_000, 2048), (2, 5, 40, 16), (3, 1, 100_000, 3)])
def test_equal_to_scoring_all(spark, monkeypatch, seed, k, portion, block):
    monkeypatch.setattr(module, "PORTION_TERMS", portion)
    monkeypatch.setattr(module, "BLOCK_DOCS", block)
    monkeypatch.setattr(module, "SEEDS", 1)
    docs, items = some_rows(seed)
    doc_table = spark.createDataFrame([(i, t, 1, 2, "q") for i, t in docs], "doc_id long, text string, score int, rank int, query string")
    item_table = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, doc_id string")
    want = sorted(slow_search(docs, items, k), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert as_rows(ranked_search(doc_table.repartition(3), item_table, k)) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search(docs.limit(0), items).collect() == []
    assert ranked_search(docs, items.limit(0)).collect() == []
    assert as_rows(ranked_search(docs, items)) == slow_search([(1, "a b")], [(1, "a")])


def test_bounds_are_never_below_the_scores():
    docs, items = some_rows(4)
    docs = [(i, t) for i, t in docs if terms_of(t)]
    hashes, first = word_hashes(pa.array([t for _, t in docs]), NOT_ALPHANUMERIC)
    waiting = [(i, int(e - b), *_counted(hashes[b:e])) for i, (b, e) in enumerate(zip(first, first[1:], strict=False))]
    asked, borders = word_hashes(pa.array([t or "" for _, t in items]), NOT_ALPHANUMERIC)
    rows = []
    for q in range(len(items)):
        for term in set(asked[borders[q] : borders[q + 1]].tolist()):
            rows.append(type("R", (), {"query": q, "term": np.uint64(term).view(np.int64), "weight": 1 + term % 7000})())
    portion = Portion(rows)
    n, total = len(docs), int(first[-1])
    tight = checked = 0
    for block in _blocks(waiting):
        keys = np.frombuffer(block["keys"], np.int64)
        for q, bounds in block_bounds(block, portion, n, total):
            for key, bound in zip(keys.tolist(), bounds.tolist(), strict=True):
                _, size, terms, counts = waiting[key]
                m = 50 + 50 * size * n // total
                tf = dict(zip(terms.tolist(), counts.tolist(), strict=True))
                score = sum(
                    int(w) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m))
                    for t, w in zip(portion.terms[portion.places[q]].tolist(), portion.weights[q], strict=True)
                    if t in tf
                )
                assert bound >= score
                tight += bound <= 1.2 * score
                checked += 1
    assert tight > 0.8 * checked
