"""Packing against the tokenizer itself, mixing against its promises."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clientele.llm import packing
from clientele.llm.mixing import mix_schedule, take_mix
from clientele.llm.packing import WordIds, _cuts_words, pack_documents
from clientele.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.01"


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item indexes: largest item first, each into the fullest bin with room.

    Bins are kept by their room, and one integer has a bit for every room that
    some bin has, so the best bin is found without going through them.
    """
    by_room: dict[int, list[int]] = {}
    rooms = 0
    bins: list[list[int]] = []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            held = by_room[room]
            target = held.pop()
            if not held:
                rooms ^= 1 << room
            bins[target].append(item)
        else:
            room, target = capacity, len(bins)
            bins.append([item])
        left = room - size
        if left:
            held = by_room.setdefault(left, [])
            if not held:
                rooms |= 1 << left
            held.append(target)
    return bins


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def pieces_of(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
    return [
        (n, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes()))
        for n, at in enumerate(range(0, len(ids), 4096))
    ]


SIGNS = st.sampled_from([*"aBzÉßñİΣςdžﬁ٣5²½ª'’.,!?*$%&#<|>-_@ \t\n\x1c\x85\xa0́中🙂", "<|endoftext|>", "'s", "don't"])


@given(st.lists(SIGNS, max_size=30).map("".join))
@settings(max_examples=400, deadline=None)
def test_ids_of_words_are_ids_of_the_text(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")) if not _cache else _cache[0]
    _cache[:] = [tokenizer]
    words = WordIds(tokenizer, _cuts_words(tokenizer))
    expected = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert words.encode(text) == expected


_cache: list = []


def check_packing(rows, expected):
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {i: sorted(p) for i, p in by_doc.items()} == expected
    for members in bins.values():
        end = 0
        for offset, length in sorted(members):
            assert offset == end
            end += length
        assert end <= 4096
    return len(bins)


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    expected = {i: pieces_of(tokenizer, t) for i, t in texts.items()}
    rows = pack_documents(docs.repartition(5), tokenizer_path).collect()
    total = sum(p[2] for ps in expected.values() for p in ps)
    assert check_packing(rows, expected) <= 1.01 * -(-total // 4096)


def test_odd_texts_and_a_deep_tree(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "LEAF_ITEMS", 7)
    monkeypatch.setattr(packing, "FAN_IN", 2)
    texts = [None, "", " ", "a", "word " * 4095, "word " * 4096, "word " * 9000] + ["b c " * (n * 40) for n in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    rows = pack_documents(docs.withColumn("piece", F.lit("x")), tokenizer_path).collect()
    check_packing(rows, {i: pieces_of(tokenizer, t) for i, t in enumerate(texts)})
    assert pack_documents(docs.limit(0), tokenizer_path).collect() == []


def test_best_fit_takes_the_fullest_bin():
    sizes = np.array([60, 50, 40, 30, 10, 10])
    assert best_fit(sizes, 100) == [[0, 2], [1, 3, 4, 5]]


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_ = {}, set(order)
    amount = share * sum(sizes.values())
    while open_:
        level = (amount - sum(out.values())) / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        out |= {s: most * sizes[s] for s in full}
        open_ -= full
    return out


def check_mix(docs, rows, tolerance):
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r.size
    want = targets(size)
    taken = dict.fromkeys(size, 0)
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id] or ""))
        assert 0 <= r.taken <= 2 * r.size and r.source_size == size[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= tolerance * want[s] + 2


def test_mix_of_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = mix_schedule(docs).collect()
    assert len(rows) == len(texts)
    check_mix(texts, rows, 0.005)
    again = mix_schedule(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_of_odd_rows(spark):
    texts = [("a " * n, s) for n, s in ((500, "x"), (3, "x"), (900, "Z"), (70, None), (5000, "ä"), (40, ""))]
    rows = [(i, t, s, 1) for i, (t, s) in enumerate(texts)] + [(90, None, "x", 1), (91, "", "empty", 1), (92, " ", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mix_schedule(docs).collect()
    assert len(got) == len(rows)
    check_mix({r[0]: r[1] for r in rows}, [r for r in got], 0.05)
    mixed = take_mix(docs)
    assert mixed.columns == docs.columns
    visits = {r.doc_id: r.visits for r in got}
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in visits.items() if n}
    assert mix_schedule(docs.limit(0)).collect() == [] and take_mix(docs.limit(0)).collect() == []


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit(counts):
    plan = packing.Plan(counts, 40)
    lengths = np.repeat(list(counts), list(counts.values())).astype(np.int64)
    ranks = np.concatenate([[0], *(np.arange(n) for n in counts.values())])[1:].astype(np.int64)
    bins, offsets = plan.places(lengths, ranks)
    fills = np.bincount(bins, lengths, plan.bins)
    expected = [sum(int(lengths[i]) for i in b) for b in best_fit(lengths, 40)]
    assert sorted(fills) == sorted(expected)
    for b in range(plan.bins):
        inside = sorted(zip(offsets[bins == b], lengths[bins == b], strict=True))
        assert [o for o, _ in inside] == [0, *np.cumsum([n for _, n in inside])[:-1]]


def test_long_pieces_of_one_task_meet_short_ones_of_another(spark):
    rows = spark.range(0, 18_000, 1, 2).selectExpr(
        "id doc_id", "0 piece", "0L start", "if(id < 9000, 2500, 1500) length", "id ids_crc32"
    )
    got = packing.pack_pieces(rows)
    assert got.count() == 18_000 and got.select("sequence_id").distinct().count() == 9_000


def test_many_batches_of_one_task_are_packed_together(spark):
    rows = spark.range(0, 120_000, 1, 1).selectExpr(
        "id doc_id", "0 piece", "0L start", "if(id < 60000, 2500, 1500) length", "id ids_crc32"
    )
    assert packing.pack_pieces(rows).select("sequence_id").distinct().count() == 60_000


def test_what_a_plan_leaves_is_numbered_by_size():
    rng = np.random.default_rng(5)
    for _ in range(200):
        counts = {int(s): int(n) for s, n in zip(rng.integers(1, 41, 8), rng.integers(1, 60, 8), strict=True)}
        plan = packing.Plan(counts, 40, spare=3)
        lengths = np.repeat(list(counts), list(counts.values())).astype(np.int64)
        ranks = np.concatenate([np.arange(n) for n in counts.values()]).astype(np.int64)
        bins, _ = plan.places(lengths, ranks)
        fills = np.bincount(bins, lengths, plan.bins)
        underfull, again = plan.left_ranks(lengths, ranks)
        assert (underfull == (fills[bins] < 37)).all()
        left = {s: int((lengths[underfull] == s).sum()) for s in counts}
        assert plan.left() == {s: n for s, n in left.items() if n}
        for s, n in left.items():
            assert sorted(again[underfull & (lengths == s)]) == list(range(n))


def test_leaves_emit_and_two_levels_of_merges_take_the_rest(spark, monkeypatch):
    monkeypatch.setattr(packing, "LEAF_ITEMS", 500)
    monkeypatch.setattr(packing, "FAN_IN", 4)
    # A third of the rows is one row again and again.
    rows = spark.range(0, 8_000, 1, 3).selectExpr(
        "if(id % 3 = 0, 7, id) doc_id", "0 piece", "0L start",
        "if(id % 3 = 0, 1700, 1 + pmod(hash(id), 4096)) length", "id ids_crc32",
    )
    got = packing.pack_pieces(rows).collect()
    assert sorted(r.ids_crc32 for r in got) == list(range(8_000))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    by_level, nodes = {}, {}
    for number, members in bins.items():
        offsets = [o for o, _ in sorted(members)]
        assert offsets == [0, *np.cumsum([n for _, n in sorted(members)])[:-1]]
        fill, level = sum(n for _, n in members), number >> 36 & 15
        assert fill <= 4096 and (level == 2 or fill >= 4096 - 20)
        by_level[level] = by_level.get(level, 0) + 1
        nodes.setdefault(level, set()).add(number >> 40)
    # 16 leaves, 4 nodes above them, one root.
    assert [len(nodes[level]) for level in range(3)] == [16, 4, 1]
    assert by_level[0] > by_level[1] > 0
    alone = len(best_fit(np.array([r.length for r in got]), 4096))
    assert len(bins) <= 1.01 * alone


def test_null_ids_are_packed_and_change_no_other_id(spark, tokenizer):
    big = 2**53 + 1
    docs = spark.createDataFrame(
        [(None, "a b"), (big, "c d"), (None, None), (-1, "e")], "doc_id long, text string"
    ).coalesce(1)
    rows = pack_documents(docs, tokenizer_path).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, -1), (False, big), (True, 0), (True, 0)]
    (empty,) = [r for r in rows if r.doc_id is None and r.length == 1]
    assert pieces_of(tokenizer, None) == [(empty.piece, empty.start, empty.length, empty.ids_crc32)]
