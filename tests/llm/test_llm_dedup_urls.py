"""Exact deduplication and URL rules: odd rows, and SQL on whole tables."""

import hashlib

from pyspark.sql import functions as F

from clientele.llm.common import Scratch
from clientele.llm.exact_dedup import drop_exact_copies, exact_groups
from clientele.llm.url_cascade import build_cascade, judge_urls, rule_table

DOCS = "doc_id long, text string, keep_id string, __sha string"


def test_groups_of_odd_texts(spark):
    long_text = "wörd " * 200_000
    rows = [
        (1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, "same  text"),
        (5, None), (6, ""), (7, "É"), (8, "é"), (9, long_text), (10, long_text.upper().replace("Ö", "ö")),
        (11, "twice"), (11, "twice"), (None, "no id"),
    ]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    got = {(r.doc_id, r.text_sha256): r for r in exact_groups(docs).collect()}
    assert exact_groups(docs).count() == len(rows)

    def of(i, text):
        return got[(i, hashlib.sha256(text.encode()).hexdigest())]

    assert {of(i, "same text").keep_id for i in (1, 2, 3)} == {3}
    assert [of(i, "same text").kept for i in (1, 2, 3)] == [False, False, True]
    assert of(4, "same  text").group_size == 1
    assert of(5, "").keep_id == 6 and of(6, "").kept and of(6, "").group_size == 2
    assert of(7, "É").group_size == of(8, "é").group_size == 1  # only A-Z are lower-cased
    assert of(9, long_text).keep_id == 10
    assert of(11, "twice").group_size == 2 and of(11, "twice").kept
    assert of(None, "no id").kept
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 6, 7, 8, 10, 11]


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert exact_groups(docs).collect() == [] and drop_exact_copies(docs).collect() == []


def test_different_texts_of_one_digest_stay_apart(spark, monkeypatch):
    from clientele.llm import exact_dedup

    def constant(docs, id_col, text_col, *more):
        rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *more)
        return rows.withColumn("__sha", F.unhex(F.lit("00")))

    monkeypatch.setattr(exact_dedup, "_keyed", constant)
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_groups(docs).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def test_urls(spark):
    urls = [
        ("https://Example.ORG/es/x", "example.org/es/", "block"),
        ("http://a.b.example.org/en/12?q#f", "example.org/en/1", "block"),
        ("http://example.org/en/2", "org/", "allow"),
        ("http://badexample.org/es/", "org/", "allow"),
        ("http://x.org", None, "allow"),
        ("http://shop.com/de/?a", "com/de/", "block"),
        ("http://shop.com/fr/", "com/fr/", "allow"),
        ("http://shop.com/de", None, "allow"),
        ("http://org/?/es/", "org/", "allow"),
        ("//example.org/es/", None, "allow"),
        ("", None, "allow"),
        (None, None, "allow"),
        ("https://y.net/" + "p" * 100_000, None, "allow"),
        ("http://example.org/es/\nline", "example.org/es/", "block"),
    ]
    pages = spark.createDataFrame([(i, u[0], "z") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules, lengths = rule_table(spark)
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(pages, rules, lengths).collect()}
    assert got == {i: (u[1], u[2]) for i, u in enumerate(urls)}
    none = judge_urls(pages.limit(0), rules, lengths)
    assert none.collect() == []


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("key"), "id").alias("key"))
    listed = spark.range(0, 20_000, 37).select(F.concat(F.lit("key"), "id").alias("key"))
    with Scratch(spark) as scratch:
        contains = build_cascade(listed, universe, scratch)
        inside = universe.filter(contains(F.col("key")))
        assert inside.exceptAll(listed).isEmpty() and inside.count() == listed.count()
