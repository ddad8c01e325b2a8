"""CSV files with line breaks in fields: read by splits, and with broken records."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from clientele.operators.settling import settle
from clientele.plans.measure import plan_nodes
from clientele.sources import csv_records as module
from clientele.sources.csv_records import csv_records
from clientele.sources.storage import read_csv, read_csv_with_rejects

HEADER = "review_score,order_id,review_id,extra,review_comment_title,review_comment_message\n"


def some_rows(rng, n):
    bits = ["a", "b c", '"', '""', "\n", "\n\n", ",", "\r\n", "é", " ", "x" * 30, "\\"]
    rows = []
    for i in range(n):
        texts = ["".join(rng.choices(bits, k=rng.choice([0, 1, 3, 8, 40]))) for _ in range(2)]
        rows.append([str(rng.randrange(1, 6)), f"o{i}", f"r{i}", "", *texts])
    return rows


def as_csv(rows, line_end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=line_end, quoting=csv.QUOTE_ALL).writerows(rows)
    return HEADER.replace("\n", line_end) + out.getvalue()


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_equal_to_the_reader_that_follows_the_quotes(spark, tmp_path, small_splits, line_end):
    rng = random.Random(len(line_end))
    want = []
    for name in ("one.csv", "two.csv"):
        rows = some_rows(rng, 150)
        # One field is larger than several splits.
        rows[70][5] = 'long "text"\n' * 400
        (tmp_path / name).write_bytes(as_csv(rows, line_end).encode())
        # An empty field is no value, as in the reader of Spark itself.
        want += [(r[2], r[1], int(r[0]), r[4] or None, r[5] or None) for r in rows]
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 12
    got = [tuple(r) for r in read_csv(spark, str(tmp_path), "reviews").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    if line_end != "\n":
        # The other reader changes line breaks inside fields here.
        return
    single = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path))
    texts = [t[0] for t in single.select("review_comment_message").collect()]
    assert sorted(texts, key=str) == sorted((r[4] for r in want), key=str)


def test_lines_are_not_gathered_into_one_task(spark, tmp_path, small_splits):
    rows = some_rows(random.Random(9), 400)
    (tmp_path / "one.csv").write_text(as_csv(rows), newline="")
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path))
    by_split = lines.groupBy(F.col("_metadata.file_block_start")).count()
    assert by_split.count() > 8
    records = csv_records(spark, str(tmp_path))
    assert records.count() == 400


def test_lines_become_records_where_they_are_read(spark, tmp_path, small_splits, monkeypatch):
    rows = some_rows(random.Random(4), 300)
    (tmp_path / "one.csv").write_text(as_csv(rows), newline="")
    settled = []
    monkeypatch.setattr(module, "settle", lambda frame: settled.append(frame) or settle(frame))
    assert csv_records(spark, str(tmp_path)).count() == 300
    with_texts = [frame for frame in settled if {"value", "record"} & set(frame.columns)]
    assert with_texts
    for frame in with_texts:
        assert plan_nodes(frame, "Exchange") == plan_nodes(frame, "Sort") == 0


def broken_file(rng):
    """Lines of payments, and what each record should lead to."""
    lines, causes = [], []
    for i in range(300):
        order, number, kind, rate, value = f"o{i}", str(i % 7), '"credit\ncard"', "2", "12.50"
        case = rng.choice(["good", "good", "good", "fields", "few", "type", "missing", "null"])
        cause = "good"
        if case == "fields":
            rate, cause = "2,2", "number of fields"
        if case == "few":
            lines.append(f"{order},{number}")
            causes.append("number of fields")
            continue
        if case == "type":
            value, cause = '"12,50"', "payment_value: not decimal(12,2)"
        if case == "missing":
            order, cause = "", "order_id: missing"
        if case == "null":
            kind, rate = "", ""
        lines.append(",".join([order, number, kind, rate, value]))
        causes.append(cause)
    return lines, causes


def test_rejected_records_have_a_file_and_a_cause(spark, tmp_path, small_splits):
    rng = random.Random(3)
    counts = {}
    for name in ("a.csv", "b.csv"):
        lines, causes = broken_file(rng)
        if name == "b.csv":
            # Nothing after a quote that is never closed can be told apart.
            lines.append('o999,1,"never closed,1,5.00\nand more')
            causes.append("quote not closed")
        header = "order_id,payment_sequential,payment_type,payment_installments,payment_value"
        (tmp_path / name).write_text("\n".join([header, *lines]) + "\n\n")
        for cause in causes:
            counts[name, cause] = counts.get((name, cause), 0) + 1
    good, rejected = read_csv_with_rejects(spark, str(tmp_path), "payments")
    found = {("good"): good.count()}
    for r in rejected.groupBy(F.element_at(F.split("file", "/"), -1).alias("file"), "cause").count().collect():
        found[r.file, r.cause] = r["count"]
    want = {k: n for k, n in counts.items() if k[1] != "good"}
    want["good"] = sum(n for k, n in counts.items() if k[1] == "good")
    assert found == want
    assert {r.payment_type for r in good.collect()} == {"credit\ncard", None}
    assert "never closed" in rejected.filter("cause = 'quote not closed'").first().record


def test_a_file_with_a_header_only(spark, tmp_path):
    (tmp_path / "one.csv").write_text(HEADER)
    assert read_csv(spark, str(tmp_path), "reviews").collect() == []
