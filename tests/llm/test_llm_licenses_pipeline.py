"""Licence scan against plain Python; the pipeline stage by stage."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clientele.llm.licenses import CUE, TEMPLATES, document_path, scan_licenses, template_table

DATA = "/root/testdata/sf0.01"
NAMED = re.compile(r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)(\.[^/]*)?$")


def terms(text):
    return re.findall(r"[a-z0-9]+", text.lower())


def plain_scan(files):
    cue = re.compile(CUE)
    headers = {}
    for path, text in files:
        named = bool(path and NAMED.search(path))
        lines = [x for x in re.split("[\r\n]+", text or "") if cue.search(x)]
        if not lines:
            continue
        share = sum(len(x.split()) for x in lines) / max(1, len((text or "").split()))
        for x in [text] if named else lines:
            entry = headers.setdefault(path, ([], [False]))
            entry[0].append(re.sub(r"\s+", " ", x).strip())
            entry[1][0] |= named or share >= 0.5
    units = {x for lines, _ in headers.values() for x in lines}
    texts = list(units) + [t for _, t in TEMPLATES]
    df = Counter(t for x in texts for t in set(terms(x)))

    def vector(text):
        v = {t: n * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in Counter(terms(text)).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    known = {name: vector(t) for name, t in TEMPLATES}
    best = {}
    for x in units:
        v = vector(x)
        best[x] = min((-round(sum(w * v.get(t, 0) for t, w in k.items()), 6), n) for n, k in known.items())
    own, directories = {}, {}
    for path, (lines, (is_file,)) in headers.items():
        cosine, name = min(best[x] for x in lines)
        if -cosine >= 0.6:
            own[path] = (name, "file" if is_file else "header")
            if is_file and path is not None:
                at = path.rpartition("/")[0]
                directories.setdefault(at, []).append((cosine, name))
    out = {}
    for path in {p for p, _ in files}:
        if path in own:
            out[path] = (*own[path], None)
            continue
        at, found = path.rpartition("/")[0] if path is not None else None, (None, None, None)
        while at is not None:
            if at in directories:
                found = (min(directories[at])[1], "directory", at)
                break
            at = at.rpartition("/")[0] if "/" in at else None
        out[path] = found
    return out


def result(frame):
    return {r.path: (r.license, r.origin, r.license_directory) for r in frame.collect()}


def test_odd_files(spark):
    files = [
        ("a/LICENSE", "MIT License text: Released under the MIT License."), ("a/b/c.py", "code"), ("a/b/d.py", None),
        ("a/b/e.py", "x\n# Licensed under the Apache License, Version 2.0.\ny and much more text that says nothing of the kind, none at all"),
        ("f.txt", "nothing"), ("g/COPYING", "Licensed under CC BY-NC 4.0."), ("g/NOTICE", "Licensed under CC BY 4.0."),
        ("g/h/i/j", ""), ("k/l", "copyright by somebody else altogether, no template"), (None, "Released under the MIT License."),
        ("a/b/c.py", "code"), ("m/n", "Licensed under CC BY-NC 4.0.\n" * 3000 + "w " * 90_000),
    ]
    table = spark.createDataFrame([(p, t, 1, "z") for p, t in files], "path string, text string, unit int, license string")
    got = result(scan_licenses(table, template_table(spark)))
    assert got == plain_scan(files)
    assert got["a/b/c.py"] == ("MIT", "directory", "a") and got["a/b/e.py"][:2] == ("Apache-2.0", "header")
    assert got["f.txt"] == (None, None, None)
    assert scan_licenses(table.limit(0), template_table(spark)).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    files = docs.select(document_path().alias("path"), "text")
    got = result(scan_licenses(files, template_table(spark)))
    assert got == plain_scan([(r.path, r.text) for r in files.collect()])
    assert {o for _, o, _ in got.values()} >= {"file", "header", None}


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        own = [words[(i * 37 + j * j * (i + 3)) % 300] + str(i % 7) for j in range(60)]
        rows.append((i, " ".join(own), "en", f"s{i % 3}", 1))
    rows += [
        (100, rows[4][1].upper(), "en", "s0", 1), (101, rows[5][1] + " more", "en", "s1", 1),
        (102, None, "en", None, 0), (103, "", "en", "s2", 0), (104, "", "en", "s2", 0),
        (105, rows[6][1], "en", "s0", 1), (105, rows[6][1], "en", "s0", 1),
    ]
    for i in range(200, 260):
        rows.append((i, f"{words[i % 50]} {words[i % 31]} idiot number{i}" if i % 2 else f"tree {words[i % 50]} x{i} y{i}", "en", "s0", 1))
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1, int("idiot" in (r[1] or ""))) for r in rows if r[0] != 105]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_one_by_one(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, [tuple(r) for r in docs.collect()])
        if name != "packing":
            assert docs.columns == names and set(seen[name][1]) <= set(before)
    before, after = seen["toxicity"]
    assert not any("idiot" in (r[1] or "") for r in after)
    assert len(after) == sum("idiot" not in (r[1] or "") for r in before)
    before, after = seen["exact_dedup"]
    largest = {}
    for r in before:
        text = (r[1] or "").lower()
        largest[text] = max(largest.get(text, -1), r[0])
    assert sorted(r[0] for r in after) == sorted(largest.values())
    before, after = seen["near_dedup"]
    assert {r[0] for r in before} - {r[0] for r in after} == {101}
    before, after = seen["source_mix"]
    assert max(after.count(r) for r in set(after)) <= 2
    mixed, packed = seen["packing"]
    assert Counter(r[0] for r in packed) == Counter(r[0] for r in mixed)


def test_run_gives_the_last_stage(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(rows.columns)
    per_bin = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert per_bin.filter("n > 4096").isEmpty() and rows.count() > 50


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
