"""Licences of files: TF-IDF cosine to templates, then inheritance from directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import Scratch, text_or_empty

# How licences are usually named in headers, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use are permitted under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use are permitted under the BSD 2-Clause License."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, Version 2.0."),
    ("ISC", "Released under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
)
CUE = r"(?i)licen[cs]|copyright|copyleft|spdx|public domain|all rights reserved|redistribution"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)(\.[^/]*)?$"
LEAST_COSINE = 0.6
LEAST_SHARE = 0.5


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda t: t != ""))


def _weighted(units: DataFrame, idf: DataFrame) -> DataFrame:
    """(unit, term, weight): TF-IDF with vectors of length one."""
    counts = units.select("unit", F.explode(_terms(F.col("text"))).alias("term"))
    rows = counts.groupBy("unit", "term").agg(F.count(F.lit(1)).alias("tf")).join(idf, "term")
    rows = rows.withColumn("weight", F.col("tf") * F.col("idf"))
    lengths = rows.groupBy("unit").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("length"))
    return rows.join(lengths, "unit").select("unit", "term", (F.col("weight") / F.col("length")).alias("weight"))


def match_templates(units: DataFrame, templates: DataFrame) -> DataFrame:
    """(unit, license, cosine) of the best template of each distinct unit.

    ``units`` has unit and text, both distinct; ``templates`` license and text.  Document
    frequencies are counted over all units and templates.  Of equal cosines (to six
    digits) the first licence by name wins.  Units that share no term are left out.
    """
    known = templates.select(F.col("license").alias("unit"), "text")
    both = known.select("text").unionAll(units.select("text"))
    total = F.lit(both.count())
    idf = (
        both.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .select("term", (F.log((1 + total) / (1 + F.col("df"))) + 1).alias("idf"))
    )
    left = _weighted(units, idf)
    right = _weighted(known, idf).withColumnsRenamed({"unit": "license", "weight": "other"})
    products = left.join(right, "term").groupBy("unit", "license").agg(
        F.round(F.sum(F.col("weight") * F.col("other")), 6).alias("cosine")
    )
    best = F.min_by(F.struct("license", "cosine"), F.struct(-F.col("cosine"), "license")).alias("best")
    return products.groupBy("unit").agg(best).select("unit", "best.license", "best.cosine")


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1)


def scan_licenses(
    files: DataFrame, templates: DataFrame, path_col: str = "path", text_col: str = "text"
) -> DataFrame:
    """(path, own_license, own_cosine, license, origin, license_directory) per path.

    Headers are the lines that mention licences or copyright; a licence file (named so,
    or half of whose words or more are in such lines) is taken whole if it is named so.
    Every different header is compared once with the templates, however many files have
    it.  A file's own licence is that of its best header with a cosine of LEAST_COSINE
    or more.  A file without one inherits from the nearest directory above it, its own
    included, that has a licence file; of several there, the best cosine and then the
    first licence by name counts.

    origin: 'file' (a licence file), 'header', 'directory' or null.  Null or empty texts
    have no header; rows that repeat a path are one file with the headers of all; a null
    path is a file without a directory.  Other columns are not read.
    """
    named = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    rows = files.select(
        F.col(path_col).alias("path"), text_or_empty(text_col).alias("text")
    ).withColumn("named", named)
    with_cue = rows.filter(F.col("text").rlike(CUE))
    lines = F.filter(F.split("text", "[\r\n]+"), lambda x: x.rlike(CUE))
    share = _words(F.array_join(lines, " ")) / F.greatest(_words(F.col("text")), F.lit(1))
    scratch = Scratch(files.sparkSession)
    with scratch:
        headers = scratch.store(
            with_cue.select(
                "path",
                (F.col("named") | (share >= LEAST_SHARE)).alias("is_file"),
                F.explode(F.when(F.col("named"), F.array("text")).otherwise(lines)).alias("line"),
            )
            .withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " ")))
            .withColumn("unit", F.sha2("line", 256))
        )
        units = headers.groupBy("unit").agg(F.first("line").alias("text"))
        matched = scratch.store(match_templates(units, templates))
        best = F.min_by(F.struct("license", "cosine"), F.struct(-F.col("cosine"), "license")).alias("best")
        own = (
            headers.join(matched, "unit")
            .filter(F.col("cosine") >= LEAST_COSINE)
            .groupBy("path")
            .agg(best, F.max("is_file").alias("is_file"))
            .select("path", F.col("best.license").alias("own_license"), F.col("best.cosine").alias("own_cosine"), "is_file")
        )
        own = scratch.store(own)
        directories = (
            own.filter("is_file and path is not null")
            .withColumn("directory", _directory(F.col("path")))
            .groupBy("directory")
            .agg(
                F.min_by(
                    F.struct("own_license", "own_cosine"), F.struct(-F.col("own_cosine"), "own_license")
                )["own_license"].alias("inherited")
            )
        )
        paths = rows.select("path").distinct()
        known = paths.join(own, paths["path"].eqNullSafe(own["path"]), "left").drop(own["path"])
        known = scratch.store(known)
        # Directories above a file, by depth; the deepest with a licence file counts.
        parts = F.split(_directory(F.col("path")), "/")
        above = known.filter("own_license is null and path is not null").select(
            "path",
            F.posexplode(
                F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
            ).alias("depth", "directory"),
        )
        inherited = (
            above.join(directories, "directory")
            .groupBy("path")
            .agg(F.max_by(F.struct("inherited", "directory"), "depth").alias("from"))
            .select("path", "from.*")
        )
        result = known.join(inherited, "path", "left").select(
            "path", "own_license", "own_cosine",
            F.coalesce("own_license", "inherited").alias("license"),
            F.when(F.col("own_license").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header"))
            .when(F.col("inherited").isNotNull(), "directory").alias("origin"),
            F.col("directory").alias("license_directory"),
        )
        return scratch.keep(result)


def template_table(spark) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license string, text string")


def document_path() -> Column:
    """source/language/digits of the id/id.txt: directories that nest."""
    digits = F.regexp_replace(F.col("doc_id").cast("string"), "(.)", "$1/")
    parts = (F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")))
    return F.concat(parts[0], F.lit("/"), parts[1], F.lit("/"), digits, F.col("doc_id").cast("string"), F.lit(".txt"))
