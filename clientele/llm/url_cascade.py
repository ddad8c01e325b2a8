"""URL rules by cascades of Bloom filters that are exact on the given URLs."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import LOWER, UPPER, Scratch

# The rules of the registered query, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ?, # or the end; else empty."""
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(path, F.lit(""))


def rule_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """All rules that could fit, longest first: (suffix of host) + (prefix of path).

    ``lengths`` are the lengths that paths of rules have.  Of two keys of equal
    length the one with the longer host comes first.
    """
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    prefixes = F.filter(
        F.array(*(F.struct(F.lit(n).alias("n"), F.substring(path, 1, n).alias("p")) for n in lengths)),
        lambda x: F.length(path) >= x["n"],
    )
    keys = F.flatten(
        F.transform(
            suffixes,
            lambda s: F.transform(
                prefixes,
                lambda x: F.struct(
                    (F.length(s) + x["n"]).alias("length"),
                    F.length(s).alias("host_length"),
                    F.concat(s, x["p"]).alias("key"),
                ),
            ),
        )
    )
    return F.when(
        host != "", F.transform(F.sort_array(keys, asc=False), lambda k: k["key"])
    ).otherwise(F.array().cast("array<string>"))


class BloomFilter:
    """Bits of one level, held as 64-bit words in a literal array.

    Sized by what it encodes: ``bits_per_key`` times the number of keys.
    """

    def __init__(self, keys: DataFrame, count: int, bits_per_key: float, seed: int):
        self.words = max(1, math.ceil(count * bits_per_key / 64))
        self.hashes = max(1, round(bits_per_key * math.log(2)))
        self.seed = seed
        # Positions are combined before and in the shuffle; the driver gets a
        # row per word that has a bit, bounded by the size of the rule list.
        position = F.explode(F.array(*self._positions(F.col("key")))).alias("at")
        rows = (
            keys.select(position)
            .select(
                F.shiftright("at", 6).alias("word"),
                F.call_function(
                    "shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int")
                ).alias("bit"),
            )
            .groupBy("word")
            .agg(F.bit_or("bit").alias("bits"))
            .collect()
        )
        bits = dict.fromkeys(range(self.words), 0) | {r.word: r.bits for r in rows}
        literal = ",".join(str(bits[i]) for i in range(self.words))
        self.array = F.split(F.lit(literal), ",").cast("array<bigint>")

    def _positions(self, key: Column) -> list[Column]:
        size = F.lit(self.words * 64).cast("long")
        return [
            F.pmod(F.xxhash64(key, F.lit(self.seed * 64 + i)), size) for i in range(self.hashes)
        ]

    def may_contain(self, key: Column) -> Column:
        hit = None
        for at in self._positions(key):
            word = F.get(self.array, F.shiftright(at, 6).cast("int"))
            bit = F.getbit(word, (at % 64).cast("int")) == 1
            hit = bit if hit is None else hit & bit
        return hit


def build_cascade(
    listed: DataFrame, universe: DataFrame, scratch: Scratch, seed: int = 1
) -> Callable[[Column], Column]:
    """Exact test for membership in ``listed``, valid for every key of ``universe``.

    Both have one column ``key`` with distinct values.  Level 1 encodes the listed
    keys.  Level 2 encodes the other keys that level 1 lets through, level 3 the
    listed keys that level 2 lets through, and so on until a level lets nothing
    wrong through.  The first level that rejects a key decides.  Level 1 gets
    enough bits for about as many false positives as keys are listed, so every
    level is bounded by the list and not by the corpus.
    """
    count = listed.count()
    if not count:
        return lambda key: F.lit(False)
    others = scratch.store(universe.join(listed, "key", "left_anti"))
    size = others.count()
    level_bits = max(2.0, math.log2(max(2.0, size / count)) / math.log(2))
    levels: list[BloomFilter] = []
    inside, inside_count, outside = listed, count, others
    while inside_count:
        level = BloomFilter(inside, inside_count, level_bits, seed + len(levels))
        levels.append(level)
        passed = scratch.store(outside.filter(level.may_contain(F.col("key"))))
        inside, outside, level_bits = passed, inside, 4.0
        inside_count = passed.count()

    def contains(key: Column) -> Column:
        answer = F.lit(len(levels) % 2 == 1)
        for i in reversed(range(len(levels))):
            answer = F.when(~levels[i].may_contain(key), F.lit(i % 2 == 1)).otherwise(answer)
        return answer

    return contains


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    path_lengths: list[int],
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``pages`` with host, path, rule and verdict of every URL.

    ``rules`` has the columns verdict ('allow' or 'block'), host and path;
    ``path_lengths`` are the lengths of its paths.  A rule fits its host and all
    subdomains where the URL's path starts with the rule's.  The longest fitting
    rule, by characters of host and path, wins; of equally long ones the one with
    the longer host; a key listed with both verdicts blocks.  A URL on no list
    gets ``default`` and a null rule, as do null URLs and those without ://.
    Columns of ``pages`` named host, path, rule or verdict are replaced.
    """
    columns = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    url = F.col(f"`{url_col}`")
    keys = rule_keys(url_host(url), url_path(url), path_lengths)
    with Scratch(pages.sparkSession) as scratch:
        universe = scratch.store(pages.select(F.explode(keys).alias("key")).distinct())
        key = F.concat("host", "path").alias("key")
        blocked = scratch.store(rules.filter("verdict = 'block'").select(key).distinct())
        allowed = scratch.store(
            rules.filter("verdict = 'allow'").select(key).distinct().join(blocked, "key", "left_anti")
        )
        in_blocked = build_cascade(blocked, universe, scratch, seed=1)
        in_allowed = build_cascade(allowed, universe, scratch, seed=101)
    judged = F.transform(
        keys,
        lambda k: F.when(in_blocked(k), F.struct(k.alias("rule"), F.lit("block").alias("verdict"))).when(
            in_allowed(k), F.struct(k.alias("rule"), F.lit("allow").alias("verdict"))
        ),
    )
    first = F.get(F.filter(judged, lambda x: x.isNotNull()), F.lit(0))
    rows = pages.withColumn("__hit", first)
    return rows.select(
        *(F.col(f"`{c}`") for c in columns),
        url_host(url).alias("host"),
        url_path(url).alias("path"),
        F.col("__hit.rule").alias("rule"),
        F.coalesce(F.col("__hit.verdict"), F.lit(default)).alias("verdict"),
    )


def rule_table(spark, rules=RULES) -> tuple[DataFrame, list[int]]:
    """The rules as a table, and the lengths that their paths have."""
    rows = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    return rows, sorted({len(path) for _, _, path in rules})
