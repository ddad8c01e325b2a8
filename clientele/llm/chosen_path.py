"""Near duplicates by a chosen-path set similarity join.

A tree of nodes divides the documents.  A node asks each of its documents for the minwise
token of its set under one or two hash functions of the node's own, and documents with
equal answers go on to the same child.  Documents with a similarity of J give equal
answers with a probability of J, and a node has 1 / J0 children for each document on the
average, so pairs at the least similarity J0 neither die out nor multiply on their way
down, while less similar ones part.  Several independent trees raise the share of pairs
that meet in a leaf to ``RECALL``.

Small nodes are leaves: all their pairs are compared.  Near copies in great number never
part, so a large node first compares all its documents with one of them.  If at most some
thousands are not connected by links then, these are compared with all and nothing is left
to find in it; otherwise it goes on to branch.  At the last depth it is compared exhaustively, in tiles.  Compared pairs are first judged by
sketches; what may link is confirmed on the full sets.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import Scratch, mix, text_or_empty, text_slices
from clientele.llm.components import components
from clientele.llm.shingle_join import _digest, shingle_sets

WORDS = 2
PERCENT = 80
# Share of the pairs at the least similarity that shall meet in some leaf.
RECALL = 0.9999
# Documents of a node that is compared exhaustively, at most.
LEAF = 48
# A level is taken to thin unlike documents out by this factor; it only sets the depth at
# which nodes are looked at first.
THINNING = 128
# Levels below that depth on which large nodes branch before they are compared in tiles.
MORE_LEVELS = 3
# Members outside a large node's main component that are compared with all of it, at most, and
# their tokens; FEW of them are however many tokens they have.
OUTSIDE, OUTSIDE_TOKENS, FEW = 4096, 1 << 19, 128
# Bytes of a sketch, each of one minwise token; and how many must agree.  Pairs of the
# least similarity fall below that once in 800,000.
SKETCH, AGREE = 32, 14
SLICE_BYTES = 1_000_000
# Tokens of the members that a task compares with a node's outsiders at once, and of a portion
# of a node's members or outsiders, where a set counts SHORT tokens at least.
SLICE_TOKENS, PORTION_TOKENS, SHORT = 1 << 15, 1 << 18, 128

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_AGAIN = np.uint64(0xBF58476D1CE4E5B9)
_TREE, _SECOND, _TWICE = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3
_ROW = "path long, rep long, n long, sketch binary"


def _minwise(tokens: np.ndarray, starts: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """For each set the least of its tokens' numbers under a hash function of its seed."""
    h = (tokens ^ seeds) * _SPREAD
    h ^= h >> np.uint64(32)
    h *= _AGAIN
    return np.minimum.reduceat(h, starts)


def _children(tokens: np.ndarray, sizes: np.ndarray, paths: np.ndarray, percent: int):
    """(number of the set, child) for the nodes ``paths`` that the sets are in."""
    owner, child = [], []
    # A second function for so many nodes that they have 100 / percent on the average.
    twice = mix(paths ^ np.uint64(_TWICE)) < np.uint64(int((100 / percent - 1) * 2**64))
    for use, salt in ((np.ones(len(paths), bool), 0), (twice, _SECOND)):
        if not use.any():
            continue
        held = tokens if use.all() else tokens[np.repeat(use, sizes)]
        seeds = mix(paths[use] + np.uint64(salt))
        n = sizes[use]
        least = _minwise(held, np.cumsum(n) - n, np.repeat(seeds, n))
        owner.append(np.flatnonzero(use))
        child.append(mix(least ^ seeds))
    return np.concatenate(owner), np.concatenate(child)


def _paths(tokens: np.ndarray, sizes: np.ndarray, trees: int, depth: int, percent: int):
    """(number of the set, node) for all nodes at ``depth`` of all trees."""
    ends = np.cumsum(sizes)
    owners, nodes = [], []
    for tree in range(trees):
        root = np.full(len(sizes), mix(np.array([(tree + 1) * _TREE % 2**64], np.uint64))[0])
        # A set may be in several nodes; `at` tells which set each node's tokens are of.
        at, here, held, n = np.arange(len(sizes)), root, tokens, sizes
        for level in range(depth):
            if level and len(at) > len(sizes):
                held = np.concatenate([tokens] + [tokens[e - k : e] for e, k in zip(ends[at[len(sizes) :]], sizes[at[len(sizes) :]], strict=True)])
                n = sizes[at]
            owner, child = _children(held, n, here, percent)
            at, here = at[owner], child
            # The first answers of all sets come first, in the order of the sets.
        owners.append(at)
        nodes.append(here)
    return np.concatenate(owners), np.concatenate(nodes)


def _sketches(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), SKETCH), np.uint8)
    for k in range(SKETCH):
        seed = mix(np.array([k + 1], np.uint64))[0]
        out[:, k] = mix(_minwise(tokens, starts, seed)) & np.uint64(255)
    return out


def _profile(words: int, trees: int, depth: int, percent: int):
    """Tasks turn texts into size, digest, sketch and nodes of their sets."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in text_slices(batch, SLICE_BYTES):
                sets = shingle_sets(part.column("__text"), words)
                some = [i for i, s in enumerate(sets) if len(s)]
                if not some:
                    continue
                sets = [sets[i] for i in some]
                sizes = np.array([len(s) for s in sets], np.int64)
                tokens = np.concatenate(sets)
                owner, node = _paths(tokens, sizes, trees, depth, percent)
                order = np.argsort(owner, kind="stable")
                cuts = np.searchsorted(owner[order], np.arange(len(sets) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("__id").take(pa.array(some)),
                        pa.array(sizes),
                        pa.array([_digest(s) for s in sets], pa.binary()),
                        pa.array([s.tobytes() for s in _sketches(tokens, sizes)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(node[order].view(np.int64))),
                    ],
                    ["id", "n", "digest", "sketch", "paths"],
                )

    return run


def _alike(reps, sizes, sketches, owner, percent: int, comps=None):
    """Pairs of members of one node whose sizes and sketches allow a link."""
    found = []
    lag = 1
    while lag < len(owner):
        left = np.flatnonzero(owner[lag:] == owner[:-lag])
        if not len(left):
            break
        right = left + lag
        low, high = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
        near = (100 * low >= percent * high) & (reps[left] != reps[right])
        if comps is not None:
            near &= comps[left] != comps[right]
        left, right = left[near], right[near]
        near = (sketches[left] == sketches[right]).sum(axis=1) >= AGREE
        found.append(np.stack([reps[left[near]], reps[right[near]]], axis=1))
        lag += 1
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return np.unique(np.sort(pairs, axis=1), axis=0)


def _leaf_pairs(percent: int):
    """Pairs of all nodes of a batch; a node is a list of its members."""

    def run(batches):
        import pyarrow as pa

        # A few nodes at a time, so that their pairs stay few.
        for members in (b.column("members").slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            owner = np.repeat(np.arange(len(members)), np.diff(members.offsets.to_numpy()))
            members = members.flatten()
            reps, sizes, comps = (members.field(c).to_numpy(zero_copy_only=False) for c in ("rep", "n", "comp"))
            sketches = np.frombuffer(b"".join(members.field("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            pairs = _alike(reps, sizes, sketches, owner, percent, comps)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _with_pivot(percent: int):
    """Pairs of members of large nodes with the node's pivot."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            pivot = batch.column("pivot")
            a, b = (x.to_numpy(zero_copy_only=False) for x in (batch.column("rep"), pc.struct_field(pivot, "rep")))
            n, m = (x.to_numpy(zero_copy_only=False) for x in (batch.column("n"), pc.struct_field(pivot, "n")))
            one, two = (
                np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, SKETCH)
                for x in (batch.column("sketch"), pc.struct_field(pivot, "sketch"))
            )
            near = (a != b) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            near &= (one == two).sum(axis=1) >= AGREE
            a, b = a[near], b[near]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _outsider_links(percent: int):
    """Components that links of members with outsiders connect, by their full sets.

    A row lists some members of a node and some or all of its outsiders; each pair of
    components is given once.
    """

    def run(batches):
        import pyarrow as pa

        for rows in (b.column("rows")[i].values for b in batches for i in range(b.num_rows)):
            sets, comps = rows.field("hashes").to_pylist(), rows.field("comp").to_numpy()
            out = rows.field("out").to_numpy(zero_copy_only=False)
            sizes = np.array([len(s) // 8 for s in sets], np.int64)
            # No count of common tokens exceeds the largest set.
            kind = np.uint16 if sizes.max() < 1 << 16 else np.int32
            mine, others = np.flatnonzero(~out), np.flatnonzero(out)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes[mine]) // SLICE_TOKENS)) + 1
            found = [np.zeros((0, 2), np.int64)]
            for at in range(0, len(others), 64):
                block = others[at : at + 64]
                tokens, place = np.unique(np.frombuffer(b"".join(sets[i] for i in block), np.uint64), return_inverse=True)
                # Which of the block's sets hold a token; the last line is for unknown tokens.
                holds = np.zeros((len(tokens) + 1, len(block)), kind)
                holds[place, np.repeat(np.arange(len(block)), sizes[block])] = 1
                for some in np.split(mine, cuts):
                    if not len(some):
                        continue
                    held = np.frombuffer(b"".join(sets[i] for i in some), np.uint64)
                    line = np.searchsorted(tokens, held)
                    line[tokens[np.minimum(line, len(tokens) - 1)] != held] = len(tokens)
                    n = sizes[some]
                    both = np.add.reduceat(holds[line], np.cumsum(n) - n, axis=0, dtype=kind).astype(np.int64)
                    linked = 100 * both >= percent * (n[:, None] + sizes[block] - both)
                    linked &= comps[some][:, None] != comps[block]
                    one, two = np.nonzero(linked)
                    found.append(np.stack([comps[some][one], comps[block][two]], axis=1))
            pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _star(pairs: np.ndarray) -> np.ndarray:
    """Pairs that connect the same numbers, each with the smallest that it hangs together with."""
    ends, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    low, was = np.arange(len(ends)), None
    while was is None or (low != was).any():
        was, low = low, low.copy()
        least = np.minimum(was[a], was[b])
        np.minimum.at(low, was[a], least)
        np.minimum.at(low, was[b], least)
        while (low[low] != low).any():
            low = low[low]
    other = low != np.arange(len(ends))
    return np.stack([ends[low[other]], ends[other]], axis=1)


def _outsider_stars(percent: int):
    """Like ``_outsider_links``, with one pair for each component that a row's links connect."""

    def run(batches):
        import pyarrow as pa

        for found in _outsider_links(percent)(batches):
            pairs = _star(np.stack([found.column(c).to_numpy() for c in ("a", "b")], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _sets(words: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in text_slices(batch, SLICE_BYTES):
                sets = shingle_sets(part.column("__text"), words)
                some = [i for i, s in enumerate(sets) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("__id").take(pa.array(some, pa.int64())), pa.array([sets[i].tobytes() for i in some], pa.binary())],
                    ["rep", "hashes"],
                )

    return run


def _branch(percent: int):
    """The children of large nodes, for each of their members."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            # One document at a time: its set is asked once for every node that it is in.
            for i in range(batch.num_rows):
                tokens = np.frombuffer(batch.column("hashes")[i].as_buffer(), np.uint64)
                paths = np.array(batch.column("paths")[i].as_py(), np.int64).view(np.uint64)
                repeated = np.tile(tokens, len(paths))
                child = _children(repeated, np.full(len(paths), len(tokens)), paths, percent)[1]
                same = pa.array(np.full(len(child), i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(child.view(np.int64))] + [batch.column(c).take(same) for c in ("rep", "n", "sketch")],
                    ["path", "rep", "n", "sketch"],
                )

    return run


def _confirm(percent: int):
    """Links among pairs, by their full sets."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def survival(depth: int, percent: int) -> float:
    """Share of the pairs at the least similarity that are together at a depth of one tree."""
    share, second = percent / 100, 100 / percent - 1
    dead = 0.0
    for _ in range(depth):
        one = 1 - share + share * dead
        dead = (1 - second) * one + second * one * one
    return 1 - dead


class _Search:
    """Nodes, pairs and links while the trees are searched."""

    def __init__(self, scratch: Scratch, texts: DataFrame, words: int, percent: int):
        self.scratch, self.texts, self.words, self.percent = scratch, texts, words, percent
        # (rep, comp) of all documents that have links.
        self.comps: DataFrame | None = None
        self.sets: DataFrame | None = None
        # Pairs whose full sets have been compared.
        self.tested: list[DataFrame] = []

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows with the component that the links found so far put them in."""
        if self.comps is None:
            return rows.withColumn("comp", F.col("rep"))
        return rows.join(self.comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    def load_sets(self, reps: DataFrame) -> None:
        """The full sets of these documents, one row for each different set."""
        found = (
            self.texts.join(reps.select(F.col("rep").alias("__id")).distinct(), "__id")
            .mapInArrow(_sets(self.words), "rep long, hashes binary")
            .groupBy("rep", F.xxhash64("hashes"))
            .agg(F.first("hashes").alias("hashes"))
        )
        self.sets = self.scratch.store_bucketed(found.select("rep", "hashes"), "rep")

    def divided(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of small and of large nodes; a node of one component has nothing to find."""
        rows = self.placed(rows)
        nodes = rows.groupBy("path").agg(
            F.count(F.lit(1)).alias("members"), F.min("comp").alias("low"), F.max("comp").alias("high")
        )
        open_nodes = nodes.filter("low < high").select("path", "members")
        rows = self.scratch.store(rows.join(open_nodes, "path"))
        small = rows.filter(F.col("members") <= LEAF).drop("members")
        return small, rows.filter(F.col("members") > LEAF).drop("members")

    def pairs(self, small: DataFrame, large: DataFrame) -> DataFrame:
        """Pairs that may link: all of small nodes, those with the pivot of large ones."""
        members = F.collect_list(F.struct("rep", "n", "sketch", "comp")).alias("members")
        within = small.groupBy("path").agg(members).select("members")
        within = within.mapInArrow(_leaf_pairs(self.percent), "a long, b long")
        by_chance = F.struct(F.xxhash64("path", "rep").alias("h"), "rep", "n", "sketch", "comp")
        pivots = large.groupBy("path").agg(F.min(by_chance).alias("pivot"))
        star = large.join(pivots, "path").filter("comp != pivot.comp").select("rep", "n", "sketch", "pivot")
        star = star.mapInArrow(_with_pivot(self.percent), "a long, b long")
        return self.scratch.store(within.unionByName(star).distinct())

    def confirm(self, pairs: DataFrame) -> None:
        """Links that connect whatever these pairs can connect.

        First every document is compared with the smallest of its partners; then only
        pairs that this has not connected.
        """
        if self.tested:
            known = reduce(DataFrame.unionByName, self.tested)
            pairs = self.scratch.store(pairs.join(known, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            return
        self.tested.append(pairs)
        first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        for chosen in (first, None):
            if chosen is None:
                low = self.placed(pairs.withColumnRenamed("a", "rep")).withColumnsRenamed({"rep": "a", "comp": "low"})
                both = self.placed(low.withColumnRenamed("b", "rep")).withColumnsRenamed({"rep": "b", "comp": "high"})
                chosen = self.scratch.store(both.filter("low != high").select("a", "b"))
                if chosen.isEmpty():
                    return
            left = self.sets.select(F.col("rep").alias("a"), F.col("hashes").alias("left"))
            right = self.sets.select(F.col("rep").alias("b"), F.col("hashes").alias("right"))
            linked = chosen.join(right, "b").join(left, "a").select("a", "b", "left", "right")
            self.connect(self.scratch.store(linked.mapInArrow(_confirm(self.percent), "a long, b long")))

    def connect(self, links: DataFrame) -> None:
        """Merge the components of linked documents."""
        if links.isEmpty():
            return
        if self.comps is not None:
            # Each component so far is a star of links.
            known = self.comps.filter("rep != comp").select(F.col("rep").alias("a"), F.col("comp").alias("b"))
            links = links.unionByName(known)
        found = components(links, self.scratch)
        self.comps = found.withColumnsRenamed({"node": "rep", "component": "comp"})

    def close(self, large: DataFrame) -> DataFrame:
        """Finish nodes with one main component; returns the rows of the other nodes.

        Where at most OUTSIDE members are outside the main component, each of them is compared
        with all members, and nothing is left to find in the node.  Portions of members meet
        portions of outsiders, and only what is connected leaves the tasks, not the pairs.
        """
        parts = large.groupBy("path", "comp").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("tokens"))
        nodes = parts.groupBy("path").agg(
            F.sum("members").alias("members"),
            F.sum("tokens").alias("tokens"),
            F.max(F.struct("members", "comp", "tokens")).alias("main"),
        )
        outside = (F.col("members") - F.col("main.members")).alias("outside")
        tokens = F.col("tokens") - F.col("main.tokens")
        few = (F.col("outside") <= FEW) | (F.col("tokens") <= OUTSIDE_TOKENS)
        nodes = nodes.select("path", "members", outside, tokens.alias("tokens"), F.col("main.comp").alias("main"))
        nodes = self.scratch.store(nodes.filter(few & (F.col("outside") <= OUTSIDE)).drop("tokens"))
        rows = self.scratch.store(large.join(nodes.select("path", "main"), "path").select("path", "main", "rep", "n", "comp"))
        # Several trees put much the same documents together: nodes with the same main component
        # are taken as one, unless that makes many more pairs.
        pairs = nodes.groupBy("main").agg(F.sum(F.col("members") * F.col("outside")).alias("pairs"))
        joint = rows.groupBy("main", "rep").agg(F.max("comp").alias("comp")).groupBy("main").agg(
            F.count(F.lit(1)).alias("members"), F.count(F.when(F.col("comp") != F.col("main"), 1)).alias("outside")
        )
        # Stored, so that its size is known: rows need not be dealt by their main component.
        joint = joint.join(pairs, "main").filter("members * outside <= 2 * pairs").select("main", F.lit(True).alias("joint"))
        joint = self.scratch.store(joint)
        joint = rows.join(joint, "main", "left").withColumn("joint", F.coalesce("joint", F.lit(False)))
        node = F.when(F.col("joint"), F.col("main")).otherwise(F.col("path")).alias("node")
        joint = joint.groupBy("joint", node, "main", "rep", "comp").agg(F.max("n").alias("n"))
        joint = self.scratch.store(joint)
        sides = joint.groupBy("joint", "node").agg(
            *(
                F.ceil(F.sum(F.when(part, F.greatest("n", F.lit(SHORT)))) / PORTION_TOKENS).cast("int").alias(name)
                for name, part in (("wide", F.lit(True)), ("deep", F.col("comp") != F.col("main")))
            )
        )
        joint = joint.join(sides, ["joint", "node"])
        own = [F.pmod(F.xxhash64("rep"), F.col(c)).cast("int") for c in ("wide", "deep")]
        every = [F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("wide", "deep")]
        cell = ["joint", "node", "portion", "block"]
        members = joint.select("joint", "node", own[0].alias("portion"), every[1].alias("block"), "rep", "comp", F.lit(False).alias("out"))
        others = joint.filter("comp != main")
        others = others.select("joint", "node", every[0].alias("portion"), own[1].alias("block"), "rep", "comp", F.lit(True).alias("out"))
        listed = F.collect_list(F.struct("comp", "out", "hashes")).alias("rows")
        found = members.unionByName(others).join(self.sets, "rep").groupBy(*cell).agg(listed)
        found = found.select("rows").mapInArrow(_outsider_stars(self.percent), "a long, b long")
        self.connect(self.scratch.store(found.distinct()))
        return large.join(nodes, "path", "left_anti")

    def tiles(self, large: DataFrame) -> DataFrame:
        """All pairs of large nodes that may link, tile by tile."""
        sizes = large.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / (LEAF // 2)).cast("int").alias("wide"))
        rows = large.join(sizes, "path").withColumn("own", F.pmod(F.xxhash64("rep", "path"), F.col("wide")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("wide") - 1))
        rows = rows.withColumn("other", other)
        tile = ["path", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two")]
        members = F.collect_list(F.struct("rep", "n", "sketch", "comp")).alias("members")
        found = rows.groupBy(*tile).agg(members).select("members")
        found = found.mapInArrow(_leaf_pairs(self.percent), "a long, b long")
        return self.scratch.store(found.distinct())


def chosen_path_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    recall: float = RECALL,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every document.

    Two documents link when their sets of ``words``-word shingles (A-Z lower-cased) have
    a Jaccard similarity of at least ``percent`` / 100; component_id is the smallest id
    reachable by links, and the document with that id is kept.  A pair of the least
    similarity is found with a probability of ``recall``, a more similar one with a
    higher one; no link is reported that the full sets do not confirm.

    Null or empty texts have no shingles, link with nothing and are kept; a text with fewer
    words is one shingle.  Rows without an id are kept, with null in the columns between.
    An id on several rows is one node whose texts all count; n_shingles is the largest.
    Other columns are not read.  Shingles are compared as 64-bit numbers.
    """
    if not 50 < percent <= 100:
        raise ValueError("nodes have one or two functions: percent must be above 50, up to 100")
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), text_or_empty(text_col).alias("__text"))
    named = rows.filter("__id is not null")
    scratch = Scratch(docs.sparkSession)
    with scratch:
        count = named.count()
        depth = max(1, math.ceil(math.log(max(2, count / LEAF)) / math.log(THINNING)))
        # Large nodes branch further, so the trees reckon with two more levels.
        trees = math.ceil(math.log(1 - recall) / math.log(1 - survival(depth + 2, percent)))
        profiles = scratch.store(
            named.mapInArrow(
                _profile(words, trees, depth, percent),
                "id long, n long, digest binary, sketch binary, paths array<long>",
            )
        )
        classes = scratch.store(
            profiles.groupBy("digest").agg(
                F.min("id").alias("rep"), F.first("n").alias("n"),
                F.first("sketch").alias("sketch"), F.first("paths").alias("paths"),
            )
        )
        search = _Search(scratch, named, words, percent)
        nodes = classes.select(F.explode("paths").alias("path"), "rep", "n", "sketch")
        small, large = search.divided(nodes)
        pairs = search.pairs(small, large)
        ends = pairs.select(F.explode(F.array("a", "b")).alias("rep"))
        search.load_sets(ends.unionByName(large.select("rep")))
        search.confirm(pairs)
        for level in range(MORE_LEVELS + 1):
            large = search.divided(large.select("path", "rep", "n", "sketch"))[1]
            if large.isEmpty():
                break
            large = search.close(large)
            if large.isEmpty():
                break
            if level == MORE_LEVELS:
                search.confirm(search.tiles(large))
                break
            member = F.collect_list("path").alias("paths")
            below = large.groupBy("rep", "n", "sketch").agg(member).join(search.sets, "rep")
            small, large = search.divided(scratch.store(below.mapInArrow(_branch(percent), _ROW)))
            search.confirm(search.pairs(small, large))
        # The sets of an id that is on several rows hang together.
        owned = profiles.select("id", "digest").join(classes.select("digest", "rep", "n"), "digest")
        owned = scratch.store(owned.groupBy("id", "rep").agg(F.max("n").alias("n")))
        several = owned.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last"))
        several = several.filter("a < last").select("id", "a").join(owned, "id")
        search.connect(several.select("a", F.col("rep").alias("b")))
        # The smallest id of a class stands for it, so the smallest of these is the component.
        per_id = search.placed(owned).groupBy("id").agg(F.max("n").alias("n"), F.min("comp").alias("component"))
        result = rows.select("__id").join(per_id, F.col("__id") == F.col("id"), "left")
        component = F.coalesce("component", "__id")
        result = result.select(
            F.col("__id").alias(id_col),
            F.when(F.col("__id").isNotNull(), F.coalesce("n", F.lit(0).cast("long"))).alias("n_shingles"),
            component.alias("component_id"),
            F.coalesce(component == F.col("__id"), F.lit(True)).alias("kept"),
        )
        return scratch.keep(result)
