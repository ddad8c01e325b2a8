"""Jaccard join of documents on word shingles by T-occurrence search."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import Scratch, mix, text_bytes, text_or_empty, word_hashes
from clientele.llm.components import components

WORDS = 5
PERCENT = 75
# Text that one range of hash values is meant to hold, and entries of one block.
RANGE_BYTES = 8_000_000
BLOCK_ENTRIES = 1_000_000
# Leading bits by which shingles are counted: numbers that agree in them count as one, so
# counts may be too high, never too low.
COUNTED = 48
SLICE_BYTES = 4_000_000
# Sets of the largest cluster that one task searches as a whole.
TILE = 128
# Sets of a larger cluster, and their shingles, of which one task gets two portions.
PORTION = 4_096
PORTION_ENTRIES = 1_000_000

_STEP = np.array(
    [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
     0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25],
    np.uint64,
) | np.uint64(1)


def _slices(batch):
    """Parts of an Arrow batch with about SLICE_BYTES of text each."""
    at = 0
    sizes = np.cumsum(np.diff(text_bytes(batch.column("__text"))[1]))
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + SLICE_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def shingle_sets(column, words: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct shingles, as sorted 64-bit numbers.

    With fewer words than ``words`` the whole sequence is one shingle; a text
    without words has none.
    """
    hashes, first = word_hashes(column)
    steps = np.resize(_STEP, words) * (np.arange(words, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    full = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        full += hashes[k : k + len(full)] * steps[k]
    full = mix(full)
    sets = []
    for begin, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = end - begin
        if n >= words:
            sets.append(np.unique(full[begin : end - words + 1]))
        elif n:
            short = (hashes[begin:end] * steps[:n]).sum(dtype=np.uint64) + np.uint64(n)
            sets.append(mix(np.array([short], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _cuts(sorted_hashes: np.ndarray, ranges: int):
    """(range, from, to) of the non-empty ranges of sorted hashes."""
    owner = _range_of(sorted_hashes, ranges)
    starts = np.r_[0, np.flatnonzero(owner[1:] != owner[:-1]) + 1] if len(owner) else []
    for s, e in zip(starts, [*starts[1:], len(owner)], strict=True):
        yield int(owner[s]), int(s), int(e)


def _gaps(sorted_values: np.ndarray) -> bytes:
    """The leading COUNTED bits of sorted numbers as differences, in 4 bytes each where those suffice."""
    sorted_values = sorted_values >> np.uint64(64 - COUNTED)
    gaps = np.diff(sorted_values, prepend=sorted_values[:1])
    head = sorted_values[:1].tobytes()
    if gaps.max(initial=0) < 2**32:
        return b"4" + head + gaps.astype(np.uint32).tobytes()
    return b"8" + head + gaps.tobytes()


def _ungaps(packed: bytes) -> np.ndarray:
    kind = np.uint32 if packed[:1] == b"4" else np.uint64
    gaps = np.frombuffer(packed, kind, offset=9).astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64) + np.frombuffer(packed, np.uint64, 1, 1)


def _place_kind(documents: int):
    """The type of places in a block of so many documents."""
    return np.uint16 if documents <= 65536 else np.uint32


_PARTS = "range int, block long, ids binary, sizes binary, digests binary, values binary, owners binary"


def _split_blocks(ranges: int, words: int):
    """Tasks read texts and send each range its part of the shingles of a block."""

    def flush(block, ids, sets):
        sizes = np.array([len(s) for s in sets], np.int64)
        digests = [_digest(s) for s in sets]
        short = np.frombuffer(b"".join(digests), np.uint64)[::2]
        yield {
            "range": block % ranges, "block": block, "ids": np.array(ids, np.int64).tobytes(),
            "sizes": sizes.tobytes(), "digests": b"".join(digests), "values": None, "owners": None,
        }
        values = np.concatenate(sets)
        owners = np.repeat(np.arange(len(sets), dtype=_place_kind(len(sets))), sizes)
        order = np.argsort(values, kind="stable")
        values, owners = values[order], owners[order]
        for r, s, e in _cuts(values, ranges):
            yield {
                "range": r, "block": block, "ids": None, "sizes": None,
                "digests": short[np.unique(owners[s:e])].tobytes(),
                "values": _gaps(values[s:e]), "owners": owners[s:e].tobytes(),
            }

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema(
            [("range", pa.int32()), ("block", pa.int64())]
            + [(c, pa.binary()) for c in ("ids", "sizes", "digests", "values", "owners")]
        )
        base, count = TaskContext.get().partitionId() << 32, 0
        ids, sets, entries = [], [], 0
        for batch in batches:
            for part in _slices(batch):
                for i, s in zip(
                    part.column("__id").to_pylist(), shingle_sets(part.column("__text"), words),
                    strict=True,
                ):
                    if len(s):
                        ids.append(i)
                        sets.append(s)
                        entries += len(s)
                    if entries >= BLOCK_ENTRIES:
                        yield pa.RecordBatch.from_pylist(list(flush(base + count, ids, sets)), schema)
                        ids, sets, entries, count = [], [], 0, count + 1
        if ids:
            yield pa.RecordBatch.from_pylist(list(flush(base + count, ids, sets)), schema)

    return run


def _repeated_in_range(rows: pd.DataFrame) -> pd.DataFrame:
    """For each block, how many shingles of a document other sets hold as well."""
    heads = rows[rows["values"].isna()]
    parts = rows[rows["values"].notna()]
    out = [(b, i, s, d, None) for b, i, s, d in zip(heads.block, heads.ids, heads.sizes, heads.digests)]
    if len(parts):
        values = [_ungaps(v) for v in parts["values"]]
        held = []
        for v, o in zip(values, parts.owners, strict=True):
            assert len(o) in (2 * len(v), 4 * len(v))
            kind = np.uint16 if len(o) == 2 * len(v) else np.uint32
            held.append(np.unique(np.frombuffer(o, kind), return_inverse=True))
        sets = np.concatenate(
            [np.frombuffer(d, np.uint64)[p] for d, (_, p) in zip(parts.digests, held, strict=True)]
        )
        every = np.concatenate(values)
        order = np.argsort(every, kind="stable")
        every, sets = every[order], sets[order]
        starts = np.r_[0, np.flatnonzero(every[1:] != every[:-1]) + 1]
        shared = np.minimum.reduceat(sets, starts) != np.maximum.reduceat(sets, starts)
        flags = np.empty(len(every), bool)
        flags[order] = np.repeat(shared, np.diff(np.r_[starts, len(every)]))
        at = 0
        for b, (present, p) in zip(parts.block, held, strict=True):
            counts = np.bincount(p[flags[at : at + len(p)]], minlength=len(present))
            at += len(p)
            some = np.flatnonzero(counts)
            if len(some):
                kind = np.uint8 if counts.max() < 256 else np.uint32
                out.append((b, present[some].tobytes(), None, None, counts[some].astype(kind).tobytes()))
    return pd.DataFrame(out, columns=["block", "ids", "sizes", "digests", "counts"])


def _sum_block(rows: pd.DataFrame) -> pd.DataFrame:
    head = rows[rows["counts"].isna()].iloc[0]
    ids, sizes = np.frombuffer(head.ids, np.int64), np.frombuffer(head.sizes, np.int64)
    total = np.zeros(len(ids), np.int64)
    for present, counts in zip(rows["ids"], rows["counts"], strict=True):
        if counts is not None and not isinstance(counts, float):
            present = np.frombuffer(present, _place_kind(len(ids)))
            total[present] += np.frombuffer(counts, np.uint8 if len(counts) == len(present) else np.uint32)
    digests = [head.digests[i : i + 16] for i in range(0, len(head.digests), 16)]
    return pd.DataFrame({"id": ids, "n": sizes, "digest": digests, "shared": total})


def _profiles(docs: DataFrame, ranges: int, words: int) -> DataFrame:
    """(id, n, digest, shared) of each document with words.

    shared: how many of its shingles occur in a different set too; counted on COUNTED
    bits, it may be too high by chance but never too low.
    """
    parts = docs.mapInArrow(_split_blocks(ranges, words), _PARTS)
    found = parts.groupBy("range").applyInPandas(
        _repeated_in_range, "block long, ids binary, sizes binary, digests binary, counts binary"
    )
    return found.groupBy("block").applyInPandas(
        _sum_block, "id long, n long, digest binary, shared long"
    )


def _pack_sets(words: int):
    """Sets of the survivors, many to a row."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("block", pa.int64()), ("reps", pa.binary()), ("sizes", pa.binary()), ("hashes", pa.binary())])
        base, count = TaskContext.get().partitionId() << 32, 0
        reps, sets = [], []

        def row():
            return pa.RecordBatch.from_pylist(
                [{
                    "block": base + count, "reps": np.array(reps, np.int64).tobytes(),
                    "sizes": np.array([len(s) for s in sets], np.int64).tobytes(),
                    "hashes": np.concatenate(sets).tobytes(),
                }], schema,
            )

        for batch in batches:
            for part in _slices(batch):
                for rep, digest, s in zip(
                    part.column("rep").to_pylist(), part.column("digest").to_pylist(),
                    shingle_sets(part.column("__text"), words), strict=True,
                ):
                    # Another row may repeat the id with another text.
                    if len(s) and _digest(s) == digest:
                        reps.append(rep)
                        sets.append(s)
                if sum(map(len, sets)) >= BLOCK_ENTRIES:
                    yield row()
                    reps, sets, count = [], [], count + 1
        if reps:
            yield row()

    return run


def _unpack(row):
    reps, sizes = np.frombuffer(row.reps, np.int64), np.frombuffer(row.sizes, np.int64)
    return reps, sizes, np.frombuffer(row.hashes, np.uint64)


def _block_entries(ranges: int):
    def run(frames):
        for frame in frames:
            for row in frame.itertuples():
                values = np.sort(_unpack(row)[2])
                out = [(r, row.block, _gaps(values[s:e])) for r, s, e in _cuts(values, ranges)]
                yield pd.DataFrame(out, columns=["range", "block", "values"])

    return run


def _frequency_classes(rows: pd.DataFrame) -> pd.DataFrame:
    """For each entry the binary logarithm of its number of documents, 0 for one."""
    values = [_ungaps(v) for v in rows["values"]]
    every = np.concatenate(values)
    order = np.argsort(every, kind="stable")
    every = every[order]
    starts = np.r_[0, np.flatnonzero(every[1:] != every[:-1]) + 1]
    lengths = np.diff(np.r_[starts, len(every)])
    classes = np.empty(len(every), np.uint8)
    classes[order] = np.repeat(np.ceil(np.log2(lengths)).astype(np.uint8), lengths)
    cuts = np.cumsum([len(v) for v in values])[:-1]
    return pd.DataFrame(
        {"block": rows["block"], "range": rows["range"],
         "classes": [c.tobytes() for c in np.split(classes, cuts)]}
    )


def _prefixes(ranges: int, percent: int):
    """Rarest-first prefixes of a block's sets, as lists for the ranges.

    Two sets that link share an element among the first n - need + 1 of either
    one, in any order that holds for all sets; rare elements come first here.
    Elements that no other set holds lead nowhere, and a set with fewer shared
    elements than it needs links with nothing.
    """

    def run(blocks: pd.DataFrame, classes: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in blocks.itertuples():
            reps, sizes, hashes = _unpack(row)
            owners = np.repeat(np.arange(len(reps)), sizes)
            by_value = np.argsort(hashes, kind="stable")
            level = np.empty(len(hashes), np.uint8)
            level[by_value] = np.concatenate(
                [np.frombuffer(c, np.uint8) for c in classes.sort_values("range")["classes"]]
            )
            order = np.lexsort((hashes, level, owners))
            owners, hashes, level = owners[order], hashes[order], level[order]
            need = -(-sizes * percent // 100)
            able = np.bincount(owners, level > 0, minlength=len(reps)) >= need
            place = np.arange(len(owners)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            use = able[owners] & (level > 0) & (place < (sizes - need + 1)[owners])
            hashes, owners = hashes[use], owners[use]
            order = np.argsort(hashes, kind="stable")
            hashes, owners = hashes[order], owners[order]
            out += [
                (r, hashes[s:e].tobytes(), reps[owners[s:e]].tobytes(), sizes[owners[s:e]].tobytes())
                for r, s, e in _cuts(hashes, ranges)
            ]
        return pd.DataFrame(out, columns=["range", "hashes", "reps", "sizes"])

    return run


def _stars(percent: int):
    """Candidate edges of a range's lists: to the smallest id of a run of like sizes.

    A list sorted by size is cut where a set is too large for the one before it;
    sets on different sides cannot link.  The edges are as many as the entries.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        hashes = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["hashes"]])
        reps = np.concatenate([np.frombuffer(x, np.int64) for x in rows["reps"]])
        sizes = np.concatenate([np.frombuffer(x, np.int64) for x in rows["sizes"]])
        order = np.lexsort((sizes, hashes))
        hashes, reps, sizes = hashes[order], reps[order], sizes[order]
        cut = (hashes[1:] != hashes[:-1]) | (100 * sizes[:-1] < percent * sizes[1:])
        starts = np.r_[0, np.flatnonzero(cut) + 1]
        low = np.repeat(np.minimum.reduceat(reps, starts), np.diff(np.r_[starts, len(reps)]))
        pairs = np.unique(np.stack([reps, low], axis=1)[reps != low], axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


# --- T-occurrence search within one task ---------------------------------------


def _overlap_needed(a: int, b: int, percent: int) -> int:
    """Smallest intersection with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def divide_skip(lists: list, needed, least: int) -> dict[int, int]:
    """Ids that occur in at least ``needed(id)`` of the sorted ``lists``, with counts that suffice.

    ``needed`` may also be an array by id; ``least``, at least 1, is its smallest value.
    The longest lists, fewer than ``least``, are set aside; the short ones are merged by
    counting, and the ids that occur there often enough to make it are looked up in the
    long ones by binary search.
    """
    lists = sorted((np.asarray(x, np.int64) for x in lists if len(x)), key=len)
    if len(lists) < least:
        return {}
    longest = len(lists[-1])
    skip = min(least - 1, int(least / (0.05 * math.log2(longest + 1) + 1)))
    short, long = lists[: len(lists) - skip], lists[len(lists) - skip :]
    counts = np.bincount(np.concatenate(short))
    items = np.flatnonzero(counts >= least - skip)
    counts = counts[items]
    need = needed[items] if isinstance(needed, np.ndarray) else np.array([needed(i) for i in items.tolist()], np.int64)
    for left in range(skip, -1, -1):
        able = counts + left >= need
        if not able.all():
            items, need, counts = items[able], need[able], counts[able]
        if not left or (counts >= need).all():
            break
        values = long[left - 1]
        at = np.minimum(np.searchsorted(values, items), len(values) - 1)
        counts = counts + (values[at] == items)
    return dict(zip(items.tolist(), counts.tolist(), strict=True))


def _differences(sets: list[np.ndarray], sizes: np.ndarray):
    """Inverted lists of what sets have apart from their core: what most of them hold.

    Returns the size of the core, how much of it each set holds, the lists one after the
    other (ids of the sets that hold an element outside the core or lack one inside, only
    lists of several sets) with their borders, and for each set the lists that it is on.  Two sets share as many elements as
    they are on lists together, plus what each holds of the core, less the core.  Near
    copies hold the same for the most part, and then the lists are short.
    """
    count = len(sets)
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(count), sizes)
    common = 2 * np.bincount(element) > count
    inside = common[element]
    within = np.bincount(owners[inside], minlength=count)
    core = np.flatnonzero(common)
    lacks = np.ones((count, len(core)), bool)
    lacks[owners[inside], (np.cumsum(common) - 1)[element[inside]]] = False
    lacking, lacked = np.nonzero(lacks)
    owners = np.concatenate([owners[~inside], lacking])
    element = np.concatenate([element[~inside], core[lacked]])
    several = np.bincount(element, minlength=1)[element] > 1
    owners, element = owners[several], element[several]
    order = np.lexsort((owners, element))
    owners, element = owners[order], element[order]
    new = np.ones(len(element), bool)
    new[1:] = element[1:] != element[:-1]
    number = np.cumsum(new) - 1
    borders = np.append(np.flatnonzero(new), len(owners))
    order = np.argsort(owners, kind="stable")
    on = np.split(number[order], np.cumsum(np.bincount(owners, minlength=count))[:-1])
    return len(core), within, owners, borders, on


def linked_groups(
    sets: list[np.ndarray], percent: int = PERCENT, known=None, asking=None
) -> list[tuple[int, int]]:
    """Links between these sets that connect whatever any link connects.

    Every set in turn is a query against the inverted lists of the others, without
    those that links already connect with it: such a link could join nothing.
    ``known``: numbers of groups whose members are connected already; the largest of
    them need not ask.  ``asking``: which sets are queries, all others being connected
    with each other or compared elsewhere.
    """
    count = len(sets)
    if count < 2:
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    label = np.arange(count) if known is None else np.unique(known, return_inverse=True)[1]
    apart = len(np.unique(label))
    queries = label != np.bincount(label).argmax() if asking is None else np.asarray(asking, bool)
    if apart == 1 or not queries.any():
        return []
    core, within, ids, borders, on = _differences(sets, sizes)
    links = []
    asked = np.zeros(count, bool)

    def join(q: int, found: np.ndarray) -> None:
        nonlocal apart
        labels, first = np.unique(label[found], return_index=True)
        links.extend((q, i) for i in found[first].tolist())
        label[np.isin(label, labels)] = label[q]
        apart -= len(labels)

    for q in np.flatnonzero(queries).tolist():
        if apart == 1:
            break
        able = (label != label[q]) & ~asked
        asked[q] = True
        able &= 100 * np.minimum(sizes, sizes[q]) >= percent * np.maximum(sizes, sizes[q])
        need = _overlap_needed(sizes[q], sizes, percent) + core - within[q] - within
        sure = np.flatnonzero(able & (need <= 0))
        if len(sure):
            join(q, sure)
            able &= label != label[q]
        if not able.any():
            continue
        least = int(need[able].min())
        if len(on[q]) < least:
            continue
        need[~able] = len(on[q]) + 1
        ends = zip(borders[on[q]].tolist(), borders[on[q] + 1].tolist(), strict=True)
        found = divide_skip([ids[s:e] for s, e in ends], need, least)
        if found:
            join(q, np.fromiter(found, np.int64))
    return links


def _search(percent: int):
    """Links of the sets that ask with all sets of two portions."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("rep")
        reps = rows["rep"].tolist()
        sets = [np.frombuffer(h, np.uint64) for h in rows["hashes"]]
        links = linked_groups(sets, percent, rows["part"].to_numpy(), rows["asks"].to_numpy())
        return pd.DataFrame([(reps[i], reps[j]) for i, j in links], columns=["a", "b"])

    return run


def _search_clusters(percent: int):
    """Links within each of several clusters."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("rep").sort_values("cluster", kind="stable")
        cluster, reps = rows["cluster"].to_numpy(), rows["rep"].tolist()
        sets = [np.frombuffer(h, np.uint64) for h in rows["hashes"]]
        starts = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1]]).tolist()
        links = [
            (reps[s + i], reps[s + j])
            for s, e in zip(starts, [*starts[1:], len(sets)], strict=True)
            for i, j in linked_groups(sets[s:e], percent)
        ]
        return pd.DataFrame(links, columns=["a", "b"])

    return run


def _probe(percent: int):
    """Links among pairs of sets: one is looked up in the other by binary search."""

    def run(frames):
        for frame in frames:
            keep = []
            for x, y in zip(frame["left"], frame["right"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(both >= _overlap_needed(len(x), len(y), percent))
            yield frame.loc[keep, ["a", "b"]]

    return run


def _rows_of_blocks(frames):
    for frame in frames:
        for row in frame.itertuples():
            reps, sizes, hashes = _unpack(row)
            sets = np.split(hashes, np.cumsum(sizes)[:-1])
            yield pd.DataFrame({"rep": reps, "hashes": [s.tobytes() for s in sets]})


def _portions(members: DataFrame, percent: int) -> DataFrame:
    """``members`` with a band of like sizes and a portion of it, ends of (cluster, outside).

    Sets that link are in one band or in neighbouring ones.  A portion has about PORTION
    sets and PORTION_ENTRIES shingles at most.
    """
    band = F.floor(F.log("n") / F.lit(math.log(max(100 / percent, 1.05))) + F.lit(1e-9)).cast("int")
    members = members.withColumn("band", band)
    place = ["cluster", "outside", "band"]
    wide = members.groupBy(*place).agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / PORTION, F.sum("n") / PORTION_ENTRIES)).cast("int").alias("wide")
    )
    return members.join(wide, place).withColumn("portion", F.pmod(F.xxhash64("rep"), F.col("wide")).cast("int"))


def _links(sets: DataFrame, stars: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links that connect the classes as all links do.

    Candidate edges fall into clusters; sets of different clusters cannot link.  A
    cluster of up to TILE sets is searched as a whole.  In a larger one the edges
    themselves are checked first, set against set, which connects most of it.  What is
    not in the cluster's largest connected part is then searched against the cluster,
    portion by portion, so that no task ever gets more than two portions.
    """
    clusters = components(stars, scratch).withColumnsRenamed({"node": "rep", "component": "cluster"})
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    clusters = scratch.store(clusters.join(sizes, "cluster"))
    sets = scratch.store(sets.join(clusters, "rep"))
    small = sets.filter(F.col("members") <= TILE)
    entries = small.agg(F.sum(F.expr("octet_length(hashes) div 8"))).first()[0] or 0
    least = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(least, math.ceil(entries / PORTION_ENTRIES))
    within = (
        small.select("cluster", "rep", "hashes")
        .groupBy(F.pmod(F.xxhash64("cluster"), F.lit(groups)).alias("group"))
        .applyInPandas(_search_clusters(percent), "a long, b long")
    )
    within = scratch.store(within)
    large = clusters.filter(F.col("members") > TILE)
    if large.isEmpty():
        return within
    sets = sets.filter(F.col("members") > TILE).select("rep", "hashes")
    edges = stars.join(large.select(F.col("rep").alias("a")), "a", "left_semi")
    left = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("left"))
    right = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("right"))
    checked = scratch.store(
        edges.join(left, "a").join(right, "b").mapInPandas(_probe(percent), "a long, b long")
    )
    parts = components(checked, scratch).withColumnsRenamed({"node": "rep", "component": "part"})
    placed = scratch.store(
        large.join(parts, "rep", "left").withColumn("part", F.coalesce("part", "rep"))
    )
    main = (
        placed.groupBy("cluster", "part")
        .agg(F.count(F.lit(1)).alias("of_part"))
        .groupBy("cluster")
        .agg(F.max(F.struct("of_part", "part")).alias("main"))
    )
    lengths = sets.select("rep", F.expr("octet_length(hashes) div 8").alias("n")).distinct()
    placed = (
        placed.join(main, "cluster")
        .filter("main.of_part < members")
        .select("cluster", "rep", "part", (F.col("part") != F.col("main.part")).alias("outside"))
        .join(lengths, "rep")
    )
    placed = scratch.store(_portions(placed, percent))
    dealt = placed.select("cluster", "outside", "band", "portion").distinct()
    one = dealt.filter("outside").select("cluster", F.col("band").alias("b1"), F.col("portion").alias("p1"))
    two = dealt.select(
        "cluster", F.col("outside").alias("o2"), F.col("band").alias("b2"), F.col("portion").alias("p2")
    )
    # Portions, not rows, are paired; two of outsiders once only, within the main part nothing is open.
    pairs = scratch.store(
        one.join(two, "cluster").filter(
            "abs(b1 - b2) <= 1 and (not o2 or b1 < b2 or (b1 = b2 and p1 <= p2))"
        )
    )
    pair = ["cluster", "b1", "p1", "o2", "b2", "p2"]
    asks = pairs.select(
        *pair, F.lit(True).alias("outside"), F.col("b1").alias("band"), F.col("p1").alias("portion"),
        F.lit(True).alias("asks"),
    )
    others = pairs.filter("not (o2 and b1 = b2 and p1 = p2)").select(
        *pair, F.col("o2").alias("outside"), F.col("b2").alias("band"), F.col("p2").alias("portion"),
        F.lit(False).alias("asks"),
    )
    across = (
        asks.unionByName(others)
        .join(placed.select("cluster", "outside", "band", "portion", "rep", "part"), ["cluster", "outside", "band", "portion"])
        .join(sets, "rep")
        .groupBy(*pair)
        .applyInPandas(_search(percent), "a long, b long")
    )
    return scratch.store(within.unionByName(checked).unionByName(across))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """(id, n_shingles, component_id) of every document.

    Two documents link when their sets of ``words``-word shingles (A-Z lower-cased)
    have a Jaccard similarity of at least ``percent`` / 100; component_id is the
    smallest id reachable by links.  Null or empty texts have no shingles and link
    with nothing; a text with fewer words is one shingle.  Rows without an id get
    null in both columns.  An id on several rows is one node whose texts all count.
    Other columns are not read.  Shingles are compared as 64-bit numbers.

    1. Blocks of texts send each range of hash values its share of their shingles;
       the ranges answer how many shingles of a document occur in other sets.  Only
       documents that share enough of them can link: the survivors.
    2. Survivors with equal sets are one class.  Their rare-first prefixes make
       inverted lists, and those make candidate clusters.
    3. Within clusters, T-occurrence search (DivideSkip) finds the links.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), text_or_empty(text_col).alias("__text"))
    named = rows.filter("__id is not null")
    scratch = Scratch(spark)
    with scratch:
        total = named.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranges = max(least, math.ceil(total / RANGE_BYTES))
        profiles = scratch.store(_profiles(named, ranges, words))
        scratch.free()
        # A class is known by a hash of its digest; ids may repeat with other texts.
        classes = scratch.store(
            profiles.groupBy("digest")
            .agg(F.min("id").alias("low"), F.max("n").alias("n"), F.max("shared").alias("shared"))
            .withColumn("rep", F.xxhash64("digest"))
        )
        survivors = classes.filter(100 * F.col("shared") >= percent * F.col("n"))
        blocks = scratch.store(
            named.join(survivors.select(F.col("low").alias("__id"), "rep", "digest"), "__id")
            .select("rep", "digest", "__text")
            .mapInArrow(_pack_sets(words), "block long, reps binary, sizes binary, hashes binary")
        )
        scratch.free()
        levels = (
            blocks.select("block", "reps", "sizes", "hashes")
            .mapInPandas(_block_entries(ranges), "range int, block long, values binary")
            .groupBy("range")
            .applyInPandas(_frequency_classes, "block long, range int, classes binary")
        )
        stars = scratch.store(
            blocks.groupBy("block")
            .cogroup(levels.groupBy("block"))
            .applyInPandas(
                _prefixes(ranges, percent), "range int, hashes binary, reps binary, sizes binary"
            )
            .groupBy("range")
            .applyInPandas(_stars(percent), "a long, b long")
            .distinct()
        )
        sets = blocks.mapInPandas(_rows_of_blocks, "rep long, hashes binary")
        links = _links(sets, stars, scratch, percent)
        # The sets of an id that is on several rows hang together.
        owned = profiles.select("id", F.xxhash64("digest").alias("b"))
        several = owned.groupBy("id").agg(F.min("b").alias("a"), F.max("b").alias("last"))
        several = several.filter("a < last").select("id", "a").join(owned, "id").select("a", "b")
        found = components(links.unionByName(several), scratch)
        found = found.withColumnsRenamed({"node": "rep", "component": "group"})
        placed = scratch.store(classes.join(found, "rep", "left").select("digest", "low", "n", "group"))
        lowest = placed.filter("group is not null").groupBy("group").agg(F.min("low").alias("lowest"))
        placed = placed.join(lowest, "group", "left").select(
            "digest", "n", F.coalesce("lowest", "low").alias("component_id")
        )
        per_id = (
            profiles.select("id", "digest")
            .join(placed, "digest")
            .groupBy("id")
            .agg(F.max("n").alias("n_shingles"), F.min("component_id").alias("component_id"))
        )
        result = rows.select("__id").join(per_id, F.col("__id") == F.col("id"), "left").select(
            F.col("__id").alias(id_col),
            F.when(F.col("__id").isNotNull(), F.coalesce("n_shingles", F.lit(0).cast("long"))).alias("n_shingles"),
            F.coalesce("component_id", "__id").alias("component_id"),
        )
        return scratch.keep(result)
