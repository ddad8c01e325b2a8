"""Best-fit packing of tokenized documents: leaves pack by themselves, a tree packs what they leave."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import Scratch, text_or_empty

CAPACITY = 4096
END_ID = 1
# Words whose ids a task remembers at once.
CACHED_WORDS = 250_000
# Pieces of a leaf on average, and nodes that meet in one of the next level.
LEAF_ITEMS = 100_000
FAN_IN = 8
# A sequence whose room is at most this share of its length is nearly full.
NEARLY_FULL = 0.005


# A word of letters that the tokenizer lower-cases sign by sign, with signs behind it
# that are a piece of their own.
_PLAIN = re.compile(r"([^\W\d_]+)([.,;:!?*$%#&]*)")
_LAST_SIMPLE, _DOTTED_I = "\u024f", "\u0130"


class WordIds(dict):
    """Ids of whitespace-separated words as little-endian 32-bit bytes.

    The tokenizer drops white space, lower-cases, and cuts letters from other signs;
    it never joins what it has cut.  So a text's ids are those of its words in turn,
    and those of a plain word are its letters' and its signs'.  Anything else, such
    as digits, apostrophes or special tokens, is left to the tokenizer as a whole.
    """

    def __init__(self, tokenizer, plain: bool):
        super().__init__()
        from tokenizers import pre_tokenizers

        self.tokenizer = tokenizer
        self.plain = plain
        self.parts: dict[str, bytes] = {}
        self.tokenize = tokenizer.model.tokenize
        self.to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _letters(self, word: str) -> bytes:
        mapped = word if word.isascii() else self.to_bytes(word)[0][0]
        return np.array([t.id for t in self.tokenize(mapped)], "<u4").tobytes()

    def _part(self, text: str, ids: Callable[[str], bytes]) -> bytes:
        known = self.parts.get(text)
        if known is None:
            known = self.parts[text] = ids(text)
        return known

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        match = _PLAIN.fullmatch(text) if self.plain else None
        if match and match[1].isalpha() and max(text) <= _LAST_SIMPLE and _DOTTED_I not in text:
            packed = self._part(match[1].lower(), self._letters)
            if match[2]:
                packed += self._part(match[2], self._whole)
        else:
            packed = self._whole(text)
        self[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        if len(self) > CACHED_WORDS:
            self.clear()
        if len(self.parts) > CACHED_WORDS:
            self.parts.clear()
        return b"".join(map(self.__getitem__, text.encode().split()))


def _cuts_words(tokenizer) -> bool:
    """Whether the tokenizer treats plain words as WordIds assumes."""
    probe = ["Straße", "ÀÉ", "word", "Ñandú"]
    words = WordIds(tokenizer, True)
    return all(
        words[f"{w}{s}".encode()] == words._whole(f"{w}{s}") for w in probe for s in ("", ".", "?!", "**")
    )


def word_ids(path: str) -> WordIds:
    """The ids of one vocabulary file; a worker process keeps them from task to task."""
    import sys

    from tokenizers import Tokenizer

    kept = sys.__dict__.setdefault("_clientele_word_ids", {})
    if path not in kept:
        tokenizer = Tokenizer.from_file(path)
        kept[path] = WordIds(tokenizer, _cuts_words(tokenizer))
    return kept[path]


def _pieces(path: Callable[[], str], capacity: int, end_id: int):
    """Pieces of each document: (id, piece, start, length, crc32 of the ids)."""

    def run(batches):
        import pyarrow as pa

        words = word_ids(path())
        end = np.array([end_id], "<u4").tobytes()
        width = 4 * capacity
        for batch in batches:
            out = []
            ids = batch.column("__id").to_pylist()
            for i, text in zip(ids, batch.column("__text"), strict=True):
                data = words.encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(data), width)):
                    part = data[at : at + width]
                    out.append((i, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def tokenized_pieces(
    docs: DataFrame, tokenizer_path: Callable[[], str], capacity: int = CAPACITY,
    end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32.

    ``tokenizer_path`` is called by the tasks, since each machine has its own copy
    of the vocabulary file.  Every document ends with ``end_id``; one of more than
    ``capacity`` ids is cut into pieces of that length and a rest.  Null text is
    empty: one piece with the end alone.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), text_or_empty(text_col).alias("__text"))
    return rows.mapInArrow(
        _pieces(tokenizer_path, capacity, end_id),
        "doc_id long, piece int, start long, length int, ids_crc32 long",
    )


class Plan:
    """Best fit of so many items of each size, in runs of equal bins.

    The largest item goes first, each into the fullest bin that has room.

    Bins with the same room are as good as each other, so they are kept as runs of bin
    numbers.  A size splits one run at most, and a run changes at most once for each
    size that fits beside the others, so a plan's length is bounded by the capacity,
    not by the items.  Items are numbered from the largest size down (``before``: the
    items above each size).  A step takes the items from ``start`` on, ``each`` of them
    into one bin after the other from ``first`` on, behind the ids that are there.

    A bin with more room than ``spare`` is underfull.  The items of underfull bins are
    numbered anew among those of their size, so that another plan can take them.
    """

    def __init__(self, counts: dict[int, int], capacity: int, spare: int = 0):
        self.before = np.zeros(capacity + 1, np.int64)
        by_room: dict[int, list[tuple[int, int]]] = {}
        steps: list[tuple[int, ...]] = []
        self.bins = rooms = item = 0

        def put(room: int, first: int, n: int):
            nonlocal rooms
            if room and n:
                by_room.setdefault(room, []).append((first, n))
                rooms |= 1 << room

        for size in sorted(counts, reverse=True):
            left = counts[size]
            self.before[size] = item
            while left:
                fitting = rooms >> size
                if fitting:
                    room = size + (fitting & -fitting).bit_length() - 1
                    held = by_room[room]
                    first, n = held.pop()
                    if not held:
                        rooms ^= 1 << room
                else:
                    room, first = capacity, self.bins
                    n = -(-left // (capacity // size))
                    self.bins += n
                each = room // size
                whole = min(n, left // each)
                rest = left - whole * each if whole < n else 0
                for bins, here in ((whole, each), (int(rest > 0), rest)):
                    if bins:
                        steps.append((item, first, here, capacity - room, bins, size))
                        put(room - here * size, first, bins)
                        item += bins * here
                        left -= bins * here
                        first += bins
                        n -= bins
                put(room, first, n)
        table = np.array(steps, np.int64).reshape(-1, 6).T
        self.start, self.first, self.each, self.offset, bins, self.size = table
        runs = sorted(run for room, held in by_room.items() if room > spare for run in held)
        self._run, self._run_bins = np.array(runs, np.int64).reshape(-1, 2).T
        self._runs_before = np.concatenate([[0], np.cumsum(self._run_bins)])
        self._left = self.each * (self._underfull_before(self.first + bins) - self._underfull_before(self.first))
        before = np.cumsum(self._left) - self._left
        self._left_before = before - before[np.searchsorted(-self.size, -self.size)] if len(before) else before

    def _underfull_before(self, bins: np.ndarray) -> np.ndarray:
        """How many underfull bins have a smaller number."""
        if not len(self._run):
            return np.zeros_like(bins)
        run = np.searchsorted(self._run, bins, side="left") - 1
        inside = np.minimum(bins - self._run[run], self._run_bins[run])
        return np.where(run < 0, 0, self._runs_before[run] + inside)

    def _steps(self, lengths: np.ndarray, ranks: np.ndarray):
        item = self.before[lengths] + ranks
        step = np.searchsorted(self.start, item, side="right") - 1
        bins, place = np.divmod(item - self.start[step], self.each[step])
        return step, self.first[step] + bins, place

    def places(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bins and offsets of items, given by their rank among those of their length."""
        step, bins, place = self._steps(lengths, ranks)
        return bins, self.offset[step] + place * lengths

    def left(self) -> dict[int, int]:
        """How many items of each size lie in underfull bins."""
        sizes, at = np.unique(self.size, return_inverse=True)
        counts = np.bincount(at, self._left, len(sizes)).astype(np.int64)
        return {s: n for s, n in zip(sizes.tolist(), counts.tolist(), strict=True) if n}

    def left_ranks(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each item lies in an underfull bin, and its rank among those of its length there."""
        step, bins, place = self._steps(lengths, ranks)
        before = self._underfull_before(bins)
        rank = self._left_before[step] + self.each[step] * (before - self._underfull_before(self.first[step])) + place
        return self._underfull_before(bins + 1) > before, rank


_PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
# A sequence's number: its node, 4 bits for the node's level, its number in the node.
_NODE_BITS, _LEVEL_BITS = 40, 36


def _left_by(capacity: int, spare: int):
    """What the plan of a node, given as counts by size, leaves in underfull sequences."""

    def run(key, rows):
        left = Plan(dict(zip(rows["size"].tolist(), rows["n"].tolist(), strict=True)), capacity, spare).left()
        return pd.DataFrame({"node": int(key[0]), "size": list(left), "n": list(left.values())})

    return run


def _shares(fan_in: int):
    """Per child and size of a node: all items of that size, and those of the children before."""

    def run(key, rows):
        sizes = np.unique(rows["size"])
        counts = np.zeros((fan_in, len(sizes)), np.int64)
        counts[rows["node"] % fan_in, np.searchsorted(sizes, rows["size"])] = rows["n"]
        earlier = np.cumsum(counts, axis=0) - counts
        return pd.DataFrame(
            {
                "node": np.repeat(int(key[0]) * fan_in + np.arange(fan_in), len(sizes)),
                "size": np.tile(sizes, fan_in),
                "n": np.tile(counts.sum(axis=0), fan_in),
                "earlier": earlier.ravel(),
            }
        )

    return run


def _placed(capacity: int, spare: int, fan_in: int, levels: int):
    """Places of a leaf's pieces: by its own plan, or by the node above that takes them."""

    def run(key, pieces, shares):
        import pyarrow as pa

        node = key[0].as_py()
        lengths = pieces.column("length").to_numpy().astype(np.int64)
        sequences, offsets = np.zeros((2, len(lengths)), np.int64)
        counts = np.bincount(lengths, minlength=capacity + 1)
        moving = np.argsort(lengths, kind="stable")
        ranks = np.arange(len(lengths)) - (np.cumsum(counts) - counts)[lengths[moving]]
        at, size, n, earlier = (shares.column(c).to_numpy() for c in ("level", "size", "n", "earlier"))
        for level in range(levels + 1):
            here = at == level
            if level:
                counts, before = np.zeros((2, capacity + 1), np.int64)
                counts[size[here]], before[size[here]] = n[here], earlier[here]
                ranks = ranks + before[lengths[moving]]
            if not len(moving):
                break
            sizes = np.flatnonzero(counts)
            plan = Plan(dict(zip(sizes.tolist(), counts[sizes].tolist(), strict=True)), capacity, spare)
            bins, offsets[moving] = plan.places(lengths[moving], ranks)
            sequences[moving] = (node << _NODE_BITS) + (level << _LEVEL_BITS) + bins
            underfull, ranks = plan.left_ranks(lengths[moving], ranks)
            moving, ranks = moving[underfull], ranks[underfull]
            node //= fan_in
        made = {"length": lengths, "sequence_id": sequences, "offset": offsets}
        names = [c.split()[0] for c in _PLACED.split(", ")]
        return pa.table({c: pa.array(made[c]) if c in made else pieces.column(c) for c in names})

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (see ``tokenized_pieces``) with their sequence_id and offset.

    The pieces are dealt evenly over leaves of about ``LEAF_ITEMS``.  A leaf packs its
    own by best fit and emits sequences that are nearly full (``NEARLY_FULL``).  The
    pieces of all its other sequences are the items of the next node, in which
    ``FAN_IN`` leaves meet; it packs them by best fit, emits, and hands on the rest, and
    so on up to one root, which emits all.  An underfull sequence is opened again on its
    way up: taken as one item, two of over half the length could never be improved.

    Best fit sees only lengths, so what goes up is the number of pieces of each length,
    at most ``capacity`` numbers a node, however many sequences are underfull.  Each leaf
    then gets the counts of the nodes above it and looks up where its pieces went; so
    no piece travels up the tree, and nothing is sealed early for want of room in a node.
    The number of a sequence tells its node, the node's level and its number there.

    Null ids stay null; equal rows are separate pieces, dealt over all leaves like any
    others.  An empty table gives no rows.
    """
    spark = pieces.sparkSession
    spare = int(capacity * NEARLY_FULL)
    scratch = Scratch(spark)
    with scratch:
        columns = [c.split()[0] for c in _PIECE.split(", ")]
        stored = scratch.store(pieces.select(*columns, F.monotonically_increasing_id().alias("at")))
        leaves = max(1, -(-stored.count() // LEAF_ITEMS))
        leaf = F.pmod(F.xxhash64("at"), F.lit(leaves))
        dealt = stored.select(*columns, leaf.alias("leaf"))
        levels, nodes = 0, leaves
        counts = dealt.groupBy(F.col("leaf").alias("node"), F.col("length").cast("long").alias("size"))
        counts = counts.agg(F.count("*").alias("n"))
        shares = spark.range(0).selectExpr("id leaf", "0 level", "id size", "id n", "id earlier")
        while nodes > 1:
            below = FAN_IN**levels
            levels, nodes = levels + 1, -(-nodes // FAN_IN)
            left = counts.groupBy("node").applyInPandas(_left_by(capacity, spare), "node long, size long, n long")
            left = scratch.store(left).withColumn("parent", F.expr(f"node div {FAN_IN}"))
            here = left.groupBy("parent").applyInPandas(
                _shares(FAN_IN), "node long, size long, n long, earlier long"
            )
            under = f"sequence(node * {below}L, least((node + 1) * {below}L, {leaves}L) - 1)"
            here = here.filter(f"node * {below}L < {leaves}L").selectExpr(
                f"explode({under}) leaf", f"{levels} level", "size", "n", "earlier"
            )
            shares = shares.unionByName(scratch.store(here))
            counts = left.groupBy(F.col("parent").alias("node"), "size").agg(F.sum("n").alias("n"))
        grouped = dealt.groupBy("leaf").cogroup(shares.groupBy("leaf"))
        return scratch.keep(grouped.applyInArrow(_placed(capacity, spare, FAN_IN, levels), _PLACED))


def pack_documents(docs: DataFrame, tokenizer_path: Callable[[], str], **options) -> DataFrame:
    """``tokenized_pieces`` and ``pack_pieces`` in one."""
    return pack_pieces(tokenized_pieces(docs, tokenizer_path, **options))
