"""What several operators share: intermediate tables, ASCII lower case, hashed words."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from functools import cache

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

# What `[^\x20\x09-\x0D]+` takes as a word in Spark's and DuckDB's patterns.
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(column: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only.

    `lower` is much faster than `translate` and equal to it where every
    character takes one byte.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder of this process; a
    cluster must name one, since its machines do not see each other's folders.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="clientele-llm-")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


# Tables that results still read; deleted by release() or when Python ends.
_kept: list[tuple[SparkSession, str]] = []


def release() -> None:
    """Delete the tables that earlier results read."""
    while _kept:
        spark, path = _kept.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            continue


atexit.register(release)


class Scratch:
    """Intermediate tables in the shared folder, deleted when the block ends.

    A written table outlives lost executors, cuts the lineage and is read column
    by column.  ``keep`` stores a result that must outlive the block.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark)}/clientele-llm-{uuid.uuid4().hex}"
        self._count = 0
        self._tables: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        for table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        _delete(self.spark, f"{self.root}/steps")

    def store(self, frame: DataFrame, **options) -> DataFrame:
        """Write ``frame`` and return a scan of it."""
        self._count += 1
        path = f"{self.root}/steps/{self._count}"
        frame.write.parquet(path, **options)
        return self.spark.read.schema(frame.schema).parquet(path)

    def store_bucketed(self, frame: DataFrame, column: str) -> DataFrame:
        """Like ``store``, in buckets of ``column``: joins on it need not shuffle the table.

        Buckets belong to catalog tables, so one of its own is declared until the block ends.
        """
        self._count += 1
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"clientele_llm_{uuid.uuid4().hex}"
        self._tables.append(table)
        writer = frame.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column)
        writer.option("path", f"{self.root}/steps/{self._count}").saveAsTable(table)
        return self.spark.table(table)

    def free(self) -> None:
        """Let Spark delete the shuffle files of stored steps.

        Otherwise they stay until the driver happens to collect its garbage.  Spark still
        holds a step for a moment after its end, so this is asked for twice.
        """
        for _ in range(2):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.5)

    def keep(self, frame: DataFrame) -> DataFrame:
        """Like ``store``, but the table stays until ``release``."""
        self.append(frame)
        return self.kept(frame.schema)

    def append(self, frame: DataFrame) -> None:
        """Write a further part of the result."""
        frame.write.mode("append").parquet(f"{self.root}/result")

    def kept(self, schema) -> DataFrame:
        """All parts of the result; none: no rows."""
        if (self.spark, self.root) not in _kept:
            _kept.append((self.spark, self.root))
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/result")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)


def with_texts(frame: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(__id, __text) of every row: the id as it is, the text empty where it is null."""
    return frame.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))


def text_slices(batch, most: int):
    """Parts of an Arrow batch with about ``most`` bytes of the column __text each.

    A text longer than that is a part of its own; none is cut.
    """
    at = 0
    sizes = np.cumsum(np.diff(text_bytes(batch.column("__text"))[1]))
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


# --- words as 64-bit numbers, for whole Arrow batches at once -----------------

_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_EXACT_BYTE = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# All of ASCII but digits and letters.
NOT_ALPHANUMERIC = np.zeros(256, bool)
NOT_ALPHANUMERIC[:128] = True
NOT_ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 2**64)
_CHUNK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole number (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and where each row starts."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE):
    """Starts and ends of all words, and for each row its first word's index."""
    space = np.empty(len(data) + 1, bool)
    np.take(separators, data, out=space[:-1])
    space[-1] = True
    before = np.empty(len(data) + 1, bool)
    before[0] = True
    before[1:] = space[:-1]
    inner = offsets[1:-1]
    begin = ~space & before
    begin[inner[inner < len(data)]] = ~space[inner[inner < len(data)]]
    starts = np.flatnonzero(begin[:-1])
    first_space = np.flatnonzero(space)
    ends = first_space[np.searchsorted(first_space, starts)]
    first = np.searchsorted(starts, offsets)
    # A word also ends where its row does.
    rows = np.searchsorted(offsets, starts, side="right")
    ends = np.minimum(ends, offsets[rows]) if len(starts) else ends
    return starts, ends, first


def word_hashes(column, separators: np.ndarray = _SPACE, lower: bool = True):
    """64-bit numbers of all words of a batch, A-Z lower-cased, and row borders.

    A word's number is a polynomial over its bytes modulo 2**64, then mixed; it
    depends on the word alone.  Different words share one with a probability of
    about 2**-64 each.  ``separators``: for each byte, whether it ends a word;
    ``lower=False`` tells A-Z from a-z.
    """
    data, offsets = text_bytes(column)
    byte_value = _BYTE if lower else _EXACT_BYTE
    starts, ends, first = word_spans(data, offsets, separators)
    out = np.zeros(len(starts), np.uint64)
    # In chunks of words, so that the work arrays stay in the cache.
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, low + _CHUNK)))
        high = int(ends[to - 1])
        terms = byte_value[data[low:high]] * _powers(_BASE, high - low)
        total = np.zeros(len(terms) + 1, np.uint64)
        np.cumsum(terms, out=total[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        spread = int(s[-1]) + 1
        out[at:to] = (total[e] - total[s]) * _powers(_UNBASE, spread)[s]
        at = to
    return mix(out + (ends - starts).astype(np.uint64)), first
