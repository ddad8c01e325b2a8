"""Write an intermediate result once and carry on from the written copy."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Tables written and frames persisted by this process.
_written: list[str] = []
_persisted: list[DataFrame] = []


def shared_folder(spark: SparkSession) -> str | None:
    """Folder for intermediate tables that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session may
    go without one; it keeps its intermediate tables in Spark's own storage.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return context.getCheckpointDir().rstrip("/")
    master = context.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return None


def chunk_count(rows: int, rows_per_chunk: int = 1_000_000) -> int:
    """Range partitions for ``rows`` rows, whatever the session's default is."""
    return max(1, -(-rows // rows_per_chunk))


def settle(frame: DataFrame) -> DataFrame:
    """Store ``frame`` as a parquet table and return a scan of it.

    Used where several passes need the same rows, or need them in the same
    physical grouping.  The copy outlives lost executors, cuts the lineage, is
    read column by column, and gives the planner true sizes for its join choice.
    A local session without a shared folder persists the frame instead.
    """
    spark = frame.sparkSession
    folder = shared_folder(spark)
    if folder is None:
        _persisted.append(frame.persist(StorageLevel.MEMORY_AND_DISK))
        # Computed now, as a written table would be.
        frame.count()
        return frame
    path = f"{folder}/settled-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    _written.append(path)
    return spark.read.schema(frame.schema).parquet(path)


def settled_so_far() -> tuple[int, int]:
    """A mark for ``discard_settled``: what had been settled before some work."""
    return len(_written), len(_persisted)


def discard_settled(spark: SparkSession, since: tuple[int, int] = (0, 0)) -> None:
    """Delete the tables this process has settled, from the mark ``since`` on.

    Only for when no result that reads them is needed any more.
    """
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    while len(_written) > since[0]:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(hadoop).delete(path, True)
    while len(_persisted) > since[1]:
        _persisted.pop().unpersist()
