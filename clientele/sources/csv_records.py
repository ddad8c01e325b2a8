"""Records of CSV files whose quoted fields may hold line breaks, read by many tasks.

A reader that follows the quotes from the start of a file needs one task for it.  Here
the lines of all splits are read at once.  A line break ends a record if the quotes
before it are even in number, so a first pass counts the quotes of every split, and a
prefix sum over the splits of a file tells which of them begin inside a field.  Each
task then puts the lines of its splits together, in the order in which it reads them.

Fields are quoted as in RFC 4180: a quote inside a field is doubled, and a field with
quotes is quoted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clientele.operators.settling import settle

REJECTED = "__rejected"
_OPTIONS = {"escape": '"', "multiLine": "true", "columnNameOfCorruptRecord": REJECTED}


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, value, quotes) of every line, a split's lines in order in one task."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        "value",
        _quotes(F.col("value")).alias("quotes"),
    )


class _Split:
    """Lines of one split on their way into records."""

    def __init__(self, part, inside, first):
        self.part = part
        # Quotes so far, those of earlier splits included; of interest is whether they are odd.
        self.quotes = int(inside)
        # Lines of the record that has not ended yet; whether it began in this split.
        self.lines, self.began = [], False
        # Whether the next record is the header.
        self.header = first

    def end(self, whole):
        """(part, piece, record) of the lines kept; piece tells which end of the split it is."""
        lines = [line for some in self.lines for line in some.to_pylist()]
        self.lines = []
        if not lines:
            return
        header, self.header = self.header and whole and len(lines) == 1, False
        if not header:
            yield self.part, None if whole and self.began else int(self.began), "\n".join(lines)

    def add(self, values, quotes):
        """Records that end before the last one that begins among these lines."""
        import pyarrow as pa
        import pyarrow.compute as pc

        sums = np.cumsum(quotes)
        starts = np.flatnonzero((self.quotes + sums - quotes) % 2 == 0)
        self.quotes += int(sums[-1])
        if not len(starts):
            self.lines.append(values)
            return
        self.lines.append(values.slice(0, starts[0]))
        for part, piece, record in self.end(True):
            yield [part], [piece], pa.array([record], pa.string())
        low, high = int(starts[0]), int(starts[-1])
        if high > low:
            cuts = pa.array((starts - low).astype(np.int32))
            records = pc.binary_join(pa.ListArray.from_arrays(cuts, values.slice(low, high - low)), "\n")
            if self.header and starts[1] == low + 1:
                records = records.slice(1)
            self.header = False
            yield [self.part] * len(records), [None] * len(records), records
        self.lines, self.began = [values.slice(high)], True


def _put_together(batches):
    """Records of splits; those that a split has only in part, as pieces.

    A split's lines come one after the other, so that what is kept is one record.
    """
    import pyarrow as pa

    names = ["part", "piece", "record"]

    def made(parts, pieces, records):
        columns = [pa.array(parts, pa.int64()), pa.array(pieces, pa.int32()), records.cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names)

    def ended(split):
        for part, piece, record in split.end(split.quotes % 2 == 0) if split else ():
            yield made([part], [piece], pa.array([record], pa.string()))

    split = None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts, quotes = (batch.column(c).to_numpy() for c in ("part", "quotes"))
        borders = np.r_[0, np.flatnonzero(parts[1:] != parts[:-1]) + 1, len(parts)]
        for low, high in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            if split is None or split.part != parts[low]:
                yield from ended(split)
                inside, first = (batch.column(c)[low].as_py() for c in ("inside", "first"))
                split = _Split(int(parts[low]), inside, first)
            for rows in split.add(batch.column("value").slice(low, high - low), quotes[low:high]):
                yield made(*rows)
    yield from ended(split)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record) of every record below the header of a file; blank ones are left out.

    A task puts the lines of its splits together as it reads them; only records that
    lie in several splits are shuffled, piece by piece.
    """
    lines = _lines(spark, path)
    by_split = Window.partitionBy("file").orderBy("split")
    before = by_split.rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "split").agg(F.sum("quotes").alias("quotes"))
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    splits = splits.select("file", "split", inside.alias("inside"), (F.col("split") == 0).alias("first"))
    splits = F.broadcast(settle(splits.withColumn("part", F.monotonically_increasing_id())))
    # A broadcast join leaves the lines in order.
    placed = lines.join(splits, ["file", "split"]).select("part", "inside", "first", "value", "quotes")
    made = settle(placed.mapInArrow(_put_together, "part long, piece int, record string"))

    # A record that is open at the end of a split goes on in the next one.
    pieces = made.filter("piece is not null").join(splits.select("part", "file", "split"), "part")
    number = F.sum("piece").over(Window.partitionBy("file").orderBy("split", "piece"))
    numbers = pieces.select("part", "piece", number.alias("number"))
    texts = F.sort_array(F.collect_list(F.struct("split", "piece", "record")))
    joined = pieces.join(numbers, ["part", "piece"]).groupBy("file", "number").agg(texts.alias("texts"))
    joined = joined.select("file", F.array_join(F.transform("texts", lambda p: p["record"]), "\n").alias("record"))
    records = made.filter("piece is null").join(splits.select("part", "file"), "part").select("file", "record")
    records = records.unionByName(joined)
    records = records.select("file", F.regexp_replace("record", "\r$", "").alias("record"))
    return records.filter("record != ''")


def header_names(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def csv_fields(spark: SparkSession, path: str) -> DataFrame:
    """The records' fields as text under the names of the header, with file and record.

    A record with more or fewer fields than the header has them as far as they go, and
    the column REJECTED holds its text; it is null otherwise.
    """
    names = header_names(spark, path)
    schema = ", ".join(f"`{name}` string" for name in [*names, REJECTED])
    fields = F.from_csv("record", schema, _OPTIONS)
    return csv_records(spark, path).withColumn("fields", fields).select("file", "record", "fields.*")


def typed_and_rejected(fields: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, typed, and (file, record, cause) of all others.

    The first cause found counts: a quote that is never closed, a wrong number of
    fields, a value that is not of its type, or a required value that is missing.
    """
    cause = F.when(_quotes(F.col("record")) % 2 == 1, "quote not closed")
    cause = cause.when(F.col(REJECTED).isNotNull(), "number of fields")
    typed = []
    for field in schema:
        text, value = F.col(field.name), F.col(field.name).try_cast(field.dataType)
        kind = field.dataType.simpleString()
        cause = cause.when(text.isNotNull() & value.isNull(), f"{field.name}: not {kind}")
        if not field.nullable:
            cause = cause.when(text.isNull(), f"{field.name}: missing")
        typed.append(value.alias(field.name))
    judged = fields.withColumn("cause", cause)
    good = judged.filter("cause is null").select(*typed)
    return good, judged.filter("cause is not null").select("file", "record", "cause")
