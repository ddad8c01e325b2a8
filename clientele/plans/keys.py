"""Which columns are keys, and which columns refer to them, by the rows themselves.

Nothing is taken from the declared keys but the column sets to look at.  Every table is read
once: each row gives one value per candidate, the values of all tables meet in one
grouping with a count per candidate, values with the same holders are put together, and all
findings are sums over these few rows.  Counts are combined before the shuffle, so a value that most rows share, null included, is one row of
each task in it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.sources.schemas import FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS, Tables


@dataclass(frozen=True)
class Candidate:
    """Columns of one table that might be a key or refer to one."""

    table: str
    columns: tuple[str, ...]

    @property
    def label(self) -> str:
        return ", ".join(self.columns)

    @property
    def declared(self) -> bool:
        return PRIMARY_KEYS.get(self.table) == self.columns

    def refers_to(self, parent: Candidate) -> bool:
        """Whether this is a declared reference to ``parent``."""
        return parent.declared and any(
            (self.table, self.columns, parent.table) == (child, (key,), table) for child, key, table in FOREIGN_KEYS
        )


def id_candidates() -> tuple[Candidate, ...]:
    """Every column that is named as an id, and the declared keys of several columns."""
    single = [Candidate(t, (f.name,)) for t, schema in SCHEMAS.items() for f in schema if f.name.endswith("_id")]
    return (*single, *(Candidate(t, key) for t, key in PRIMARY_KEYS.items() if len(key) > 1))


def _kinds(tables: Tables, candidates: Sequence[Candidate]) -> list[str]:
    """The types of each candidate; only values of one kind are compared."""
    schemas = {name: dict(frame.dtypes) for name, frame in tables.named().items()}
    return [",".join(schemas[c.table][column] for column in c.columns) for c in candidates]


def _places(kinds: Sequence[str]) -> list[tuple[int, int]]:
    """(number of its kind, place among the candidates of its kind) of each candidate.

    A value is counted for the candidates of its kind only, so kinds share the counters.
    """
    order = list(dict.fromkeys(kinds))
    return [(order.index(kind), list(kinds[:i]).count(kind)) for i, kind in enumerate(kinds)]


def _value(columns: Sequence[str]) -> Column:
    """The value as text; null if a column is, as SQL takes a key with a missing part."""
    texts = [F.col(column).cast("string") for column in columns]
    if len(texts) == 1:
        return texts[0]
    # The length before each text tells where it ends, whatever it holds.
    return F.concat(*[part for text in texts for part in (F.length(text).cast("string"), F.lit(":"), text)])


def _occurrences(tables: Tables, candidates: Sequence[Candidate]) -> DataFrame:
    """(kind, value, n0, n1, ...): how often each candidate of a kind has each of its values."""
    places = _places(_kinds(tables, candidates))
    frames = tables.named()
    parts = []
    for table in dict.fromkeys(c.table for c in candidates):
        values = [
            F.struct(F.lit(places[i][1]).alias("at"), F.lit(places[i][0]).alias("kind"), _value(c.columns).alias("value"))
            for i, c in enumerate(candidates)
            if c.table == table
        ]
        parts.append(frames[table].select(F.inline(F.array(*values))))
    counts = [F.count_if(F.col("at") == i).alias(f"n{i}") for i in range(1 + max(at for _, at in places))]
    return reduce(DataFrame.unionByName, parts).groupBy("kind", "value").agg(*counts)


def _patterns(tables: Tables, candidates: Sequence[Candidate]) -> DataFrame:
    """Values that the same candidates have, put together.

    One row per kind and set of candidates that share values, nulls apart: ``values``, and for
    each candidate of the kind its rows (n0, ...) and those beyond the first of each value
    (extra0, ...).  There are few such sets, whatever the tables hold; one of each kind without
    rows makes empty tables count.
    """
    found = _occurrences(tables, candidates)
    slots = range(len(found.columns) - 2)
    nothing = found.sparkSession.range(len(set(_kinds(tables, candidates)))).select(
        F.col("id").cast("int").alias("kind"),
        F.lit(None).cast("string").alias("value"),
        *[F.lit(0).cast("bigint").alias(f"n{i}") for i in slots],
    )
    held = F.array(*[F.col(f"n{i}") > 0 for i in slots]).alias("held")
    sums = [F.sum(f"n{i}").alias(f"n{i}") for i in slots]
    extra = [F.sum(F.greatest(F.col(f"n{i}") - 1, F.lit(0))).alias(f"extra{i}") for i in slots]
    absent = F.col("value").isNull().alias("absent")
    return found.unionByName(nothing).groupBy("kind", absent, held).agg(F.count("*").alias("values"), *sums, *extra)


def _rows(place: tuple[int, int]) -> Column:
    """Rows of a candidate with the values of a set."""
    return F.when(F.col("kind") == place[0], F.col(f"n{place[1]}")).otherwise(0)


def _unfit(place: tuple[int, int]) -> Column:
    """Rows that keep a candidate from being a key."""
    unfit = F.when(F.col("absent"), F.col(f"n{place[1]}")).otherwise(F.col(f"extra{place[1]}"))
    return F.when(F.col("kind") == place[0], unfit).otherwise(0)


def key_candidates(tables: Tables, candidates: Sequence[Candidate] | None = None) -> DataFrame:
    """One row per candidate: whether its values are all there and all different.

    ``missing`` counts rows with a null in the key, ``repeated_rows`` the rows beyond the
    first of each value.  An empty table has no repeated value, so its candidates are keys.
    """
    candidates = id_candidates() if candidates is None else tuple(candidates)
    places = _places(_kinds(tables, candidates))
    names = ["table_name", "key_columns", "declared"]
    parts = [
        F.struct(
            F.lit(c.table).alias("table_name"),
            F.lit(c.label).alias("key_columns"),
            F.lit(c.declared).alias("declared"),
            _rows(places[i]).alias("n"),
            _unfit(places[i]).alias("unfit"),
        )
        for i, c in enumerate(candidates)
    ]
    rows = _patterns(tables, candidates).select("absent", "values", F.inline(F.array(*parts)))
    return rows.groupBy(*names).agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(F.col("absent"), F.col("n")).otherwise(0)).alias("missing"),
        F.sum(F.when(~F.col("absent") & (F.col("n") > 0), F.col("values")).otherwise(0)).alias("distinct_values"),
        F.sum(F.when(F.col("absent"), 0).otherwise(F.col("unfit"))).alias("repeated_rows"),
        (F.sum("unfit") == 0).alias("is_key"),
    )


def key_inclusions(tables: Tables, candidates: Sequence[Candidate] | None = None) -> DataFrame:
    """One row per pair of candidates of different tables and equal types.

    ``lost_values`` and ``lost_rows`` count the different values and the rows of the child
    that the parent lacks; a null refers to nothing and is not counted.  A reference
    ``holds`` if there are none, whether or not the parent is a key (``parent_is_key``).
    Numbers that merely lie in the same range hold too: it is for the reader to judge.
    """
    candidates = id_candidates() if candidates is None else tuple(candidates)
    kinds = _kinds(tables, candidates)
    # What no other table has a column like is in no pair, and need not be counted.
    users = {kind: {c.table for c, k in zip(candidates, kinds, strict=True) if k == kind} for kind in kinds}
    candidates = tuple(c for c, kind in zip(candidates, kinds, strict=True) if len(users[kind]) > 1)
    kinds = [kind for kind in kinds if len(users[kind]) > 1]
    places = _places(kinds)
    names = ["child_table", "child_columns", "parent_table", "parent_columns", "declared"]
    parts = []
    for i, child in enumerate(candidates):
        for j, parent in enumerate(candidates):
            if child.table == parent.table or kinds[i] != kinds[j]:
                continue
            lost = ~F.col("absent") & (_rows(places[i]) > 0) & (_rows(places[j]) == 0)
            parts.append(
                F.struct(
                    F.lit(child.table).alias("child_table"),
                    F.lit(child.label).alias("child_columns"),
                    F.lit(parent.table).alias("parent_table"),
                    F.lit(parent.label).alias("parent_columns"),
                    F.lit(child.refers_to(parent)).alias("declared"),
                    F.when(lost, F.col("values")).otherwise(0).alias("lost_values"),
                    F.when(lost, _rows(places[i])).otherwise(0).alias("lost_rows"),
                    _unfit(places[j]).alias("unfit"),
                )
            )
    if not parts:
        raise ValueError("no two candidates of different tables have the same types")
    rows = _patterns(tables, candidates).select(F.inline(F.array(*parts)))
    return rows.groupBy(*names).agg(
        F.sum("lost_values").alias("lost_values"),
        F.sum("lost_rows").alias("lost_rows"),
        (F.sum("lost_values") == 0).alias("holds"),
        (F.sum("unfit") == 0).alias("parent_is_key"),
    )
