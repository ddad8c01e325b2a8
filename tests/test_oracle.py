"""Every registered query against its SQL, on whole tables."""

import math
import os
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _canonical(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)

    def value(v):
        assert not isinstance(v, Decimal), "decimals differ between engines"
        return None if isinstance(v, float) and math.isnan(v) else v

    return sorted(
        (tuple(value(row[i]) for i in order) for row in rows),
        key=lambda row: tuple((v is None, str(type(v)), v) for v in row),
    )


def test_every_query_has_sql():
    assert entry.QUERIES.keys() == entry.ORACLE.keys()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, database, name):
    actual = entry.queries()[name](spark, DATA)
    result = database.execute(entry.oracle_sql()[name])
    names = [column[0] for column in result.description]
    expected = result.fetchall()
    assert sorted(names) == sorted(actual.columns)
    rows = actual.collect()
    assert len(rows) == len(expected) > 0
    assert _canonical(actual.columns, rows) == _canonical(names, expected)


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.retention_rate_pct == 100.0 for r in rows if r.months_since_cohort == 0)
