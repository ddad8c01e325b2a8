"""Run reports from a shell: ``python -m clientele TABLES REPORT [REPORT ...]``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from clientele.analytics import REPORTS, Analytics
from clientele.sources import read_tables


def print_rows(name: str, rows: DataFrame, limit: int | None = None) -> None:
    """Tab-separated rows under the column names, a partition at a time."""
    print(f"# {name}")
    print("\t".join(rows.columns))
    for row in (rows if limit is None else rows.limit(limit)).toLocalIterator():
        print("\t".join("" if value is None else str(value) for value in row))


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="clientele", description=__doc__)
    parser.add_argument("tables", help="folder with one folder or file per table")
    parser.add_argument("reports", nargs="+", choices=REPORTS, metavar="report")
    parser.add_argument("--format", default="parquet", help="format of the tables")
    parser.add_argument("--out", help="write each report here as parquet, do not print it")
    parser.add_argument("--rows", type=int, help="print this many rows only; default: all")
    options = parser.parse_args(arguments)

    spark = SparkSession.builder.appName("clientele").getOrCreate()
    with Analytics(read_tables(spark, options.tables, options.format)) as analytics:
        for name in options.reports:
            if options.out:
                # A file sink needs no total order.
                getattr(analytics, name)().write.parquet(f"{options.out}/{name}")
            else:
                print_rows(name, analytics.report(name), options.rows)


if __name__ == "__main__":
    main()
