"""Run queries from the command line: `python -m gaugeflow --data DIR --out DIR [--only NAME ...]`.

Each query is written once under --out as Parquet, checked and renamed. A result that stands is kept, unless --again. --summaries-only rebuilds the summaries from the tables that stand and
--record writes a receipt of the tables and of the software.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession

from . import suite
from .plans import synthesis
from .sources import sinks

#: Queries that summarise; the others make the tables that stand.
SUMMARIES = ("ag_", "pd_", "sy_", "ct_")


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="gaugeflow", description="Run the library's queries over a folder of tables.")
    p.add_argument("--data", required=True, help="folder of the Parquet tables")
    p.add_argument("--out", required=True, help="folder of the results")
    p.add_argument("--only", nargs="*", default=None, help="names of queries")
    p.add_argument("--summaries-only", action="store_true", help="only queries that summarise")
    p.add_argument("--again", action="store_true", help="rebuild results that stand")
    p.add_argument("--record", action="store_true", help="write receipts of tables and software")
    return p.parse_args(given)


def chosen(a: argparse.Namespace) -> list[str]:
    names = list(suite.QUERIES) if a.only is None else a.only
    if unknown := sorted(set(names) - set(suite.QUERIES)):
        raise SystemExit(f"unknown queries: {', '.join(unknown)}")
    return [n for n in names if n.startswith(SUMMARIES)] if a.summaries_only else names


def run(spark: SparkSession, a: argparse.Namespace) -> dict[str, int]:
    """Rows of each result, also of those that stood."""
    written: dict[str, int] = {}
    tables: dict[str, DataFrame] = {}
    for name in chosen(a):
        path = f"{a.out}/{name}"
        if a.again or not sinks.stands(spark, path):
            sinks.write_checked(suite.QUERIES[name](spark, a.data), path)
        written[name], tables[name] = sinks.row_count(spark, path), spark.read.parquet(path)
    if a.record and tables:
        sinks.write_receipt(synthesis.receipt(spark, tables), f"{a.out}/_receipt")
        sinks.write_receipt(synthesis.software_versions(spark), f"{a.out}/_software")
    return written


def main() -> None:
    a = arguments()
    spark = SparkSession.builder.appName("gaugeflow").master(os.environ.get("MASTER", "local[*]")).getOrCreate()
    for name, n in run(spark, a).items():
        print(f"{name}\t{n}")
    spark.stop()


if __name__ == "__main__":
    main()
