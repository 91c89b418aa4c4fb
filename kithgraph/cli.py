"""Command line: python -m kithgraph.cli <query> <folder of tables> [--out PATH] [--explain]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from kithgraph.plans import catalog
from kithgraph.session import ship


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Run a query over a folder of Parquet tables.")
    parser.add_argument("query", choices=sorted(catalog.QUERIES))
    parser.add_argument("folder")
    parser.add_argument("--out", help="write Parquet here instead of showing the first rows")
    parser.add_argument("--explain", action="store_true", help="show the plan only")
    own = parser.parse_args(args)
    spark = SparkSession.builder.appName(f"kithgraph {own.query}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    result = catalog.QUERIES[own.query](spark, own.folder)
    if own.explain:
        result.explain("formatted")
    elif own.out:
        result.write.parquet(own.out)
    else:
        result.show(20, truncate=False)


if __name__ == "__main__":
    main()
