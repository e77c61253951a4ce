"""The daily run from a command line: python -m pelagia.pipeline DATE ROOT GRANULES [--index PATH] [--purge FOLDER]. GRANULES is a folder of NetCDF files, or of Parquet with
``--parquet``; the status is printed, and the exit code is 0 unless the check failed."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ..sources.netcdf import read_granules
from .ingest import daily


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pelagia.pipeline")
    for name in ("date", "root", "granules"):
        parser.add_argument(name)
    parser.add_argument("--index")
    parser.add_argument("--purge")
    parser.add_argument("--parquet", action="store_true")
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("pelagia-daily").getOrCreate()
    read = (lambda d: spark.read.parquet(a.granules).filter(f"date = '{d}'")) if a.parquet else (lambda d: read_granules(spark, f"{a.granules}/{d:%Y%m%d}*"))
    said, gone = daily(spark, a.date, a.root, read, a.index, a.purge)
    print(said, *gone, sep="\n")
    return int(said == "FAIL")


if __name__ == "__main__":
    sys.exit(main())
