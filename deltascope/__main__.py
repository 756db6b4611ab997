"""Command line: diagnose a folder of Parquet tables, or re-analyse a trace."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .plans import files
from .sources.catalog import FileSource


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="deltascope")
    commands = parser.add_subparsers(dest="command", required=True)
    look = commands.add_parser("diagnose", help="profile and snapshot a folder of Parquet tables")
    look.add_argument("folder")
    look.add_argument("--ignore", nargs="*", default=[])
    again = commands.add_parser("reanalyse", help="interpret a trace again, without its database")
    again.add_argument("trace")
    again.add_argument("--to")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("deltascope").getOrCreate()
    if args.command == "reanalyse":
        print("\n".join(files.reanalyse_file(spark, args.trace, args.to)))
        return 0
    names = sorted(n.removesuffix(".parquet") for n in os.listdir(args.folder) if n.endswith(".parquet"))
    return 0 if files.diagnose(FileSource(spark, f"file://{os.path.abspath(args.folder)}", names), args.ignore) else 1


if __name__ == "__main__":
    sys.exit(main())
