"""Command-line entry: run or check a manifest of experiments.

    spark-submit --py-files trackml.zip trackml/__main__.py sweep --manifest runs.csv --results out/
    python -m trackml check --manifest runs.csv --roots hdfs:///tracks --out ready/

The manifest is a CSV file with a header whose columns are those of
``experiments.MANIFEST_SCHEMA`` (missing columns are NULL, unknown ones are
rejected; a list is written ``0.3;0.1``).  ``sweep`` appends the result rows to
``--results``; ``check`` writes ``CHECK`` / ``MISSING`` per input file to
``--out``.  Both print how many rows have each status and the table's path.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from trackml.plans import experiments
from trackml.session import build_session


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest CSV → manifest DataFrame with the manifest schema's types."""
    header = spark.read.option("header", True).csv(path).columns
    names = [f.name for f in experiments.MANIFEST_SCHEMA.fields]
    unknown = set(header) - set(names)
    if unknown:
        raise ValueError(f"unknown manifest columns: {sorted(unknown)}")
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)

    def column(f):
        if f.name not in header:
            return F.lit(None)
        return F.split(f.name, ";") if isinstance(f.dataType, ArrayType) else F.col(f.name)

    return raw.select(*[column(f).cast(f.dataType).alias(f.name)
                        for f in experiments.MANIFEST_SCHEMA.fields])


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="trackml")
    sub = parser.add_subparsers(dest="command", required=True)
    sweep = sub.add_parser("sweep", help="run every experiment of a manifest")
    sweep.add_argument("--manifest", required=True)
    sweep.add_argument("--results", required=True,
                       help="Parquet results table (appended, resumable)")
    sweep.add_argument("--fixtures", help="use the Parquet test tables of this folder")
    sweep.add_argument("--parallelism", type=int, default=2)
    check = sub.add_parser("check", help="check that every input file exists")
    check.add_argument("--manifest", required=True)
    check.add_argument("--roots", nargs="+", required=True)
    check.add_argument("--out", required=True, help="Parquet table of CHECK / MISSING per file")
    args = parser.parse_args(argv)

    spark = build_session(app_name=f"trackml {args.command}")
    manifest = read_manifest(spark, args.manifest)
    if args.command == "sweep":
        out = experiments.run_sweep(spark, manifest, args.fixtures, args.results,
                                    parallelism=args.parallelism)
    else:
        out = experiments.readiness(spark, manifest, args.roots)
        out.write.mode("overwrite").parquet(args.out)
        out = spark.read.parquet(args.out)
    counts = out.groupBy("status").count().orderBy("status").collect()
    for row in counts:
        print(f"{row['count']:8d}  {row['status']}")
    print(f"table: {args.results if args.command == 'sweep' else args.out}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
