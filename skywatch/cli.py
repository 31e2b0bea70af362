"""Command-line entry point: run a job as a script or under spark-submit.

    python -m skywatch annual   INPUT [--output PATH] [--table NAME] [--declared-schema] ...
    python -m skywatch biennial INPUT [--output PATH] [--table NAME] [--width N] ...
    python -m skywatch load     INPUT --database DB [--sep ,] [--mode append|overwrite]
    python -m skywatch inspect  INPUT --database DB [--sep '|'] [--mode append|overwrite]
    python -m skywatch ingest   LANDING --table DB.TABLE [--sep ,] [--archive PATH [--forget-after 30d]]
    python -m skywatch load-new LANDING --database DB [--sep ,]
    python -m skywatch store    INPUT --store PATH [--annual NAME] [--biennial NAME] [--compact]

The session comes from ``SparkSession.builder.getOrCreate()``, so master,
resources and ``spark.checkpoint.dir`` are whatever spark-submit or the
cluster defaults set. The jobs print what the reference's jobs showed: the
summary preview, the partition list, the description and the row count.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from skywatch.operators.sinks import show_preview
from skywatch.plans.incremental import SummaryStore
from skywatch.plans.load import inspect_and_partition_by_year, load_and_partition, load_new_files
from skywatch.plans.summary import YEAR, YEAR_GROUP, SummaryTarget, annual_summary, biennial_summary
from skywatch.schema import dated_schema, raw_table_schema, sighting_schema
from skywatch.streaming.ingest import ingest_new_files


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skywatch", description=__doc__.split("\n\n")[0])
    sub = p.add_subparsers(dest="job", required=True)

    for name in ("annual", "biennial"):
        s = sub.add_parser(name, help=f"{name} summary of a report CSV")
        s.add_argument("input")
        s.add_argument("--output", help="partitioned CSV output folder (replaced)")
        s.add_argument("--table", help="partitioned result table (replaced)")
        s.add_argument("--declared-schema", action="store_true", help="declare the report schema instead of inferring it")
        s.add_argument("--chronological", action="store_true", help="order month extremes by date, not text")
        s.add_argument("--header", action="store_true", help="write a header line in the CSV output")
        s.add_argument("--accuracy", type=int, help="of the approximate median")
        s.add_argument("--approx-distinct", action="store_true", help="sketch the distinct counts (one scan, one small shuffle)")
        s.add_argument("--approx-median", action="store_true", help="the sketched median instead of the exact lower one")
        s.add_argument("--no-preview", action="store_true")
        if name == "biennial":
            s.add_argument("--width", type=int, default=2)

    for name, sep, help_ in (("load", ",", "load and partition by month_count"), ("inspect", "|", "describe, count, partition by year")):
        s = sub.add_parser(name, help=help_)
        s.add_argument("input")
        s.add_argument("--database", required=True)
        s.add_argument("--location", help="database location (created if absent)")
        s.add_argument("--sep", default=sep)
        s.add_argument("--mode", choices=("append", "overwrite"), default="append")
        if name == "inspect":
            s.add_argument("--date-typed", action="store_true", help="declare the date columns as DATE (yyyy-MM-dd text)")

    s = sub.add_parser("ingest", help="append new files of a landing folder exactly once")
    s.add_argument("landing")
    s.add_argument("--table", required=True)
    s.add_argument("--sep", default=",")
    s.add_argument("--max-files-per-trigger", type=int)
    s.add_argument("--archive", help="folder that takes the files of committed batches")
    s.add_argument("--forget-after", help="bound what the stream remembers of archived files (30d)")

    s = sub.add_parser("load-new", help="the load job, exactly once for each file of a landing folder")
    s.add_argument("input")
    s.add_argument("--database", required=True)
    s.add_argument("--location", help="database location (created if absent)")
    s.add_argument("--sep", default=",")

    s = sub.add_parser("store", help="take new report CSVs into a summary store and publish its summaries")
    s.add_argument("input")
    s.add_argument("--store", required=True, help="the store's folder")
    s.add_argument("--annual", metavar="TABLE", help="publish the annual summary to this table (replaced)")
    s.add_argument("--biennial", metavar="TABLE", help="publish the two-year summary to this table (replaced)")
    s.add_argument("--compact", action="store_true", help="merge the cells of all loads")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"skywatch-{args.job}").getOrCreate()

    if args.job in ("annual", "biennial"):
        options = dict(
            output_path=args.output,
            schema=sighting_schema() if args.declared_schema else None,
            chronological=args.chronological,
            accuracy=args.accuracy,
            approx_distinct=args.approx_distinct,
            median="approx" if args.approx_median else "exact",
            header=args.header,
        )
        if args.job == "annual":
            result = annual_summary(spark, args.input, table=args.table, **options)
        else:
            result = biennial_summary(spark, args.input, hive_table=args.table, width=args.width, **options)
        if not args.no_preview:
            show_preview(result)
    elif args.job == "load":
        res = load_and_partition(spark, args.input, args.database, sep=args.sep, mode=args.mode, location=args.location)
        res.partitions.show(truncate=False)
    elif args.job == "inspect":
        res = inspect_and_partition_by_year(
            spark,
            args.input,
            args.database,
            sep=args.sep,
            mode=args.mode,
            location=args.location,
            schema=dated_schema() if args.date_typed else None,
        )
        res.description.show(truncate=False)
        res.raw_count.show()
        res.partitions.show(truncate=False)
    elif args.job == "ingest":
        if not spark.catalog.tableExists(args.table):
            from skywatch.operators.catalog import create_table

            create_table(spark, args.table, raw_table_schema())
        ingest_new_files(
            spark,
            args.landing,
            args.table,
            sep=args.sep,
            max_files_per_trigger=args.max_files_per_trigger,
            archive_dir=args.archive,
            forget_after=args.forget_after,
        )
        print(f"{args.table}: {spark.table(args.table).count()} rows")
    elif args.job == "load-new":
        res = load_new_files(spark, args.input, args.database, sep=args.sep, location=args.location)
        res.partitions.show(truncate=False)
    elif args.job == "store":
        store = SummaryStore(spark, args.store)
        print(f"{len(store.add(args.input))} new files")
        if args.compact:
            store.compact()
        wanted = ((YEAR, args.annual), (YEAR_GROUP, args.biennial))
        for summary in store.publish([SummaryTarget(key, 2, table=table) for key, table in wanted if table]):
            show_preview(summary)
    return 0


if __name__ == "__main__":
    sys.exit(main())
