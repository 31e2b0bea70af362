"""Benchmark the headline jobs; print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_RUNS (default 5), BENCH_WARMUP (default 2),
BENCH_VERBOSE (print every run to stderr). Inputs (the report CSV and the
delimited exports derived from ``orders``, and one loaded raw table) are
written once, untimed. Every job is warmed up, then the jobs are timed
round-robin from read to last write, and the median per job is reported.
The headline value is the sum of the medians of the reference's three jobs.
The reference's form of the annual job (one wide aggregate, recomputed
for each of three sinks) is reported under ``comparisons``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from skywatch.operators import create_database, save_csv, save_table  # noqa: E402
from skywatch.operators import create_table, summary_columns  # noqa: E402
from skywatch.plans import (  # noqa: E402
    annual_summary,
    load_file_into_table,
    summary_from_table,
    biennial_summary,
    inspect_and_partition_by_year,
    keyed_reports,
    load_and_partition,
)
from skywatch.schema import raw_table_schema, sighting_schema  # noqa: E402
from skywatch.session import scratch_path, unique_name  # noqa: E402
from skywatch.sources import read_csv, sightings_from_orders  # noqa: E402
from skywatch.sources.frames import write_report_csv, write_report_text  # noqa: E402


WARMUP_RUNS = int(os.environ.get("BENCH_WARMUP", "2"))
# The headline value: the reference's three jobs (annual summary, biennial
# summary, load and partition), end to end; variants are reported per query.
HEADLINE = ("annual_summary", "biennial_summary", "load_and_partition")


def _folder_bytes(path: str) -> int:
    local = path[len("file:"):] if path.startswith("file:") else path
    return sum(
        os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(local) for f in fs if not f.startswith((".", "_"))
    )


def _time_all(jobs: dict, runs: int, warmup: int) -> dict:
    """Warm every job up first, then time the jobs round-robin, so JIT
    warm-up and machine drift fall on all of them alike; report medians."""
    for _ in range(warmup):
        for fn in jobs.values():
            fn()
    times = {name: [] for name in jobs}
    for _ in range(runs):
        for name, fn in jobs.items():
            t0 = time.perf_counter()
            fn()
            times[name].append(time.perf_counter() - t0)
    if os.environ.get("BENCH_VERBOSE"):
        for name, ts in times.items():
            print(name, [round(t, 3) for t in ts], file=sys.stderr)
    return {name: round(statistics.median(ts), 4) for name, ts in times.items()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("skywatch-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    reports = sightings_from_orders(spark, sf_dir)
    rows_in = reports.count()
    csv_path = write_report_csv(reports, scratch_path(spark, "bench-csv"))
    text_comma = write_report_text(reports, scratch_path(spark, "bench-text"), sep=",")
    text_pipe = write_report_text(reports, scratch_path(spark, "bench-pipe"), sep="|")
    # Size file splits to the input so every core gets a share of each scan
    # (on a cluster the 128 MB default already yields thousands of splits).
    input_bytes = _folder_bytes(csv_path)
    split = max(1 << 20, input_bytes // (2 * cpus))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    db = create_database(spark, unique_name("bench"), location=scratch_path(spark, "bench-db"))
    out = scratch_path(spark, "bench-out")
    raw = create_table(spark, f"{db}.loaded_raw", raw_table_schema())
    load_file_into_table(spark, text_comma, raw, mode="overwrite")

    def annual():
        annual_summary(spark, csv_path, output_path=f"{out}/annual", table=f"{db}.annual")

    def annual_declared():
        annual_summary(spark, csv_path, output_path=f"{out}/annual2", table=f"{db}.annual2", schema=sighting_schema())

    def biennial():
        biennial_summary(spark, csv_path, output_path=f"{out}/biennial", hive_table=f"{db}.biennial")

    def biennial_chrono():
        biennial_summary(spark, csv_path, output_path=f"{out}/biennial_c", chronological=True).count()

    def annual_exact_median():
        annual_summary(
            spark, csv_path, output_path=f"{out}/annual_x", table=f"{db}.annual_x", schema=sighting_schema(), median="exact"
        )

    def annual_from_table():
        summary_from_table(spark, raw, "year", output_path=f"{out}/annual_t", summary_table=f"{db}.annual_t")

    def load_partition():
        res = load_and_partition(spark, text_comma, db, mode="overwrite")
        res.partitions.collect()

    def load_by_year():
        res = inspect_and_partition_by_year(spark, text_pipe, db, sep="|", mode="overwrite")
        res.raw_count.collect()
        res.partitions.collect()

    def reference_form():
        # The reference's shape: one agg call (multi-distinct expansion),
        # then three actions that each recompute read + aggregate.
        keyed = keyed_reports(read_csv(spark, csv_path), "year")
        result = keyed.groupBy("year").agg(*summary_columns())
        result.collect()
        save_csv(result, f"{out}/ref_csv", "year")
        save_table(result, f"{db}.ref_annual", "year")

    timed = _time_all(
        {
            "annual_summary": annual,
            "annual_summary_explicit_schema": annual_declared,
            "biennial_summary": biennial,
            "biennial_summary_chronological": biennial_chrono,
            "annual_summary_exact_median": annual_exact_median,
            "annual_summary_from_table": annual_from_table,
            "load_and_partition": load_partition,
            "load_and_partition_by_year": load_by_year,
            "reference_form_annual_recompute_per_sink": reference_form,
        },
        runs,
        WARMUP_RUNS,
    )
    comparisons = {"reference_form_annual_recompute_per_sink": timed.pop("reference_form_annual_recompute_per_sink")}
    queries = timed
    print(
        json.dumps(
            {
                "metric": "reference_jobs_median_seconds",
                "value": round(sum(queries[q] for q in HEADLINE), 4),
                "headline": list(HEADLINE),
                "unit": "sec",
                "queries": queries,
                "comparisons": comparisons,
                "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                "rows_in": rows_in,
                "cpus": cpus,
                "runs": runs,
                "warmup_runs": WARMUP_RUNS,
                "shuffle_partitions": cpus,
                "max_partition_bytes": split,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
