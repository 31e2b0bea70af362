"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query starts from the driver's ``orders`` table: the report frame is
derived from it row for row (``sources.frames``), written out as the report
file the jobs read, and then run through the library's sources, operators,
sinks and jobs. Files and tables go under the session's checkpoint folder,
each run in a new sub-folder and a new database, because the returned frame
is read lazily after the function returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywatch.functions import lag_days, parse_day, parse_month, year_bucket, year_of_month_text
from skywatch.operators import (
    create_database,
    describe_table,
    project_columns,
    row_count,
    save_csv,
    save_table,
    split_not_null,
    summarize,
    with_year,
)
from skywatch.operators.aggregates import lower_median, month_extremes
from skywatch.plans import (
    SummaryStore,
    SummaryTarget,
    annual_summary as annual_job,
    biennial_summary as biennial_job,
    inspect_and_partition_by_year,
    load_and_partition,
    load_new_files as load_new_files_job,
    summarize_reports,
    summary_from_table,
    summary_jobs,
)
from skywatch.plans.load import load_file_into_table
from skywatch.operators.catalog import create_table
from skywatch.schema import dated_schema, raw_table_schema, sighting_schema, summary_csv_schema
from skywatch.session import scratch_path, unique_name
from skywatch.sources import read_csv, read_delimited, read_table, sightings_from_orders
from skywatch.sources.frames import write_report_csv, write_report_text
from skywatch.streaming import ingest_new_files

Query = Callable[[SparkSession, str], DataFrame]


# -- inputs derived from the driver's tables ---------------------------------


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings_from_orders(spark, sf_dir)


def _report_csv(spark: SparkSession, sf_dir: str) -> str:
    return write_report_csv(_reports(spark, sf_dir), scratch_path(spark, "reports-csv"))


def _report_text(spark: SparkSession, sf_dir: str, sep: str = ",") -> str:
    return write_report_text(_reports(spark, sf_dir), scratch_path(spark, "reports-text"), sep=sep)


def _database(spark: SparkSession) -> str:
    return create_database(spark, unique_name("skywatch"), location=scratch_path(spark, "db"))


# -- composed jobs -------------------------------------------------------------


def annual_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV (inferred schema) -> year -> summary -> table + CSV tree; table read-back."""
    db = _database(spark)
    return annual_job(
        spark,
        _report_csv(spark, sf_dir),
        output_path=scratch_path(spark, "annual-csv"),
        table=f"{db}.annual_summary",
    )


def annual_summary_explicit_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``annual_summary`` with a declared schema: one pass over the CSV."""
    db = _database(spark)
    return annual_job(
        spark,
        _report_csv(spark, sf_dir),
        output_path=scratch_path(spark, "annual-csv"),
        table=f"{db}.annual_summary",
        schema=sighting_schema(),
    )


def annual_summary_exact_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annual job with the distributed exact median (no sketch merge)."""
    db = _database(spark)
    return annual_job(
        spark,
        _report_csv(spark, sf_dir),
        output_path=scratch_path(spark, "annual-csv"),
        table=f"{db}.annual_summary",
        schema=sighting_schema(),
        median="exact",
    )


def biennial_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV -> two-year bucket -> summary (text extremes) -> table + CSV tree."""
    db = _database(spark)
    return biennial_job(
        spark,
        _report_csv(spark, sf_dir),
        output_path=scratch_path(spark, "biennial-csv"),
        hive_table=f"{db}.biennial_summary",
    )


def biennial_summary_chronological(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-year buckets with chronological (not text) month extremes."""
    return biennial_job(spark, _report_csv(spark, sf_dir), chronological=True)


def biennial_summary_chronological_exact_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-year buckets, chronological extremes, exact median (one input scan)."""
    return biennial_job(spark, _report_csv(spark, sf_dir), chronological=True, median="exact")


def annual_summary_chronological(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-year summary with chronological month extremes, no sinks."""
    return summarize_reports(_reports(spark, sf_dir), "year", chronological=True)


def annual_summary_from_raw_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load the delimited export into the Parquet raw table, then summarise
    the table by year (text rules apply: header and shifted rows included,
    NULL city and shape read as empty text)."""
    db = _database(spark)
    raw = create_table(spark, f"{db}.sightings_raw", raw_table_schema())
    load_file_into_table(spark, _report_text(spark, sf_dir, ","), raw, sep=",")
    return summary_from_table(spark, raw, "year", summary_table=f"{db}.annual_from_raw")


def annual_summary_fractional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annual job on counts with fractions: inference makes the column double, and so is its median."""
    reports = _reports(spark, sf_dir).withColumn("month_count", F.col("month_count") / 4)
    path = write_report_csv(reports, scratch_path(spark, "reports-csv"))
    return annual_job(spark, path, table=f"{_database(spark)}.annual_summary")


def summaries_of_one_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual, biennial and decade summaries, each to its table, from one scan and one base."""
    db = _database(spark)
    spans = (("year", 1), ("year_group", 2), ("year_group", 10))
    targets = [SummaryTarget(key, width, table=f"{db}.by_{width}") for key, width in spans]
    made = summary_jobs(spark, _report_csv(spark, sf_dir), targets, schema=sighting_schema())
    parts = [
        df.select(F.lit(width).alias("width"), F.col(key).alias("start_year"), *(c for c in df.columns if c != key))
        for (key, width), df in zip(spans, made)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _arrivals(spark: SparkSession, sf_dir: str, write: Callable[[DataFrame, str], str]) -> list[str]:
    """The reports as three arrivals, by the order of their keys: each report is in one of them."""
    reports = _reports(spark, sf_dir)
    arrival = F.pmod(F.substring("details", 2, 20).cast("bigint"), F.lit(3))
    landing = scratch_path(spark, "landing")
    return [write(reports.where(arrival == k), f"{landing}/arrival-{k}") for k in range(3)]


def incremental_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary store fed by three arrivals, compacted after two, equals the summary of all reports."""
    store = SummaryStore(spark, scratch_path(spark, "summary-store"))
    first, second, third = _arrivals(spark, sf_dir, write_report_csv)
    store.add(first)
    store.add([first, second])
    store.compact()
    store.add([first, second, third])
    store.add([first, second, third])
    (summary,) = store.publish([SummaryTarget("year", table=f"{_database(spark)}.annual_summary")])
    return summary


# -- scalar functions ------------------------------------------------------------


def parse_month_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reports(spark, sf_dir)
    return r.select(
        "details",
        "date",
        parse_month("date").alias("month"),
        year_of_month_text("date").alias("year"),
    )


def parse_day_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reports(spark, sf_dir)
    return r.select(
        "details",
        parse_day("report_date").alias("report_day"),
        parse_day("posted_date").alias("posted_day"),
    )


def lag_days_per_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reports(spark, sf_dir)
    return r.select("details", lag_days("report_date", "posted_date").alias("days_diff"))


def year_bucket_per_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = with_year(_reports(spark, sf_dir))
    return r.select(
        "details",
        "year",
        year_bucket("year", 2).alias("year_group"),
        year_bucket("year", 5).alias("year_group_5"),
    )


# -- single aggregates -------------------------------------------------------------


def _by_year(spark: SparkSession, sf_dir: str):
    return with_year(_reports(spark, sf_dir)).groupBy("year")


def minmax_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    hi, lo = month_extremes("date")
    return _by_year(spark, sf_dir).agg(hi.alias("max_date"), lo.alias("min_date"))


def distinct_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_year(spark, sf_dir).agg(
        F.count_distinct(F.col("city")).alias("unique_cities"),
        F.count_distinct(F.col("shape")).alias("unique_shapes"),
    )


def median_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year whose counts are all NULL keeps its row, with a NULL median."""
    keyed = with_year(_reports(spark, sf_dir), "date", "year")
    median = lower_median(keyed, "year").withColumnRenamed("year", "y")
    years = keyed.select("year").distinct()
    return years.join(median, years["year"].eqNullSafe(median["y"]), "left").select("year", "median_month_count")


def median_of_wide_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact median where values need several steps of 16 bits, NULL key and negatives included."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    value = (F.col("l_orderkey") * 1_000_003 * (F.col("l_linenumber") - 3)).cast("bigint")
    wide = items.select(F.col("l_returnflag").alias("flag"), value.alias("value"))
    return lower_median(wide, "flag", "value", "median_value")


def median_of_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact median of a double column, negatives and zeros included."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    value = F.col("l_extendedprice") * (F.col("l_linenumber") - 3)
    return lower_median(items.select(F.col("l_returnflag").alias("flag"), value.alias("value")), "flag", "value", "median_value")


def median_of_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact median of a date column."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    dated = items.select(F.col("l_linenumber").alias("line"), F.col("l_shipdate").cast("date").alias("day"))
    return lower_median(dated, "line", "day", "median_day")


def median_of_wide_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact median of decimals beyond 64 bits (as text, whose form both engines share)."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    value = (F.col("l_orderkey") * (F.col("l_linenumber") - 3)).cast("decimal(24,0)") * F.lit(10**12 + 39).cast("decimal(13,0)")
    wide = items.select(F.col("l_returnflag").alias("flag"), value.cast("decimal(36,0)").alias("value"))
    return lower_median(wide, "flag", "value", "median_value").withColumn("median_value", F.col("median_value").cast("string"))


def avg_lag_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_year(spark, sf_dir).agg(F.avg(lag_days("report_date", "posted_date")).alias("avg_days_diff"))


def summary_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary aggregate keyed by another column (any key works)."""
    return summarize(_reports(spark, sf_dir), "state")


# -- sources -----------------------------------------------------------------------


def csv_infer_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write reports as CSV with a header; read back with inferred types."""
    return read_csv(spark, _report_csv(spark, sf_dir))


def delimited_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited text (',' no quoting) -> raw table (append) -> table scan."""
    db = _database(spark)
    raw = create_table(spark, f"{db}.sightings_raw", raw_table_schema())
    load_file_into_table(spark, _report_text(spark, sf_dir, ","), raw, sep=",")
    return read_table(spark, raw)


def delimited_load_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with '|' as separator (no shifted rows)."""
    return read_delimited(spark, _report_text(spark, sf_dir, "|"), raw_table_schema(), "|")


# -- projections / filters ---------------------------------------------------------


def _raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_delimited(spark, _report_text(spark, sf_dir, ","), raw_table_schema(), ",")


def project_columns_partition_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [f.name for f in raw_table_schema().fields]
    return project_columns(_raw_rows(spark, sf_dir), cols, ["month_count"])


def not_null_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = split_not_null(_raw_rows(spark, sf_dir), "month_count")
    return kept


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = split_not_null(_raw_rows(spark, sf_dir), "month_count")
    return rejected


# -- load jobs, partitioned tables, catalog -----------------------------------------


def partitioned_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = load_and_partition(spark, _report_text(spark, sf_dir, ","), _database(spark))
    return read_table(spark, res.partitioned_table)


def list_table_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = load_and_partition(spark, _report_text(spark, sf_dir, ","), _database(spark))
    return res.partitions


def load_rerun_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running the load twice in append mode (reference behaviour).

    The second run appends the file to the raw table again and then inserts
    the whole raw table, so the partitioned table holds three copies.
    """
    path, db = _report_text(spark, sf_dir, ","), _database(spark)
    load_and_partition(spark, path, db, mode="append")
    res = load_and_partition(spark, path, db, mode="append")
    return read_table(spark, res.partitioned_table)


def load_rerun_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running the load twice in overwrite mode gives the same table as once."""
    path, db = _report_text(spark, sf_dir, ","), _database(spark)
    load_and_partition(spark, path, db, mode="overwrite")
    res = load_and_partition(spark, path, db, mode="overwrite")
    return read_table(spark, res.partitioned_table)


def load_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The load job fed by three arrivals, run again after each: every report is there once."""
    db, seen = _database(spark), []
    for path in _arrivals(spark, sf_dir, write_report_text):
        seen.append(path)
        for _ in range(2):
            res = load_new_files_job(spark, list(seen), db)
    table = read_table(spark, res.partitioned_table)
    return table.select(*(c for c in table.columns if c != "load_id"))


def partial_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second file, of corrected reports of a few month counts, replaces those partitions alone."""
    db = _database(spark)
    load_and_partition(spark, _report_text(spark, sf_dir, ","), db, mode="overwrite")
    corrected = _reports(spark, sf_dir).where(F.col("month_count") >= 9).withColumn("summary", F.lit("corrected"))
    path = write_report_text(corrected, scratch_path(spark, "reports-text"), sep=",")
    res = load_and_partition(spark, path, db, mode="overwrite", dynamic=True)
    return read_table(spark, res.partitioned_table)


def partitioned_insert_by_year_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hand-run variant with DATE columns: yyyy-MM-dd text, the year from the date itself."""
    reports = _reports(spark, sf_dir)
    iso = {
        "date": F.date_format(parse_month("date"), "yyyy-MM-dd"),
        "report_date": F.date_format(parse_day("report_date"), "yyyy-MM-dd"),
        "posted_date": F.date_format(parse_day("posted_date"), "yyyy-MM-dd"),
    }
    path = write_report_text(reports.withColumns(iso), scratch_path(spark, "reports-text"), sep="|")
    res = inspect_and_partition_by_year(spark, path, _database(spark), sep="|", schema=dated_schema())
    return read_table(spark, res.partitioned_table)


def partitioned_insert_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = inspect_and_partition_by_year(spark, _report_text(spark, sf_dir, "|"), _database(spark), sep="|")
    return read_table(spark, res.partitioned_table)


def list_year_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = inspect_and_partition_by_year(spark, _report_text(spark, sf_dir, "|"), _database(spark), sep="|")
    return res.partitions


def row_count_raw_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = inspect_and_partition_by_year(spark, _report_text(spark, sf_dir, "|"), _database(spark), sep="|")
    return res.raw_count


def describe_raw_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The description of the loaded table beside the number of rows it describes."""
    db = _database(spark)
    raw = create_table(spark, f"{db}.sightings_raw", raw_table_schema())
    load_file_into_table(spark, _report_text(spark, sf_dir, ","), raw, sep=",")
    rows = row_count(read_table(spark, raw)).first()["row_count"]
    return describe_table(spark, raw).withColumn("table_rows", F.lit(rows).cast("bigint"))


def streaming_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly-once incremental load: a second run over the same landing
    folder finds no new file and leaves the table as it is."""
    landing = scratch_path(spark, "landing")
    write_report_text(_reports(spark, sf_dir), f"{landing}/arrival-1", sep=",")
    db = _database(spark)
    raw = create_table(spark, f"{db}.sightings_raw", raw_table_schema())
    ingest_new_files(spark, f"{landing}/*", raw, sep=",")
    ingest_new_files(spark, f"{landing}/*", raw, sep=",")
    return read_table(spark, raw)


# -- sinks and read-back -------------------------------------------------------------


def csv_partitioned_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual summary -> CSV tree by year (no header) -> read back, key last."""
    out = scratch_path(spark, "annual-csv")
    summary = summarize_reports(_reports(spark, sf_dir), "year")
    save_csv(summary, out, "year")
    return spark.read.schema(summary_csv_schema("year")).csv(out)


def biennial_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Biennial job -> CSV tree by year_group (no header) -> read back, key last."""
    out = scratch_path(spark, "biennial-csv")
    biennial_job(spark, _report_csv(spark, sf_dir), out)
    return spark.read.schema(summary_csv_schema("year_group")).csv(out)


def table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Biennial summary -> table partitioned by year_group -> table scan."""
    db = _database(spark)
    table = save_table(summarize_reports(_reports(spark, sf_dir), "year_group"), f"{db}.biennial", "year_group")
    return read_table(spark, table)


QUERIES: dict[str, Query] = {
    "annual_summary": annual_summary,
    "annual_summary_explicit_schema": annual_summary_explicit_schema,
    "annual_summary_chronological": annual_summary_chronological,
    "annual_summary_from_raw_table": annual_summary_from_raw_table,
    "annual_summary_exact_median": annual_summary_exact_median,
    "biennial_summary": biennial_summary,
    "biennial_summary_chronological": biennial_summary_chronological,
    "biennial_summary_chronological_exact_median": biennial_summary_chronological_exact_median,
    "annual_summary_fractional_counts": annual_summary_fractional_counts,
    "summaries_of_one_scan": summaries_of_one_scan,
    "incremental_summary": incremental_summary,
    "summary_by_state": summary_by_state,
    "parse_month": parse_month_text,
    "parse_day": parse_day_text,
    "lag_days": lag_days_per_report,
    "year_bucket": year_bucket_per_report,
    "minmax_by_year": minmax_by_year,
    "distinct_by_year": distinct_by_year,
    "median_by_year": median_by_year,
    "median_of_wide_column": median_of_wide_column,
    "median_of_doubles": median_of_doubles,
    "median_of_dates": median_of_dates,
    "median_of_wide_decimals": median_of_wide_decimals,
    "avg_lag_by_year": avg_lag_by_year,
    "row_count": row_count_raw_table,
    "project_columns": project_columns_partition_last,
    "not_null_filter": not_null_filter,
    "rejected_rows": rejected_rows,
    "csv_infer_roundtrip": csv_infer_roundtrip,
    "csv_partitioned_roundtrip": csv_partitioned_roundtrip,
    "biennial_csv_roundtrip": biennial_csv_roundtrip,
    "delimited_load": delimited_load,
    "delimited_load_pipe": delimited_load_pipe,
    "streaming_ingest": streaming_ingest,
    "partitioned_insert": partitioned_insert,
    "load_rerun_append": load_rerun_append,
    "load_rerun_overwrite": load_rerun_overwrite,
    "load_new_files": load_new_files,
    "partial_reload": partial_reload,
    "partitioned_insert_by_year": partitioned_insert_by_year,
    "partitioned_insert_by_year_dated": partitioned_insert_by_year_dated,
    "list_partitions": list_table_partitions,
    "list_year_partitions": list_year_partitions,
    "table_roundtrip": table_roundtrip,
    "describe_table": describe_raw_table,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: the annual summary job."""
    return annual_summary(spark, sf_dir)


__all__ = ["QUERIES", "flagship"]
