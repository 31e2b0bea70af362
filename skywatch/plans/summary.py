"""Annual and multi-year summaries of a report file (read -> key -> aggregate -> sinks).

The aggregate runs exactly once. It is written to its durable home first
(the partitioned table, or a Parquet folder under the session's checkpoint
directory when no table is asked for), and every other sink and the
returned frame read that copy back. Losing an executor after the write
therefore never reruns the scan and aggregate over the input, and the
sinks see identical rows.

The summary has one row per key value, and years that a timestamp can hold
number under 600,000; the result is small whatever the input size. It needs no repartitioning before the partitioned writes:
the final aggregate is already hash-partitioned on the key, so each key
value is written by one task into one file.

The exact summary's base is keyed by the month text. It is small, so month text
is parsed once for each of its cells instead of once a report, and one base gives
every summary: ``summary_jobs`` runs the annual and the biennial summary, or any
other buckets, from one scan of the reports. Its scratch folder goes when the
results are durable.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skywatch.operators.aggregates import report_cells, store_cells, summarize, summarize_cells
from skywatch.operators.sinks import save_csv, save_table, show_preview
from skywatch.operators.transforms import with_year, with_year_bucket
from skywatch.session import Scratch, scratch_path
from skywatch.sources.csv import read_csv

YEAR = "year"
YEAR_GROUP = "year_group"


def keyed_reports(df: DataFrame, key: str = YEAR, width: int = 2, date_col: str = "date") -> DataFrame:
    """Add the summary key: ``year``, or the ``width``-year bucket ``year_group``."""
    if key == YEAR:
        return with_year(df, date_col, YEAR)
    if key == YEAR_GROUP:
        return with_year_bucket(df, width, YEAR, YEAR_GROUP, date_col)
    raise ValueError(f"unknown summary key: {key!r} (expected 'year' or 'year_group')")


def summarize_reports(
    df: DataFrame,
    key: str = YEAR,
    *,
    width: int = 2,
    chronological: bool = False,
    approx_distinct: bool = False,
    accuracy: int | None = None,
    date_col: str = "date",
    median: str = "exact",
    scratch: Scratch | None = None,
) -> DataFrame:
    """Key the reports and compute the summary (key first; see ``summarize``).

    ``date_col`` names the month-text column (``datetime`` in the raw table).
    """
    if median == "exact" and not approx_distinct and accuracy is None:
        return summarize_months(store_cells(report_cells(df, date_col, date_col), scratch), key, width, chronological)
    return summarize(
        keyed_reports(df, key, width, date_col),
        key,
        date_col=date_col,
        chronological=chronological,
        approx_distinct=approx_distinct,
        accuracy=accuracy,
        median=median,
    )


def summarize_months(cells: DataFrame, key: str = YEAR, width: int = 2, chronological: bool = False) -> DataFrame:
    """The summary by ``key`` from stored cells that are keyed by month text."""
    return summarize_cells(keyed_reports(cells, key, width, "_key"), key, chronological)


def materialize(result: DataFrame, tag: str = "summary") -> DataFrame:
    """Write ``result`` once under the checkpoint directory and read it back."""
    spark = result.sparkSession
    path = scratch_path(spark, tag)
    result.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def publish_summary(
    result: DataFrame,
    key: str,
    *,
    output_path: str | None = None,
    table: str | None = None,
    header: bool = False,
    csv_dynamic: bool = False,
    preview: bool = False,
) -> DataFrame:
    """Run the summary once and send it to the requested sinks.

    Returns the durable copy (from the table, key last, when ``table`` is
    given). ``csv_dynamic`` replaces only the CSV partitions present in the
    result instead of the whole folder.
    """
    spark = result.sparkSession
    if table:
        save_table(result, table, key)
        durable = spark.table(table)
    else:
        durable = materialize(result, f"summary-{key}")
    if output_path:
        save_csv(durable, output_path, key, header=header, dynamic=csv_dynamic)
    if preview:
        show_preview(durable)
    return durable


def summary_job(
    spark: SparkSession,
    input_path: str | list[str],
    key: str = YEAR,
    *,
    output_path: str | None = None,
    table: str | None = None,
    width: int = 2,
    schema: T.StructType | None = None,
    chronological: bool = False,
    approx_distinct: bool = False,
    accuracy: int | None = None,
    header: bool = False,
    preview: bool = False,
    median: str = "exact",
) -> DataFrame:
    """Read a report CSV, summarise by ``key`` and publish (see module doc).

    Without ``schema`` the types are inferred by an extra pass over all of the
    input.
    """
    reports = read_csv(spark, input_path, schema=schema)
    with Scratch(spark) as scratch:
        result = summarize_reports(
            reports,
            key,
            width=width,
            chronological=chronological,
            approx_distinct=approx_distinct,
            accuracy=accuracy,
            median=median,
            scratch=scratch,
        )
        return publish_summary(result, key, output_path=output_path, table=table, header=header, preview=preview)


@dataclass(frozen=True)
class SummaryTarget:
    """One summary of a run of several: its key, and where it goes."""

    key: str = YEAR
    width: int = 2
    chronological: bool = False
    output_path: str | None = None
    table: str | None = None
    header: bool = False


def summary_jobs(
    spark: SparkSession,
    input_path: str | list[str],
    targets: Sequence[SummaryTarget],
    *,
    schema: T.StructType | None = None,
    date_col: str = "date",
) -> list[DataFrame]:
    """Several exact summaries of a report CSV from one scan and one base, in the order of ``targets``.

    (Without ``schema`` the types are inferred by an extra pass, as in ``summary_job``.)
    """
    return _publish_targets(read_csv(spark, input_path, schema=schema), targets, date_col)


def summary_jobs_from_table(
    spark: SparkSession, table: str, targets: Sequence[SummaryTarget], *, date_col: str = "datetime"
) -> list[DataFrame]:
    """``summary_jobs`` over a loaded report table."""
    return _publish_targets(spark.table(table), targets, date_col)


def _publish_targets(reports: DataFrame, targets: Sequence[SummaryTarget], date_col: str) -> list[DataFrame]:
    with Scratch(reports.sparkSession) as scratch:
        return publish_cells(store_cells(report_cells(reports, date_col, date_col), scratch), targets)


def publish_cells(cells: DataFrame, targets: Sequence[SummaryTarget]) -> list[DataFrame]:
    """Publish each target's summary of stored cells that are keyed by month text."""
    return [
        publish_summary(
            summarize_months(cells, t.key, t.width, t.chronological), t.key, output_path=t.output_path, table=t.table, header=t.header
        )
        for t in targets
    ]


def summary_from_table(
    spark: SparkSession,
    table: str,
    key: str = YEAR,
    *,
    output_path: str | None = None,
    summary_table: str | None = None,
    date_col: str = "datetime",
    width: int = 2,
    chronological: bool = False,
    approx_distinct: bool = False,
    accuracy: int | None = None,
    header: bool = False,
    median: str = "exact",
) -> DataFrame:
    """Summarise a loaded report table (Parquet) instead of re-parsing text.

    Load the files once, then summarise as often as needed: each branch of
    the summary reads only the columns it uses from the columnar table.
    """
    with Scratch(spark) as scratch:
        result = summarize_reports(
            spark.table(table),
            key,
            width=width,
            chronological=chronological,
            approx_distinct=approx_distinct,
            accuracy=accuracy,
            date_col=date_col,
            median=median,
            scratch=scratch,
        )
        return publish_summary(result, key, output_path=output_path, table=summary_table, header=header)


def annual_summary(
    spark: SparkSession,
    input_path: str | list[str],
    output_path: str | None = None,
    table: str | None = None,
    **options,
) -> DataFrame:
    """Summary per calendar year, to a CSV tree and/or a table partitioned by ``year``."""
    return summary_job(spark, input_path, YEAR, output_path=output_path, table=table, **options)


def biennial_summary(
    spark: SparkSession,
    input_path: str | list[str],
    output_path: str | None = None,
    hive_table: str | None = None,
    *,
    width: int = 2,
    **options,
) -> DataFrame:
    """Summary per ``width``-year bucket, partitioned by ``year_group``."""
    return summary_job(
        spark, input_path, YEAR_GROUP, output_path=output_path, table=hive_table, width=width, **options
    )
