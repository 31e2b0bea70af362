"""Jobs composed from sources, operators and sinks."""

from skywatch.plans.incremental import SummaryStore
from skywatch.plans.load import (
    LoadResult,
    inspect_and_partition_by_year,
    insert_partitioned,
    load_and_partition,
    load_file_into_table,
    load_new_files,
)
from skywatch.plans.summary import (
    SummaryTarget,
    annual_summary,
    biennial_summary,
    keyed_reports,
    materialize,
    publish_summary,
    summarize_reports,
    summary_from_table,
    summary_job,
    summary_jobs,
    summary_jobs_from_table,
)

__all__ = [
    "LoadResult",
    "SummaryStore",
    "SummaryTarget",
    "annual_summary",
    "biennial_summary",
    "inspect_and_partition_by_year",
    "insert_partitioned",
    "keyed_reports",
    "load_and_partition",
    "load_file_into_table",
    "load_new_files",
    "materialize",
    "publish_summary",
    "summarize_reports",
    "summary_from_table",
    "summary_job",
    "summary_jobs",
    "summary_jobs_from_table",
]
