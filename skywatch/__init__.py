"""skywatch: batch analytics over event-report tables on Spark.

Reads report files (CSV or delimited text), parses month and day text
tolerantly, keys reports by year or by multi-year bucket, summarises them
(text or chronological extremes, exact distinct counts, exact or sketched median,
mean reporting lag), and writes partitioned CSV trees and partitioned
tables. Everything is DataFrame/SQL, planned by Catalyst and adaptive
execution; the caller supplies the session.
"""

from skywatch.functions import (
    lag_days,
    parse_day,
    parse_month,
    text_field,
    tolerant_int,
    year_bucket,
    year_of_month_text,
)
from skywatch.operators import (
    create_database,
    create_table,
    describe_table,
    insert_into,
    list_partitions,
    project_columns,
    require_not_null,
    row_count,
    save_csv,
    save_table,
    show_preview,
    split_not_null,
    summarize,
    use_database,
    with_year,
    with_year_bucket,
)
from skywatch.plans import (
    annual_summary,
    biennial_summary,
    inspect_and_partition_by_year,
    load_and_partition,
    load_file_into_table,
    publish_summary,
    summarize_reports,
)
from skywatch.schema import dated_schema, raw_table_schema, sighting_schema, summary_schema
from skywatch.sources import read_csv, read_delimited, read_table, sightings_from_orders

__all__ = [
    "annual_summary",
    "biennial_summary",
    "create_database",
    "create_table",
    "dated_schema",
    "describe_table",
    "insert_into",
    "inspect_and_partition_by_year",
    "lag_days",
    "list_partitions",
    "load_and_partition",
    "load_file_into_table",
    "parse_day",
    "parse_month",
    "project_columns",
    "publish_summary",
    "raw_table_schema",
    "read_csv",
    "read_delimited",
    "read_table",
    "require_not_null",
    "row_count",
    "save_csv",
    "save_table",
    "show_preview",
    "sighting_schema",
    "sightings_from_orders",
    "split_not_null",
    "summarize",
    "summarize_reports",
    "summary_schema",
    "text_field",
    "tolerant_int",
    "use_database",
    "with_year",
    "with_year_bucket",
    "year_bucket",
    "year_of_month_text",
]
