"""Operators: transforms, aggregates, sinks and catalog operations."""

from skywatch.operators.aggregates import lower_median, month_extremes, row_count, summarize, summary_columns
from skywatch.operators.catalog import (
    create_database,
    create_table,
    describe_table,
    drop_table,
    list_partitions,
    use_database,
)
from skywatch.operators.sinks import insert_into, rebalance, save_csv, save_table, show_preview
from skywatch.operators.transforms import (
    project_columns,
    require_not_null,
    split_not_null,
    with_year,
    with_year_bucket,
)

__all__ = [
    "create_database",
    "create_table",
    "describe_table",
    "drop_table",
    "insert_into",
    "list_partitions",
    "lower_median",
    "month_extremes",
    "project_columns",
    "rebalance",
    "require_not_null",
    "row_count",
    "save_csv",
    "save_table",
    "show_preview",
    "split_not_null",
    "summarize",
    "summary_columns",
    "use_database",
    "with_year",
    "with_year_bucket",
]
