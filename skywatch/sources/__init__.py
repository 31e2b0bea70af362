"""Sources: CSV, delimited text, catalog tables, derived report frames."""

from skywatch.sources.csv import read_csv
from skywatch.sources.delimited import parse_delimited, read_delimited
from skywatch.sources.frames import sightings_from_orders, write_report_csv, write_report_text
from skywatch.sources.table import read_table

__all__ = [
    "parse_delimited",
    "read_csv",
    "read_delimited",
    "read_table",
    "sightings_from_orders",
    "write_report_csv",
    "write_report_text",
]
