"""Schemas of the sightings report table and of its summaries.

The raw report is ten positional columns. Nine are text (the three date
columns included: their parse patterns need text), the tenth is an int.
Column 2 is called ``date`` in the CSV header and ``datetime`` in the
delimited-text table; both bind by position.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The column names and order of the report table.
SIGHTING_COLUMNS = (
    "details",
    "date",
    "city",
    "state",
    "country",
    "shape",
    "summary",
    "report_date",
    "posted_date",
    "month_count",
)

# Name of column 2 in the delimited-text (raw) table.
RAW_DATE_COLUMN = "datetime"

# The summary columns, in output order, after the group key.
SUMMARY_COLUMNS = (
    "max_date",
    "min_date",
    "unique_cities",
    "unique_shapes",
    "median_month_count",
    "avg_days_diff",
)


def sighting_schema(date_column: str = "date") -> T.StructType:
    """Explicit schema of the report table (no inference pass needed)."""
    fields = [T.StructField(c, T.StringType(), True) for c in SIGHTING_COLUMNS[:-1]]
    fields[1] = T.StructField(date_column, T.StringType(), True)
    fields.append(T.StructField("month_count", T.IntegerType(), True))
    return T.StructType(fields)


def dated_schema(date_column: str = "date") -> T.StructType:
    """Report schema with the three date columns typed as DATE.

    The hand-run table declares them so; a text table then reads each as
    ``yyyy-MM-dd`` text (anything else is NULL), and the year comes from the
    date itself rather than from month text.
    """
    fields = list(sighting_schema(date_column).fields)
    for i, f in enumerate(fields):
        if f.name in (date_column, "report_date", "posted_date"):
            fields[i] = T.StructField(f.name, T.DateType(), True)
    return T.StructType(fields)


def raw_table_schema() -> T.StructType:
    """Schema of the delimited-text raw table (column 2 named ``datetime``)."""
    return sighting_schema(RAW_DATE_COLUMN)


def summary_schema(key: str = "year", key_last: bool = False) -> T.StructType:
    """Schema of a summary keyed by ``key``.

    A computed summary has the key first; a summary read back from a
    partitioned table or directory has it last (``key_last=True``).
    """
    body = [
        T.StructField("max_date", T.StringType(), True),
        T.StructField("min_date", T.StringType(), True),
        T.StructField("unique_cities", T.LongType(), False),
        T.StructField("unique_shapes", T.LongType(), False),
        T.StructField("median_month_count", T.IntegerType(), True),
        T.StructField("avg_days_diff", T.DoubleType(), True),
    ]
    key_field = T.StructField(key, T.IntegerType(), True)
    return T.StructType(body + [key_field] if key_last else [key_field] + body)


def summary_csv_schema(key: str = "year") -> T.StructType:
    """Schema for reading a summary CSV tree back (data columns, then key).

    Nullability is relaxed because file sources never promise non-null.
    """
    return T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in summary_schema(key, key_last=True)]
    )
