"""Delimited-text scan with a positional schema.

This reads files the way a text table with ``FIELDS TERMINATED BY`` reads
them: every line is a row (a header line too), fields are cut at each
separator with no quoting, field ``i`` binds to column ``i`` whatever the
header says, missing trailing fields are NULL, extra fields are dropped, an
empty field stays ``''`` and typed fields that do not convert are NULL.

The CSV reader cannot give these rules (it honours quotes, makes ``''``
NULL and rejects ``4.7`` for an int), so the scan is a text read plus a
split, all in built-in expressions. Text files are split across tasks by
byte range, so the scan parallelises with the input size.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skywatch.functions.casts import TEXT_NULL_MARKER, text_field
from skywatch.schema import raw_table_schema

_FIELDS = "__fields"


def parse_delimited(
    lines: DataFrame,
    schema: T.StructType,
    sep: str = ",",
    *,
    line_col: str = "value",
    null_marker: str | None = TEXT_NULL_MARKER,
) -> DataFrame:
    """Turn a one-column frame of text lines into typed positional columns."""
    if not sep:
        raise ValueError("separator must be non-empty")
    # split() takes a regex; escape so that '|' or '.' are literal. limit -1
    # keeps trailing empty fields.
    fields = lines.select(F.split(F.col(line_col), re.escape(sep), -1).alias(_FIELDS))
    arr = F.col(_FIELDS)
    return fields.select(
        *[
            text_field(F.get(arr, i), f.dataType, null_marker).alias(f.name)
            for i, f in enumerate(schema.fields)
        ]
    )


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    sep: str = ",",
    *,
    null_marker: str | None = TEXT_NULL_MARKER,
) -> DataFrame:
    """Read delimited text files into ``schema`` (default: the raw report table)."""
    schema = schema or raw_table_schema()
    return parse_delimited(spark.read.text(path), schema, sep, null_marker=null_marker)
