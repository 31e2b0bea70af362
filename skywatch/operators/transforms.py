"""Row-level transforms: derived year keys, projection, NULL filtering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skywatch.functions.dates import MONTH_PATTERN, year_bucket, year_of_month_text


def with_year(
    df: DataFrame,
    date_col: str = "date",
    name: str = "year",
    pattern: str = MONTH_PATTERN,
) -> DataFrame:
    """Add the calendar year of the month text; unparsable text gives NULL."""
    return df.withColumn(name, year_of_month_text(date_col, pattern))


def with_year_bucket(
    df: DataFrame,
    width: int = 2,
    year_col: str = "year",
    name: str = "year_group",
    date_col: str = "date",
) -> DataFrame:
    """Add the start year of the ``width``-year bucket (adds ``year`` if absent)."""
    if year_col not in df.columns:
        df = with_year(df, date_col, year_col)
    return df.withColumn(name, year_bucket(year_col, width))


def project_columns(
    df: DataFrame,
    columns: Sequence[str],
    partition_cols: Sequence[str] = (),
) -> DataFrame:
    """Select ``columns`` in order, partition columns moved to the end."""
    body = [c for c in columns if c not in partition_cols]
    return df.select(*body, *partition_cols)


def split_not_null(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """Return (rows where ``col`` is not NULL, rows where it is NULL).

    Both halves are lazy filters over the same input; with a text source
    the second one holds the header line, shifted rows and malformed
    values that the first one drops.
    """
    c = F.col(col)
    return df.where(c.isNotNull()), df.where(c.isNull())


def require_not_null(df: DataFrame, col: str) -> DataFrame:
    """Keep rows where ``col`` is not NULL."""
    return df.where(F.col(col).isNotNull())
