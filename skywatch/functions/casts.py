"""Text-table field conversion.

A delimited-text table converts each field from text on read. Integer fields
accept an optional sign and digits, optionally followed by a fractional part
that is dropped (``4.7`` -> 4); a fraction alone is zero (``.5``, ``-.5``). Anything else (empty text, surrounding
blanks, letters, out-of-range values) is NULL. The null marker of text
tables, ``\\N``, is NULL for every type; an empty string field stays ``''``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skywatch.functions._cols import ColumnOrName, as_col
from skywatch.functions.dates import parse_date_text

# The null marker of delimited-text tables, the accepted
# integer text (sign, digits, optional dropped fraction) and the date text.
TEXT_NULL_MARKER = "\\N"
INTEGRAL_TEXT = r"^([-+]?[0-9]+)(?:\.[0-9]*)?$"
FRACTION_TEXT = r"^[-+]?\.[0-9]+$"
TEXT_DATE_PATTERN = "yyyy-MM-dd"

_INTEGRAL_TYPES = (
    (T.ByteType, "tinyint"),
    (T.ShortType, "smallint"),
    (T.IntegerType, "int"),
    (T.LongType, "bigint"),
)


def tolerant_int(col: ColumnOrName, type_name: str = "int") -> Column:
    """Text -> integral type with text-table rules; malformed -> NULL."""
    c = as_col(col)
    digits = F.regexp_extract(c, INTEGRAL_TEXT, 1)
    # regexp_extract gives '' on no match: answer NULL without a cast attempt
    # (a failing cast is the slow path); try_cast only sees digit strings and
    # gives NULL on overflow.
    zero = F.lit(0).cast(type_name)
    return F.when(digits != F.lit(""), digits.try_cast(type_name)).when(c.rlike(FRACTION_TEXT), zero)


def text_field(
    col: ColumnOrName,
    data_type: T.DataType,
    null_marker: str | None = TEXT_NULL_MARKER,
) -> Column:
    """Convert one text field to ``data_type`` the way a text table reads it."""
    c = as_col(col)
    if null_marker is not None:
        c = F.when(c == F.lit(null_marker), F.lit(None).cast("string")).otherwise(c)
    if isinstance(data_type, T.StringType):
        return c
    for cls, name in _INTEGRAL_TYPES:
        if isinstance(data_type, cls):
            return tolerant_int(c, name)
    if isinstance(data_type, T.DateType):
        return parse_date_text(c, TEXT_DATE_PATTERN)
    if isinstance(data_type, (T.DoubleType, T.FloatType, T.BooleanType)):
        return c.try_cast(data_type.simpleString())
    raise TypeError(f"unsupported text-table column type: {data_type.simpleString()}")
