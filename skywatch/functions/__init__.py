"""Column functions: date-text parsing, year keys, text-field conversion."""

from skywatch.functions.casts import text_field, tolerant_int
from skywatch.functions.dates import (
    DAY_PATTERN,
    MONTH_PATTERN,
    lag_days,
    parse_day,
    parse_month,
    year_bucket,
    year_of_month_text,
)

__all__ = [
    "DAY_PATTERN",
    "MONTH_PATTERN",
    "lag_days",
    "parse_day",
    "parse_month",
    "text_field",
    "tolerant_int",
    "year_bucket",
    "year_of_month_text",
]
