"""Date-text parsing and derived date keys.

All functions return Column expressions built from Spark built-ins, so they
stay inside whole-stage codegen. Parsing is strict about the pattern and
tolerant about failure: text that does not match gives NULL instead of
raising, whatever ``spark.sql.ansi.enabled`` is set to. Every year that a
timestamp can hold parses; years beyond that give NULL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from skywatch.functions._cols import ColumnOrName, as_col

# The text patterns of the report columns.
MONTH_PATTERN = "MM/yyyy"
DAY_PATTERN = "MM/dd/yyyy"


# The last year that a timestamp holds whole, the year after it (held up to its
# ninth day), and the first year held whole.
LAST_YEAR = 294_246
FIRST_YEAR = -290_307
_LONG_YEAR = r"[-+]?[0-9]{6,}"


def _has_free_year(pattern: str) -> bool:
    """Whether the year field takes any number of digits: ``yyyy`` with no field right beside it."""
    return re.search(r"(?<![A-Za-z])yyyy(?![A-Za-z])", pattern) is not None


def _longest_usual(pattern: str) -> int:
    """Texts up to this length have no room for a year of six digits beside the other fields."""
    fixed = set(re.findall(r"[A-Za-z]+", pattern)) <= {"yyyy", "MM", "dd", "HH", "mm", "ss"}
    return len(pattern) if fixed else 5


def parse_date_text(col: ColumnOrName, pattern: str) -> Column:
    """Parse text with ``pattern`` to a date; anything malformed gives NULL.

    The year field also takes a sign and more than four digits, and a year past the timestamp
    range makes ``try_to_date`` fail instead of giving NULL. So text longer than the pattern with a
    run of six digits or more is parsed only if that number is a year the type can hold; shorter text has no room for such a year, so that the usual text is parsed once and searched never.
    """
    c = as_col(col)
    parsed = F.try_to_date(c, pattern)
    if not _has_free_year(pattern):
        return parsed
    year = F.regexp_extract(c, _LONG_YEAR, 0).try_cast("bigint")
    in_year = F.try_to_date(F.regexp_replace(c, _LONG_YEAR, "2000"), pattern)
    held = year.between(FIRST_YEAR, LAST_YEAR) | (
        (year == LAST_YEAR + 1) & (F.month(in_year) == 1) & (F.dayofmonth(in_year) <= 9)
    )
    return F.when((F.length(c) <= _longest_usual(pattern)) | ~c.rlike(_LONG_YEAR) | held, parsed)


def parse_month(col: ColumnOrName, pattern: str = MONTH_PATTERN) -> Column:
    """Parse month text (``MM/yyyy``) to the first day of that month, else NULL."""
    return parse_date_text(col, pattern)


def parse_day(col: ColumnOrName, pattern: str = DAY_PATTERN) -> Column:
    """Parse day text (``MM/dd/yyyy``) to a date, else NULL."""
    return parse_date_text(col, pattern)


def year_of_month_text(col: ColumnOrName, pattern: str = MONTH_PATTERN) -> Column:
    """Calendar year of month text; NULL when the text does not parse."""
    return F.year(parse_month(col, pattern))


def lag_days(report: ColumnOrName, posted: ColumnOrName, pattern: str = DAY_PATTERN) -> Column:
    """Days from posting to report: ``report - posted`` (negative when posted later).

    NULL unless both texts parse.
    """
    return F.datediff(parse_day(report, pattern), parse_day(posted, pattern))


def year_bucket(year: ColumnOrName, width: int = 2) -> Column:
    """Start year of a ``width``-year bucket: ``int(year / width) * width``.

    Double division then a truncating cast, so it rounds toward zero; NULL
    stays NULL.
    """
    if width < 1:
        raise ValueError("bucket width must be a positive integer")
    return (as_col(year) / F.lit(width)).cast("int") * F.lit(width)
