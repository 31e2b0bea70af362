import datetime as dt

import pytest

from skywatch.functions import lag_days, parse_day, parse_month, tolerant_int, year_bucket, year_of_month_text
from skywatch.functions.casts import text_field
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _one(spark, values, expr, schema="s string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr).collect()]


def test_parse_month_strict(spark):
    bad = ["1/1999", "13/1999", "12/99", "12/05/1999", " 12/1999", "", "junk", None]
    assert _one(spark, ["12/1999", "01/2000"], parse_month("s")) == [dt.date(1999, 12, 1), dt.date(2000, 1, 1)]
    assert _one(spark, bad, parse_month("s")) == [None] * len(bad)


def test_parse_day_strict(spark):
    assert _one(spark, ["01/05/1999"], parse_day("s")) == [dt.date(1999, 1, 5)]
    assert _one(spark, ["02/30/1999", "1/5/1999", "01/05/99"], parse_day("s")) == [None, None, None]


def test_year_of_month_text(spark):
    assert _one(spark, ["12/1998", "junk", None], year_of_month_text("s")) == [1998, None, None]


def test_parsing_does_not_raise_under_ansi(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    assert _one(spark, ["junk"], parse_month("s")) == [None]


def test_lag_days_sign_is_report_minus_posted(spark):
    df = spark.createDataFrame([("01/05/1999", "01/28/1999"), ("01/28/1999", "01/05/1999"), ("x", "01/05/1999")], "r string, p string")
    assert [r[0] for r in df.select(lag_days("r", "p")).collect()] == [-23, 23, None]


@pytest.mark.parametrize(
    "year,width,expected",
    [(1998, 2, 1998), (1999, 2, 1998), (2000, 2, 2000), (2001, 5, 2000), (-1999, 2, -1998), (None, 2, None)],
)
def test_year_bucket_truncates(spark, year, width, expected):
    assert _one(spark, [year], year_bucket("s", width), "s int") == [expected]


def test_year_bucket_rejects_bad_width():
    with pytest.raises(ValueError):
        year_bucket("y", 0)


def test_tolerant_int(spark):
    values = ["7", "+7", "-7", "4.7", "4.", "", " 4", "4 ", "x", "2147483648", "1e3", None]
    assert _one(spark, values, tolerant_int("s")) == [7, 7, -7, 4, 4, None, None, None, None, None, None, None]
    values = [".5", "-.5", "+.5", "-.", "..", ".", "-", "+", "4..5", ".5x", "007", "-2147483648", "4.x"]
    assert _one(spark, values, tolerant_int("s")) == [0, 0, 0, None, None, None, None, None, None, None, 7, -2147483648, None]


def test_text_field_null_marker_and_types(spark):
    assert _one(spark, ["\\N", "", "a"], text_field("s", T.StringType())) == [None, "", "a"]
    assert _one(spark, ["\\N", "5"], text_field("s", T.LongType())) == [None, 5]
    assert _one(spark, ["1999-01-05", "01/05/1999"], text_field("s", T.DateType())) == [dt.date(1999, 1, 5), None]
    with pytest.raises(TypeError):
        text_field("s", T.ArrayType(T.StringType()))


def test_out_of_range_years_give_null_not_overflow(spark):
    # Signed years inside the range parse as Spark parses them; years past the
    # timestamp range used to raise a long overflow inside try_to_date.
    values = ["12/-1999", "12/+99999", "01/+1000000", "12/-290309", "12/+294247", "01/+9999999999", "01/+99999999999999999999"]
    got = _one(spark, values, year_of_month_text("s"))
    assert got == [-1999, 99999, None, None, None, None, None]
    held = ["01/+100000", "01/+200000", "12/+294246", "01/+294247", "01/+294248"]
    assert _one(spark, held, year_of_month_text("s")) == [100000, 200000, 294246, 294247, None]
    days = ["01/09/+294247", "01/11/+294247", "12/31/+294246"]
    assert _one(spark, days, F.year(parse_day("s"))) == [294247, None, 294246]
    assert _one(spark, ["01/05/+1000000", "01/05/1999"], parse_day("s")) == [None, dt.date(1999, 1, 5)]
    assert _one(spark, ["+1000000-01-01"], text_field("s", T.DateType())) == [None]


def test_patterns_without_a_free_year_parse_as_they_are(spark):
    from skywatch.functions.dates import parse_date_text

    assert _one(spark, ["19990105", "1999015"], parse_date_text("s", "yyyyMMdd")) == [dt.date(1999, 1, 5), None]
