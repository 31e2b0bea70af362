"""Brute-force checks of the summary on generated rows."""

import datetime
import math
import random
import statistics
import struct
from collections import defaultdict
from datetime import date
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skywatch import summarize_reports
from skywatch.functions.ordering import double_key
from skywatch.operators.aggregates import lower_median
from skywatch.schema import sighting_schema

months = st.one_of(
    st.builds(lambda m, y: f"{m:02d}/{y}", st.integers(1, 12), st.integers(1990, 2005)),
    st.sampled_from(["junk", "13/1999", "1/1999", ""]),
)
days = st.one_of(
    st.builds(lambda m, d, y: f"{m:02d}/{d:02d}/{y}", st.integers(1, 12), st.integers(1, 28), st.integers(1990, 2005)),
    st.sampled_from(["02/30/1999", None]),
)
rows = st.lists(
    st.tuples(
        months,
        st.one_of(st.none(), st.sampled_from(["a", "b", "c"])),
        st.one_of(st.none(), st.sampled_from(["disk", "orb"])),
        days,
        days,
        st.one_of(st.none(), st.integers(0, 12)),
    ),
    min_size=1,
    max_size=40,
)


def _parse_month(s):
    try:
        m, y = s.split("/")
        if len(m) == 2 and len(y) == 4 and 1 <= int(m) <= 12:
            return date(int(y), int(m), 1)
    except (ValueError, AttributeError):
        pass
    return None


def _parse_day(s):
    try:
        m, d, y = s.split("/")
        if len(m) == 2 and len(d) == 2 and len(y) == 4:
            return date(int(y), int(m), int(d))
    except (ValueError, AttributeError):
        pass
    return None


def _expected(data, width=None):
    groups = defaultdict(list)
    for r in data:
        pm = _parse_month(r[0])
        y = pm.year if pm else None
        key = y if width is None or y is None else int(y / width) * width
        groups[key].append(r)
    out = {}
    for key, rs in groups.items():
        texts = [r[0] for r in rs]
        mc = sorted(r[5] for r in rs if r[5] is not None)
        lags = [
            (_parse_day(r[3]) - _parse_day(r[4])).days
            for r in rs
            if _parse_day(r[3]) and _parse_day(r[4])
        ]
        out[key] = (
            max(texts),
            min(texts),
            len({r[1] for r in rs if r[1] is not None}),
            len({r[2] for r in rs if r[2] is not None}),
            mc[(len(mc) - 1) // 2] if mc else None,
            statistics.fmean(lags) if lags else None,
        )
    return out


def _frame(spark, data):
    full = [("d", m, c, "s", "USA", sh, "x", rd, pd, n) for (m, c, sh, rd, pd, n) in data]
    return spark.createDataFrame(full, sighting_schema())


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows)
def test_summary_matches_brute_force(spark, data):
    for key, width in (("year", None), ("year_group", 2)):
        got = {
            r[key]: (r.max_date, r.min_date, r.unique_cities, r.unique_shapes, r.median_month_count, r.avg_days_diff)
            for r in summarize_reports(_frame(spark, data), key).collect()
        }
        exp = _expected(data, width)
        assert got.keys() == exp.keys()
        for k in exp:
            g, e = got[k], exp[k]
            assert g[:5] == e[:5], (key, k)
            assert (g[5] is None and e[5] is None) or abs(g[5] - e[5]) < 1e-9


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows)
def test_group_counts_add_up_and_buckets_nest(spark, data):
    from skywatch.plans import keyed_reports

    keyed = keyed_reports(_frame(spark, data), "year_group")
    by_year = {r.year: r.n for r in keyed.groupBy("year").agg(F.count("*").alias("n")).collect()}
    by_group = {r.year_group: r.n for r in keyed.groupBy("year_group").agg(F.count("*").alias("n")).collect()}
    assert sum(by_year.values()) == sum(by_group.values()) == len(data)
    regrouped = defaultdict(int)
    for y, n in by_year.items():
        regrouped[None if y is None else int(y / 2) * 2] += n
    assert dict(regrouped) == by_group


def test_summary_with_hot_year_matches_brute_force(spark):
    # 3,000 rows over 8 input partitions; one year holds a third of them.
    data = []
    for i in range(3000):
        year = 1999 if i % 3 == 0 else 1990 + i % 11
        data.append(
            (
                f"{1 + i % 12:02d}/{year}",
                None if i % 17 == 0 else f"c{i % 97}",
                None if i % 19 == 0 else f"s{i % 5}",
                f"{1 + i % 12:02d}/{1 + i % 28:02d}/{year}",
                None if i % 23 == 0 else f"{1 + (i * 7) % 12:02d}/{1 + i % 27:02d}/{year}",
                None if i % 29 == 0 else i % 13,
            )
        )
    df = _frame(spark, data).repartition(8)
    for key, width, median in (("year", None, "approx"), ("year_group", 2, "approx"), ("year", None, "exact")):
        got = {
            r[key]: (r.max_date, r.min_date, r.unique_cities, r.unique_shapes, r.median_month_count, r.avg_days_diff)
            for r in summarize_reports(df, key, median=median).collect()
        }
        exp = _expected(data, width)
        assert got.keys() == exp.keys()
        for k in exp:
            assert got[k][:5] == exp[k][:5], (key, k)
            assert abs(got[k][5] - exp[k][5]) < 1e-9


def _lower_median_brute(pairs):
    groups = defaultdict(list)
    for k, v in pairs:
        groups[k].append(v)
    out = {}
    for k, vs in groups.items():
        vals = sorted(v for v in vs if v is not None)
        if vals:
            out[k] = vals[(len(vals) + 1) // 2 - 1]
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    pairs=st.lists(
        st.tuples(
            st.one_of(st.none(), st.integers(1, 4)),
            st.one_of(st.none(), st.integers(-50, 50), st.integers(-(2**31), 2**31 - 1)),
        ),
        min_size=1,
        max_size=60,
    )
)
def test_lower_median_matches_brute_force(spark, pairs):
    from skywatch.operators.aggregates import lower_median

    df = spark.createDataFrame(pairs, "k int, v int").repartition(5)
    got = {r.k: r.m for r in lower_median(df, "k", "v", "m").collect()}
    assert got == _lower_median_brute(pairs)


def test_lower_median_hot_key_many_buckets(spark):
    from skywatch.operators.aggregates import lower_median

    # Key 1 has a third of the rows and values spread over many high-bit
    # buckets (negative ones too); the others are dense in one bucket.
    pairs = [
        (1, ((i * 7919) % 400_003) * 10_007 - 2_000_000_000) if i % 3 == 0 else (2 + i % 5, (i * 31) % 1000)
        for i in range(30000)
    ]
    df = spark.createDataFrame(pairs, "k int, v int").repartition(8)
    got = {r.k: r.m for r in lower_median(df, "k", "v", "m").collect()}
    assert got == _lower_median_brute(pairs)


EXTREME = [0.0, -0.0, 1.0, -1.0, 1.5, 4.5, 1e308, -1e308, 1.7976931348623157e308, 5e-324, -5e-324, 2.2250738585072014e-308]
EXTREME += [2.225073858507201e-308, float("inf"), float("-inf"), float("nan"), 0.1, 0.30000000000000004, 2.0**1023, 2.0**-1022]
EXTREME += [x for e in (-1074, -1000, -52, -1, 0, 1, 52, 53, 1000, 1023) for x in (2.0**e, math.nextafter(2.0**e, 0.0), math.nextafter(2.0**e, 2.0**1023))]


def _bits(x):
    """The order key of a double from its actual bits."""
    if x != x:
        return (0x7FF << 52) + 1
    bits = struct.unpack(">q", struct.pack(">d", abs(x)))[0]
    return -bits if x < 0 else bits


def test_double_keys_are_the_bits_of_the_doubles(spark):
    rng = random.Random(9)
    values = EXTREME + [-x for x in EXTREME] + [struct.unpack(">d", rng.randbytes(8))[0] for _ in range(3000)]
    values += [rng.gauss(0, 1) * 10 ** rng.randrange(-20, 20) for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = {r.i: r.k for r in df.select("i", double_key(F.col("v")).alias("k")).collect()}
    wrong = [(values[i], k) for i, k in got.items() if k != _bits(values[i])]
    assert not wrong, wrong[:5]


def _lower(values, key=None):
    present = sorted((v for v in values if v is not None), key=key)
    return present[(len(present) - 1) // 2] if present else None


ORDERED = {
    "double": (lambda r: r.choice([None, r.gauss(0, 5), float(r.randrange(4)), 1e300 * r.random(), -5e-324]), None),
    "float": (lambda r: r.choice([None, float(r.randrange(-9, 9)) / 4]), None),
    "smallint": (lambda r: r.choice([None, r.randrange(-300, 300)]), None),
    "bigint": (lambda r: r.randrange(-(2**63), 2**63), None),
    "boolean": (lambda r: r.choice([None, True, False]), None),
    "date": (lambda r: datetime.date(1, 1, 1) + datetime.timedelta(r.randrange(3_000_000)), None),
    "timestamp": (lambda r: datetime.datetime(1950, 1, 1) + datetime.timedelta(microseconds=r.randrange(10**16)), None),
    "timestamp_ntz": (lambda r: datetime.datetime(1950, 1, 1) + datetime.timedelta(microseconds=r.randrange(10**16)), None),
    "decimal(9,3)": (lambda r: Decimal(r.randrange(-(10**9) + 1, 10**9)).scaleb(-3), None),
    "decimal(18,18)": (lambda r: Decimal(r.randrange(-(10**18) + 1, 10**18)).scaleb(-18), None),
    "decimal(20,0)": (lambda r: Decimal(r.randrange(-(10**20) + 1, 10**20)), None),
    "decimal(38,10)": (lambda r: Decimal(r.choice([r.randrange(-(10**38) + 1, 10**38), r.randrange(-9, 9)])).scaleb(-10), None),
    "decimal(38,38)": (lambda r: Decimal(r.randrange(-(10**38) + 1, 10**38)).scaleb(-38), None),
}


@pytest.mark.parametrize("kind", sorted(ORDERED))
def test_lower_median_of_every_ordered_type(spark, kind):
    rng = random.Random(kind)
    make, _ = ORDERED[kind]
    rows = [(rng.choice([None, 1, 2, 2, 2, 2]), make(rng)) for _ in range(500)] + [(3, None), (4, make(rng))]
    df = spark.createDataFrame(rows, f"k int, v {kind}").repartition(4)
    out = lower_median(df, "k", "v", "m")
    assert out.schema["m"].dataType.simpleString() == kind
    want = {k: _lower(v for key, v in df.collect() if key == k) for k in {r[0] for r in rows}}
    assert {r.k: r.m for r in out.collect()} == {k: v for k, v in want.items() if v is not None}


def test_lower_median_of_nan_text_and_other_types(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, nan), (1, 1.0), (1, nan), (2, 2.0), (2, float("inf")), (2, nan)], "k int, v double")
    got = {r.k: r.m for r in lower_median(df, "k", "v", "m").collect()}
    assert got[1] != got[1] and got[2] == float("inf")
    text = spark.createDataFrame([(1, "4.5"), (1, "x"), (1, "1e1"), (1, "7")], "k int, v string")
    assert [tuple(r) for r in lower_median(text, "k", "v", "m").collect()] == [(1, 7.0)]
    with pytest.raises(TypeError):
        lower_median(spark.createDataFrame([(1, [1])], "k int, v array<int>"), "k", "v")


def test_exact_median_summary_equals_approx_on_small_groups(spark):
    data = [(f"{1 + i % 12:02d}/{1990 + i % 7}", f"c{i % 5}", "s", "01/01/1999", "01/02/1999", i % 13) for i in range(500)]
    df = _frame(spark, data)
    a = sorted(map(tuple, summarize_reports(df, "year").collect()), key=repr)
    e = sorted(map(tuple, summarize_reports(df, "year", median="exact").collect()), key=repr)
    assert a == e
