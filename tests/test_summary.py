import os

from pyspark.sql import functions as F

from skywatch import annual_summary, biennial_summary, read_csv, summarize_reports
from skywatch.operators import create_database, row_count
from skywatch.schema import sighting_schema, summary_schema
from skywatch.session import unique_name

COLS = ["max_date", "min_date", "unique_cities", "unique_shapes", "median_month_count", "avg_days_diff"]


def _by_key(df, key):
    return {r[key]: tuple(r[c] for c in COLS) for r in df.collect()}


def test_annual_summary_fixture(spark, summary_csv):
    got = _by_key(summarize_reports(read_csv(spark, summary_csv), "year"), "year")
    assert got == {
        1998: ("12/1998", "12/1998", 1, 1, 5, -23.0),
        1999: ("02/1999", "01/1999", 2, 1, 7, -22.0),
        None: ("junk", "junk", 1, 1, 9, -26.0),
    }


def test_exact_median_fixture(spark, summary_csv):
    got = _by_key(summarize_reports(read_csv(spark, summary_csv), "year_group", median="exact"), "year_group")
    assert got == {
        1998: ("12/1998", "01/1999", 2, 2, 5, -22.5),
        None: ("junk", "junk", 1, 1, 9, -26.0),
    }


def test_biennial_summary_text_extremes(spark, summary_csv):
    got = _by_key(summarize_reports(read_csv(spark, summary_csv), "year_group"), "year_group")
    assert got == {
        1998: ("12/1998", "01/1999", 2, 2, 5, -22.5),
        None: ("junk", "junk", 1, 1, 9, -26.0),
    }


def test_biennial_summary_chronological_extremes(spark, summary_csv):
    df = summarize_reports(read_csv(spark, summary_csv), "year_group", chronological=True)
    got = {r["year_group"]: (r["max_date"], r["min_date"]) for r in df.collect()}
    assert got == {1998: ("02/1999", "12/1998"), None: (None, None)}


def test_summary_schema(spark, summary_csv):
    df = summarize_reports(read_csv(spark, summary_csv), "year")
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in summary_schema("year")]


def test_inferred_schema_matches_declared(spark, summary_csv):
    inferred = read_csv(spark, summary_csv).schema
    assert [(f.name, f.dataType) for f in inferred] == [(f.name, f.dataType) for f in sighting_schema()]


def test_annual_job_writes_table_and_csv(spark, summary_csv, tmp_path):
    db = create_database(spark, unique_name("t"), location=str(tmp_path / "db"))
    out = str(tmp_path / "annual")
    result = annual_summary(spark, summary_csv, output_path=out, table=f"{db}.annual")
    # Table read-back: partition column last.
    assert result.columns == COLS + ["year"]
    assert sorted(d for d in os.listdir(out) if d.startswith("year=")) == [
        "year=1998",
        "year=1999",
        "year=__HIVE_DEFAULT_PARTITION__",
    ]
    back = spark.read.csv(out)  # no header by default: _c0.._c5 + year
    assert back.columns == [f"_c{i}" for i in range(6)] + ["year"]
    assert back.where(F.col("year").isNull()).count() == 1
    # One file per key directory: the final aggregate is partitioned on the key.
    for d in ("year=1998", "year=1999"):
        assert len([f for f in os.listdir(os.path.join(out, d)) if f.startswith("part-")]) == 1


def test_biennial_job_without_table_uses_checkpoint_copy(spark, summary_csv, tmp_path):
    out = str(tmp_path / "biennial")
    result = biennial_summary(spark, summary_csv, output_path=out)
    assert row_count(result).first()[0] == 2
    assert sorted(d for d in os.listdir(out) if d.startswith("year_group=")) == [
        "year_group=1998",
        "year_group=__HIVE_DEFAULT_PARTITION__",
    ]


def test_rerun_overwrites_outputs(spark, summary_csv, tmp_path):
    db = create_database(spark, unique_name("t"), location=str(tmp_path / "db"))
    out = str(tmp_path / "annual")
    annual_summary(spark, summary_csv, output_path=out, table=f"{db}.annual")
    again = annual_summary(spark, summary_csv, output_path=out, table=f"{db}.annual")
    assert again.count() == 3
    assert spark.read.csv(out).count() == 3


def test_approx_distinct_option(spark, summary_csv):
    exact = _by_key(summarize_reports(read_csv(spark, summary_csv), "year"), "year")
    approx = _by_key(summarize_reports(read_csv(spark, summary_csv), "year", approx_distinct=True, median="approx"), "year")
    assert approx == exact  # tiny cardinalities are exact for the sketch


def test_exact_median_key_guard(spark, summary_csv):
    import pytest

    from skywatch import summarize

    with pytest.raises(ValueError):
        summarize(read_csv(spark, summary_csv), "month_count", median="exact")
    with pytest.raises(ValueError):
        summarize(read_csv(spark, summary_csv), "year", median="median")
    for option in ({"approx_distinct": True}, {"rsd": 0.1}, {"accuracy": 100}):
        with pytest.raises(ValueError):
            summarize(read_csv(spark, summary_csv), "year", **option)


def test_lower_median_of_wide_integers(spark):
    import random

    from skywatch.operators.aggregates import lower_median

    rng = random.Random(3)
    wide = [0, -1, 1, 2**62, -(2**63), 2**63 - 1, 2**31, -(2**31), 2**16, -(2**16)]
    rows = [(k % 7, rng.choice(wide) if k % 3 else rng.randrange(-(2**63), 2**63)) for k in range(500)] + [(None, 5), (8, None)]
    got = {r[0]: r[1] for r in lower_median(spark.createDataFrame(rows, "k int, v bigint"), "k", "v", "m").collect()}
    for k in [*range(7), None]:
        values = sorted(v for x, v in rows if x == k and v is not None)
        assert got[k] == values[(len(values) + 1) // 2 - 1]
    assert 8 not in got


def test_unknown_key_rejected(spark, summary_csv):
    import pytest

    with pytest.raises(ValueError):
        summarize_reports(read_csv(spark, summary_csv), "decade")


def test_results_do_not_depend_on_partitioning_or_adaptive_execution(spark, summary_csv):
    baseline = sorted(map(tuple, summarize_reports(read_csv(spark, summary_csv), "year").collect()), key=repr)
    settings = [
        {"spark.sql.shuffle.partitions": "1"},
        {"spark.sql.shuffle.partitions": "200"},
        {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"},
    ]
    for conf in settings:
        old = {k: spark.conf.get(k) for k in conf}
        try:
            for k, v in conf.items():
                spark.conf.set(k, v)
            for median in ("approx", "exact"):
                got = summarize_reports(read_csv(spark, summary_csv), "year", median=median).collect()
                assert sorted(map(tuple, got), key=repr) == baseline, (conf, median)
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)
