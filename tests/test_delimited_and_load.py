import pytest
from pyspark.sql import functions as F

from skywatch import inspect_and_partition_by_year, load_and_partition, read_delimited, read_table
from skywatch.operators import split_not_null
from skywatch.session import unique_name

from conftest import SUMMARY_CSV, write_lines


def test_delimited_rules(spark, text_file):
    rows = {r["details"]: r for r in read_delimited(spark, text_file).collect()}
    assert rows["details"]["month_count"] is None  # header line is data
    assert rows["d1"]["summary"] == '"x' and rows["d1"]["report_date"] == ' y"'  # quotes not honoured
    assert rows["d1"]["month_count"] is None
    assert rows["d2"]["month_count"] == 7
    assert rows["d3"]["month_count"] is None and rows["d3"]["shape"] == ""
    assert rows["d4"]["month_count"] == 9
    assert rows["d5"]["state"] is None and rows["d5"]["month_count"] is None
    assert rows["d6"]["month_count"] == 9  # extra field dropped
    assert rows["d7"]["month_count"] is None  # leading blank
    assert rows["d8"]["month_count"] == 4  # fraction truncated
    assert rows["d2"]["datetime"] == "01/1999"  # column 2 binds by position


def test_not_null_split(spark, text_file):
    kept, rejected = split_not_null(read_delimited(spark, text_file), "month_count")
    assert sorted(r.details for r in kept.collect()) == ["d2", "d4", "d6", "d8"]
    assert rejected.count() == 5  # 9 lines (header, d1-d8), 4 kept


def test_pipe_separator(spark, tmp_path):
    path = write_lines(tmp_path, "p.txt", ["a|01/1999|c|s|USA|disk|x, y|01/05/1999|01/28/1999|3"])
    (r,) = read_delimited(spark, path, sep="|").collect()
    assert r.summary == "x, y" and r.month_count == 3


def test_load_and_partition(spark, text_file, tmp_path):
    db = unique_name("t")
    res = load_and_partition(spark, text_file, db, location=str(tmp_path / "db"))
    assert sorted(r[0] for r in res.partitions.collect()) == ["month_count=4", "month_count=7", "month_count=9"]
    table = read_table(spark, res.partitioned_table)
    assert table.columns[-1] == "month_count"
    assert table.count() == 4
    assert res.rejected.count() == 5
    # Partition pruning reaches the scan.
    plan = table.where(F.col("month_count") == 9)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_count" in plan


def test_append_rerun_triples_and_overwrite_is_idempotent(spark, text_file, tmp_path):
    db = unique_name("t")
    loc = str(tmp_path / "db")
    load_and_partition(spark, text_file, db, location=loc)
    res = load_and_partition(spark, text_file, db, location=loc)
    assert read_table(spark, res.raw_table).count() == 18
    assert read_table(spark, res.partitioned_table).count() == 12
    db2 = unique_name("t")
    loc2 = str(tmp_path / "db2")
    load_and_partition(spark, text_file, db2, location=loc2, mode="overwrite")
    res2 = load_and_partition(spark, text_file, db2, location=loc2, mode="overwrite")
    assert read_table(spark, res2.raw_table).count() == 9
    assert read_table(spark, res2.partitioned_table).count() == 4


def test_bad_mode(spark, text_file, tmp_path):
    with pytest.raises(ValueError):
        load_and_partition(spark, text_file, unique_name("t"), location=str(tmp_path / "db"), mode="merge")


def test_inspect_with_date_typed_columns(spark, tmp_path):
    import datetime as dt

    from skywatch.schema import dated_schema

    lines = [
        "a|1999-12-01|Reno|NV|USA|disk|x|1999-12-05|1999-12-28|5",
        "b|2001-01-01|Reno|NV|USA|orb|x|2001-01-02|2001-01-03|7",
        "c|12/1999|Yuma|AZ|USA|orb|x|01/05/1999|01/28/1999|9",
    ]
    path = write_lines(tmp_path, "dated.txt", lines)
    res = inspect_and_partition_by_year(
        spark, path, unique_name("t"), location=str(tmp_path / "db"), schema=dated_schema()
    )
    assert sorted(r[0] for r in res.partitions.collect()) == ["year=1999", "year=2001", "year=__HIVE_DEFAULT_PARTITION__"]
    rows = {r.details: r for r in read_table(spark, res.partitioned_table).collect()}
    assert rows["a"].report_date == dt.date(1999, 12, 5) and rows["c"].date is None and rows["c"].year is None
    types = {r.col_name: r.data_type for r in res.description.collect()}
    assert types["date"] == "date" and types["month_count"] == "int"


def test_inspect_and_partition_by_year(spark, tmp_path):
    lines = [l.replace(",", "|") for l in SUMMARY_CSV if '"' not in l]
    path = write_lines(tmp_path, "pipe.txt", lines)
    res = inspect_and_partition_by_year(spark, path, unique_name("t"), location=str(tmp_path / "db"))
    assert res.raw_count.first()[0] == 4
    assert [r.col_name for r in res.description.collect()][:10] == [
        "details", "date", "city", "state", "country", "shape", "summary", "report_date", "posted_date", "month_count",
    ]
    assert sorted(r[0] for r in res.partitions.collect()) == ["year=1999", "year=__HIVE_DEFAULT_PARTITION__"]
    assert read_table(spark, res.partitioned_table).where(F.col("year").isNull()).count() == 2  # header + junk


def test_partial_reload_with_dynamic_overwrite(spark, text_file, tmp_path):
    db = unique_name("t")
    loc = str(tmp_path / "db")
    load_and_partition(spark, text_file, db, location=loc, mode="overwrite")
    only_nine = write_lines(tmp_path, "nine.txt", ["n1,01/2000,X,S,USA,orb,z,01/06/2000,02/01/2000,9"])
    res = load_and_partition(spark, only_nine, db, location=loc, mode="overwrite", dynamic=True)
    rows = {r.details: r.month_count for r in read_table(spark, res.partitioned_table).collect()}
    assert rows == {"d2": 7, "d8": 4, "n1": 9}  # 4 and 7 kept, 9 replaced by the new file's rows
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"  # restored


def test_full_reload_is_static_even_if_session_default_is_dynamic(spark, text_file, tmp_path):
    db = unique_name("t")
    loc = str(tmp_path / "db")
    load_and_partition(spark, text_file, db, location=loc, mode="overwrite")
    only_nine = write_lines(tmp_path, "nine.txt", ["n1,01/2000,X,S,USA,orb,z,01/06/2000,02/01/2000,9"])
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        res = load_and_partition(spark, only_nine, db, location=loc, mode="overwrite")
        rows = {r.details: r.month_count for r in read_table(spark, res.partitioned_table).collect()}
        assert rows == {"n1": 9}  # a full reload replaces every partition
        assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == "dynamic"  # caller's value restored
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
