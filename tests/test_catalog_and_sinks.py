import pytest
from pyspark.errors import AnalysisException

from skywatch import create_database, create_table, describe_table, read_csv, save_csv, save_table, show_preview, use_database
from skywatch.operators.catalog import quote_ident
from skywatch.plans import summarize_reports
from skywatch.schema import raw_table_schema, summary_csv_schema
from skywatch.session import unique_name
from conftest import SUMMARY_CSV, write_lines


def test_show_preview_prints_rows(spark, summary_csv, capsys):
    show_preview(summarize_reports(read_csv(spark, summary_csv), "year"))
    out = capsys.readouterr().out
    assert "max_date" in out and "12/1998" in out


def test_use_database_switches_current(spark, tmp_path):
    before = spark.catalog.currentDatabase()
    db = create_database(spark, unique_name("u"), location=str(tmp_path / "db"))
    try:
        use_database(spark, db)
        assert spark.catalog.currentDatabase() == db
    finally:
        use_database(spark, before)


def test_create_database_guard(spark, tmp_path):
    db = create_database(spark, unique_name("g"), location=str(tmp_path / "db"))
    create_database(spark, db, location=str(tmp_path / "db"))  # IF NOT EXISTS: no error
    with pytest.raises(AnalysisException):
        create_database(spark, db, if_not_exists=False)


def test_create_table_checks_partition_columns_last(spark, tmp_path):
    db = create_database(spark, unique_name("c"), location=str(tmp_path / "db"))
    with pytest.raises(ValueError):
        create_table(spark, f"{db}.bad", raw_table_schema(), partition_by=["city"])
    t = create_table(spark, f"{db}.ok", raw_table_schema(), partition_by=["month_count"])
    rows = [r.col_name for r in describe_table(spark, t).collect()]
    assert "# Partition Information" in rows


def test_quote_ident():
    assert quote_ident("db.t") == "`db`.`t`"
    assert quote_ident("we`ird") == "`we``ird`"


def test_csv_dynamic_overwrite_keeps_other_partitions(spark, summary_csv, tmp_path):
    out = str(tmp_path / "tree")
    summary = summarize_reports(read_csv(spark, summary_csv), "year")
    save_csv(summary, out, "year")
    save_csv(summary.where("year = 1998"), out, "year", dynamic=True)
    back = spark.read.schema(summary_csv_schema("year")).csv(out)
    assert back.count() == 3  # 1999 and NULL partitions survive the partial rewrite
    save_csv(summary.where("year = 1998"), out, "year")
    assert spark.read.schema(summary_csv_schema("year")).csv(out).count() == 1  # static overwrite


def test_csv_header_option(spark, summary_csv, tmp_path):
    out = str(tmp_path / "h")
    save_csv(summarize_reports(read_csv(spark, summary_csv), "year"), out, "year", header=True)
    back = spark.read.option("header", True).csv(out)
    assert back.columns[:2] == ["max_date", "min_date"]


def test_sink_options_pass_through(spark, summary_csv, tmp_path):
    import glob

    out = str(tmp_path / "gz")
    save_csv(summarize_reports(read_csv(spark, summary_csv), "year"), out, "year", options={"compression": "gzip"})
    assert glob.glob(out + "/year=1998/*.csv.gz")
    assert spark.read.schema(summary_csv_schema("year")).csv(out).count() == 3


def test_swapped_header_fails_with_a_declared_schema(spark, tmp_path):
    from skywatch.schema import sighting_schema

    swapped = [SUMMARY_CSV[0].replace("details,date", "date,details"), *SUMMARY_CSV[1:]]
    path = write_lines(tmp_path, "swapped.csv", swapped)
    with pytest.raises(Exception, match="(?i)header|column name"):
        read_csv(spark, path, schema=sighting_schema()).collect()


def test_batch_writes_to_a_stream_table_are_refused(spark, tmp_path):
    from skywatch.schema import raw_table_schema
    from skywatch.streaming import ingest_new_files

    landing = tmp_path / "landing"
    landing.mkdir()
    write_lines(landing, "a.txt", SUMMARY_CSV[1:])
    db = create_database(spark, unique_name("own"), location=str(tmp_path / "db"))
    raw = create_table(spark, f"{db}.raw", raw_table_schema())
    ingest_new_files(spark, str(landing), raw)
    with pytest.raises(ValueError, match="stream"):
        save_table(spark.table(raw), raw, mode="append")


def test_read_csv_options_pass_through(spark, summary_csv):
    df = read_csv(spark, summary_csv, nullValue="junk")
    assert df.where("details = 'd4'").first()["date"] is None


def test_save_table_other_format(spark, summary_csv, tmp_path):
    from skywatch import save_table

    db = create_database(spark, unique_name("f"), location=str(tmp_path / "db"))
    t = save_table(summarize_reports(read_csv(spark, summary_csv), "year"), f"{db}.orc_summary", "year", format="orc")
    assert spark.table(t).count() == 3
    assert spark.sql(f"DESCRIBE TABLE EXTENDED {t}").where("col_name = 'Provider'").first()[1].lower() == "orc"
