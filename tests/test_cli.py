import os

from skywatch.cli import main
from skywatch.session import unique_name

from conftest import SUMMARY_CSV, write_lines


def test_annual_cli(spark, summary_csv, tmp_path, capsys):
    db = unique_name("cli")
    spark.sql(f"CREATE DATABASE {db} LOCATION '{tmp_path / 'db'}'")
    out = str(tmp_path / "out")
    assert main(["annual", summary_csv, "--output", out, "--table", f"{db}.annual"], spark=spark) == 0
    assert "12/1998" in capsys.readouterr().out
    assert spark.table(f"{db}.annual").count() == 3
    assert any(d.startswith("year=") for d in os.listdir(out))


def test_biennial_cli_declared_schema(spark, summary_csv, tmp_path, capsys):
    out = str(tmp_path / "out")
    assert main(["biennial", summary_csv, "--output", out, "--declared-schema", "--chronological"], spark=spark) == 0
    assert "02/1999" in capsys.readouterr().out


def test_summary_cli_options(spark, summary_csv, tmp_path, capsys):
    out = str(tmp_path / "out")
    args = ["annual", summary_csv, "--output", out, "--approx-median", "--approx-distinct", "--header"]
    assert main(args, spark=spark) == 0
    assert "12/1998" in capsys.readouterr().out
    assert spark.read.option("header", True).csv(out).columns[0] == "max_date"


def test_load_and_inspect_cli(spark, text_file, tmp_path, capsys):
    db = unique_name("cli")
    assert main(["load", text_file, "--database", db, "--location", str(tmp_path / "db")], spark=spark) == 0
    assert "month_count=9" in capsys.readouterr().out
    pipe = write_lines(tmp_path, "p.txt", [l.replace(",", "|") for l in SUMMARY_CSV if '"' not in l])
    db2 = unique_name("cli")
    assert main(["inspect", pipe, "--database", db2, "--location", str(tmp_path / "db2")], spark=spark) == 0
    out = capsys.readouterr().out
    assert "year=1999" in out and "month_count" in out


def test_ingest_cli(spark, tmp_path, capsys):
    landing = tmp_path / "landing" / "a"
    landing.mkdir(parents=True)
    write_lines(landing, "f.txt", SUMMARY_CSV)
    db = unique_name("cli")
    spark.sql(f"CREATE DATABASE {db} LOCATION '{tmp_path / 'db'}'")
    assert main(["ingest", str(tmp_path / "landing" / "*"), "--table", f"{db}.raw"], spark=spark) == 0
    assert f"{db}.raw: 5 rows" in capsys.readouterr().out


def test_inspect_cli_date_typed(spark, tmp_path, capsys):
    path = write_lines(tmp_path, "d.txt", ["a|1999-12-01|Reno|NV|USA|disk|x|1999-12-05|1999-12-28|5"])
    db = unique_name("cli")
    assert main(["inspect", path, "--database", db, "--location", str(tmp_path / "db"), "--date-typed"], spark=spark) == 0
    out = capsys.readouterr().out
    assert "year=1999" in out and "date" in out


def test_load_new_and_store_cli(spark, tmp_path, capsys):
    landing = tmp_path / "landing"
    landing.mkdir()
    write_lines(landing, "a.csv", SUMMARY_CSV)
    db = unique_name("cli")
    args = ["load-new", str(landing), "--database", db, "--location", str(tmp_path / "db")]
    for _ in range(2):
        assert main(args, spark=spark) == 0
    assert "month_count=9" in capsys.readouterr().out
    assert spark.table(f"{db}.sightings_raw").count() == 5
    args = ["store", str(landing), "--store", str(tmp_path / "store"), "--annual", f"{db}.annual", "--biennial", f"{db}.biennial", "--compact"]
    assert main(args, spark=spark) == 0
    out = capsys.readouterr().out
    assert "1 new files" in out and "12/1998" in out
    assert spark.table(f"{db}.annual").count() == 3 and spark.table(f"{db}.biennial").count() == 2
    write_lines(landing, "b.csv", [SUMMARY_CSV[0], "d9,03/2001,Reno,NV,USA,disk,x,01/05/1999,01/28/1999,5"])
    assert main(args, spark=spark) == 0
    assert "1 new files" in capsys.readouterr().out and spark.table(f"{db}.annual").count() == 4
