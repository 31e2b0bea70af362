"""One scan for several summaries, summaries of growing input, exactly-once loads, scratch, overwrites."""

import os
import re
import threading

import pytest
from pyspark.sql import functions as F

import skywatch.plans.load as load_plan
from skywatch import annual_summary, biennial_summary, insert_into, read_csv, read_table
from skywatch.operators import aggregates
from skywatch.operators.catalog import create_database, create_table, list_partitions
from skywatch.operators.ledger import Ledger, list_files
from skywatch.plans import SummaryStore, SummaryTarget, load_new_files, summarize_reports, summary_jobs
from skywatch.schema import sighting_schema
from skywatch.session import Scratch, checkpoint_root, unique_name

from conftest import SUMMARY_CSV, write_lines

HEADER = SUMMARY_CSV[0]


def _csv(directory, name, rows):
    os.makedirs(directory, exist_ok=True)
    return write_lines(directory, name, [HEADER, *rows])


def _line(k, count=None):
    month = "junk" if k % 17 == 0 else f"{1 + k % 12:02d}/{1990 + k % 9}"
    posted = "" if k % 5 == 0 else f"02/{1 + k % 28:02d}/1999"
    return f"d{k},{month},city{k % 7},NV,USA,{'disk' if k % 3 else ''},x,01/06/1999,{posted},{k % 11 if count is None else count}"


def _rows(df, *drop):
    return sorted((tuple(r[c] for c in sorted(df.columns) if c not in drop) for r in df.collect()), key=repr)


def _scratch(spark):
    root = checkpoint_root(spark)
    folder = (root[5:] if root.startswith("file:") else root) + "/skywatch"
    return {f for f in os.listdir(folder)} if os.path.isdir(folder) else set()


# -- types and scratch of the default summary -----------------------------------------------------------


@pytest.mark.parametrize("counts, kind", [(["5", "4.5"], "double"), (["5", "many"], "double"), (["5", "99999999999"], "bigint")])
def test_default_summary_takes_the_inferred_type(spark, tmp_path, counts, kind):
    path = _csv(tmp_path, "a.csv", [_line(2, counts[0]), _line(11, counts[1]), _line(2, counts[0])])
    got = summarize_reports(read_csv(spark, path), "year")
    assert got.schema["median_month_count"].dataType.simpleString() == kind
    approx = summarize_reports(read_csv(spark, path), "year", median="approx").collect() if "many" not in counts else None
    rows = {r.year: r.median_month_count for r in got.collect()}
    assert rows[1992] == 5
    if approx is not None:
        assert {r.year: r.median_month_count for r in approx} == rows


def test_jobs_leave_no_scratch_behind(spark, tmp_path):
    path = _csv(tmp_path, "a.csv", [_line(k) for k in range(200)])
    db = create_database(spark, unique_name("t"), location=str(tmp_path / "db"))
    before = _scratch(spark)
    out = annual_summary(spark, path, output_path=str(tmp_path / "out"), table=f"{db}.annual")
    summary_jobs(spark, path, [SummaryTarget("year", table=f"{db}.one"), SummaryTarget("year_group", table=f"{db}.two")])
    assert _scratch(spark) == before
    assert out.count() == 10  # nine years, and the junk
    with pytest.raises(Exception):  # also when the job fails
        annual_summary(spark, path, table="no_such_database.annual")
    assert _scratch(spark) == before
    with Scratch(spark) as scratch:
        kept = scratch.path("x")
        spark.range(3).write.parquet(kept)
        assert spark.read.parquet(kept).count() == 3
    assert _scratch(spark) == before


def test_one_scan_gives_all_summaries(spark, tmp_path, monkeypatch):
    path = _csv(tmp_path, "a.csv", [_line(k) for k in range(400)])
    plans = []
    real = aggregates.store_cells

    def seen(cells, scratch=None):
        plans.append(cells._jdf.queryExecution().executedPlan().toString())
        return real(cells, scratch)

    monkeypatch.setattr("skywatch.plans.summary.store_cells", seen)
    db = create_database(spark, unique_name("t"), location=str(tmp_path / "db"))
    targets = [SummaryTarget("year", table=f"{db}.a"), SummaryTarget("year_group", 2, table=f"{db}.b", output_path=str(tmp_path / "csv"))]
    targets.append(SummaryTarget("year_group", 5, chronological=True))
    annual, biennial, five = summary_jobs(spark, path, targets, schema=sighting_schema())
    assert len(plans) == 1 and plans[0].count("FileScan csv") == 1
    for df in (annual, biennial, five):
        assert "FileScan csv" not in df._jdf.queryExecution().executedPlan().toString()
    assert _rows(annual) == _rows(annual_summary(spark, path, schema=sighting_schema()))
    assert _rows(biennial) == _rows(biennial_summary(spark, path, schema=sighting_schema()))
    assert _rows(five) == _rows(biennial_summary(spark, path, width=5, chronological=True, schema=sighting_schema()))


# -- growing input ----------------------------------------------------------------------------------------


def test_store_equals_the_summary_of_all_files_and_reads_each_once(spark, tmp_path):
    landing = str(tmp_path / "landing")
    store = SummaryStore(spark, str(tmp_path / "store"))
    assert store.summary().count() == 0 and store.add(str(_empty(tmp_path))) == ()
    _csv(landing, "a.csv", [_line(k) for k in range(300)])
    first = store.add(landing)
    _csv(landing, "b [1],{x}.csv", [_line(k) for k in range(250, 600)])  # a name that looks like a pattern
    second = store.add(landing)
    assert [len(first), len(second)] == [1, 1] and first != second
    assert store.add(landing) == ()
    whole = read_csv(spark, landing, schema=sighting_schema())
    for key, options in (("year", {}), ("year_group", {"width": 3}), ("year", {"chronological": True})):
        assert _rows(store.summary(key, **options)) == _rows(summarize_reports(whole, key, **options)), (key, options)
    before = _rows(store.summary("year"))
    merged = store.compact()
    assert os.listdir(tmp_path / "store" / "cells") == [merged] and store.compact() is None
    assert _rows(store.summary("year")) == before
    _csv(landing, "c.csv", [_line(k) for k in range(600, 650)])
    assert len(store.add(landing)) == 1
    whole = read_csv(spark, landing, schema=sighting_schema())
    assert _rows(store.summary("year")) == _rows(summarize_reports(whole, "year"))


def _empty(tmp_path):
    folder = tmp_path / "nothing"
    folder.mkdir()
    return folder


def test_broken_run_of_the_store_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    landing = str(tmp_path / "landing")
    _csv(landing, "a.csv", [_line(k) for k in range(100)])
    store = SummaryStore(spark, str(tmp_path / "store"))

    def die(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(store.ledger, "finish", die)
    with pytest.raises(RuntimeError):
        store.add(landing)
    again = SummaryStore(spark, str(tmp_path / "store"))
    assert again.summary().count() == 0  # a load without its end is not read
    stat = os.stat(f"{landing}/a.csv")
    os.utime(f"{landing}/a.csv", (stat.st_atime, stat.st_mtime - 5))
    with pytest.raises(ValueError, match="changed"):  # its files must be as they were planned
        again.add(landing)
    os.utime(f"{landing}/a.csv", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    _csv(landing, "b.csv", [_line(k) for k in range(100, 150)])
    assert len(again.add(landing)) == 1
    whole = read_csv(spark, landing, schema=sighting_schema())
    assert _rows(again.summary("year")) == _rows(summarize_reports(whole, "year"))


def test_changed_files_are_refused(spark, tmp_path):
    landing = str(tmp_path / "landing")
    _csv(landing, "a.csv", [_line(k) for k in range(10)])
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.finish(ledger.plan(landing))
    assert ledger.plan(landing) is None and list_files(spark, landing).count() == 1
    _csv(landing, "a.csv", [_line(k) for k in range(11)])
    with pytest.raises(ValueError, match="changed"):
        ledger.plan(landing)


# -- exactly-once load ------------------------------------------------------------------------------------


def _text(directory, name, ks):
    os.makedirs(directory, exist_ok=True)
    return write_lines(directory, name, [_line(k) for k in ks])


@pytest.mark.parametrize("step", ["before raw", "after raw", "before end"])
def test_a_load_that_dies_doubles_and_loses_nothing(spark, tmp_path, monkeypatch, step):
    landing, db = str(tmp_path / "landing"), unique_name("t")
    where = str(tmp_path / "db")
    _text(landing, "a.txt", range(60))
    res = load_new_files(spark, landing, db, location=where)
    _text(landing, "b.txt", range(60, 100))
    real, calls = load_plan.insert_into, []

    def insert(df, table, **options):
        calls.append(table)
        if len(calls) == {"before raw": 1, "after raw": 2, "before end": 3}[step]:
            raise RuntimeError("lost")
        return real(df, table, **options)

    with monkeypatch.context() as m:
        m.setattr(load_plan, "insert_into", insert)
        if step == "before end":
            m.setattr(Ledger, "finish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            load_new_files(spark, landing, db, location=where)
    _text(landing, "c.txt", range(100, 120))
    for _ in range(2):
        res = load_new_files(spark, landing, db, location=where)
    raw = sorted(r.details for r in read_table(spark, res.raw_table).collect())
    assert raw == sorted(f"d{k}" for k in range(120))
    kept = sorted(r.details for r in read_table(spark, res.partitioned_table).collect())
    assert kept == raw  # every line has a count
    assert res.rejected.count() == 0
    assert len({r[0].split("/")[0] for r in res.partitions.collect()}) == 3


# -- overwrites -------------------------------------------------------------------------------------------


def _table(spark, tmp_path, rows=((1, 1), (2, 2), (3, None))):
    db = create_database(spark, unique_name("t"), location=str(tmp_path / "db"))
    table = create_table(spark, f"{db}.t", spark.createDataFrame([], "v int, k int").schema, partition_by=["k"])
    insert_into(spark.createDataFrame(list(rows), "v int, k int"), table, overwrite=True, dynamic=False)
    return table


def _values(spark, table):
    return sorted(((r.v, r.k) for r in spark.table(table).collect()), key=repr)


def test_overwrites_take_no_session_setting(spark, tmp_path):
    setting = "spark.sql.sources.partitionOverwriteMode"
    table = _table(spark, tmp_path)
    for default in ("dynamic", "static"):
        spark.conf.set(setting, default)
        try:
            insert_into(spark.createDataFrame([(1, 1), (2, 2), (3, None)], "v int, k int"), table, overwrite=True, dynamic=False)
            assert _values(spark, table) == [(1, 1), (2, 2), (3, None)]
            insert_into(spark.createDataFrame([(9, 2), (8, 7)], "x int, y int"), table, overwrite=True, dynamic=True)
            assert _values(spark, table) == [(1, 1), (3, None), (8, 7), (9, 2)]
            assert spark.conf.get(setting) == default
            insert_into(spark.createDataFrame([(5, 5)], "v int, k int"), table, overwrite=True, dynamic=False)
            assert _values(spark, table) == [(5, 5)]
            assert [r[0] for r in list_partitions(spark, table).collect()] == ["k=5"]
        finally:
            spark.conf.unset(setting)
    with pytest.raises(TypeError):
        insert_into(spark.createDataFrame([("a", 5)], "v string, k int"), table, overwrite=True)
    with pytest.raises(ValueError, match="read from it"):
        insert_into(spark.table(table), table, overwrite=True)
    with pytest.raises(ValueError):
        insert_into(spark.createDataFrame([(5,)], "k int"), table, overwrite=True)


def test_two_overwrites_side_by_side(spark, tmp_path):
    table = _table(spark, tmp_path, [(k, k) for k in range(8)])
    other = _table(spark, tmp_path / "other")
    errors = []

    def run(df, target, dynamic):
        try:
            insert_into(df, target, overwrite=True, dynamic=dynamic)
        except Exception as e:  # noqa: BLE001 (shown by the assertion)
            errors.append(e)

    jobs = [(spark.range(200).select(F.lit(100 + k).alias("v"), F.lit(k).alias("k")), table, True) for k in (1, 4)]
    jobs.append((spark.createDataFrame([(7, 7)], "v int, k int"), other, False))
    threads = [threading.Thread(target=run, args=j) for j in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    want = [(k, k) for k in range(8) if k not in (1, 4)] + [(101, 1)] * 200 + [(104, 4)] * 200
    assert _values(spark, table) == sorted(want, key=repr)
    assert _values(spark, other) == [(7, 7)]


def test_ledger_file_names_are_no_patterns():
    from skywatch.operators.ledger import literal_path

    assert literal_path("a[1]{x,y}*?.csv") == r"a\[1\]\{x\,y\}\*\?.csv"
    assert re.sub(r"\\(.)", r"\1", literal_path("plain-1.csv")) == "plain-1.csv"
