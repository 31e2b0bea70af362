import os
import time

from pyspark.sql import functions as F

from skywatch import create_database, create_table, read_table, use_database
from skywatch.operators import rebalance
from skywatch.plans.load import insert_partitioned, partitioned_schema
from skywatch.schema import raw_table_schema
from skywatch.session import unique_name
from skywatch.streaming import ingest_checkpoint, ingest_new_files

from conftest import SUMMARY_CSV, EXTRA_TEXT, write_lines


def test_ingest_is_exactly_once(spark, tmp_path):
    landing = tmp_path / "landing"
    (landing / "a").mkdir(parents=True)
    write_lines(landing / "a", "f1.txt", SUMMARY_CSV)
    db = create_database(spark, unique_name("s"), location=str(tmp_path / "db"))
    table = create_table(spark, f"{db}.raw", raw_table_schema())
    cp = str(tmp_path / "cp")
    ingest_new_files(spark, str(landing / "*"), table, checkpoint=cp, timeout_seconds=120)
    assert read_table(spark, table).count() == 5
    ingest_new_files(spark, str(landing / "*"), table, checkpoint=cp, timeout_seconds=120)
    assert read_table(spark, table).count() == 5  # nothing new: no duplicates
    (landing / "b").mkdir()
    write_lines(landing / "b", "f2.txt", EXTRA_TEXT)
    ingest_new_files(spark, str(landing / "*"), table, checkpoint=cp, timeout_seconds=120)
    rows = {r.details: r.month_count for r in read_table(spark, table).collect()}
    assert len(rows) == 9 and rows["d8"] == 4 and rows["d7"] is None


def test_batch_insert_into_stream_owned_table_is_refused(spark, tmp_path):
    import pytest

    from skywatch.operators.catalog import is_stream_owned
    from skywatch.plans import load_file_into_table

    landing = tmp_path / "landing" / "a"
    landing.mkdir(parents=True)
    write_lines(landing, "f1.txt", SUMMARY_CSV)
    batch = write_lines(tmp_path, "batch.txt", EXTRA_TEXT)
    db = create_database(spark, unique_name("s"), location=str(tmp_path / "db"))
    table = create_table(spark, f"{db}.raw", raw_table_schema())
    assert not is_stream_owned(spark, table)
    load_file_into_table(spark, batch, table)  # plain table: batch load works
    other = create_table(spark, f"{db}.streamed", raw_table_schema())
    ingest_new_files(spark, str(tmp_path / "landing" / "*"), other, checkpoint=str(tmp_path / "cp"), timeout_seconds=120)
    assert is_stream_owned(spark, other)
    with pytest.raises(ValueError, match="written by a stream"):
        load_file_into_table(spark, batch, other)
    assert read_table(spark, other).count() == 5


def test_ingest_checkpoint_is_in_the_table(spark, tmp_path):
    db = create_database(spark, unique_name("ck"), location=str(tmp_path / "db"))
    a, b = (create_table(spark, f"{db}.{t}", raw_table_schema()) for t in "ab")
    assert ingest_checkpoint(spark, a) == ingest_checkpoint(spark, a.upper())
    assert ingest_checkpoint(spark, a) != ingest_checkpoint(spark, b)
    assert "/_" in ingest_checkpoint(spark, a)


def _hot_frame(spark, n=6000):
    # Key 1 holds a third of the rows; 8 input partitions stand for 8 files.
    df = spark.range(n).select(
        F.concat(F.lit("d"), F.col("id").cast("string")).alias("details"),
        *[F.lit("x").alias(c) for c in ("datetime", "city", "state", "country", "shape", "summary", "report_date", "posted_date")],
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise((F.col("id") % 7 + 2).cast("int")).alias("month_count"),
    )
    return df.repartition(8)


def _files_per_partition(spark, table):
    loc = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first()[1]
    root = loc.replace("file:", "")
    return {
        d: len([f for f in os.listdir(os.path.join(root, d)) if f.startswith("part-")])
        for d in os.listdir(root)
        if d.startswith("month_count=")
    }


def test_hot_partition_key_is_split_over_tasks(spark, tmp_path):
    db = create_database(spark, unique_name("k"), location=str(tmp_path / "db"))
    table = create_table(spark, f"{db}.p", partitioned_schema(raw_table_schema(), "month_count"), partition_by=["month_count"])
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        insert_partitioned(spark, _hot_frame(spark), table, "month_count")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = _files_per_partition(spark, table)
    assert files["month_count=1"] > 1  # the hot key was written by several tasks
    assert read_table(spark, table).count() == 6000  # and no row was lost or duplicated


def test_rebalance_without_adaptive_execution_salts(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        df = rebalance(_hot_frame(spark), "month_count")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "xxhash64" in plan
        per_task = df.where(F.col("month_count") == 1).groupBy(F.spark_partition_id()).count().count()
        assert per_task > 16  # as many tasks as the shuffle has, not a fixed number
        assert df.count() == 6000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_ingest_loses_no_file(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    first, db2 = unique_name("one"), unique_name("two")
    for db in (first, db2):
        create_database(spark, db, location=str(tmp_path / db))
    raw = create_table(spark, f"{first}.raw", raw_table_schema())
    write_lines(landing, "new.txt", SUMMARY_CSV[1:3])
    ingest_new_files(spark, str(landing), raw)
    old = write_lines(landing, "old.txt", SUMMARY_CSV[3:4])
    os.utime(old, (time.time() - 30 * 86400,) * 2)  # arrives late, with an old time stamp
    ingest_new_files(spark, str(landing), raw)
    assert read_table(spark, raw).count() == 3
    spark.sql(f"DROP TABLE {raw}")
    raw = create_table(spark, raw, raw_table_schema())
    ingest_new_files(spark, str(landing), raw)
    assert read_table(spark, raw).count() == 3
    use_database(spark, db2)  # the same unqualified name in another database
    try:
        create_table(spark, "raw", raw_table_schema())
        ingest_new_files(spark, str(landing), "raw")
        assert read_table(spark, f"{db2}.raw").count() == 3
    finally:
        use_database(spark, "default")


def test_ingest_bounded_micro_batches(spark, tmp_path):
    landing = tmp_path / "landing" / "a"
    landing.mkdir(parents=True)
    write_lines(landing, "f1.txt", SUMMARY_CSV[:3])
    write_lines(landing, "f2.txt", SUMMARY_CSV[3:])
    db = create_database(spark, unique_name("s"), location=str(tmp_path / "db"))
    table = create_table(spark, f"{db}.raw", raw_table_schema())
    q = ingest_new_files(
        spark, str(tmp_path / "landing" / "*"), table, checkpoint=str(tmp_path / "cp"), max_files_per_trigger=1, timeout_seconds=120
    )
    assert read_table(spark, table).count() == 5
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) == 2  # one file per micro-batch


def test_ingest_archives_what_it_has_taken_and_forgets_nothing_silently(spark, tmp_path):
    import pytest

    landing, archive = tmp_path / "landing", tmp_path / "archive"
    landing.mkdir()
    db = create_database(spark, unique_name("s"), location=str(tmp_path / "db"))
    table = create_table(spark, f"{db}.raw", raw_table_schema())
    options = {"checkpoint": str(tmp_path / "cp"), "timeout_seconds": 120, "archive_dir": str(archive), "forget_after": "30d"}
    now = time.time()

    def arrive(name, lines, age_days):
        path = write_lines(landing, name, lines)
        os.utime(path, (now - age_days * 86_400,) * 2)

    arrive("old.txt", SUMMARY_CSV, 400)  # the first run takes files of any age
    arrive("f1.txt", EXTRA_TEXT[:1], 3)
    ingest_new_files(spark, str(landing), table, **options)
    assert read_table(spark, table).count() == 6
    arrive("f2.txt", EXTRA_TEXT[1:2], 20)  # older than the newest, but not by too much
    arrive("f3.txt", EXTRA_TEXT[2:], 0)
    for _ in range(2):
        ingest_new_files(spark, str(landing), table, **options)
    assert read_table(spark, table).count() == 9
    moved = {f for _, _, files in os.walk(archive) for f in files if not f.startswith(".")}
    assert {"old.txt", "f1.txt"} <= moved and not moved & {f.name for f in landing.iterdir()}
    arrive("late.txt", EXTRA_TEXT, 60)
    with pytest.raises(ValueError, match="late.txt"):
        ingest_new_files(spark, str(landing), table, **options)
    arrive("late.txt", EXTRA_TEXT, 1)
    ingest_new_files(spark, str(landing), table, **options)
    assert read_table(spark, table).count() == 13
    with pytest.raises(ValueError, match="archive_dir"):
        ingest_new_files(spark, str(landing), table, forget_after="30d")
