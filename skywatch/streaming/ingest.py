"""Incremental, exactly-once loading of report files into a raw table.

The batch load appends whatever the given path holds, so loading the same
folder twice doubles the table. Here a Structured Streaming file source
watches a landing folder instead: each run picks up only files it has not
seen (the source keeps a log of processed files in the checkpoint), parses
them with the same positional text-table rules, and appends them through
the file sink, whose commit log makes each file's rows land exactly once,
also when a run dies half-way and is started again.

The target table becomes stream-owned: its folder holds the sink's commit
log and every read lists only committed files, so batch inserts into it
are refused (``operators.sinks.insert_into``); load other files through
the stream too, by dropping them into the landing folder.

Runs use ``trigger(availableNow=True)``: process everything that has
arrived, in bounded micro-batches, then stop; call it from a scheduler as
often as files arrive. The checkpoint lives in an underscore folder of the
table's own location (readers skip it), so every run for one table resumes the
same log, dropping a managed table drops its log, and two tables never share
one. Files are taken whatever their age.

The source remembers every file it has seen, on the driver, for as long as the
landing folder may hold it. For landing folders that are fed for years,
``archive_dir`` moves each file away once its batch is committed, so that the
folder (and every run's listing of it) holds new files alone, and ``forget_after``
bounds the memory: files older than that, counted from the newest file seen, are
forgotten. The source would then skip a new file that is older still, without a
word; a run that finds such a file refuses it instead, before it starts.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from skywatch.operators.catalog import create_table, table_location
from skywatch.operators.ledger import list_files
from skywatch.session import hadoop_path
from skywatch.sources.delimited import parse_delimited
from skywatch.functions.casts import TEXT_NULL_MARKER


CHECKPOINT_DIR = "_ingest_checkpoint"
#: No file is too old: the source otherwise skips files a week behind the newest it has seen.
ANY_AGE = "36500d"


def ingest_checkpoint(spark: SparkSession, table: str) -> str:
    """The checkpoint folder of the stream that feeds ``table``, inside its location."""
    location = table_location(spark, table)
    if not location:
        raise ValueError(f"{table} has no location to keep its checkpoint in; pass checkpoint=")
    return f"{location.rstrip('/')}/{CHECKPOINT_DIR}"


_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400}


def _seconds(age: str) -> int:
    found = re.fullmatch(r"(\d+)([smhd])", age)
    if not found:
        raise ValueError(f"an age is a number and one of s, m, h, d: {age!r}")
    return int(found[1]) * _UNITS[found[2]]


def refuse_forgotten(spark: SparkSession, landing_dir: str, checkpoint: str, forget_after: str) -> None:
    """Raise if the landing folder holds new files that the source would skip for their age."""
    log = f"{checkpoint.rstrip('/')}/sources/0"
    found = hadoop_path(spark, log)
    if found is not None and not found[0].exists(found[1]):
        return  # the first run takes whatever there is
    entries = spark.read.text(log).select(
        F.get_json_object("value", "$.path").alias("file"), F.get_json_object("value", "$.timestamp").cast("bigint").alias("at")
    )
    entries = entries.where(F.col("file").isNotNull())
    newest = entries.agg(F.max("at")).first()[0]
    if newest is None:
        return
    horizon = newest - 1000 * _seconds(forget_after)

    def plain(c):
        return F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")

    old = list_files(spark, landing_dir).where(F.unix_millis("modified") < horizon).select(plain("file").alias("file"))
    new = old.join(entries.select(plain("file").alias("file")), "file", "left_anti").take(5)
    if new:
        raise ValueError(
            f"files older than {forget_after} before the newest one loaded would be skipped: {[r['file'] for r in new]}; "
            "give them a new modification time, or load them with load_file_into_table into another table"
        )


def start_ingest(
    spark: SparkSession,
    landing_dir: str,
    table: str,
    *,
    sep: str = ",",
    schema: T.StructType | None = None,
    checkpoint: str | None = None,
    max_files_per_trigger: int | None = None,
    null_marker: str | None = TEXT_NULL_MARKER,
    archive_dir: str | None = None,
    forget_after: str | None = None,
) -> StreamingQuery:
    """Start an available-now stream from ``landing_dir`` into ``table``.

    ``table`` must exist with the target schema (or ``schema`` is given and
    the table is created here). ``max_files_per_trigger`` bounds
    each micro-batch. ``archive_dir`` (outside the landing folder) takes the
    files of committed batches, and ``forget_after`` (``"30d"``, with
    ``archive_dir`` only) bounds what the source remembers of them.
    """
    if forget_after and not archive_dir:
        raise ValueError("forget_after needs archive_dir: a forgotten file that is still there could be loaded twice")
    if schema is None:
        schema = spark.table(table).schema
    elif not spark.catalog.tableExists(table):
        create_table(spark, table, schema)
    checkpoint = checkpoint or ingest_checkpoint(spark, table)
    reader = spark.readStream.format("text").option("maxFileAge", forget_after or ANY_AGE)
    if archive_dir:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    if forget_after:
        refuse_forgotten(spark, landing_dir, checkpoint, forget_after)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = parse_delimited(reader.load(landing_dir), schema, sep, null_marker=null_marker)
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .toTable(table)
    )


def ingest_new_files(
    spark: SparkSession,
    landing_dir: str,
    table: str,
    *,
    sep: str = ",",
    schema: T.StructType | None = None,
    checkpoint: str | None = None,
    max_files_per_trigger: int | None = None,
    timeout_seconds: float | None = None,
    archive_dir: str | None = None,
    forget_after: str | None = None,
) -> StreamingQuery:
    """Run one available-now ingest to completion; return the finished query."""
    q = start_ingest(
        spark,
        landing_dir,
        table,
        sep=sep,
        schema=schema,
        checkpoint=checkpoint,
        max_files_per_trigger=max_files_per_trigger,
        archive_dir=archive_dir,
        forget_after=forget_after,
    )
    finished = q.awaitTermination(timeout_seconds) if timeout_seconds else q.awaitTermination()
    if finished is False:
        q.stop()
        raise TimeoutError(f"ingest into {table} did not finish in {timeout_seconds}s")
    if q.exception() is not None:
        raise q.exception()
    return q
