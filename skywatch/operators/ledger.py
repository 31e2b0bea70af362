"""A ledger of loaded files, so that a load takes each file exactly once.

A load writes in several steps (a raw table, then a partitioned one), and a run can die between any two.
The ledger is a small append-only Parquet table that says which files belong to which load and which
loads are whole:

* ``plan`` records the new files under a new load id, in one file, before anything else is written;
* the caller writes each of its outputs under that load id, replacing what an earlier try left;
* ``finish`` records that the load is whole.

A run that dies leaves a planned load without its end. The next run finds it (``unfinished``) and does
its steps again with the same files; as each step replaces the load's own partitions, nothing is doubled
or lost. Files are known by path, size and time; a known path with another size or time is refused,
because the rows it gave before can't be told from its new ones.

One run at a time may use a ledger.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywatch.session import hadoop_path

LEDGER_SCHEMA = "load_id string, step string, file string, size bigint, modified timestamp, at timestamp"
PLANNED, DONE, MERGED = "planned", "done", "merged"


@dataclass(frozen=True)
class Load:
    """A planned load: its id and its files."""

    load_id: str
    files: tuple[str, ...]


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, size, modified`` of the files under ``path`` (listed only, not read)."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def literal_path(file: str) -> str:
    """A file's path such that a reader, which takes patterns, finds exactly that file."""
    return re.sub(r"([\\{}\[\]*?,])", r"\\\1", file)


class Ledger:
    """The ledger in a Parquet folder; it is created by the first entry."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def entries(self) -> DataFrame:
        """All entries, also those of unfinished loads."""
        reader = self.spark.read.schema(LEDGER_SCHEMA)
        found = hadoop_path(self.spark, self.path)
        if found is not None and not found[0].exists(found[1]):
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        return reader.parquet(self.path)

    def _append(self, rows: DataFrame) -> None:
        # One file, so that an entry of many rows is there whole or not at all.
        rows = rows.withColumn("at", F.current_timestamp())
        rows.select(*[c.split()[0] for c in LEDGER_SCHEMA.split(", ")]).coalesce(1).write.mode("append").parquet(self.path)

    def _entry(self, load_id: str, step: str, files: list[str | None]) -> None:
        rows = self.spark.createDataFrame([(load_id, step, f) for f in files], "load_id string, step string, file string")
        self._append(rows.withColumn("size", F.lit(None).cast("bigint")).withColumn("modified", F.lit(None).cast("timestamp")))

    def plan(self, path: str | list[str]) -> Load | None:
        """Record the files under ``path`` that no load has yet; None if there are none."""
        known = self.entries().where(F.col("step") == PLANNED).select("file", "size", "modified")
        found = list_files(self.spark, path)
        old = known.select("file", F.col("size").alias("_size"), F.col("modified").alias("_modified"))
        both = found.join(old, "file")
        changed = both.where((F.col("size") != F.col("_size")) | (F.col("modified") != F.col("_modified"))).select("file").take(5)
        if changed:
            raise ValueError(f"files changed since they were loaded: {[r['file'] for r in changed]}")
        load_id = f"load-{uuid.uuid4().hex[:16]}"
        new = found.join(known.select("file"), "file", "left_anti").cache()
        try:
            if not new.take(1):
                return None
            self._append(new.select(F.lit(load_id).alias("load_id"), F.lit(PLANNED).alias("step"), "file", "size", "modified"))
        finally:
            new.unpersist()
        return self._load(load_id)

    def _load(self, load_id: str) -> Load:
        # The reader is given every path by name, and Spark's own file index holds them all as well.
        rows = self.entries().where((F.col("load_id") == load_id) & (F.col("step") == PLANNED)).select("file").collect()
        return Load(load_id, tuple(sorted(literal_path(r["file"]) for r in rows)))

    def finish(self, load: Load) -> None:
        """Record that the load is whole."""
        self._entry(load.load_id, DONE, [None])

    def finished(self) -> list[str]:
        """Ids of the whole loads that were not merged into another, in order."""
        rows = self.entries().where(F.col("step") != PLANNED).select("load_id", "step", "file").collect()
        gone = {r["file"] for r in rows if r["step"] == MERGED}
        return sorted({r["load_id"] for r in rows} - gone)

    def _refuse_changed(self, load: Load) -> None:
        planned = self.entries().where((F.col("load_id") == load.load_id) & (F.col("step") == PLANNED))
        now = list_files(self.spark, list(load.files))
        changed = planned.join(now, ["file", "size", "modified"], "left_anti").select("file").take(5)
        if changed:
            raise ValueError(f"files changed since they were planned: {[r['file'] for r in changed]}")

    def unfinished(self) -> list[Load]:
        """Planned loads whose run did not come to its end, their files as they were."""
        entries = self.entries()
        done = entries.where(F.col("step") == DONE).select("load_id")
        open_ids = entries.where(F.col("step") == PLANNED).select("load_id").distinct().join(done, "load_id", "left_anti")
        loads = [self._load(r["load_id"]) for r in open_ids.orderBy("load_id").collect()]
        for load in loads:
            self._refuse_changed(load)
        return loads

    def replace(self, merged: str, load_ids: list[str]) -> None:
        """Record, in one entry, that the outputs of ``merged`` stand for those of ``load_ids``."""
        self._entry(merged, MERGED, list(load_ids))
