"""Summaries of a growing set of report files, each file read once.

A ``SummaryStore`` is a folder with a ledger and, for each load, the cells of its files
(``operators.aggregates.report_cells``, keyed by month text). ``add`` reads only the files that no load
has yet and writes their cells; a summary adds up the cells of all loads and re-aggregates them. Cells
are deduplicated counts, so the store grows with the distinct (month, city), (month, shape) and (month,
month_count) combinations of a load, not with its reports; ``compact`` merges the loads into one.

The result equals the summary of all files at once: row counts, lag sums and lag counts add up, distinct
values are deduplicated again, and the median is taken over the added counts.

A run that dies leaves a planned load, whose cells the next ``add`` writes again (each load has its own
folder, replaced whole); summaries read finished loads only. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skywatch.operators.aggregates import merge_cells, report_cells, store_cells
from skywatch.operators.ledger import Ledger, Load
from skywatch.plans.summary import YEAR, SummaryTarget, publish_cells, summarize_months
from skywatch.schema import sighting_schema
from skywatch.session import Scratch, remove_path
from skywatch.sources.csv import read_csv


class SummaryStore:
    """Cells of all loaded files under ``path``. ``schema`` declares the report columns: every load has
    the same types, whatever its files hold."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None, date_col: str = "date"):
        self.spark, self.path, self.date_col = spark, path.rstrip("/"), date_col
        self.schema = schema or sighting_schema(date_col)
        self.ledger = Ledger(spark, f"{self.path}/ledger")

    def _folder(self, load_id: str) -> str:
        return f"{self.path}/cells/{load_id}"

    def _write(self, load: Load) -> None:
        reports = read_csv(self.spark, list(load.files), schema=self.schema)
        report_cells(reports, self.date_col, self.date_col).write.mode("overwrite").parquet(self._folder(load.load_id))
        self.ledger.finish(load)

    def add(self, input_path: str | list[str]) -> tuple[str, ...]:
        """Take in the files under ``input_path`` that are new; returns them. Finishes a broken run first."""
        for load in self.ledger.unfinished():
            self._write(load)
        load = self.ledger.plan(input_path)
        if load is None:
            return ()
        self._write(load)
        return load.files

    def _empty(self) -> DataFrame:
        reports = self.spark.createDataFrame([], self.schema)
        return report_cells(reports, self.date_col, self.date_col)

    def cells(self) -> DataFrame:
        """The cells of all finished loads, added up."""
        loads = self.ledger.finished()
        if not loads:
            return self._empty()
        stored = self.spark.read.schema(self._empty().schema).parquet(*(self._folder(i) for i in loads))
        return merge_cells(stored) if len(loads) > 1 else stored

    def summary(self, key: str = YEAR, *, width: int = 2, chronological: bool = False, scratch: Scratch | None = None) -> DataFrame:
        """The summary by ``key`` of all files taken in."""
        return summarize_months(store_cells(self.cells(), scratch), key, width, chronological)

    def publish(self, targets: Sequence[SummaryTarget]) -> list[DataFrame]:
        """Several summaries, each to its sinks, from one reading of the cells."""
        with Scratch(self.spark) as scratch:
            return publish_cells(store_cells(self.cells(), scratch), targets)

    def compact(self) -> str | None:
        """Merge the cells of all finished loads into one folder; the old folders go.

        The ledger switches over in one entry, after the new folder is whole and before any old one is
        removed.
        """
        loads = self.ledger.finished()
        if len(loads) < 2:
            return None
        merged = f"merged-{uuid.uuid4().hex[:16]}"
        self.cells().write.mode("overwrite").parquet(self._folder(merged))
        self.ledger.replace(merged, loads)
        for load_id in loads:
            remove_path(self.spark, self._folder(load_id))
        return merged
