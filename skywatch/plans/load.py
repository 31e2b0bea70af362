"""Load report files into a raw table, then into a partitioned table.

``load_and_partition`` is the load job: create the database and the raw
table, load the delimited file into it, create the partitioned table, and
insert every row whose partition value is present, with dynamic
partitioning; then list the partitions. ``inspect_and_partition_by_year``
is the hand-run variant: a different separator, a DESCRIBE and a row count,
and a partition key derived from the month text.

Reruns: ``mode="append"`` appends in both steps, as the reference does: a
rerun appends the file to the raw table again and then inserts the whole
(now doubled) raw table, so the partitioned table holds three copies.
``mode="overwrite"`` replaces the raw table and the partitioned table, so a
rerun gives the same tables. For files that arrive over time, ``load_new_files``
does both steps exactly once for each file, also when a run dies between or
within them; the stream in ``skywatch.streaming`` feeds a raw table alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skywatch.functions.dates import year_of_month_text
from skywatch.operators.aggregates import row_count
from skywatch.operators.catalog import create_database, create_table, database_location, describe_table, list_partitions
from skywatch.operators.ledger import Ledger, Load
from skywatch.operators.sinks import insert_into
from skywatch.operators.transforms import project_columns, split_not_null
from skywatch.schema import raw_table_schema, sighting_schema
from skywatch.sources.delimited import read_delimited
from skywatch.sources.table import read_table

_MODES = ("append", "overwrite")


@dataclass
class LoadResult:
    raw_table: str
    partitioned_table: str
    partitions: DataFrame
    rejected: DataFrame | None
    description: DataFrame | None = None
    raw_count: DataFrame | None = None


def _check_mode(mode: str) -> bool:
    if mode not in _MODES:
        raise ValueError(f"mode must be one of {_MODES}, got {mode!r}")
    return mode == "overwrite"


def load_file_into_table(
    spark: SparkSession,
    path: str | list[str],
    table: str,
    *,
    sep: str = ",",
    mode: str = "append",
) -> str:
    """Parse delimited files with the table's own schema and insert them.

    No shuffle: each text split is parsed and written by one task.
    """
    schema = spark.table(table).schema
    rows = read_delimited(spark, path, schema, sep)
    insert_into(rows, table, overwrite=_check_mode(mode), dynamic=False, balance=False)
    return table


def partitioned_schema(base: T.StructType, partition_col: str, partition_type: T.DataType | None = None) -> T.StructType:
    """``base`` with ``partition_col`` moved (or appended) to the end."""
    fields = [f for f in base.fields if f.name != partition_col]
    existing = [f for f in base.fields if f.name == partition_col]
    dtype = partition_type or (existing[0].dataType if existing else T.IntegerType())
    return T.StructType(fields + [T.StructField(partition_col, dtype, True)])


def insert_partitioned(
    spark: SparkSession,
    source: DataFrame,
    table: str,
    partition_col: str,
    *,
    mode: str = "append",
    dynamic: bool = False,
    drop_null: bool = True,
) -> DataFrame | None:
    """Insert rows into ``table``, one directory per ``partition_col`` value.

    With ``drop_null`` only rows with a non-NULL value are inserted and the
    rejected rows are returned as a lazy frame; otherwise NULL values go to
    the default partition and ``None`` is returned.
    """
    if drop_null:
        kept, rejected = split_not_null(source, partition_col)
    else:
        kept, rejected = source, None
    columns = [f.name for f in spark.table(table).schema.fields]
    insert_into(
        project_columns(kept, columns, [partition_col]),
        table,
        overwrite=_check_mode(mode),
        dynamic=dynamic,
        partition_by=partition_col,
    )
    return rejected


def load_and_partition(
    spark: SparkSession,
    input_path: str | list[str],
    database: str,
    *,
    raw_table: str = "sightings_raw",
    partitioned_table: str = "sightings_by_month_count",
    partition_col: str = "month_count",
    sep: str = ",",
    mode: str = "append",
    location: str | None = None,
    dynamic: bool = False,
) -> LoadResult:
    """Create, load and partition (see module doc).

    With ``mode="overwrite"`` and ``dynamic=True`` the partitioned table
    keeps the partitions the new file does not touch: a partial reload
    replaces only the partition values it contains.
    """
    create_database(spark, database, location=location)
    raw = f"{database}.{raw_table}"
    create_table(spark, raw, raw_table_schema())
    load_file_into_table(spark, input_path, raw, sep=sep, mode=mode)
    part = f"{database}.{partitioned_table}"
    create_table(spark, part, partitioned_schema(raw_table_schema(), partition_col), partition_by=[partition_col])
    rejected = insert_partitioned(spark, read_table(spark, raw), part, partition_col, mode=mode, dynamic=dynamic)
    return LoadResult(raw, part, list_partitions(spark, part), rejected)


LOAD_ID = "load_id"


def load_new_files(
    spark: SparkSession,
    input_path: str | list[str],
    database: str,
    *,
    raw_table: str = "sightings_raw",
    partitioned_table: str = "sightings_by_month_count",
    partition_col: str = "month_count",
    sep: str = ",",
    location: str | None = None,
) -> LoadResult:
    """The load job, exactly once for each file (see ``operators.ledger``).

    Both tables have one more partition column, ``load_id``. The files under
    ``input_path`` that no load has are planned in the database's ledger; their
    rows replace the load's own partitions of the raw table and, read back from
    there, those of the partitioned table; then the load is marked whole. A run
    that died is finished first, with the files it had planned, so its rows are
    there once whatever step it had come to. ``rejected`` are the raw rows, of
    all loads, without a partition value.
    """
    create_database(spark, database, location=location)
    raw, part = f"{database}.{raw_table}", f"{database}.{partitioned_table}"
    schema = T.StructType([*raw_table_schema().fields, T.StructField(LOAD_ID, T.StringType())])
    create_table(spark, raw, schema, partition_by=[LOAD_ID])
    body = partitioned_schema(raw_table_schema(), partition_col).fields
    keyed = T.StructType([*body[:-1], T.StructField(LOAD_ID, T.StringType()), body[-1]])
    create_table(spark, part, keyed, partition_by=[LOAD_ID, partition_col])
    ledger = Ledger(spark, f"{database_location(spark, database)}/_load_ledger")

    def take(load: Load) -> None:
        rows = read_delimited(spark, list(load.files), raw_table_schema(), sep).withColumn(LOAD_ID, F.lit(load.load_id))
        insert_into(rows, raw, overwrite=True, dynamic=True, balance=False)
        loaded = read_table(spark, raw).where(F.col(LOAD_ID) == load.load_id)
        kept, _ = split_not_null(loaded, partition_col)
        names = [f.name for f in keyed.fields]
        insert_into(kept.select(*names), part, overwrite=True, dynamic=True, partition_by=[LOAD_ID, partition_col])
        ledger.finish(load)

    for load in ledger.unfinished():
        take(load)
    load = ledger.plan(input_path)
    if load is not None:
        take(load)
    _, rejected = split_not_null(read_table(spark, raw), partition_col)
    return LoadResult(raw, part, list_partitions(spark, part), rejected)


def inspect_and_partition_by_year(
    spark: SparkSession,
    input_path: str | list[str],
    database: str,
    *,
    raw_table: str = "sightings",
    partitioned_table: str = "sightings_by_year",
    sep: str = "|",
    mode: str = "append",
    location: str | None = None,
    date_col: str = "date",
    schema: T.StructType | None = None,
) -> LoadResult:
    """Hand-run variant: load with ``sep``, describe, count, partition by year.

    ``schema`` is the raw table's schema (default: all text dates); with
    ``schema.dated_schema()`` the date columns are DATE and the year is taken
    from the date column directly.

    Otherwise the year is derived from the month text. Every row is
    inserted; rows without a year land in the default partition
    (``year=__HIVE_DEFAULT_PARTITION__``).
    """
    create_database(spark, database, location=location)
    raw = f"{database}.{raw_table}"
    create_table(spark, raw, schema or sighting_schema(date_col))
    # An existing table keeps its own schema (IF NOT EXISTS): follow it.
    schema = spark.table(raw).schema
    description = describe_table(spark, raw)
    load_file_into_table(spark, input_path, raw, sep=sep, mode=mode)
    count = row_count(read_table(spark, raw))
    part = f"{database}.{partitioned_table}"
    create_table(spark, part, partitioned_schema(schema, "year", T.IntegerType()), partition_by=["year"])
    if isinstance(schema[date_col].dataType, T.DateType):
        year = F.year(F.col(date_col))
    else:
        year = year_of_month_text(date_col)
    keyed = read_table(spark, raw).withColumn("year", year)
    insert_partitioned(spark, keyed, part, "year", mode=mode, drop_null=False)
    return LoadResult(raw, part, list_partitions(spark, part), None, description, count)


__all__ = [
    "LoadResult",
    "inspect_and_partition_by_year",
    "insert_partitioned",
    "load_and_partition",
    "load_file_into_table",
    "load_new_files",
    "partitioned_schema",
]
