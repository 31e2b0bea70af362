"""Catalog operations: databases, tables, partitions, descriptions.

Tables are datasource tables (Parquet by default): they need no Hive
support in the session, and filters on them reach the Parquet reader.
Names are always passed qualified, so no call depends on the session's
current database.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skywatch.session import hadoop_path


def quote_ident(name: str) -> str:
    """Backtick-quote each part of a possibly qualified identifier."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def _column_ddl(schema: T.StructType) -> str:
    return ", ".join(f"{quote_ident(f.name)} {f.dataType.simpleString()}" for f in schema.fields)


def _string_literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_database(
    spark: SparkSession,
    name: str,
    *,
    location: str | None = None,
    if_not_exists: bool = True,
) -> str:
    """CREATE DATABASE [IF NOT EXISTS] name [LOCATION ...]."""
    guard = "IF NOT EXISTS " if if_not_exists else ""
    loc = f" LOCATION {_string_literal(location)}" if location else ""
    spark.sql(f"CREATE DATABASE {guard}{quote_ident(name)}{loc}")
    return name


def database_location(spark: SparkSession, name: str) -> str:
    """The folder in which a database's tables are."""
    return spark.catalog.getDatabase(name).locationUri.rstrip("/")


def use_database(spark: SparkSession, name: str) -> None:
    """USE name (changes the session's current database)."""
    spark.catalog.setCurrentDatabase(name)


def create_table(
    spark: SparkSession,
    table: str,
    schema: T.StructType,
    *,
    partition_by: Sequence[str] = (),
    if_not_exists: bool = True,
    format: str = "parquet",
) -> str:
    """CREATE TABLE [IF NOT EXISTS] with an explicit schema.

    Partition columns must be the last columns of ``schema``.
    """
    names = [f.name for f in schema.fields]
    if list(partition_by) and names[-len(partition_by) :] != list(partition_by):
        raise ValueError("partition columns must be the last columns of the schema")
    guard = "IF NOT EXISTS " if if_not_exists else ""
    parts = ""
    if partition_by:
        parts = " PARTITIONED BY (" + ", ".join(quote_ident(c) for c in partition_by) + ")"
    spark.sql(
        f"CREATE TABLE {guard}{quote_ident(table)} ({_column_ddl(schema)}) USING {format}{parts}"
    )
    return table


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {quote_ident(table)}")


def list_partitions(spark: SparkSession, table: str) -> DataFrame:
    """SHOW PARTITIONS: one row per partition directory (``key=value``)."""
    return spark.sql(f"SHOW PARTITIONS {quote_ident(table)}")


def describe_table(spark: SparkSession, table: str) -> DataFrame:
    """DESCRIBE TABLE: column name, type, comment (partition columns listed again)."""
    return spark.sql(f"DESCRIBE TABLE {quote_ident(table)}")


STREAM_LOG_DIR = "_spark_metadata"


def table_detail(spark: SparkSession, table: str, name: str) -> str | None:
    """One line of DESCRIBE TABLE EXTENDED (``Location``, ``Provider``), below the columns."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {quote_ident(table)}").collect()
    below = [r for k, r in enumerate(rows) if any(x["col_name"] == "# Detailed Table Information" for x in rows[:k])]
    return next((r["data_type"] for r in below if r["col_name"] == name), None)


def table_location(spark: SparkSession, table: str) -> str | None:
    """Storage location of a table."""
    return table_detail(spark, table, "Location")


def is_stream_owned(spark: SparkSession, table: str) -> bool:
    """True when a streaming file sink writes ``table``.

    Such a folder holds the sink's commit log, and every read of it lists
    only the files in that log, so rows written by a batch insert would be
    invisible. Batch inserts check this first. A session that cannot look
    (Spark Connect) gets an error rather than a wrong answer.
    """
    loc = table_location(spark, table)
    if not loc:
        return False
    found = hadoop_path(spark, loc.rstrip("/") + "/" + STREAM_LOG_DIR)
    if found is None:
        raise RuntimeError(f"this session cannot tell whether a stream writes {table}; insert from a session with a SparkContext")
    system, path = found
    return bool(system.exists(path))
