"""Sinks: partitioned CSV trees, catalog tables, row-level partitioned inserts.

Write modes:

* ``append`` adds files (a rerun duplicates rows, as a plain load does);
* ``overwrite`` replaces the whole output;
* ``overwrite`` with ``dynamic=True`` replaces only the partitions present in
  the new data, which makes partial reloads idempotent.

The overwrite mode is always an option of the one write. An insert into a
partitioned catalog table would read it from the session, where every job of
the session sees it; so such an overwrite writes to the table's location with
the option and then brings the catalog's list of partitions up to date. Two
overwrites on one session can run side by side, and no session default can turn
a full replace into a partial one or the reverse.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skywatch.operators.catalog import is_stream_owned, quote_ident, table_detail

_OVERWRITE_MODE = "partitionOverwriteMode"
_DYNAMIC = (_OVERWRITE_MODE, "dynamic")


def _keys(partition_by: str | Sequence[str] | None) -> list[str]:
    if partition_by is None:
        return []
    return [partition_by] if isinstance(partition_by, str) else list(partition_by)


def rebalance(
    df: DataFrame,
    partition_by: str | Sequence[str] | None,
) -> DataFrame:
    """Cluster rows by the partition key before a partitioned write.

    A REBALANCE shuffle puts each key value in few tasks (few files per
    directory) and lets adaptive execution split a key that holds a large
    share of the rows into several tasks (by ranges of map outputs) and
    merge small ones, so neither small files nor one huge writer task occur.

    Without adaptive execution REBALANCE is a plain hash shuffle and a hot
    key would be one task. Rows then also spread by a hash of the whole row
    over as many buckets per key as there are shuffle partitions, so a key of
    any size can reach every task: deterministic, so a retried map task sends
    every row where it went the first time.
    """
    keys = _keys(partition_by)
    if df.sparkSession.conf.get("spark.sql.adaptive.enabled", "true").lower() == "true":
        return df.hint("rebalance", *keys) if keys else df.hint("rebalance")
    if not keys:
        return df  # nothing to cluster; the input splits already bound the task sizes
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(buckets))
    return df.repartition(*[F.col(k) for k in keys], salt)


def _refuse_stream_owned(spark, table: str) -> None:
    if spark.catalog.tableExists(table) and is_stream_owned(spark, table):
        raise ValueError(
            f"{table} is written by a stream (its folder holds the stream's commit log); "
            "reads would not see batch-inserted files. Feed it with skywatch.streaming.ingest_new_files."
        )


def save_csv(
    df: DataFrame,
    path: str,
    partition_by: str | Sequence[str] | None = None,
    *,
    mode: str = "overwrite",
    header: bool = False,
    dynamic: bool = False,
    sep: str = ",",
    options: dict[str, str] | None = None,
) -> str:
    """Write ``df`` as CSV, one sub-folder per partition value.

    NULL keys go to ``<key>=__HIVE_DEFAULT_PARTITION__`` and read back as
    NULL. The default writes no header line, as the reference does.
    ``options`` go to the CSV writer (``compression``, ``quoteAll``, ...).
    """
    w = df.write.mode(mode).option("header", header).option("sep", sep).options(**(options or {}))
    keys = _keys(partition_by)
    if keys:
        w = w.partitionBy(*keys)
    if dynamic:
        w = w.option(*_DYNAMIC)
    w.csv(path)
    return path


def save_table(
    df: DataFrame,
    table: str,
    partition_by: str | Sequence[str] | None = None,
    *,
    mode: str = "overwrite",
    format: str = "parquet",
    options: dict[str, str] | None = None,
) -> str:
    """Write ``df`` as a managed table; ``overwrite`` drops and recreates it.

    Partition columns are stored last, so a read-back has them at the end.
    ``options`` go to the writer (``compression`` and the like).
    """
    if mode == "append":
        _refuse_stream_owned(df.sparkSession, table)
    w = df.write.mode(mode).format(format).options(**(options or {}))
    keys = _keys(partition_by)
    if keys:
        w = w.partitionBy(*keys)
    w.saveAsTable(table)
    return table


def insert_into(
    df: DataFrame,
    table: str,
    *,
    overwrite: bool = False,
    dynamic: bool = True,
    partition_by: str | Sequence[str] | None = None,
    balance: bool = True,
) -> str:
    """Insert rows into an existing table by column position.

    For a partitioned table the partition columns must come last in ``df``;
    their values pick the directory of each row (dynamic partitioning).
    ``balance`` rebalances row-level data on the partition key first. ``dynamic``
    says whether an overwrite replaces only the partitions that ``df`` has rows for.
    """
    _refuse_stream_owned(df.sparkSession, table)
    keys = _keys(partition_by)
    if balance:
        df = rebalance(df, keys)
    if overwrite and partition_columns(df.sparkSession, table):
        _overwrite_partitions(df, table, dynamic)
    else:
        df.write.insertInto(table, overwrite=overwrite)
    return table


def partition_columns(spark, table: str) -> list[str]:
    """Partition columns of a catalog table, in order."""
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


# Widening that loses nothing: what an insert by position may do on its own.
_WIDER = {
    "tinyint": {"smallint", "int", "bigint", "float", "double"},
    "smallint": {"int", "bigint", "float", "double"},
    "int": {"bigint", "double"},
    "float": {"double"},
    "date": {"timestamp"},
    "void": None,
}


def _aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the table's column names and types, by position; other types are refused."""
    if len(df.columns) != len(schema.fields):
        raise ValueError(f"{len(df.columns)} columns for a table of {len(schema.fields)}")
    out = []
    for have, want in zip(df.schema.fields, schema.fields):
        old, new = have.dataType.simpleString(), want.dataType.simpleString()
        if old != new and (old not in _WIDER or (_WIDER[old] is not None and new not in _WIDER[old])):
            raise TypeError(f"cannot insert {old} {have.name!r} into {new} column {want.name!r}")
        out.append(F.col(quote_ident_part(have.name)).cast(want.dataType).alias(want.name))
    return df.select(*out)


def quote_ident_part(name: str) -> str:
    """One column name, quoted whole (a dot in it is no field access)."""
    return "`" + name.replace("`", "``") + "`"


def _overwrite_partitions(df: DataFrame, table: str, dynamic: bool) -> None:
    spark = df.sparkSession
    location, provider = table_detail(spark, table, "Location"), table_detail(spark, table, "Provider")
    if not location or not provider:
        raise ValueError(f"{table} has no location or format to overwrite")
    base = location.rstrip("/") + "/"
    if any(_plain(f).startswith(_plain(base)) for f in df.inputFiles()):
        raise ValueError(f"cannot overwrite {table} with rows read from it; materialise them first")
    rows = _aligned(df, spark.table(table).schema)
    writer = rows.write.format(provider.lower()).mode("overwrite").partitionBy(*partition_columns(spark, table))
    writer.option(_OVERWRITE_MODE, "dynamic" if dynamic else "static").save(location)
    # Partitions that the write made are added to the catalog; after a full replace, those gone are dropped.
    spark.sql(f"MSCK REPAIR TABLE {quote_ident(table)} {'ADD' if dynamic else 'SYNC'} PARTITIONS")
    spark.catalog.refreshTable(table)


def _plain(path: str) -> str:
    """A path without its scheme's empty authority: ``file:///a`` and ``file:/a`` are one."""
    return path.replace(":///", ":/")


def show_preview(df: DataFrame, n: int = 20, truncate: bool = True) -> None:
    """Print the first ``n`` rows (console preview; not part of any result)."""
    df.show(n, truncate=truncate)
