"""Catalog table scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Scan a catalog table by (qualified) name.

    Filters on partition columns prune directories and filters on data
    columns reach the Parquet reader.
    """
    return spark.table(name)
