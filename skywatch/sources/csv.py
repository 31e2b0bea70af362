"""CSV scan of report files.

With an explicit schema the scan is a single pass and types are fixed up
front; that is the form to use on large inputs. ``infer_schema=True``
keeps the reference behaviour (header gives the names, an extra pass over
all of the data gives the types). A header must name the columns of an
explicit schema in its order: fields bind by position, so a file whose header
says otherwise fails instead of swapping columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    *,
    schema: T.StructType | str | None = None,
    infer_schema: bool = True,
    header: bool = True,
    sep: str = ",",
    **options: str,
) -> DataFrame:
    """Read CSV files; quoted fields may hold the separator."""
    reader = spark.read.option("header", header).option("sep", sep)
    if schema is not None:
        reader = reader.schema(schema)
        if header:
            reader = reader.option("enforceSchema", False)
    else:
        reader = reader.option("inferSchema", infer_schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.csv(path)
