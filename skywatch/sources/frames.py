"""Report frames derived from the driver's ``orders`` table.

The real report file is not shipped, so test and benchmark inputs are
derived, row for row, from ``orders``: every order becomes one report. The
derivation puts in the cases the jobs must handle: unparsable month text,
NULL city/shape/posted date/month count, and a summary holding the
separator. The order key only decides which reports carry those cases; no
order is dropped. All of it is one projection over the scan, so it grows
with ``orders`` and runs in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skywatch.schema import SIGHTING_COLUMNS


def sightings_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per order (mapping documented in FIXTURES.md section 3)."""
    o = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")

    def unless(modulus: int, value):
        return F.when(k % modulus == 0, F.lit(None)).otherwise(value)

    return o.select(
        F.concat(F.lit("d"), k.cast("string")).alias("details"),
        F.when(k % 97 == 0, F.lit("unknown"))
        .otherwise(F.date_format(day, "MM/yyyy"))
        .alias("date"),
        unless(41, F.concat(F.lit("city_"), (F.col("o_custkey") % 50).cast("string"))).alias("city"),
        F.col("o_orderstatus").alias("state"),
        F.lit("USA").alias("country"),
        unless(53, F.col("o_orderpriority")).alias("shape"),
        F.when(k % 7 == 0, F.lit("bright, fast")).otherwise(F.lit("light")).alias("summary"),
        F.date_format(day, "MM/dd/yyyy").alias("report_date"),
        unless(89, F.date_format(F.date_add(day, (k % 60).cast("int")), "MM/dd/yyyy")).alias(
            "posted_date"
        ),
        unless(29, (k % 13).cast("int")).alias("month_count"),
    )


def write_report_csv(frame: DataFrame, path: str, *, header: bool = True, sep: str = ",") -> str:
    """Write report rows as CSV files (fields with the separator are quoted)."""
    frame.write.mode("overwrite").option("header", header).option("sep", sep).csv(path)
    return path


def write_report_text(frame: DataFrame, path: str, *, sep: str = ",", header_line: bool = True) -> str:
    """Write report rows as a delimited export with a single header line.

    Rows are written by the CSV writer (so a field holding the separator is
    quoted, as in an exported report file). The header is written once, as
    its own one-line file in the same folder, so the folder holds exactly
    one header line however many tasks wrote the rows.
    """
    frame.write.mode("overwrite").option("header", False).option("sep", sep).csv(path)
    if header_line:
        spark = frame.sparkSession
        names = [f.name for f in frame.schema.fields] or list(SIGHTING_COLUMNS)
        line = spark.createDataFrame([(sep.join(names),)], T.StructType([T.StructField("value", T.StringType())]))
        line.coalesce(1).write.mode("append").text(path)
    return path
