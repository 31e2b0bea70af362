"""The report summary aggregate and the global row count.

``summarize`` computes, per key value (NULL is a group of its own):

* ``max_date`` / ``min_date``: extremes of the month text, compared as text
  (as the reference does), or chronologically (``chronological=True``);
* ``unique_cities`` / ``unique_shapes``: exact distinct counts, NULL ignored;
* ``median_month_count``: approximate median, an actual input value;
* ``avg_days_diff``: mean of ``report - posted`` in days over rows where both
  day texts parse.

Plan shape. The default scans the input once: every row becomes three
fixed-width cells, which one hash aggregate deduplicates map-side into a base
(``report_cells``) that is written to the shared checkpoint folder. The counts,
extremes and mean are one aggregate of that base; the median is the exact lower
median from a histogram with bounded value buckets (``lower_median``), for
``month_count`` of any orderable type. A hot key is spread over its values in
every shuffle, so no task receives more than a bounded slice of it.

Cells add up: cells keyed by the month text give the summary by year and by any
bucket (``summarize_cells`` of the same base), and cells of more files are merged
into them (``merge_cells``) without reading the old files again.

``median="approx"`` keeps the reference's ``percentile_approx`` in a lazy plan
of two aggregates over the same input (two scans): extremes, sketch and mean
by key, and exact distinct counts deduplicated on (key, value). Its limit: the
sketch is not fixed-width, every map task sends one per key, and one task
merges all sketches of a key. ``approx_distinct=True`` (with the approximate
median only) replaces the exact counts by sketches: one scan.

The per-key results are joined with a NULL-safe equality; adaptive execution
picks the join from their measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skywatch.functions.dates import lag_days, parse_month
from skywatch.functions.ordering import bucket_steps, order_keys
from skywatch.schema import SUMMARY_COLUMNS
from skywatch.session import Scratch, checkpoint_root, scratch_path

DEFAULT_ACCURACY = 10000

_ORDER = SUMMARY_COLUMNS  # output columns after the key
_JOIN_KEY = "__summary_key"


def month_extremes(date_col: str = "date", chronological: bool = False) -> tuple[Column, Column]:
    """(max, min) of the month text, by text order or by the parsed month.

    Chronological extremes ignore text that does not parse (NULL when none
    does); ties on the month are broken by the text, so the result is
    deterministic.
    """
    if not chronological:
        return F.max(date_col), F.min(date_col)
    month = parse_month(date_col)
    ordered = F.when(month.isNotNull(), F.struct(month.alias("m"), F.col(date_col).alias("t")))
    return F.max(ordered).getField("t"), F.min(ordered).getField("t")


def value_columns(
    *,
    date_col: str = "date",
    chronological: bool = False,
    accuracy: int = DEFAULT_ACCURACY,
    with_median: bool = True,
) -> list[Column]:
    """Extremes, median and mean lag: aggregates that need no distinct step."""
    max_date, min_date = month_extremes(date_col, chronological)
    cols = [max_date.alias("max_date"), min_date.alias("min_date")]
    if with_median:
        cols.append(F.percentile_approx("month_count", 0.5, accuracy).alias("median_month_count"))
    cols.append(F.avg(lag_days("report_date", "posted_date")).alias("avg_days_diff"))
    return cols


def lower_median(
    df: DataFrame,
    key: str,
    col: str = "month_count",
    name: str = "median_month_count",
    weight: str | None = None,
) -> DataFrame:
    """Exact lower median of ``col`` per ``key`` (NULL values ignored).

    ``weight`` names a count column when ``df`` is already aggregated (each
    row stands for that many rows); without it every row counts once. Any
    numeric, date, timestamp or boolean column will do, and the median has its
    type; text counts as the double it spells, and other text is ignored.

    The value at rank ceil(n / 2) of the n non-NULL values: what
    ``percentile_approx(col, 0.5)`` returns when its sketch is exact, and
    always inside its error bound. Keys whose values are all NULL have no row.

    Computed without sketches, deterministically, and with every window
    bounded whatever the data:

    1. histogram: count per (key, value), fixed-width and combined map-side,
       shuffled on (key, value), so a hot key spreads over its values;
    2. each value gets its order-preserving 64-bit key (``order_keys``). For each
       16 bits of it but the last, from the top: the totals per (key, these bits)
       among the values still in question; a window over a key's buckets (at
       most 65,536 rows) finds the one bucket holding rank ceil(n / 2) and the
       count before it (one such step for ``int`` and ``date``, three for 64 bits,
       eight for decimals beyond that, with a checkpoint after every third);
    3. only that bucket's histogram rows (at most 65,536 values per key) are
       walked in value order to find the value where the count reaches it.
    """
    value, kind = F.col(col), df.schema[col].dataType
    if isinstance(kind, T.StringType):
        value, kind = value.try_cast("double"), T.DoubleType()
    keys = order_keys(F.col("_v"), kind)
    count = F.sum(weight) if weight else F.count(F.lit(1))
    hist = (
        df.where(value.isNotNull())
        .groupBy(key, value.alias("_v"))
        .agg(count.alias("_n"))
        .select(key, "_v", "_n", *(k.alias(f"_o{i}") for i, (k, _) in enumerate(keys)))
    )
    orders = [f"_o{i}" for i in range(len(keys))]
    per_key = Window.partitionBy(key)
    rank = None
    for step, (place, shift) in enumerate(bucket_steps(keys)):
        if step and step % 3 == 0:
            # Each step uses the values twice; wide decimals take more steps than a plan should hold.
            checkpoint_root(df.sparkSession)
            hist = hist.checkpoint()
        bits = F.shiftright(orders[place], shift)
        bucket = bits.alias("_hi")
        if rank is None:
            buckets = hist.groupBy(key, bucket).agg(F.sum("_n").alias("_bn"))
            before, target = F.lit(0).cast("bigint"), F.ceil(F.sum("_bn").over(per_key) / F.lit(2))
        else:
            buckets = hist.groupBy(key, "_base", "_target", bucket).agg(F.sum("_n").alias("_bn"))
            before, target = F.col("_base"), F.col("_target")
        located = (
            buckets.select(
                F.col(key).alias(_JOIN_KEY),
                F.col("_hi").alias("_bucket"),
                "_bn",
                (before + F.sum("_bn").over(per_key.orderBy("_hi")) - F.col("_bn")).alias("_before"),
                target.alias("_rank"),
            )
            .where((F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_bn")))
            .select(_JOIN_KEY, "_bucket", F.col("_before").alias("_base"), F.col("_rank").alias("_target"))
        )
        hist = hist.select(key, "_v", "_n", *orders).join(
            located,
            F.col(key).eqNullSafe(F.col(_JOIN_KEY)) & (bits == F.col("_bucket")),
        ).select(key, "_v", "_n", *orders, "_base", "_target")
        rank = "_target"
    cumulative = F.col("_base") + F.sum("_n").over(Window.partitionBy(key).orderBy("_v"))
    return (
        hist.withColumn("_cum", cumulative)
        .where((F.col("_cum") >= F.col("_target")) & (F.col("_cum") - F.col("_n") < F.col("_target")))
        .select(key, F.col("_v").cast(kind).alias(name))
    )


def distinct_columns(approx: bool = False, rsd: float = 0.05) -> list[Column]:
    """Distinct counts of city and shape (exact, or HyperLogLog++ sketches)."""
    if approx:
        return [
            F.approx_count_distinct("city", rsd).alias("unique_cities"),
            F.approx_count_distinct("shape", rsd).alias("unique_shapes"),
        ]
    return [
        F.count_distinct(F.col("city")).alias("unique_cities"),
        F.count_distinct(F.col("shape")).alias("unique_shapes"),
    ]


def summary_columns(
    *,
    date_col: str = "date",
    chronological: bool = False,
    approx_distinct: bool = False,
    rsd: float = 0.05,
    accuracy: int = DEFAULT_ACCURACY,
) -> list[Column]:
    """The six summary aggregates for a single ``agg`` call (output order)."""
    max_date, min_date, median, mean = value_columns(
        date_col=date_col, chronological=chronological, accuracy=accuracy
    )
    cities, shapes = distinct_columns(approx_distinct, rsd)
    return [max_date, min_date, cities, shapes, median, mean]


def summarize(
    df: DataFrame,
    key: str = "year",
    *,
    date_col: str = "date",
    chronological: bool = False,
    approx_distinct: bool = False,
    rsd: float | None = None,
    accuracy: int | None = None,
    median: str = "exact",
    scratch: Scratch | None = None,
) -> DataFrame:
    """Group by ``key`` and compute the six summary columns (key first).

    ``median``: ``"exact"`` (``lower_median``; one input scan) or ``"approx"``
    (``percentile_approx``, as the reference; see the module text for its
    limit). They are equal whenever the sketch is exact. The exact form
    materialises a small base aggregate, so it runs a job when called; the
    approximate form is lazy. ``approx_distinct``, ``rsd`` and ``accuracy`` belong
    to the approximate form and are refused with the exact one. The base lies
    in ``scratch``, which removes it, or stays where none is given, because the
    returned frame reads it.
    """
    if median not in ("approx", "exact"):
        raise ValueError(f"median must be 'approx' or 'exact', got {median!r}")
    if median == "exact":
        if approx_distinct or rsd is not None or accuracy is not None:
            raise ValueError("approx_distinct, rsd and accuracy need median='approx'")
        if key in ("month_count", date_col, "city", "shape"):
            raise ValueError(f"the exact median summary cannot be keyed by an input column it aggregates: {key!r}")
        cells = store_cells(report_cells(df, key, date_col), scratch)
        return summarize_cells(cells.withColumnRenamed("_key", key), key, chronological)
    values = value_columns(
        date_col=date_col, chronological=chronological, accuracy=DEFAULT_ACCURACY if accuracy is None else accuracy
    )
    if approx_distinct:
        out = df.groupBy(key).agg(*values, *distinct_columns(True, 0.05 if rsd is None else rsd))
    else:
        count_side = df.groupBy(key).agg(*distinct_columns(False))
        out = _join_on_key(df.groupBy(key).agg(*values), count_side, key, "inner")
    return out.select(key, *_ORDER)


#: Columns of the base: the key, what a cell holds, and how often. ``_kind``: 0 for (month text,
#: month_count) with the lag, 1 for a city, 2 for a shape.
CELL_KEYS = ("_key", "_kind", "_s", "_i")
CELL_SUMS = ("_rows", "_lag_sum", "_lag_n")


def report_cells(df: DataFrame, key: str, date_col: str = "date") -> DataFrame:
    """The base of a summary: deduplicated cells of the reports by ``key`` (as ``_key``).

    Each row becomes three cells: (0, month text, month_count) carrying the
    lag, (1, city) and (2, shape). One hash aggregate per (key, kind, text,
    value) with a row count, lag sum and lag count deduplicates them all:
    fixed-width buffers, combined map-side, a hot key spread over its
    values. Lazy; text in ``month_count`` counts as the double it spells.
    """
    value, kind = F.col("month_count"), df.schema["month_count"].dataType
    if isinstance(kind, T.StringType):
        value, kind = value.try_cast("double"), T.DoubleType()
    lag = lag_days("report_date", "posted_date")

    def cell(number: int, text: str, value, lag_value):
        return F.struct(
            F.lit(number).alias("_kind"),
            F.col(text).cast("string").alias("_s"),
            value.cast(kind).alias("_i"),
            lag_value.cast("int").alias("_lag"),
        )

    none = F.lit(None)
    cells = F.explode(
        F.array(cell(0, date_col, value, lag), cell(1, "city", none, none), cell(2, "shape", none, none))
    ).alias("_cell")
    return (
        df.select(F.col(key).alias("_key"), cells)
        .select("_key", "_cell.*")
        .groupBy(*CELL_KEYS)
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.sum("_lag").alias("_lag_sum"),
            F.count("_lag").alias("_lag_n"),
        )
    )


def merge_cells(cells: DataFrame) -> DataFrame:
    """Cells of several loads as those of all their reports: equal cells are added up."""
    return cells.groupBy(*CELL_KEYS).agg(*(F.sum(c).alias(c) for c in CELL_SUMS))


def store_cells(cells: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Write the base once under the checkpoint folder; everything else reads that copy."""
    spark = cells.sparkSession
    path = scratch.path("summary-base") if scratch else scratch_path(spark, "summary-base")
    cells.write.mode("overwrite").parquet(path)
    return spark.read.schema(cells.schema).parquet(path)


def summarize_cells(cells: DataFrame, key: str, chronological: bool = False) -> DataFrame:
    """The summary from stored cells with a ``key`` column: one aggregate by key for extremes, mean
    and distinct counts, and the median histogram from kind 0.

    Cells may repeat (a base keyed by month text has a city once for each month of a year), so the
    distinct counts deduplicate again, on (key, kind, text).
    """
    kind = cells.schema["_i"].dataType
    is_report = F.col("_kind") == 0
    per_text = cells.groupBy(key, "_kind", "_s").agg(
        F.sum("_lag_sum").alias("_lag_sum"), F.sum("_lag_n").alias("_lag_n")
    )
    max_date, min_date = month_extremes("_t", chronological)
    lag_n = F.sum("_lag_n")
    per_key = (
        per_text.withColumn("_t", F.when(is_report, F.col("_s")))
        .groupBy(key)
        .agg(
            max_date.alias("max_date"),
            min_date.alias("min_date"),
            F.when(lag_n > 0, F.sum("_lag_sum") / lag_n).alias("avg_days_diff"),
            F.count(F.when(F.col("_kind") == 1, F.col("_s"))).alias("unique_cities"),
            F.count(F.when(F.col("_kind") == 2, F.col("_s"))).alias("unique_shapes"),
        )
    )
    median = lower_median(cells.where(is_report), key, "_i", "median_month_count", weight="_rows").withColumn(
        "median_month_count", F.col("median_month_count").cast(kind)
    )
    return _join_on_key(per_key, median, key, "left").select(key, *_ORDER)


def _join_on_key(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Join two per-key results on ``key``, NULL matching NULL."""
    right = right.withColumnRenamed(key, _JOIN_KEY)
    joined = left.join(right, left[key].eqNullSafe(right[_JOIN_KEY]), how)
    return joined.drop(_JOIN_KEY)


def row_count(df: DataFrame, name: str = "row_count") -> DataFrame:
    """One-row frame with the number of rows (partial counts, one shuffle of a row per task)."""
    return df.agg(F.count(F.lit(1)).alias(name))
