"""DuckDB SQL oracles for the registered queries.

Each oracle recomputes its query's result from the ``orders`` view alone,
independently of the Spark code: the report derivation, the delimited
export and its positional re-reading, the strict date parsing and the
aggregates are all written out in SQL. Two dialect points matter:

* DuckDB's ``strptime`` is laxer than the strict patterns (it takes
  ``1/1999``), so parsing is guarded by a full-match regex;
* ``CAST(x / 2 AS INTEGER)`` rounds in DuckDB but truncates in Spark, so
  buckets use integer division ``//``.
"""

from __future__ import annotations

from skywatch.schema import SIGHTING_COLUMNS

_REPORTS = """
reports AS (
  SELECT
    'd' || CAST(o_orderkey AS VARCHAR) AS details,
    CASE WHEN o_orderkey % 97 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%m/%Y') END AS "date",
    CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE 'city_' || CAST(o_custkey % 50 AS VARCHAR) END AS city,
    o_orderstatus AS state,
    'USA' AS country,
    CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_orderpriority END AS shape,
    CASE WHEN o_orderkey % 7 = 0 THEN 'bright, fast' ELSE 'light' END AS summary,
    strftime(o_orderdate, '%m/%d/%Y') AS report_date,
    CASE WHEN o_orderkey % 89 = 0 THEN NULL
         ELSE strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER), '%m/%d/%Y') END AS posted_date,
    CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(o_orderkey % 13 AS INTEGER) END AS month_count
  FROM orders
)"""


def _month(col: str) -> str:
    return f"CASE WHEN regexp_full_match({col}, '[0-9]{{2}}/[0-9]{{4}}') THEN CAST(try_strptime({col}, '%m/%Y') AS DATE) END"


def _day(col: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({col}, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') "
        f"THEN CAST(try_strptime({col}, '%m/%d/%Y') AS DATE) END"
    )


def _year(col: str) -> str:
    return f"CAST(year({_month(col)}) AS INTEGER)"


_KEYED = f"""
keyed AS (
  SELECT *,
    {_month('"date"')} AS month,
    {_year('"date"')} AS year,
    {_day('report_date')} AS report_day,
    {_day('posted_date')} AS posted_day,
    CAST(datediff('day', {_day('posted_date')}, {_day('report_date')}) AS INTEGER) AS days_diff,
    CAST(({_year('"date"')} // 2) * 2 AS INTEGER) AS year_group
  FROM reports
)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def _export_lines(sep: str) -> str:
    """The report rows as a delimited export: the CSV writer quotes a field
    holding the separator, writes NULL as an empty field, and the folder
    holds one header line."""

    def field(c: str) -> str:
        text = f"CAST({c} AS VARCHAR)" if c == "month_count" else c
        quoted = f"CASE WHEN strpos({text}, '{sep}') > 0 THEN '\"' || {text} || '\"' ELSE {text} END"
        return f"coalesce({quoted}, '')"

    cols = ['"date"' if c == "date" else c for c in SIGHTING_COLUMNS]
    header = sep.join(SIGHTING_COLUMNS)
    return f"""
lines AS (
  SELECT concat_ws('{sep}', {', '.join(field(c) for c in cols)}) AS line FROM reports
  UNION ALL
  SELECT '{header}' AS line
)"""


def _integer_text(text: str) -> str:
    """Text-table integers, written without a pattern: the sign is taken off, the rest is split at
    its first point, both sides must be digits or nothing, with one digit at least in all."""
    sign = f"({text}[1:1] IN ('+', '-'))"
    body = f"(CASE WHEN {sign} THEN {text}[2:] ELSE {text} END)"
    whole, part = f"split_part({body}, '.', 1)", f"substr({body}, strpos({body} || '.', '.') + 1)"
    digits = f"translate({whole} || {part}, '0123456789', '')"
    value = f"TRY_CAST((CASE WHEN {text}[1:1] = '-' THEN '-' ELSE '' END) || (CASE WHEN {whole} = '' THEN '0' ELSE {whole} END) AS INTEGER)"
    return f"(CASE WHEN {digits} = '' AND length({whole} || {part}) > 0 THEN {value} END)"


def _raw(sep: str, date_name: str = "datetime") -> str:
    """Positional re-reading of the export: no quoting, missing fields NULL,
    extra fields dropped, text-table integer rules for month_count."""
    names = list(SIGHTING_COLUMNS[:-1])
    names[1] = date_name
    strings = ", ".join(f'p[{i + 1}] AS "{n}"' for i, n in enumerate(names))
    return f"""{_export_lines(sep)},
raw AS (
  SELECT {strings},
    {_integer_text('p[10]')} AS month_count
  FROM (SELECT string_split(line, '{sep}') AS p FROM lines) AS f
)"""


def _summary(key: str, chronological: bool = False) -> str:
    if chronological:
        hi = 'arg_max("date", month) FILTER (WHERE month IS NOT NULL)'
        lo = 'arg_min("date", month) FILTER (WHERE month IS NOT NULL)'
    else:
        hi, lo = 'max("date")', 'min("date")'
    return _with(_REPORTS, _KEYED) + f"""
SELECT {key},
  {hi} AS max_date,
  {lo} AS min_date,
  count(DISTINCT city) AS unique_cities,
  count(DISTINCT shape) AS unique_shapes,
  quantile_disc(month_count, 0.5) AS median_month_count,
  avg(days_diff) AS avg_days_diff
FROM keyed GROUP BY {key}"""


def _aggregates(key: str, source: str = "keyed") -> str:
    return f"""SELECT {key},
  max("date") AS max_date, min("date") AS min_date,
  count(DISTINCT city) AS unique_cities, count(DISTINCT shape) AS unique_shapes,
  quantile_disc(month_count, 0.5) AS median_month_count, avg(days_diff) AS avg_days_diff
FROM {source} GROUP BY {key.rsplit(' AS ', 1)[0]}"""


def _spans() -> str:
    """Summaries by year, two years and ten, one below the other."""
    parts = []
    for width in (1, 2, 10):
        parts.append(
            f"SELECT CAST({width} AS INTEGER) AS width, * FROM ("
            + _aggregates("start_year", f"(SELECT *, CAST((year // {width}) * {width} AS INTEGER) AS start_year FROM keyed)")
            + ")"
        )
    return _keyed(" UNION ALL ".join(parts))


# Counts in quarters: a double column.
_QUARTERS = "quarters AS (SELECT * REPLACE (CAST(month_count AS DOUBLE) / 4 AS month_count) FROM keyed)"

# The dated export: month and day texts as dates, one header line, text rules for the count.
_DATED = f"""
dated AS (
  SELECT details, {_month('"date"')} AS "date", coalesce(city, '') AS city, state, country, coalesce(shape, '') AS shape, summary,
    {_day('report_date')} AS report_date, {_day('posted_date')} AS posted_date, month_count, {_year('"date"')} AS year FROM reports
  UNION ALL
  SELECT 'details', NULL, 'city', 'state', 'country', 'shape', 'summary', NULL, NULL, NULL, NULL
)"""


def _keyed(select: str) -> str:
    return _with(_REPORTS, _KEYED) + select


def _raw_select(sep: str, select: str, date_name: str = "datetime") -> str:
    return _with(_REPORTS, _raw(sep, date_name)) + select


_RAW_COLS = ", ".join("datetime" if c == "date" else c for c in SIGHTING_COLUMNS)

_PARTITIONED = f"SELECT {_RAW_COLS} FROM raw WHERE month_count IS NOT NULL"

_BY_YEAR = _raw_select(
    "|",
    f"""SELECT details, "date", city, state, country, shape, summary, report_date, posted_date,
  month_count, {_year('"date"')} AS year FROM raw""",
    "date",
)


_RAW_SUMMARY = _raw_select(
    ",",
    f"""SELECT {_year('datetime')} AS year,
  max(datetime) AS max_date,
  min(datetime) AS min_date,
  count(DISTINCT city) AS unique_cities,
  count(DISTINCT shape) AS unique_shapes,
  quantile_disc(month_count, 0.5) AS median_month_count,
  avg(CAST(datediff('day', {_day('posted_date')}, {_day('report_date')}) AS INTEGER)) AS avg_days_diff
FROM raw GROUP BY 1""",
)


def oracle_sql() -> dict[str, str]:
    return {
        "annual_summary": _summary("year"),
        "annual_summary_explicit_schema": _summary("year"),
        "annual_summary_chronological": _summary("year", chronological=True),
        "annual_summary_from_raw_table": _RAW_SUMMARY,
        "annual_summary_exact_median": _summary("year"),
        "biennial_summary": _summary("year_group"),
        "biennial_summary_chronological": _summary("year_group", chronological=True),
        "biennial_summary_chronological_exact_median": _summary("year_group", chronological=True),
        "annual_summary_fractional_counts": _with(_REPORTS, _KEYED, _QUARTERS) + _aggregates("year", "quarters"),
        "summaries_of_one_scan": _spans(),
        "incremental_summary": _summary("year"),
        "summary_by_state": _summary("state"),
        "parse_month": _keyed('SELECT details, "date", month, year FROM keyed'),
        "parse_day": _keyed("SELECT details, report_day, posted_day FROM keyed"),
        "lag_days": _keyed("SELECT details, days_diff FROM keyed"),
        "year_bucket": _keyed(
            "SELECT details, year, year_group, CAST((year // 5) * 5 AS INTEGER) AS year_group_5 FROM keyed"
        ),
        "minmax_by_year": _keyed('SELECT year, max("date") AS max_date, min("date") AS min_date FROM keyed GROUP BY year'),
        "distinct_by_year": _keyed(
            "SELECT year, count(DISTINCT city) AS unique_cities, count(DISTINCT shape) AS unique_shapes "
            "FROM keyed GROUP BY year"
        ),
        "median_by_year": _keyed(
            "SELECT year, quantile_disc(month_count, 0.5) AS median_month_count FROM keyed GROUP BY year"
        ),
        "avg_lag_by_year": _keyed("SELECT year, avg(days_diff) AS avg_days_diff FROM keyed GROUP BY year"),
        "row_count": _with(_REPORTS, _export_lines("|")) + "SELECT count(*) AS row_count FROM lines",
        "project_columns": _raw_select(",", f"SELECT {_RAW_COLS} FROM raw"),
        "not_null_filter": _raw_select(",", _PARTITIONED),
        "rejected_rows": _raw_select(",", f"SELECT {_RAW_COLS} FROM raw WHERE month_count IS NULL"),
        "csv_infer_roundtrip": _with(_REPORTS) + "SELECT * FROM reports",
        "csv_partitioned_roundtrip": _summary("year"),
        "biennial_csv_roundtrip": _summary("year_group"),
        "median_of_wide_column": "SELECT l_returnflag AS flag, "
        "quantile_disc(CAST(l_orderkey * 1000003 * (l_linenumber - 3) AS BIGINT), 0.5) AS median_value FROM lineitem GROUP BY 1",
        "median_of_doubles": "SELECT l_returnflag AS flag, "
        "quantile_disc(l_extendedprice * (l_linenumber - 3), 0.5) AS median_value FROM lineitem GROUP BY 1",
        "median_of_dates": "SELECT l_linenumber AS line, quantile_disc(CAST(l_shipdate AS DATE), 0.5) AS median_day "
        "FROM lineitem GROUP BY 1",
        "median_of_wide_decimals": "SELECT l_returnflag AS flag, "
        "CAST(quantile_disc(CAST(l_orderkey * (l_linenumber - 3) AS HUGEINT) * 1000000000039, 0.5) AS VARCHAR) AS median_value "
        "FROM lineitem GROUP BY 1",
        "describe_table": _raw_select(
            ",",
            "SELECT col_name, data_type, CAST(NULL AS VARCHAR) AS comment, (SELECT count(*) FROM raw) AS table_rows FROM (VALUES "
            + ", ".join(
                f"('{'datetime' if c == 'date' else c}', '{'int' if c == 'month_count' else 'string'}')" for c in SIGHTING_COLUMNS
            )
            + ") AS d(col_name, data_type)",
        ),
        "delimited_load": _raw_select(",", f"SELECT {_RAW_COLS} FROM raw"),
        "delimited_load_pipe": _raw_select("|", f"SELECT {_RAW_COLS} FROM raw"),
        "streaming_ingest": _raw_select(",", f"SELECT {_RAW_COLS} FROM raw"),
        "partitioned_insert": _raw_select(",", _PARTITIONED),
        # Run 1 inserts the raw rows once; run 2 appends the file to the raw
        # table again and inserts the whole (doubled) raw table: 3 copies.
        "load_rerun_append": _raw_select(",", " UNION ALL ".join([_PARTITIONED] * 3)),
        "load_rerun_overwrite": _raw_select(",", _PARTITIONED),
        "load_new_files": _raw_select(",", _PARTITIONED),
        "partial_reload": _raw_select(
            ",",
            f"SELECT * FROM ({_PARTITIONED}) WHERE month_count < 9 UNION ALL "
            "SELECT details, \"date\", coalesce(city, ''), state, country, coalesce(shape, ''), 'corrected', report_date, "
            "coalesce(posted_date, ''), month_count FROM reports WHERE month_count >= 9",
        ),
        "partitioned_insert_by_year": _BY_YEAR,
        "partitioned_insert_by_year_dated": _with(_REPORTS, _DATED) + "SELECT * FROM dated",
        "list_partitions": _raw_select(
            ",",
            "SELECT DISTINCT 'month_count=' || CAST(month_count AS VARCHAR) AS partition "
            "FROM raw WHERE month_count IS NOT NULL",
        ),
        "list_year_partitions": _raw_select(
            "|",
            f"""SELECT DISTINCT 'year=' || coalesce(CAST({_year('"date"')} AS VARCHAR), '__HIVE_DEFAULT_PARTITION__')
  AS partition FROM raw""",
            "date",
        ),
        "table_roundtrip": _summary("year_group"),
    }
