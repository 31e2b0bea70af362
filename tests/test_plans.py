"""Plan-shape checks: the properties the scale design relies on."""

import re

from skywatch import read_csv, summarize
from skywatch.plans import summarize_reports
from skywatch.schema import sighting_schema


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_summary_uses_key_only_sketch_and_hash_only_distinct(spark, summary_csv):
    plan = _plan(summarize_reports(read_csv(spark, summary_csv, schema=sighting_schema()), "year", median="approx"))
    assert "SortAggregate" not in plan
    # The sketch aggregate is keyed by the year alone.
    sketch_keys = re.findall(r"ObjectHashAggregate\(keys=\[([^\]]*)\]", plan)
    assert sketch_keys and all(k.startswith("year#") and "," not in k for k in sketch_keys)
    # The distinct step expands only city and shape, deduplicated by hash aggregation.
    assert plan.count("Expand") == 1
    dedup = re.findall(r"HashAggregate\(keys=\[(year#\d+, [^\]]*gid#\d+)\], functions=\[\]", plan)
    assert dedup and all("city" in k and "shape" in k for k in dedup)
    assert "isnull(year" in plan  # joined NULL-safely


def test_summary_leaves_join_to_planner(spark, summary_csv):
    df = summarize(read_csv(spark, summary_csv, schema=sighting_schema()), "state")
    hints = df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in hints.lower()


def test_column_pruning_per_branch(spark, summary_csv):
    plan = _plan(summarize_reports(read_csv(spark, summary_csv, schema=sighting_schema()), "year", median="approx"))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert sorted(schemas) == sorted(
        [
            "date:string,report_date:string,posted_date:string,month_count:int",
            "date:string,city:string,shape:string",
        ]
    )


def test_exact_median_has_no_sketch_and_no_sampling(spark, summary_csv):
    df = summarize_reports(read_csv(spark, summary_csv, schema=sighting_schema()), "year")
    plan = _plan(df)
    assert "percentile_approx" not in plan
    assert "FileScan csv" not in plan  # the input was scanned once, for the base that this plan reads
    assert "rangepartitioning" not in plan  # deterministic buckets, no sampled bounds
    assert "shiftright(_v" in plan or "shiftright(" in plan


def test_approx_distinct_single_aggregate(spark, summary_csv):
    df = summarize_reports(read_csv(spark, summary_csv, schema=sighting_schema()), "year", approx_distinct=True, median="approx")
    plan = _plan(df)
    assert "Expand" not in plan and "Join" not in plan
    assert plan.count("Exchange") == 1
