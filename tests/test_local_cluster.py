"""Queries on executors of their own, with ``spark.checkpoint.dir`` as a plain path.

The executors of a ``local-cluster`` run on the driver's machine, so a folder without a scheme is one
that all of them share. A second Spark context needs a process of its own: this file, run as a script.
"""

import json
import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: Queries that keep files in the checkpoint folder.
NAMES = [
    "annual_summary",
    "annual_summary_chronological",
    "annual_summary_exact_median",
    "annual_summary_explicit_schema",
    "annual_summary_fractional_counts",
    "annual_summary_from_raw_table",
    "biennial_csv_roundtrip",
    "biennial_summary",
    "biennial_summary_chronological",
    "csv_infer_roundtrip",
    "biennial_summary_chronological_exact_median",
    "csv_partitioned_roundtrip",
    "delimited_load",
    "delimited_load_pipe",
    "describe_table",
    "incremental_summary",
    "list_partitions",
    "list_year_partitions",
    "load_new_files",
    "load_rerun_append",
    "median_of_wide_decimals",
    "load_rerun_overwrite",
    "not_null_filter",
    "partial_reload",
]

ORDERS = """
SELECT i AS o_orderkey, i % 70 AS o_custkey, ['O', 'F', 'P'][1 + i % 3] AS o_orderstatus,
       TIMESTAMP '1994-11-20' + INTERVAL 1 DAY * (i * 5 % 1200) AS o_orderdate,
       ['1-URGENT', '3-MEDIUM', '5-LOW'][1 + i * 7 % 3] AS o_orderpriority
FROM range(1, 401) t(i)
"""
LINEITEM = """
SELECT i // 3 AS l_orderkey, CAST(1 + i % 7 AS INTEGER) AS l_linenumber, ['A', 'N', NULL][1 + i % 3] AS l_returnflag,
       (i % 50) * 17.25 AS l_extendedprice, TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * (i % 365) AS l_shipdate
FROM range(1, 601) t(i)
"""


def run(top: str, names: list[str]) -> None:
    """Print a line of JSON for each query: its name, whether it gives the oracle's rows, and why not."""
    import duckdb
    import pyspark
    from pyspark.sql import SparkSession

    sys.path[:0] = [REPO, f"{REPO}/tools"]
    import __spark_entry__ as entry
    from check_oracles import compare

    con = duckdb.connect()
    os.makedirs(f"{top}/in")
    for table, sql in (("orders", ORDERS), ("lineitem", LINEITEM)):
        con.execute(f"COPY ({sql}) TO '{top}/in/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{top}/in/{table}.parquet'")
    # The executors' folders go below SPARK_HOME.
    os.makedirs(f"{top}/home")
    home = os.path.dirname(pyspark.__file__)
    for p in os.listdir(home):
        if p != "work":
            os.symlink(f"{home}/{p}", f"{top}/home/{p}")
    os.environ |= {"SPARK_HOME": f"{top}/home", "SPARK_LOCAL_DIRS": f"{top}/local", "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    conf = {
        "spark.master": "local-cluster[2,1,1024]",
        "spark.driver.host": "127.0.0.1",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "2",
        "spark.sql.warehouse.dir": f"{top}/warehouse",
        "spark.checkpoint.dir": f"{top}/shared",
    }
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    for name in names:
        try:
            ok, detail = compare(entry.queries()[name](spark, f"{top}/in"), con, entry.oracle_sql()[name])
        except Exception as x:
            ok, detail = False, f"{type(x).__name__}: {x}"
        print(json.dumps([name, ok, detail[:500]]), flush=True)
    spark.stop()


@pytest.fixture(scope="module")
def found(tmp_path_factory):
    top = str(tmp_path_factory.mktemp("cluster"))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "_PYSPARK", "SPARK_"))}
    made = subprocess.run(
        [sys.executable, __file__, top, *NAMES], env=env, cwd=top, capture_output=True, text=True, timeout=600
    )
    lines = [json.loads(x) for x in made.stdout.splitlines() if x.startswith("[")]
    assert lines, made.stderr[-2000:]
    return {name: (ok, detail) for name, ok, detail in lines}


@pytest.mark.parametrize("name", NAMES)
def test_query_on_executors_of_its_own(found, name):
    ok, detail = found[name]
    assert ok, detail


@pytest.mark.parametrize(
    "root, named, fine",
    [
        ("/scratch", True, True),
        ("file:/warehouse/_skywatch_checkpoints", False, True),
        ("hdfs://store/scratch", True, True),
        ("scratch", True, False),  # each executor has a working folder of its own
    ],
)
def test_scratch_folder_of_a_local_cluster(root, named, fine):
    from skywatch import session

    class Fake:
        class conf:
            get = staticmethod(lambda key, default=None: root if named else default)

        class sparkContext:
            master = "local-cluster[3,2,3000]"

    if fine:
        session._refuse_local_on_cluster(Fake, root)
    else:
        with pytest.raises(ValueError):
            session._refuse_local_on_cluster(Fake, root)


if __name__ == "__main__":
    run(sys.argv[1], sys.argv[2:])
