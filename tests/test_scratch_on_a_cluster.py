"""Queries on a cluster whose ``spark.checkpoint.dir`` is a plain path.

The executors of a ``local-cluster`` stand for the machines; the code is told another master, as it
would see it on them. A second Spark context needs a process of its own: this file, run as a script.
"""

import json
import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)

from tests.llm import corpus  # noqa: E402
from tests.test_local_cluster import LINEITEM, ORDERS  # noqa: E402

MASTER = "spark://driver:7077"

#: Queries that keep files in the checkpoint folder.
NAMES = [
    "pipeline",
    "annual_summary",
    "annual_summary_chronological",
    "annual_summary_exact_median",
    "annual_summary_explicit_schema",
    "annual_summary_fractional_counts",
    "biennial_csv_roundtrip",
    "biennial_summary",
    "annual_summary_from_raw_table",
    "biennial_summary_chronological",
    "biennial_summary_chronological_exact_median",
    "csv_infer_roundtrip",
    "csv_partitioned_roundtrip",
    "delimited_load",
    "delimited_load_pipe",
    "describe_table",
    "incremental_summary",
    "list_partitions",
    "load_new_files",
    "list_year_partitions",
    "load_rerun_append",
    "load_rerun_overwrite",
    "median_of_wide_decimals",
    "partial_reload",
    "not_null_filter",
    "op4_suffix_array_dedup",
    "op5_context_tree_scoring",
    "op7_benchmark_decontamination",
    "op8_ngram_jaccard_join",
    "op9_substring_dedup",
    "op12_vector_codes",
]


def rows():
    """Documents with ids of their own."""
    return [r for r in dict((t[0], t) for t in corpus.texts()).values() if r[0] is not None]


def write_tables(con, top: str) -> None:
    import pyarrow as pa
    import pyarrow.parquet as pq

    docs = rows()
    ids, texts = [i for i, _ in docs], [t for _, t in docs]
    langs = ["de" if i % 2 else "en" for i in ids]
    tables = {
        "documents": {"doc_id": ids, "text": texts, "lang": langs, "source": ["web"] * len(ids), "n_chars": [len(t or "") for t in texts]},
        "labels": {"doc_id": ids, "quality": [1] * len(ids), "toxic": [1 if "spam" in (t or "") else 0 for t in texts]},
        "benchmark": {"item_id": [1, 2, 3], "text": [dict(docs)[500], "a b c d e f g h i j k l", "wort7 the3"]},
        "embeddings": {"vec_id": range(80), "embedding": [[(i * k % 17) / 8 for k in range(32)] for i in range(80)], "label": [i % 3 for i in range(80)]},
    }
    kinds = {"quality": pa.int32(), "toxic": pa.int32(), "label": pa.int32(), "embedding": pa.list_(pa.float32())}
    os.makedirs(f"{top}/in")
    for name, columns in tables.items():
        made = pa.table({c: pa.array(list(v), kinds.get(c, pa.string() if c in ("text", "lang", "source") else pa.int64())) for c, v in columns.items()})
        pq.write_table(made, f"{top}/in/{name}.parquet")
    for name, sql in (("orders", ORDERS), ("lineitem", LINEITEM)):
        con.execute(f"COPY ({sql}) TO '{top}/in/{name}.parquet' (FORMAT parquet)")
    for name in (*tables, "orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{top}/in/{name}.parquet'")


def cluster(top: str):
    """A session on executors of their own; the package sees another master."""
    import pyspark
    from pyspark.sql import SparkSession

    from skywatch import session

    # The executors' folders go below SPARK_HOME.
    os.makedirs(f"{top}/home")
    home = os.path.dirname(pyspark.__file__)
    for p in os.listdir(home):
        if p != "work":
            os.symlink(f"{home}/{p}", f"{top}/home/{p}")
    os.environ |= {"SPARK_HOME": f"{top}/home", "SPARK_LOCAL_DIRS": f"{top}/local", "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    conf = {
        "spark.master": "local-cluster[2,2,1024]",
        "spark.driver.host": "127.0.0.1",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "2",
        "spark.sql.warehouse.dir": f"{top}/warehouse",
        "spark.checkpoint.dir": f"{top}/shared",
    }
    spark = SparkSession.builder.config(map=conf).getOrCreate()

    class Context:
        master = MASTER

        def __getattr__(self, name):
            return getattr(spark.sparkContext, name)

    session._spark_context = lambda _: Context()
    return spark


def outcome(spark, con, top: str, name: str) -> tuple[bool, str]:
    import __spark_entry__ as entry
    from check_oracles import compare

    df = entry.queries()[name](spark, f"{top}/in")
    if name in entry.oracle_sql():
        return compare(df, con, entry.oracle_sql()[name])
    ids = sorted(r.doc_id for r in df.select("doc_id").collect())
    if name == "pipeline":  # chosen by a model, too
        return 0 < len(ids) < len(rows()) and set(ids) < {i for i, _ in rows()}, f"{len(ids)} rows"
    if name == "op4_suffix_array_dedup":
        columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        return corpus.ordered([r.asDict() for r in df.collect()], columns) == sorted(corpus.repeated_bytes(rows()), key=repr), f"{len(ids)} rows"
    return ids == sorted(i for i, _ in rows()), f"{len(ids)} rows"


def run(top: str, names: list[str]) -> None:
    """Print a line of JSON for each query (its name, whether its rows are right, and what they are), then for two folders."""
    import duckdb

    sys.path.insert(0, f"{REPO}/tools")
    from skywatch import session

    con = duckdb.connect()
    write_tables(con, top)
    spark = cluster(top)
    for name in names:
        try:
            ok, detail = outcome(spark, con, top, name)
        except Exception as x:
            ok, detail = False, f"{type(x).__name__}: {x}"
        print(json.dumps([name, ok, detail[:500]]), flush=True)

    # Each process has a working folder of its own: no other sees what it writes there.
    for name, root in (("shared", f"{top}/another"), ("own", "/proc/self/cwd/scratch")):
        try:
            session._refuse_local_on_cluster(spark, root)
            found = "taken"
        except ValueError as x:
            found = f"refused: {x}"
        left = os.listdir(f"{root}/skywatch") if os.path.isdir(f"{root}/skywatch") else []
        print(json.dumps([name, not left, found]), flush=True)
    spark.stop()


@pytest.fixture(scope="module")
def found(tmp_path_factory):
    top = str(tmp_path_factory.mktemp("cluster"))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "_PYSPARK", "SPARK_"))}
    env["PYTHONPATH"] = os.pathsep.join([REPO, *filter(None, [env.get("PYTHONPATH")])])
    made = subprocess.run(
        [sys.executable, __file__, top, *NAMES], env=env, cwd=top, capture_output=True, text=True, timeout=900
    )
    lines = [json.loads(x) for x in made.stdout.splitlines() if x.startswith("[")]
    assert lines, made.stderr[-2000:]
    return {name: (ok, detail) for name, ok, detail in lines}


@pytest.mark.parametrize("name", NAMES)
def test_query_with_a_plain_checkpoint_path(found, name):
    ok, detail = found[name]
    assert ok, detail


def test_a_folder_is_tried_out(found):
    assert found["shared"] == (True, "taken")
    clean, said = found["own"]
    assert clean and said.startswith("refused") and "spark.checkpoint.dir" in said


if __name__ == "__main__":
    run(sys.argv[1], sys.argv[2:])
