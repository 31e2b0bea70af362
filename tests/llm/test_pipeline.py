"""The pipeline's stages, one by one and together."""

import os

import pytest

import corpus_pipeline
from skywatch.llm import queries
from skywatch.session import checkpoint_root
from tests.llm import corpus

pytestmark = pytest.mark.skipif(not os.path.exists(queries.MODEL_FILE), reason="no vocabulary file here")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = corpus.texts()
    path = tmp_path_factory.mktemp("pipeline")
    labels = spark.createDataFrame([(i, 1 if "spam" in (t or "") else 0) for i, t in rows if i is not None], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, rows[10][1]), (2, "a b c d e f g h i j k l")], "item_id long, text string")
    corpus.documents(spark, path, {"documents": corpus.frame(spark, rows), "labels": labels, "benchmark": bench})
    return str(path), rows


def test_stages_keep_columns_and_take_effect(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        got = [tuple(r) for r in out.select("doc_id", "text").collect()]
        if name == "near_duplicates":
            want = corpus.classes(rows)
            assert len(got) == len({c for _, n, c in want if n}) + sum(not n for _, n, _ in want)
        elif name == "repeated_passages":
            left = {(i, corpus.sha(" ".join(corpus.words(t)))) for i, t in got}
            assert left == {(i, s) for i, _, _, s in corpus.repeated_words(rows)}
            gone = {i: n for i, _, n, _ in corpus.repeated_words(rows)}
            assert all((i, t) in rows for i, t in got if not gone[i])  # untouched texts stay as they were
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
            bad = [hit for *_, hit in corpus.contamination(rows, items)]
            assert sorted(got, key=repr) == sorted([r for r, b in zip(rows, bad) if not b], key=repr)
        else:
            assert set(got) <= set(rows)


def test_run(spark, folder):
    path, rows = folder
    root = checkpoint_root(spark).removeprefix("file:") + "/skywatch"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    out = corpus_pipeline.run(spark, path)
    left = set(os.listdir(root)) - before  # the folders of all steps but the last stage's result are gone
    assert len(left) == 1 and left.pop().startswith("stage-sentencepiece")
    got = out.select("doc_id", "text", "ids_", "n_tokens").collect()
    assert 0 < len(got) < len(rows)
    assert all((r.ids_ is None) == (r.text is None) and (r.n_tokens or 0) == len(r.ids_ or []) for r in got)
    assert {600, 601, 602} <= {r.doc_id for r in got}  # texts without words pass


def test_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = corpus.frame(spark, [], [*corpus.CLASHING, "lang"])
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    path = corpus.documents(spark, tmp_path, {"documents": docs, "labels": labels, "benchmark": bench, "embeddings": vectors})
    assert corpus_pipeline.run(spark, path).count() == 0
    for name, query in queries.QUERIES.items():
        assert query(spark, path).count() == 0, name
