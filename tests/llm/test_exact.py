"""Operators with an exact answer against brute force, on awkward rows and on the test tables."""

import hashlib

import numpy as np
import pytest

from skywatch.llm import contamination, jaccard, quality, queries, substrings, suffixes
from tests.llm import corpus

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = corpus.texts()
    items = [(1, rows[0][1]), (2, " ".join(rows[8][1].split()[2:30])), (3, rows[50][1]), (4, "la1"), (5, ""), (6, None), (7, "the3 of4 xi5")]
    items += [(8, rows[8][1].upper()), (9, rows[8][1])]
    path = tmp_path_factory.mktemp("corpus")
    docs = corpus.frame(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    corpus.documents(spark, path, {"documents": docs, "benchmark": bench})
    return str(path), rows, items


@pytest.fixture(scope="module")
def table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    return SF, [tuple(r) for r in docs], [tuple(r) for r in items]


@pytest.fixture(params=["folder", "table"])
def data(request):
    return request.getfixturevalue(request.param)


def check(df, columns, want):
    got = corpus.ordered(df.select(*columns).collect(), columns)
    assert got == sorted(want, key=repr)


def test_substring_dedup(spark, data):
    path, rows, _ = data
    check(queries.op9_substring_dedup(spark, path), ["doc_id", "n_words", "n_removed", "kept_sha256"], corpus.repeated_words(rows))


def test_suffix_array_dedup(spark, data):
    path, rows, _ = data
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    check(queries.op4_suffix_array_dedup(spark, path), columns, corpus.repeated_bytes(rows))


def test_quality_rules(spark, data):
    path, rows, _ = data
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    df = queries.op6_quality_rules(spark, path)
    check(df, columns, [(i, *corpus.quality(t)) for i, t in rows])
    assert not df.filter("base_failed and kept").count()


def test_decontamination(spark, data):
    path, rows, items = data
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    check(queries.op7_benchmark_decontamination(spark, path), columns, corpus.contamination(rows, items))


def test_very_long_texts_full_of_hits(spark, tmp_path):
    """A text of 20,000 different hit words, and one of 400,000 equal ones."""
    item = [f"w{k}" for k in range(20_000)]
    rows = [(1, "x " + " ".join(item) + " y"), (2, "same " * 400_000), (3, " ".join(item[:9])), (4, "w1 w2 other")]
    items = [(7, " ".join(item)), (8, "same " * 12), (9, "w1 w2")]
    path = corpus.documents(
        spark, tmp_path, {"documents": corpus.frame(spark, rows, []), "benchmark": spark.createDataFrame(items, "item_id long, text string")}
    )
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"]
    got = corpus.ordered(queries.op7_benchmark_decontamination(spark, path).collect(), columns)
    want = [(1, 20_002, 20_000, 2, corpus.sha("7,9")), (2, 400_000, 400_000, 1, corpus.sha("8")), (3, 9, 2, 1, corpus.sha("9"))]
    assert got == [*want, (4, 3, 2, 1, corpus.sha("9"))]


def test_jaccard_join(spark, data):
    path, rows, _ = data
    check(queries.op8_ngram_jaccard_join(spark, path), ["doc_id", "n_shingles", "component_id"], corpus.classes(rows))


def test_empty_tables(spark, tmp_path):
    docs = corpus.frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    path = corpus.documents(spark, tmp_path, {"documents": docs, "benchmark": bench})
    for name in ("op4_suffix_array_dedup", "op6_quality_rules", "op7_benchmark_decontamination", "op8_ngram_jaccard_join", "op9_substring_dedup"):
        assert queries.QUERIES[name](spark, path).count() == 0, name


def test_empty_benchmark(spark, tmp_path):
    path = corpus.documents(
        spark, tmp_path, {"documents": corpus.frame(spark, [(1, "a b c")]), "benchmark": spark.createDataFrame([], "item_id long, text string")}
    )
    assert [tuple(r)[:4] for r in queries.op7_benchmark_decontamination(spark, path).collect()] == [(1, 3, 0, 0)]


def test_other_columns_pass_through(spark):
    rows = corpus.texts()
    docs = corpus.frame(spark, rows)
    bench = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    cut = substrings.remove_repeats(docs)
    assert cut.columns == [*docs.columns, "n_words_", "n_removed_"]
    left = suffixes.remove_repeated_bytes(docs)
    assert left.columns[: len(docs.columns) - 1] == [c for c in docs.columns if c != "text"]
    judged = quality.with_quality(docs)
    assert judged.columns[: len(docs.columns)] == docs.columns
    kept = jaccard.keep_first(docs)
    clean = contamination.drop_contaminated(docs, bench)
    extra = corpus.CLASHING
    want = {tuple(f"x{k}" for k in range(len(extra)))}
    for df in (cut, left, judged, kept, clean):
        assert {tuple(r) for r in df.select(*extra).distinct().collect()} == want
    assert kept.schema == docs.schema and clean.schema == docs.schema


def test_keep_first_keeps_one_of_each_class(spark):
    rows = corpus.texts()
    kept = [tuple(r) for r in jaccard.keep_first(corpus.frame(spark, rows)).select("doc_id", "text").collect()]
    want = corpus.classes(rows)
    some = {c for _, n, c in want if n}
    empty = [i for i, n, _ in want if not n]
    assert len(kept) == len(some) + len(empty)
    assert {i for i, t in kept if corpus.words(t)} == some


def test_repeat_levels_double_until_none_is_left(spark):
    base = [f"w{k}" for k in range(70)]
    rows = [(1, " ".join(base)), (2, "x " + " ".join(base[:60]) + " y"), (3, "alone")]
    found = substrings.repeat_levels(corpus.frame(spark, rows))
    got = corpus.ordered(found.collect(), ["doc_id", "length", "n_windows"])
    assert got == sorted([(i, n, 60 - n + 1) for i in (1, 2) for n in (13, 26, 52)], key=repr)


@pytest.mark.parametrize("window", [1, 2, 3, 9, 13, 20])
def test_removal_walks_the_levels_up_to_any_window(spark, window):
    rows = corpus.texts()
    got = substrings.remove_repeats(corpus.frame(spark, rows, []), window).collect()
    want = [(i, n, m) for i, n, m, _ in corpus.repeated_words(rows, window)]
    assert corpus.ordered(got, ["doc_id", "n_words", "n_removed"]) == sorted(want, key=repr)
    lengths = substrings._up_to(window)
    assert lengths[-1] == window and len(lengths) > 1 and all(b <= 2 * a for a, b in zip(lengths, lengths[1:]))


def test_removal_without_candidates_ends_early(spark):
    rows = [(k, " ".join(f"{k}-{j}" for j in range(30))) for k in range(5)]
    got = substrings.remove_repeats(corpus.frame(spark, rows, [])).collect()
    assert all((r.n_words, r.n_removed, r.text) == (30, 0, rows[r.doc_id][1]) for r in got)


@pytest.mark.parametrize("kind", ["random", "runs", "one", "empty", "words"])
def test_suffix_array_order(kind):
    rng = np.random.default_rng(5)
    text = {
        "random": rng.integers(0, 4, 3000),
        "runs": np.repeat(rng.integers(0, 3, 100), rng.integers(1, 40, 100)),
        "one": np.full(500, 7),
        "empty": np.zeros(0),
        "words": np.frombuffer(b"mississippi banana " * 30, np.uint8),
    }[kind].astype(np.uint8)
    data = text.tobytes()
    order = suffixes.suffix_array(text, 64)
    assert sorted(order.tolist()) == list(range(len(data)))
    cut = [data[i : i + 64] for i in order]
    assert cut == sorted(cut)
    same = suffixes.adjacent_prefixes(text, order, 50)
    want = [len(a) >= 50 and len(b) >= 50 and a[:50] == b[:50] for a, b in zip(cut, cut[1:])]
    assert same.tolist() == want


def test_sketch_distance_is_a_lower_bound():
    """Differing blocks never outnumber the symmetric difference of the sets."""
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = [f"w{x}" for x in rng.integers(0, 400, 120)]
        b = list(a)
        for k in rng.integers(0, len(b), rng.integers(0, 30)):
            b[k] = f"v{k}"
        raw = np.frombuffer((" ".join(a) + " ".join(b)).encode(), np.uint8)
        offsets = np.array([0, len(" ".join(a)), len(raw)])
        sets = jaccard.ShingleSets(raw, offsets)
        one, two = (set(sets.hash[sets.first[k] : sets.first[k + 1]].tolist()) for k in (0, 1))
        sketch = jaccard.Sketches(sets, np.array([0, 1]), 3, 4)
        keys = [[set(sketch.key[sketch.entry == e].tolist()) for e in np.flatnonzero(sketch.who == k)] for k in (0, 1)]
        if [int(np.log2(len(x))) for x in (one, two)] == [6, 6]:  # one band: the first sketch of each
            assert max(len(keys[0][0] - keys[1][0]), len(keys[1][0] - keys[0][0])) <= len(one ^ two)


def test_hot_groups_and_hot_passages(spark):
    """Hundreds of near copies and a line in a third of all texts: classes are still exact."""
    rng = np.random.default_rng(4)
    line = "released under the terms of a well known line that many texts share"
    rows = []
    for k in range(200):
        rows.append((k, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 20)) + (" " + line if k % 3 == 0 else "")))
    base = [f"c{x}" for x in range(150)]
    for k in range(150):
        w = list(base)
        w[int(rng.integers(0, 150))] = f"m{k}"
        rows.append((1000 + k, " ".join(w)))
    found = jaccard.near_duplicates(corpus.frame(spark, rows))[1]
    got = corpus.ordered(found.collect(), ["id", "n_shingles", "component"])
    assert got == sorted(corpus.classes(rows), key=repr)


def test_a_frequent_line_brings_no_large_group_of_fragments(spark, monkeypatch):
    """A line in every text, with other neighbours each time, and some longer passages: no shard gets them all."""
    rng = np.random.default_rng(6)
    line = "a long line that every text of all has in it"
    passage = f"a longer passage with it: {line}, of some texts"
    rows = []
    for k in range(6000):
        a, b = ("".join(chr(x) for x in rng.integers(97, 123, 40)) for _ in range(2))
        rows.append((k, a + (passage if k % 50 == 0 else line) + b))
    asked = []

    def kept(df, tag, write=suffixes.materialise):
        out = write(df, tag)
        if tag == "fragments":
            asked.append(out)
        return out

    monkeypatch.setattr(suffixes, "materialise", kept)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    check(suffixes.remove_repeated_bytes(corpus.frame(spark, rows, [])), columns, corpus.repeated_bytes(rows))
    met = {}
    for r in asked[0].filter("shard >= 0").collect():
        n = int(np.frombuffer(r.body[:8], np.int64)[0])
        met[r.shard] = met.get(r.shard, 0) + max(n, 0)
    assert max(met.values(), default=0) <= 4096, max(met.values())


@pytest.mark.parametrize("hot", [0, 3])
def test_windows_of_hot_anchors_are_all_looked_up(spark, data, hot):
    _, rows, _ = data
    docs = corpus.frame(spark, rows, [])
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    check(suffixes.remove_repeated_bytes(docs, hot=hot), columns, corpus.repeated_bytes(rows))


def test_hash_is_of_the_kept_bytes(spark):
    done = suffixes.remove_repeated_bytes(corpus.frame(spark, corpus.texts(), []))
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in done.collect())
