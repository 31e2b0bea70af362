"""Fill-in-middle, vector codes and token counts against brute force and the tokenizer's library."""

import hashlib
import json
import math
import os
import random

import numpy as np
import pytest

from skywatch.llm import infill, queries, token_counts, vector_codes
from skywatch.llm.common import text_bytes
from tests.llm import corpus

import pyarrow as pa

needs_tokenizer = pytest.mark.skipif(not os.path.exists(queries.TOKENIZER_FILE), reason="no vocabulary file here")


# -- 11: fill-in-middle -----------------------------------------------------------------------------------


def marked_texts():
    rows = corpus.texts()
    rows += [(800 + k, t) for k, t in enumerate(["a<P>b", "<S>", "x<M>", "<P", "S><P", "<", "é<", "日本", "\n", " ", "<PP>", "\\E.*", "😀" * 50])]
    return rows + [(900 + k, f"word{k} <S {k}> ünï") for k in range(60)]


def fill_in_middle(doc_id, text):
    t = text or ""
    n = len(t)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, corpus.sha(t), corpus.sha(t))
    prefix, middle, suffix = t[:a], t[a:b], t[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc_id, n, form, a, b - a, corpus.sha(out), corpus.sha(t))


@pytest.mark.parametrize("piece", [infill.PIECE_BYTES, 37])
def test_fill_in_middle(spark, tmp_path, monkeypatch, piece):
    rows = marked_texts()
    path = corpus.documents(spark, tmp_path, {"documents": corpus.frame(spark, rows, ["form", "fim", "_h1", "n"])})
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    if piece == infill.PIECE_BYTES:
        got = corpus.ordered(queries.op11_fill_in_middle(spark, path).collect(), columns)
        want = [fill_in_middle(i, t) for i, t in rows]
        assert got == sorted(want, key=repr)
        assert {w[2] for w in want} == {"plain", "psm", "spm"}
    else:  # texts in many pieces, as a very long one is
        monkeypatch.setattr(infill, "PIECE_BYTES", piece)
        texts = [t or "" for _, t in rows]
        raw, offsets = text_bytes(pa.array(texts))
        n = infill.count_units(raw, offsets, "char")
        assert n.tolist() == [len(t) for t in texts]
        first, second = n // 3, n - n // 4
        parts = infill.cut_three(raw, offsets, first, second, "char")
        want = [(t[:a], t[a:b], t[b:]) for t, a, b in zip(texts, first, second)]
        assert list(zip(*(p.to_pylist() for p in parts))) == want


@pytest.mark.parametrize("piece", [infill.PIECE_BYTES, 5])
@pytest.mark.parametrize("unit", ["word", "line"])
def test_units_of_words_and_lines(monkeypatch, unit, piece):
    monkeypatch.setattr(infill, "PIECE_BYTES", piece)
    texts = ["a b", "", " \n lead", "one\ntwo\n\nthree\n", "\n", "no end", "é ü\tñ", "x" * 30 + " y"]
    raw, offsets = text_bytes(pa.array(texts))
    pattern = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+" if unit == "word" else r"[^\n]*\n|[^\n]+"
    import re

    units = [re.findall(pattern, t) for t in texts]
    assert infill.count_units(raw, offsets, unit).tolist() == [len(u) for u in units]
    n = np.array([len(u) for u in units])
    parts = infill.cut_three(raw, offsets, n // 2, (n + 1) // 2, unit)
    want = [("".join(u[: len(u) // 2]), "".join(u[len(u) // 2 : (len(u) + 1) // 2]), "".join(u[(len(u) + 1) // 2 :])) for u in units]
    assert list(zip(*(p.to_pylist() for p in parts))) == want


def test_fill_in_middle_interface(spark):
    docs = corpus.frame(spark, marked_texts(), ["form", "fim"])
    made = infill.transform(docs, unit="line", seed=7, fim_percent=100, spm_percent=50, marks=("[pre]", "[suf]", "[mid]"))
    assert made.columns == [*docs.columns, "n_units", "form_", "prefix_units", "middle_units", "fim_"]
    back = made.select("text", infill.restore(made["fim_"], made["form_"], ("[pre]", "[suf]", "[mid]")).alias("back")).collect()
    assert all((r.text or "") == r.back for r in back)
    assert infill.transform(corpus.frame(spark, [])).count() == 0
    for marks in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("", "a", "b"), ("ab", "bc", "x")):
        with pytest.raises(ValueError):
            infill.transform(docs, marks=marks)
    with pytest.raises(ValueError):
        infill.transform(docs, unit="page")


# -- 12: vector codes -----------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, code string"


def vector_rows(seed=4, n=400, width=32):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.4) for _ in range(width)] for _ in range(20)]
    rows = []
    for k in range(n):
        c = rng.choice(centres)
        label = None if k % 11 == 0 else 7 if k % 3 == 0 else rng.randrange(5)
        rows.append(((k * 37) % 1009 - 30, [x + rng.gauss(0, 0.05) for x in c], label, "x"))
    rows += [(5000 + k, rows[3][1], 7, "x") for k in range(150)]  # copies
    rows += [(rows[0][0], rows[9][1], 1, "x"), (None, rows[5][1], None, "x"), rows[8], rows[8]]
    rows += [(6000, None, 1, "x"), (-100, [None] * width, 1, "x"), (6001, [math.nan] + [0.0] * (width - 1), 1, "x")]
    rows += [(6002, [math.inf] + [0.0] * (width - 1), 1, "x"), (6003, [0.0] * (width + 1), 1, "x"), (6004, [], 2, "x")]
    rows += [(6005, [1e30] + [0.0] * (width - 1), 9, "x"), (6006, [3e6] + [0.25] * (width - 1), 3, "x")]
    return rows


def vector_codes_of(rows, parts=16, entries=64, rounds=2):
    kept = [
        (i, np.float32(v).astype(float).tolist(), g)
        for i, v, g, _ in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted((i is None, i or 0, v) for i, v, _ in kept if v and all(abs(x) < 2**22 for x in v))
    length = len(order[0][2])
    width = length // parts

    def able(v):
        return len(v) == length and all(abs(x) < 2**22 for x in v)

    def cut(v):
        q = [math.floor(256 * x) for x in v]
        return [q[p * width : (p + 1) * width] for p in range(parts)]

    first = [cut(v) for _, _, v in order if len(v) == length][:entries]
    books = [[f[p] for f in first] for p in range(parts)]
    vectors = [cut(v) if able(v) else None for _, v, _ in kept]

    def assign():
        out = []
        for v in vectors:
            if v is None:
                out.append(None)
                continue
            out.append([min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p])) for p, x in enumerate(v)])
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            groups = {}
            for v, f in zip(vectors, found):
                if v is not None:
                    groups.setdefault(f[p][1], []).append(v[p])
            for k, members in groups.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    found = assign()
    sha = corpus.sha(",".join(str(x) for b in books for e in b for x in e))
    error = [None if f is None else sum(d for d, _ in f) for f in found]
    groups = {}
    for (_, _, g), e in zip(kept, error):
        if e is not None:
            groups[g] = groups.get(g, 0) + e
    return [
        (i, None if f is None else "".join(f"{k:02x}" for _, k in f), e, groups.get(g), sha)
        for (i, _, g), f, e in zip(kept, found, error)
    ]


def test_vector_codes(spark, tmp_path):
    rows = vector_rows()
    path = corpus.documents(spark, tmp_path, {"embeddings": spark.createDataFrame(rows, VECTORS).repartition(5)})
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = corpus.ordered(queries.op12_vector_codes(spark, path).collect(), columns)
    assert got == sorted(vector_codes_of(rows), key=repr)


def test_vector_codes_of_few_and_no_vectors(spark, tmp_path):
    few = vector_rows()[:3]
    path = corpus.documents(spark, tmp_path / "few", {"embeddings": spark.createDataFrame(few, VECTORS)})
    got = queries.op12_vector_codes(spark, path).collect()
    assert sorted(tuple(r) for r in got) == sorted(vector_codes_of(few))
    assert {r.error for r in got} == {0}
    for name, rows in (("none", []), ("bad", [(1, None, 1, "x"), (2, [math.nan], 1, "x")])):
        path = corpus.documents(spark, tmp_path / name, {"embeddings": spark.createDataFrame(rows, VECTORS)})
        assert queries.op12_vector_codes(spark, path).count() == 0
    path = corpus.documents(spark, tmp_path / "empty", {"embeddings": spark.createDataFrame([(1, [], 1, "x")], VECTORS)})
    assert [tuple(r) for r in queries.op12_vector_codes(spark, path).collect()] == [(1, None, None, None, None)]


@pytest.mark.parametrize("width", [1, 3, 4, 7, 8])
@pytest.mark.parametrize("top", [2, 300, 1 << 29])
def test_elimination_finds_the_nearest_entry(width, top):
    rng = np.random.default_rng(width * 31 + top % 7)
    x, e = rng.integers(-top, top, (200, width)), rng.integers(-top, top, (64, width))
    e[40:] = e[:24]  # ties
    x[:30] = e[:30]
    entry, distance = vector_codes.nearest(x, e)
    every = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in e] for p in x]
    assert [int(d) for d in distance] == [min(d) for d in every]
    assert entry.tolist() == [d.index(min(d)) for d in every]


def test_transform_keeps_distances_and_sequency_order():
    eye = vector_codes.transformed(np.eye(8, dtype=np.int64))
    changes = (eye.T[:, 1:] != eye.T[:, :-1]).sum(axis=1)
    assert changes.tolist() == list(range(8))
    assert (eye @ eye.T == 8 * np.eye(8)).all()


def test_vector_codes_interface(spark):
    """Other parts, a length that they do not divide, and clashing names."""
    rows = [(k, [float((k * 7 + j * j) % 5) for j in range(10)], k % 2, "x") for k in range(50)]
    df = spark.createDataFrame(rows, VECTORS)
    coded, books = vector_codes.compress(df, parts=4, entries=8, rounds=1)
    assert coded.columns == ["vec_id", "label", "code", "code_", "error", "label_error"]
    got = coded.collect()
    assert books.entries.shape == (4, 8, 3) and all(len(r.code_) == 8 for r in got)
    assert sum(r.error for r in got) == sum({r.label: r.label_error for r in got}.values())


# -- 13: token counts -----------------------------------------------------------------------------------

ODD = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\t", " ", "　", "a", "é", "日", "1", "٣", "!", "'s", "<|endoftext|>"]
ODD += ["<|endof", "😀", "x", "\r\n", "́", "_", "²", "՘", "࢏", "\U000323b0", "\x00", "\x1c", "\x85", "​", "﻿"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.TOKENIZER_FILE)


@pytest.fixture(scope="module")
def counter():
    source = token_counts.load_tokenizer(queries.TOKENIZER_FILE)
    runs = token_counts.class_runs()
    return token_counts.Worker(source, runs, token_counts.frequent_lengths(source, runs, ["ein Text mit über hundert Wörtern 's"]))


@needs_tokenizer
@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_token_counts_of_odd_texts(counter, monkeypatch, piece):
    monkeypatch.setattr(token_counts, "PIECE_BYTES", piece)
    rng = random.Random(piece)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ["".join(rng.choice(ODD) for _ in range(3000)) for _ in range(5)]
    got = counter.count(*text_bytes(pa.array(texts)))
    want = [len(e.ids) for e in library().encode_batch(texts, add_special_tokens=False)]
    assert got.tolist() == want


@needs_tokenizer
def test_classes_are_those_of_the_library():
    table = token_counts.class_table(token_counts.class_runs())
    cut = library().pre_tokenizer
    some = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 29 == 0)]
    for probe, kind in (("a", token_counts.LETTER), ("1", token_counts.NUMBER), ("!", token_counts.OTHER)):
        whole = {s for _, (s, e) in cut.pre_tokenize_str("\n".join(probe + chr(c) + probe for c in some)) if e - s == 3}
        assert [4 * k in whole for k in range(len(some))] == [table[c] == kind for c in some]


@needs_tokenizer
def test_cache_is_emptied_and_counts_stay(counter, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 50)
    counter.cache = token_counts.Lengths(50)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdeéz") for _ in range(9)) for _ in range(rng.choice([3, 30, 90]))) for _ in range(60)]
    want = [len(e.ids) for e in library().encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [int(counter.count(*text_bytes(pa.array([t])))[0]) for t in texts] == want
    assert counter.cache.used <= 50


def test_hash_table_of_lengths():
    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate([rng.integers(1, 1 << 63, 3000).astype(np.uint64), np.arange(1, 2000, dtype=np.uint64)]))
    table = token_counts.Lengths(len(keys))
    table.add(keys[::2], np.arange(len(keys[::2])))
    value, missing = table.get(keys)
    assert missing[1::2].all() and not missing[::2].any()
    assert (value[::2] == np.arange(len(keys[::2]))).all()


@needs_tokenizer
def test_token_counts_query(spark, tmp_path):
    rows = corpus.texts() + [(900, "<|endoftext|> a<|endoftext|><|endoftext|>"), (901, "don't 'tis we'll I'M"), (902, "日本語" * 40000), (903, "ab " * 60000)]
    path = corpus.documents(spark, tmp_path, {"documents": corpus.frame(spark, rows, ["n_bytes", "n_tokens"])})
    made = library()
    want = []
    for i, t in rows:
        n = len(made.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    got = queries.op13_token_counts(spark, path).collect()
    assert corpus.ordered(got, ["doc_id", "n_bytes", "n_tokens", "over_limit"]) == sorted(want, key=repr)
    source = token_counts.load_tokenizer(queries.TOKENIZER_FILE)
    docs = corpus.frame(spark, rows, ["n_tokens"])
    assert token_counts.count_tokens(docs, source).columns == [*docs.columns, "n_tokens_"]
    assert token_counts.count_tokens(corpus.frame(spark, []), source).count() == 0


@needs_tokenizer
def test_tokenizers_without_fixed_pretokens_are_refused():
    source = json.loads(token_counts.load_tokenizer(queries.TOKENIZER_FILE))
    token = source["added_tokens"][0]
    for change in (
        {"normalizer": {"type": "NFC"}},
        {"pre_tokenizer": {"type": "Whitespace"}},
        {"pre_tokenizer": source["pre_tokenizer"] | {"add_prefix_space": True}},
        {"added_tokens": [token | {"lstrip": True}]},
        {"model": source["model"] | {"dropout": 0.1}},
    ):
        with pytest.raises(ValueError):
            token_counts.added_tokens(json.dumps(source | change))
