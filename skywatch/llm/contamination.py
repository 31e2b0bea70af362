"""Operator 7: benchmark decontamination by winnowing, with Spark functions only.

A *window* is ``window`` consecutive words of a benchmark item (an item of fewer words is one
window). Every window of ``window`` words holds ``window - gram + 1`` hashed grams; keeping the
smallest of them for each window (winnowing) leaves about a quarter of all grams and still
guarantees that two texts that share a window share a kept gram. Training and test fingerprints are
joined on the hash; the places of the hits are extended to the windows around them, which are then
compared as text, so the result is exact.

Skew: fingerprints are distinct per document before the join, the item side is distinct, and items
are joined in only for verified windows. Benchmarks of any size work: whether the item side is
broadcast is left to Spark's own size check. Null or empty texts have no words and hit nothing; null
ids are kept apart by their text; rows that repeat get the same answer each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skywatch.llm.columns import PUNCTUATION, lower_ascii, or_empty, split_words
from skywatch.llm.common import discard, materialise, release

WINDOW = 10
GRAM = 5


def _words(text: Column) -> Column:
    return split_words(lower_ascii(or_empty(text)), PUNCTUATION)


def _grams(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order."""
    return F.when(
        F.size(words) >= size,
        F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size))),
    ).otherwise(F.array().cast("array<bigint>"))


def _winnowed(grams: Column, width: int) -> Column:
    """The smallest hash of every ``width`` neighbours, once each."""
    return F.when(
        F.size(grams) >= width,
        F.array_distinct(
            F.transform(F.sequence(F.lit(1), F.size(grams) - (width - 1)), lambda i: F.array_min(F.slice(grams, i, width)))
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """``item, size, phrase``: the distinct windows of each item."""
    words = benchmark.select(F.col(item_col).alias("item"), _words(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    size = F.least(F.lit(window), F.size("words"))
    places = words.select("item", "words", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)).alias("at"))
    return places.select("item", "size", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("phrase")).distinct()


def _key(id_col: str, text_col: str) -> list[Column]:
    """A row's key, its id and text: rows that agree in both share one answer."""
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("k"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("k2")]


def _search(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Every row's ``id, k, k2, n_words``, and ``k, k2, n_hit, items`` of those with a hit."""
    if not 1 <= gram <= window:
        raise ValueError("gram must be between 1 and window")
    width = window - gram + 1
    windows = materialise(item_windows(benchmark, window, item_col, item_text_col), "windows")
    # Lengths of items shorter than a window: fewer than `window` numbers.
    short = sorted(r["size"] for r in windows.filter(F.col("size") < window).select("size").distinct().collect())

    def probes(words: Column, grams: Column) -> Column:
        found = [_winnowed(grams, width), *(_grams(words, n) for n in short)]
        return F.array_distinct(F.concat(*found)) if short else found[0]

    phrase_words = F.split("phrase", " ")
    item_side = windows.select("size", phrase_words.alias("words"), _grams(phrase_words, gram).alias("grams")).select(
        F.explode(
            F.when(F.col("size") == window, _winnowed(F.col("grams"), width)).otherwise(F.array(F.xxhash64("words")))
        ).alias("probe")
    ).distinct()

    key = _key(id_col, text_col)
    marked = docs.select(F.col(id_col).alias("id"), *key, _words(F.col(text_col)).alias("words"))
    marked = marked.withColumn("grams", _grams(F.col("words"), gram))
    prints = materialise(
        marked.select("id", "k", "k2", F.size("words").cast("long").alias("n_words"), probes(F.col("words"), F.col("grams")).alias("probes")),
        "prints",
    )
    pairs = prints.select("k", "k2", F.explode("probes").alias("probe")).join(item_side, "probe", "left_semi")
    pairs = materialise(pairs, "probes")

    # Extend the hits: windows around them, compared as text. Rows without a hit are left out before
    # any text moves, by a join that Spark plans by the measured size of the keys.
    hit_rows = materialise(pairs.select("k", "k2").distinct(), "hit-rows")
    texts = docs.select(*key, F.col(text_col).alias("text")).join(hit_rows, ["k", "k2"], "left_semi")
    near = texts.dropDuplicates(["k", "k2"]).select("k", "k2", _words(F.col("text")).alias("words"))
    near = materialise(near, "texts")

    def places(size: int) -> DataFrame:
        """``k, k2, at`` of the runs of ``size`` words whose hash is a hit of their row."""
        runs = near.select("k", "k2", F.posexplode(_grams(F.col("words"), size)).alias("at", "probe"))
        return runs.join(pairs, ["k", "k2", "probe"], "left_semi").select("k", "k2", F.lit(size).alias("run"), "at")

    found = places(gram)
    for n in short:
        if n != gram:
            found = found.unionByName(places(n))
    found = found.groupBy("k", "k2").agg(F.collect_list(F.struct("run", "at")).alias("found"))

    def starts(size: int) -> Column:
        """The windows of ``size`` words around the hits: place, size and text."""
        last = F.size("words") - size
        run = gram if size == window else size
        at = F.transform(F.filter("found", lambda x: x["run"] == run), lambda x: x["at"])
        if size == window:
            around = F.transform(at, lambda i: F.sequence(F.greatest(i - (width - 1), F.lit(0)), F.greatest(F.least(i, last), F.lit(0))))
            at = F.array_distinct(F.flatten(around))
        return F.transform(
            F.filter(at, lambda i: i <= last),
            lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.array_join(F.slice("words", i + 1, size), " ").alias("phrase")),
        )

    # Phrases are cut out before the explode, so that no row carries its words along.
    tried = near.join(found, ["k", "k2"]).select("k", "k2", F.explode(F.concat(*(starts(n) for n in [window, *short]))).alias("w"))
    tried = tried.select("k", "k2", "w.*")
    whole = materialise(tried.join(windows.select("size", "phrase").distinct(), ["size", "phrase"], "left_semi"), "hits")
    for step in (pairs, hit_rows, near):
        discard(step)
    release(docs.sparkSession)

    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    spans = whole.groupBy("k", "k2").agg(F.array_sort(F.collect_list(F.struct("at", (F.col("at") + F.col("size")).alias("end")))).alias("s"))
    n_hit = F.aggregate(
        "s",
        begin,
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["at"]))).cast("long").alias("n"),
            F.greatest(a["end"], x["end"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    items = (
        whole.select("k", "k2", "size", "phrase").distinct()
        .join(windows, ["size", "phrase"])
        .select("k", "k2", F.col("item").cast("string").alias("item"))
        .distinct()
        .groupBy("k", "k2")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    found = spans.select("k", "k2", n_hit.alias("n_hit")).join(items, ["k", "k2"], "left")
    return prints.drop("probes"), found


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """One row for each row of ``docs``: ``id, n_words, n_hit, n_items, items, contaminated``.

    ``items`` are the ids of the items with an occurring window, sorted as strings.
    """
    rows, found = _search(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    none = F.array().cast("array<string>")
    return rows.join(found, ["k", "k2"], "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any hit, unchanged."""
    _, found = _search(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    row = docs.select(F.struct("*").alias("row"), *_key(id_col, text_col))
    return row.join(found.select("k", "k2"), ["k", "k2"], "left_anti").select("row.*")
