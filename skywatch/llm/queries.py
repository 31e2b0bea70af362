"""The queries ``opN_<name>`` and their DuckDB SQL; each runs its operator over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywatch.llm.common import fold, table
from skywatch.llm.oracles import ORACLES  # noqa: F401  (the SQL of these queries)


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skywatch.llm.suffixes import remove_repeated_bytes

    done = remove_repeated_bytes(_documents(spark, sf_dir))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skywatch.llm.substrings import remove_repeats

    done = remove_repeats(_documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skywatch.llm.quality import RESULTS, with_quality

    return with_quality(_documents(spark, sf_dir)).select("doc_id", *RESULTS)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skywatch.llm.contamination import find_contamination

    found = find_contamination(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", ids, "contaminated")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skywatch.llm.jaccard import near_duplicates

    _, found = near_duplicates(_documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skywatch.llm import toxicity

    docs = _documents(spark, sf_dir)
    net = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0))
    scored = toxicity.score(docs, net)
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skywatch.llm.licenses import RESULTS, scan

    return scan(_documents(spark, sf_dir)).select("doc_id", *RESULTS)


def op5_context_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skywatch.llm.weighting import score

    docs = _documents(spark, sf_dir).withColumn("held_out", fold("doc_id", 10) == 0)
    return score(docs, "held_out").select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skywatch.llm import language

    docs = _documents(spark, sf_dir, "lang")
    training = language.fit(docs.filter(fold("doc_id", 4) != 2))
    return language.predict(docs.select("doc_id", "text"), training).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )


#: The vocabulary file; the environment may name another.
MODEL_FILE = os.environ.get("SKYWATCH_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skywatch.llm import pieces

    model = pieces.load_model(MODEL_FILE)
    coded = pieces.encode(_documents(spark, sf_dir), model, decoded_col="decoded")
    return coded.select(
        "doc_id", F.size(F.coalesce("ids", F.array().cast("array<int>"))).cast("long").alias("n_tokens"), "ids",
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skywatch.llm import infill

    made = infill.transform(_documents(spark, sf_dir))
    return made.select(
        "doc_id", F.col("n_units").alias("n"), "form",
        F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("fim", 256).alias("output_sha256"), F.sha2(infill.restore(F.col("fim"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skywatch.llm import vector_codes

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    coded, books = vector_codes.compress(vectors)
    digest = F.lit(books.sha256 if books is not None else None).cast("string")
    return coded.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


#: The tokenizer whose tokens are counted; the environment may name another.
TOKENIZER_FILE = os.environ.get("SKYWATCH_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skywatch.llm import token_counts

    counted = token_counts.count_tokens(_documents(spark, sf_dir), token_counts.load_tokenizer(TOKENIZER_FILE))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_license_scan,
        op3_language_id,
        op4_suffix_array_dedup,
        op5_context_tree_scoring,
        op6_quality_rules,
        op7_benchmark_decontamination,
        op8_ngram_jaccard_join,
        op9_substring_dedup,
        op10_toxicity,
        op11_fill_in_middle,
        op12_vector_codes,
        op13_token_counts,
    )
}
