"""The training-data pipeline: stages over ``documents``, each calling one corpus operator.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame, which is written as Parquet and read back as the next stage's ``docs``. All stages but
the last return the columns they were given, and each works on all rows that the stage before kept.
Null and empty texts pass every stage, as do extra columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywatch.llm import contamination, jaccard, pieces, substrings, toxicity
from skywatch.llm.common import discard, fold, materialise, passing_steps, release, spare_name, table
from skywatch.llm.queries import MODEL_FILE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores 0.5 or more go."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0))
    score = spare_name("score", docs.columns)
    return toxicity.score(docs, net, score_col=score).filter(F.col(score) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return jaccard.keep_first(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that a document with a smaller id holds are cut out.

    A document that loses words keeps the rest joined by single spaces, and its ``n_chars`` follows;
    all others keep their text as it was.
    """
    text = spare_name("text_before", docs.columns)
    marked = docs.withColumn(text, F.col("text"))
    cut = substrings.remove_repeats(marked)
    removed = cut.columns[-1]
    kept = F.when(F.col(removed) > 0, F.col("text")).otherwise(F.col(text))
    columns = {"text": kept}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col(removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
    return cut.select(*(columns.get(c, F.col(c)).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the SentencePiece ids of each text, and their number."""
    ids, count = spare_name("ids", docs.columns), spare_name("n_tokens", docs.columns)
    return pieces.encode(docs, pieces.load_model(MODEL_FILE), ids_col=ids).withColumn(
        count, F.when(F.col(ids).isNotNull(), F.size(ids)).cast("long")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: Scores of a trained model, a tokenizer and transitive links: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table.

    Once a stage's rows are durable, the folders of its steps and of the stage before go.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with passing_steps() as steps:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
            steps[:] = [step for step in steps if step is not docs]
        if before is not None:
            discard(before)
        before = docs
        release(spark)
    return docs
