"""Cleaning a training corpus: language, quality, near duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, folder) and returns what it keeps of docs, with
the columns of docs; the last returns token ids instead. A stage's models are
learned from its own input and the tables in the folder. Null and empty texts
are rejected by the first stage, as they have no letter. Rows without an id are
kept until they are rejected for their text. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm import decontaminate, language, ngram_join, pieces, quality
from storelens.llm.common import held_out, read
from storelens.llm.registry import tokenizer_path
from storelens.operators.checkpoints import written

# A text is rejected when no language is this likely.
LEAST_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents without a letter and those whose language stays open."""
    model = language.fit(docs.where(~held_out()))
    found = language.predict(docs, model, docs.columns, names=("_lang_pred", "_lang_score"))
    kept = (F.col("_lang_pred") != language.UNDETERMINED) & (F.col("_lang_score") >= LEAST_LANGUAGE_SCORE)
    return found.where(kept).select(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents whose lines are more likely bad, at the operator's threshold."""
    field = quality.fit(docs.where(~held_out()), read(spark, folder, "labels"))
    scored = quality.score(docs, field, docs.columns, name="_quality_score")
    return scored.where(F.col("_quality_score") >= quality.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps the smallest id of every group of documents linked by 5-word shingles at 0.8."""
    return ngram_join.one_of_each(docs, ngram_join.Rule(words=5, num=80, den=100))


def benchmark_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents that hold a benchmark window."""
    return decontaminate.decontaminated(docs, read(spark, folder, "benchmark"), remove="documents")


def token_ids(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, number of tokens and digests of ids and decoded text."""
    model = pieces.model_bytes(tokenizer_path("piece_bpe_32k.model"))
    return pieces.digests(pieces.encode(docs, model, ["doc_id"]))


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("pieces", token_ids),
]

# Learned models and piece encoding are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written as Parquet below the shared checkpoint folder and read again."""
    docs = read(spark, folder, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if number < len(STAGES) - 1:
            docs = written(docs)
    return docs
