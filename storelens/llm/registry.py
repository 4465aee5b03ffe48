"""The operators as queries over whole tables, with the parameters of their contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm import caps, centroids, chat, decontaminate, exact, html_region, importance, language, licences, ngram_join, pieces, quality, url_rules
from storelens.llm.common import held_out, read
from storelens.llm.registry_sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return ngram_join.similar_groups(docs, ngram_join.Rule(words=3, num=90, den=100))


def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages").select("page_id", "url", "html")
    found = html_region.extract(pages, html_region.fit(pages), ["page_id", "url"])
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~held_out()))
    found = language.predict(docs, model, ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    labels = read(spark, folder, "labels").select("doc_id", "quality")
    field = quality.fit(docs.where(~held_out()), labels)
    scored = quality.score(docs, field, ["doc_id"])
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"))


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find_hits(docs, read(spark, folder, "benchmark"), ["doc_id"])
    return decontaminate.report(found)


def op6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = pieces.model_bytes(tokenizer_path("piece_bpe_32k.model"))
    return pieces.digests(pieces.encode(docs, model, ["doc_id"]))


def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one that looks like control strings of templates."""
    known = read(spark, folder, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    messages = known.union(odd).withColumn("parts", chat.text_part(F.col("text")))
    return chat.digests(chat.formatted(messages))


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every url is labelled by the listed rules: blocked where one blocks it, else not.

    The rows of `labels` are of documents; a page's number says nothing about them. Every token of a url is mined.
    """
    pages = read(spark, folder, "pages").select("page_id", "url")
    rules = url_rules.mine(url_rules.listed_labels(pages), whole=True)
    return url_rules.judged(pages, rules, ["page_id"]).select("page_id", "host", "path", "rule", "verdict")


def op9_vector_caps(spark: SparkSession, folder: str) -> DataFrame:
    return caps.near_duplicates(read(spark, folder, "embeddings").select("vec_id", "embedding"))


def op10_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(read(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])


def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return importance.resample(docs, read(spark, folder, "benchmark"))


def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.clusters(read(spark, folder, "embeddings").select("vec_id", "embedding"))


def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.duplicates(read(spark, folder, "documents").select("doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_join, op2_html_text, op3_language_id, op4_quality, op5_decontaminate,
        op6_pieces, op7_chat, op8_url_filter, op9_vector_caps, op10_licence_scan,
        op11_importance, op12_centroids, op13_exact_dedup,
    )
}
