"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embedding_dedup, filter_audit, fingerprint, html_crf, importance, line_dedup, minhash_dedup, mixing
from . import packing, quality, token_counts, toxicity
from .common import fold, table

MARKER_CASE = "\\### Assistant: </turn> ok"


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    text = html_crf.extractor(html_crf.fit(pages))
    return pages.select("page_id", "url", text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return rows.select(
        "row.doc_id", "line.n_lines", "line.n_dropped", line_dedup.kept_sha256().alias("kept_sha256"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKER_CASE).alias("text"))
    out = chat.format_conversations(talks.unionByName(extra))
    loss = chat.loss_text(F.col("segments"))
    turns = F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.withColumns({"loss": loss, "turns": turns}).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", "bad_turn")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return minhash_dedup.mark(docs, ["doc_id"]).select("row.doc_id", "representative", "kept")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprint.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    own, edited = F.col("sketch"), F.col("edited_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.as_text(own).alias("fingerprint"), fingerprint.as_text(edited).alias("edited_fingerprint"),
        fingerprint.resemblance(own, edited).alias("near_edited"),
        fingerprint.resemblance(own, F.col("next_sketch")).alias("near_next"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).filter(fold("doc_id", 5) != 0)
    score = toxicity.scorer(toxicity.fit(docs, labels))
    return docs.select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), score("text").alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.place(docs).select(
        "row.doc_id", "row.source", "block", "in_block", "slot", "release", "deadline")


QUALITY_CUT = 0.7


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    """Fitted on the labelled rows of ``docs`` outside the held-out fold."""
    labels = quality.quality_labels(table(spark, sf_dir, "labels"), fold("doc_id", 4) == 2)
    return quality.fit(docs.select("doc_id", "text"), labels)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = quality.scorer(quality_model(spark, docs, sf_dir))
    return docs.select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), score("text").alias("score"),
    ).withColumn("predicted", (F.col("score") >= QUALITY_CUT).cast("int"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, table(spark, sf_dir, "benchmark").select("text"))


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_fingerprints": op6_fingerprints,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
    "op11_token_counts": op11_token_counts,
    "op12_filter_audit": op12_filter_audit,
    "op13_importance": op13_importance,
}
