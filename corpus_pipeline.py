"""The corpus pipeline: quality filter, line dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes
each stage's result as Parquet in the shared folder and gives the next stage what
it reads back, so a lost executor never costs more than the stage at hand.

All stages take null columns, empty texts, repeated rows, empty tables and extra
columns as their operators document; every stage but the last returns the columns
it was given, the last one the pieces of training sequences.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from eventide.llm import line_dedup, minhash_dedup, mixing, packing, quality
from eventide.llm.common import land, table
from eventide.llm.queries import QUALITY_CUT, quality_model

# Classifiers and packing have no SQL twin; the pipeline is tested stage by stage
# against brute force instead.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality score reaches the cut."""
    score = quality.scorer(quality_model(spark, docs, sf_dir))
    return docs.filter(score("text") >= QUALITY_CUT)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that an earlier document holds; documents stay, if need be empty."""
    return line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return minhash_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lays the documents out in mix order."""
    return mixing.in_order(mixing.place(docs), docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, numbered in the order in which the files hold the documents.

    The mixing stage wrote them in mix order, and sequences are numbered by file and place.
    Documents that are not rows of files have no such order: their places are found here.
    """
    try:
        docs.select("_metadata.file_path").schema
    except AnalysisException:
        placed = mixing.place(docs.select("doc_id", "source", "text"))
        return packing.pack(mixing.in_order(placed, ["doc_id", "text"]))
    return packing.pack_files(docs)


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
