"""Small helpers of the training-data operators."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, scratch_dir

# Stands for a missing id wherever ids are ordered: it comes after all others.
NO_ID = (1 << 63) - 1


def land(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and return it read back.

    Later jobs restart from the files, so a lost executor costs a reread only.
    """
    path = scratch_dir(df.sparkSession, f"llm-{label}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.landed = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete what ``land`` wrote for frames that nothing reads any more."""
    for df in frames:
        discard(df.sparkSession, df.landed)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def order_id(column: str = "doc_id") -> Column:
    """The id as a number; one that is none counts as missing."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(parts))


def per_worker(key: object, make: Callable):
    """``make()``, once per Python worker process: later tasks of the worker find it again.

    Functions travel by value, so their modules' globals do not outlive a task.
    """
    shelf = sys.modules.setdefault("_worker_shelf", ModuleType("_worker_shelf")).__dict__
    if key not in shelf:
        shelf[key] = make()
    return shelf[key]


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of ``edges (a, b)``: ``node, component`` with the smallest node id.

    Alternating large-star and small-star steps; every step is written to the shared
    folder, and a hot node's edges meet its one minimum in a plain join that AQE can split.
    Nodes without an edge do not appear.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    pairs = land(pairs, f"{label}-edges")
    seen = _digest(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = land(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{label}-least")
        large = land(both.filter("v > u").join(first, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .distinct(), f"{label}-large")
        least = land(large.groupBy("u").agg(F.min("v").alias("m")), f"{label}-least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        small = land(small, f"{label}-small")
        drop(pairs, large, first, least)
        pairs = small
        now = _digest(pairs)
        if now == seen:
            break
        seen = now
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _digest(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
