"""Mergeable sketches of the telemetry: kept per small window, merged to any larger one.

A table of sketches is built in one pass over the events and stored; dashboards of any
window read it instead of the events. Sketches merge in any order, so the rows of a
window may be made by different tasks, loads or days.

Error bounds
- quantiles (KLL, ``k`` items): a value's rank differs from the one asked for by at most
  ``rank_error(k)`` of the rows, with 99 % confidence.
- distinct counts (HyperLogLog, ``2 ** lg`` registers): the relative standard error is
  ``1.04 / sqrt(2 ** lg)``; theta sketches of ``2 ** lg`` entries have ``1 / sqrt(2 ** lg - 1)``, and
  are exact below that many items. A set difference errs by the error of the union.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KLL_ITEMS = 800
LG_REGISTERS = 12
LG_ENTRIES = 14


def rank_error(k: int = KLL_ITEMS) -> float:
    """Normalised rank error of a KLL sketch of ``k`` items (99 % confidence)."""
    return 2.296 / k ** 0.9021


def distinct_error(lg: int = LG_REGISTERS) -> float:
    return 1.04 / math.sqrt(2 ** lg)


def theta_error(lg: int = LG_ENTRIES) -> float:
    return 1 / math.sqrt(2 ** lg - 1)


# --- quantiles --------------------------------------------------------------
def quantile_sketches(events: DataFrame, by: list[str], value: str, ts: str = "ts", window: str = "5 minutes",
                      k: int = KLL_ITEMS) -> DataFrame:
    """``by, window_start, rows, sketch``: one quantile sketch of ``value`` per key and window."""
    start = F.window(F.col(ts), window)["start"].alias("window_start")
    present = events.filter(F.col(value).isNotNull())
    return present.groupBy(*by, start).agg(
        F.count(F.lit(1)).alias("rows"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merge_quantiles(sketches: DataFrame, by: list[str], window: str, quantiles: dict[str, float], k: int = KLL_ITEMS) -> DataFrame:
    """Quantiles of longer windows, from stored sketches alone. Windows must be multiples of the stored ones."""
    span = F.window("window_start", window)
    merged = sketches.groupBy(*by, span["start"].alias("window_start"), span["end"].alias("window_end")).agg(
        F.sum("rows").alias("rows"), F.kll_merge_agg_double("sketch", k).alias("sketch"))
    return merged.select(
        *by, "window_start", "window_end", "rows",
        *[F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name) for name, q in quantiles.items()])


# --- distinct counts and set differences ------------------------------------
def distinct_sketches(events: DataFrame, day: str, columns: dict[str, Column], lg: int = LG_REGISTERS) -> DataFrame:
    """``day`` and one HyperLogLog sketch per named column."""
    return events.groupBy(F.col(day).alias("day")).agg(*[
        F.hll_sketch_agg(c.cast("string"), lg).alias(name) for name, c in columns.items()])


def distinct_counts(sketches: DataFrame, names: list[str], by: list[Column] | None = None) -> DataFrame:
    """Estimated distinct values over all days of a group, merged from the days' sketches."""
    return sketches.groupBy(*(by or [])).agg(*[F.hll_sketch_estimate(F.hll_union_agg(n)).alias(n) for n in names])


def exact_counts(events: DataFrame, columns: dict[str, Column], by: list[Column] | None = None) -> DataFrame:
    """The same counts from the events: every distinct value is shuffled."""
    return events.groupBy(*(by or [])).agg(*[F.count_distinct(c).alias(n) for n, c in columns.items()])


def side_sketches(edges: DataFrame, by: list[Column], lg: int = LG_ENTRIES) -> DataFrame:
    """``by, read, written``: theta sketches of the datasets read and written."""
    name = F.concat_ws("|", "namespace", "name")
    return edges.groupBy(*by).agg(*[
        F.theta_sketch_agg(F.when(F.col("direction") == side, name), lg).alias(out)
        for side, out in (("input", "read"), ("output", "written"))])


def external_counts(sketches: DataFrame, lg: int = LG_ENTRIES) -> DataFrame:
    """Estimated numbers of datasets that are read but never written and the reverse, over all rows of sketches."""
    whole = sketches.agg(F.theta_union_agg("read", lg).alias("r"), F.theta_union_agg("written", lg).alias("w"))
    return whole.select(
        F.theta_sketch_estimate(F.theta_difference("r", "w")).alias("read_only"),
        F.theta_sketch_estimate(F.theta_difference("w", "r")).alias("written_only"),
        F.theta_sketch_estimate(F.theta_union("r", "w", lg)).alias("datasets"))
