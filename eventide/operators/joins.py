"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import together

_KEY = "_join_key"

# --- frequent keys ----------------------------------------------------------
SHARDS = 16  # a sketch per hash shard of the keys: no task merges all of them
TRACKED = 2048  # keys that one sketch follows
LEAST_HOT = 20_000  # rows below which a key is never worth splitting
FINER = 4  # parts per fair share, so that parts that meet in a task by chance even out


def frequent_keys(df: DataFrame, key: str, shards: int = SHARDS, tracked: int = TRACKED) -> DataFrame:
    """``shard, rows, items``: a mergeable frequent-items sketch of each hash shard of ``key``.

    ``items`` holds the followed keys with estimated counts. A count errs by no more
    than ``count_error(rows)``, so every key with more rows of its shard than that is
    among them. One pass over the key column; NULL keys are not counted.
    """
    shard = F.pmod(F.xxhash64(F.col(key)), F.lit(shards)).cast("int")
    items = F.expr(f"approx_top_k(`{key}`, {tracked}, {tracked})")
    return df.select(key).filter(F.col(key).isNotNull()).groupBy(shard.alias("shard")).agg(
        F.count(F.lit(1)).alias("rows"), items.alias("items"))


def count_error(rows: int, tracked: int = TRACKED) -> float:
    """Largest error of a sketch's count over ``rows`` rows: 3.5 divided by the sketch's table size."""
    return 3.5 * rows / 2 ** math.ceil(math.log2(tracked / 0.75))


def hot_keys(df: DataFrame, key: str, parts: int, least: int = LEAST_HOT) -> tuple[dict, int]:
    """Keys with more rows than a fair share of ``parts`` tasks, with their estimated rows, and that share.

    At most ``2 * parts`` keys have that many rows, so the list is bounded by the number of tasks.
    """
    found = frequent_keys(df, key)
    total = found.agg(F.sum("rows")).scalar()
    share = F.greatest(F.lit(least), F.ceil(total / parts))
    rows = found.select(F.explode("items").alias("item"), share.alias("share")).filter(
        F.col("item.count") > F.col("share")).select("item.item", "item.count", "share").collect()
    return {r["item"]: r["count"] for r in rows}, int(rows[0]["share"]) if rows else least


def salted_left_join(left: DataFrame, right: DataFrame, key: str, least: int = LEAST_HOT,
                     left_keys: DataFrame | None = None) -> DataFrame:
    """``left LEFT JOIN right USING (key)`` in one join, whichever side repeats a key.

    A sketch of both key columns names the hot keys. The rows of a hot key are laid out
    on a grid: ``a`` parts of its left rows by ``b`` parts of its right rows, where a row
    goes to one part of its own side and is repeated for each part of the other. Other
    keys stay whole, so each side is shuffled once and hardly grows. Rows of the left
    side without a key are spread over all tasks.

    A row's part follows from its values and its map task, so a task that runs again
    deals its rows alike, and copies of one row spread, too. ``left_keys`` may give the left
    side's keys by a cheaper plan than ``left`` itself.
    """
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    right = right.filter(F.col(key).isNotNull())
    (many_l, share_l), (many_r, share_r) = together(
        spark, *[partial(hot_keys, df, key, parts, least) for df in (left if left_keys is None else left_keys, right)])
    names = [f"_g{i}" for i in range(4)]
    a, b, i, j = names
    if not many_l and not many_r:
        return left.join(right, key, "left")
    grid = [(k, -(-FINER * many_l.get(k, 0) // share_l) or 1, -(-FINER * many_r.get(k, 0) // share_r) or 1)
            for k in {**many_l, **many_r}]
    layout = f"{key} {left.schema[key].dataType.simpleString()}, {a} int, {b} int"
    grid = F.broadcast(spark.createDataFrame(grid, layout))  # at most 4 * parts rows

    def side(df: DataFrame, own: str, other: str, at: str, every: str) -> DataFrame:
        dealt = F.xxhash64(*df.columns, F.spark_partition_id())
        df = df.withColumn("_deal", dealt).join(grid, key, "left")
        single = F.lit(1) if every == i else F.when(F.col(key).isNull(), F.lit(FINER * parts)).otherwise(1)
        df = df.withColumns({
            at: F.pmod("_deal", F.coalesce(own, single)).cast("int"), other: F.coalesce(other, F.lit(1))})
        return df.withColumn(every, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_deal", own)

    cells = side(left, a, b, i, j)
    # A key with several right parts is in the sketch, so it has a match: parts that hold none add nothing.
    matches = side(right, b, a, j, i).drop(a).withColumn("_match", F.lit(True))
    joined = cells.join(matches, [key, i, j], "left").filter((F.col(b) == 1) | F.col("_match").isNotNull())
    return joined.select(*left.columns, *[c for c in right.columns if c != key])


# --- splits left to the engine ----------------------------------------------
def split_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """A join whose sides arrive by a shuffle of their own, unless one is small enough to be sent whole.

    AQE splits a hot key only where a plain shuffle lies under the join; a side
    that was just aggregated by the key has none. The join therefore also compares
    a hash of the key, which no earlier partitioning covers. A hot key is split on
    the left for left, semi and anti joins, and on either side for inner joins.
    Whether a side is sent whole is the engine's choice by its measured size.
    """
    on = [on] if isinstance(on, str) else on
    keyed = [df.withColumn(_KEY, F.xxhash64(*on)) for df in (left, right)]
    return keyed[0].join(keyed[1], [_KEY, *on], how).drop(_KEY)


# --- Bloom filter -----------------------------------------------------------
WORDS = 1 << 20  # 64-bit words of a filter: the bound of what is broadcast
BITS = 4  # bits set per key


def _bloom_mask(h: Column) -> Column:
    """``BITS`` bits of a 64-bit word, from six bits of the hash each."""
    mask = F.lit(0).cast("long")
    for n in range(BITS):
        at = F.shiftrightunsigned(h, 6 * n).bitwiseAND(F.lit(63).cast("long")).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return mask


def _bloom_columns(df: DataFrame, on: list[str], words: int) -> DataFrame:
    """``df`` with the word and the bits of each row's key, from two hashes."""
    return df.withColumn("_bh", F.xxhash64(F.lit(23), *on)).withColumns({
        "_word": F.pmod(F.xxhash64(F.lit(17), *on), F.lit(words)).cast("int"), "_mask": _bloom_mask(F.col("_bh"))}).drop("_bh")


def bloom_filter(keys: DataFrame, on: str | list[str], words: int = WORDS) -> DataFrame:
    """``_word, _bits``: a Bloom filter of the keys, one row per 64-bit word with a bit set.

    All bits of a key lie in one word, so one lookup tests a key, and filters of parts
    merge by ``bit_or`` per word. See ``false_positive_rate``.
    """
    on = [on] if isinstance(on, str) else on
    marked = _bloom_columns(keys.select(*on), on, words)
    return marked.groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))


def merge_filters(*filters: DataFrame) -> DataFrame:
    """The filter of all keys of several filters of one width."""
    rows = filters[0]
    for other in filters[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))


def maybe_in(df: DataFrame, bits: DataFrame, on: str | list[str], words: int = WORDS) -> DataFrame:
    """Rows of ``df`` whose key may be in the filter; a key that is in it always stays."""
    on = [on] if isinstance(on, str) else on
    tested = _bloom_columns(df, on, words).join(F.broadcast(bits), "_word")  # at most ``words`` rows
    return tested.filter(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask")).select(*df.columns)


def false_positive_rate(keys: int, words: int = WORDS) -> float:
    """Expected share of absent keys that pass a filter of ``keys`` distinct keys."""
    load, rate, chance = keys / words, 0.0, math.exp(-keys / words)
    for i in range(1, int(load + 12 * math.sqrt(load) + 30)):
        chance *= load / i
        rate += chance * (1 - (1 - 1 / 64) ** (i * BITS)) ** BITS
    return rate


def bloom_anti_join(df: DataFrame, facts: DataFrame, on: str | list[str], words: int = WORDS) -> DataFrame:
    """Rows of ``df`` whose key the far larger ``facts`` lack; NULL keys are kept.

    A filter of ``df``'s keys is tested on the facts before they are shuffled, so only keys
    that can match travel, one row each. The join on what passes is exact.
    """
    on = [on] if isinstance(on, str) else on
    candidates = maybe_in(facts.select(*on), bloom_filter(df, on, words), on, words).distinct()
    return split_join(df, candidates, on, "left_anti")


# --- semi and anti joins ----------------------------------------------------
def rows_in(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key appears in ``keys`` (each key is shuffled once)."""
    on = [on] if isinstance(on, str) else on
    return split_join(df, keys.select(*on).distinct(), on, "left_semi")


def rows_not_in(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key does not appear in ``keys``; NULL keys are kept."""
    on = [on] if isinstance(on, str) else on
    return split_join(df, keys.select(*on).distinct(), on, "left_anti")


def cross_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """Size of the cross product of two inputs, without building it."""
    total = b.agg(F.count(F.lit(1)).alias("n"))
    return a.agg(F.count(F.lit(1)).alias("cnt")).select((F.col("cnt") * total.scalar()).alias("cnt"))
