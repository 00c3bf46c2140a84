"""Hash samples against a sort, and the drills against their stated counts."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from eventide.operators import quality as Q, sampling as D

DAY = "2024-01-02"


def brute(keys, seed, n):
    """Keys in hash order until ``n`` rows are covered."""
    sizes = {}
    for k in keys:
        sizes[k] = sizes.get(k, 0) + 1
    out, covered = set(), 0
    for k in sorted(sizes, key=lambda k: hashlib.md5(f"{k}|{seed}".encode()).hexdigest()):
        if covered >= n:
            break
        out.add(k)
        covered += sizes[k]
    return out


@pytest.mark.parametrize("fraction,seed", [(0.05, 1), (0.10, 2), (0.5, 3), (1.0, 4), (0.0001, 5)])
def test_share_matches_brute_force(spark, fraction, seed):
    keys = [i // 3 if i < 30 else i for i in range(1000)] + [7] * 500
    df = spark.createDataFrame([(k,) for k in keys], "k int")
    got = {r["k"] for r in D.sample_rows(df, "k", seed, fraction=fraction).collect()}
    assert got == brute(keys, seed, max(1, int(len(keys) * fraction)))


def test_small_sample_is_exact(spark):
    df = spark.createDataFrame([(7,)] * 50 + [(8,)] * 50, "k int")
    assert D.sample_rows(df, "k", 1, n=20).count() == 20


def test_any_n_is_exact_with_a_tied_key_on_the_cut(spark):
    df = spark.range(40_000).select((F.col("id") % 30).alias("k"), "id")
    for n in (10_000, 10_001, 10_667):
        assert D.sample_rows(df, "k", 3, n=n).count() == n
    got = sorted(tuple(r) for r in D.sample_rows(df, "k", 3, n=5_000).collect())
    ranked = sorted(((i % 30, i) for i in range(40_000)), key=lambda r: (hashlib.md5(f"{r[0]}|3".encode()).hexdigest(), r))
    assert got == sorted(ranked[:5_000])


def test_large_n(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert D.sample_rows(df, "k", 3, n=321).count() == 321
    assert D.sample_rows(df, "k", 3, n=5000).count() == 1000


@pytest.fixture(scope="module")
def trades(spark):
    return spark.range(500).select(
        F.format_string("TRD-%05d", "id").alias("trade_id"), F.col("id").cast("string").alias("order_id"),
        F.concat(F.lit("TK"), (F.col("id") % 8).cast("string")).alias("ticker"),
        F.lit(f"{DAY} 10:00:00").cast("timestamp").alias("trade_time"),
        (F.col("id") % 50 + 10).cast("decimal(18,4)").alias("price"), F.lit(100).alias("quantity"),
        F.lit("P1").alias("buyer_participant"), F.lit("P2").alias("seller_participant"),
        F.lit(DAY).cast("date").alias("business_date"))


def test_duplicates_drill(spark, trades):
    hit = D.drill_duplicates(trades, DAY, seed=1, n=4)
    assert hit.count() == 504
    assert Q.excess_duplicates(hit, "trade_id").first()[0] == 4
    changed = D.drill_duplicates(trades, DAY, seed=1, n=4, new_values={"quantity": F.lit(7)})
    assert changed.filter("quantity = 7").count() == 4


def test_drop_drill(spark, trades):
    kept = D.drill_drop_rows(trades, DAY, seed=1)
    assert kept.count() == 450
    row = Q.check_row_count_tolerance(kept, trades, "business_date", "business_date", DAY).first()
    assert not row["passed"] and row["details"].endswith("diff=11.11%")


def test_volume_spike_drill(spark, trades):
    before = {r["ticker"]: r["count"] for r in trades.groupBy("ticker").count().collect()}
    after = {r["ticker"]: r["count"] for r in D.drill_volume_spike(trades, DAY, seed=3).groupBy("ticker").count().collect()}
    grown = [t for t in before if after[t] != before[t]]
    assert len(grown) == 1 and after[grown[0]] == 11 * before[grown[0]]


def positions(spark, n):
    return spark.range(n).select(
        F.format_string("POS-%04d", "id").alias("position_id"), F.lit(DAY).cast("date").alias("position_date"),
        F.lit(DAY).cast("date").alias("business_date"), F.lit(5).cast("decimal(18,6)").alias("settlement_price"),
        (F.col("id") + 1).cast("decimal(22,6)").alias("settlement_value"))


def test_null_drills(spark):
    p = positions(spark, 50)
    assert D.drill_null_column(p, "settlement_price", DAY, first=8).filter("settlement_price is null").count() == 8
    assert D.drill_null_column(p, "settlement_price", DAY, seed=2).filter("settlement_price is null").count() == 2
    assert D.drill_null_column(positions(spark, 3), "settlement_price", DAY).filter("settlement_price is null").count() == 1


def test_force_zero_drill(spark):
    assert Q.source_zero_sum(D.drill_force_zero(positions(spark, 40), DAY), DAY).first()["zero_sum"] == 6


def test_late_settlement_drill(spark):
    i = spark.range(200).select(
        F.col("id").cast("string").alias("instruction_id"), F.lit(DAY).cast("date").alias("settlement_date"),
        F.lit("PENDING").alias("status"), F.lit(DAY).cast("date").alias("business_date"))
    late = D.drill_late_settlement(i, DAY, seed=4).filter("status = 'FAILED'")
    rows = late.select(F.date_diff("settlement_date", "business_date").alias("d")).collect()
    assert len(rows) == 50 and {r["d"] for r in rows} <= {1, 2, 3}
