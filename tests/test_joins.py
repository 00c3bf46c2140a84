"""Joins on skewed keys against the plain join."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from eventide.operators import joins, recon as R


def counts(df):
    rows = [tuple(str(v) for v in r) for r in df.select(*sorted(df.columns)).collect()]
    return sorted(rows)


@pytest.fixture(scope="module")
def skewed(spark):
    # A third of both sides shares one key; the right side has exact copies.
    left = spark.range(90).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"),
        F.col("id").alias("a"))
    right = spark.range(120).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") * 2).cast("string")).alias("k"),
        (F.col("id") % 4).alias("b"))
    return left, right


@pytest.mark.parametrize("least", [3, 25, 10_000])
def test_salted_left_join_equals_left_join(skewed, least):
    left, right = skewed
    for a, b in ((left, right), (right, left.withColumnRenamed("a", "c")), (left, right.limit(0)), (left.limit(0), right)):
        assert counts(joins.salted_left_join(a, b, "k", least)) == counts(a.join(b, "k", "left"))


def test_salted_join_shuffles_each_side_once_and_splits_the_hot_key(spark):
    left = spark.range(0, 40_000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 5 == 0, None).otherwise(F.col("id").cast("string")).alias("k"),
        F.col("id").alias("a"))
    right = spark.range(0, 20_000, 1, 8).select(
        F.when(F.col("id") % 4000 == 0, "hot").otherwise((F.col("id") * 3).cast("string")).alias("k"), F.lit(2).alias("b"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = joins.salted_left_join(left, right, "k", 1000)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and plan.count("SortMergeJoin") == 1
        # Neither the hot rows nor those without a key lie in one task.
        sizes = df.filter("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) <= 0.6 * 100_000
        loose = df.filter("k IS NULL").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in loose) <= 0.6 * 4_000
        assert df.count() == left.join(right, "k", "left").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_frequent_keys_merge_within_the_stated_error(spark):
    rows = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 7 == 0, F.lit(-2)).otherwise(F.col("id")).alias("k"))
    true = {r["k"]: r["count"] for r in rows.filter("k < 0").groupBy("k").count().collect()}
    found = joins.frequent_keys(rows, "k", shards=2, tracked=64).collect()
    assert sum(r["rows"] for r in found) == 60_000
    for k, n in true.items():
        best = max((i["count"], r["rows"]) for r in found for i in r["items"] if i["item"] == k)
        assert abs(best[0] - n) <= joins.count_error(best[1], 64)
    hot, share = joins.hot_keys(rows, "k", 16, 1000)
    assert set(hot) == {-1, -2} and share == 3750


@pytest.mark.parametrize("words", [64, 4096])
def test_bloom_filter(spark, words):
    keys = spark.range(0, 6000, 3).select(F.col("id").alias("k"), F.lit("x").alias("d"))
    facts = spark.range(0, 60_000, 1, 4).select(F.col("id").alias("k"), F.lit("x").alias("d"))
    whole = joins.bloom_filter(keys, ["k", "d"], words)
    parts = [joins.bloom_filter(keys.filter(F.col("k") % 2 == n), ["k", "d"], words) for n in (0, 1)]
    assert counts(joins.merge_filters(*parts)) == counts(whole)
    passed = joins.maybe_in(facts, whole, ["k", "d"], words)
    assert passed.join(keys, "k", "left_semi").count() == 2000  # no key is lost
    rate = (passed.count() - 2000) / 58_000
    stated = joins.false_positive_rate(2000, words)
    assert abs(rate - stated) < 0.15 * stated + 0.001


@pytest.mark.parametrize("words", [16, joins.WORDS])
def test_bloom_anti_join(spark, words):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "a"), (7, None)], "k int, d string")
    facts = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (7, None), (None, "a")], "k int, d string")
    got = joins.bloom_anti_join(df, facts, ["k", "d"], words)
    assert counts(got) == sorted([("a", "2"), ("a", "None"), ("None", "7")])


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("case", ["report", "orphans", "rows_in", "enrich"])
def test_hot_key_is_split(spark, case):
    """The final plan reads the hot key's partition in parts (skew=true)."""
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    hot = F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
    facts = spark.range(0, 40_000, 1, 8).select(
        hot.alias("trade_id"), hot.alias("ticker"), F.lit("2024-01-02").cast("date").alias("business_date"),
        (F.col("id") * 7919 % 100_003).cast("decimal(18,4)").alias("price"), F.lit(5).alias("quantity"),
        F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    keys = facts.select("trade_id", "ticker", "business_date").distinct()
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        if case == "report":
            df = R.settlement_report_from_raw(facts, keys.select("trade_id", F.lit("MATCHED").alias("status")))
        elif case == "orphans":
            df = R.orphan_instructions(facts, keys)
        elif case == "rows_in":
            df = joins.rows_in(facts, keys, "trade_id")
        else:
            df = R.enrich_trades(facts, keys.groupBy("ticker", "business_date").agg(F.max(F.lit(2)).alias("closing_price")))
        assert "skew=true" in final_plan(df)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_recon_with_repeated_ids(spark):
    t = spark.createDataFrame(
        [("x", "A", "2024-01-01", 2.0, 10), ("x", "A", "2024-01-01", 3.0, 10), ("y", "B", "2024-01-02", 4.0, 5), ("z", "B", "2024-01-02", 1.0, 1)],
        "trade_id string, ticker string, business_date string, price double, quantity int",
    ).withColumns({"business_date": F.to_date("business_date"), "price": F.col("price").cast("decimal(18,4)"),
                   "buyer_participant": F.lit("P"), "seller_participant": F.lit("Q")})
    i = spark.createDataFrame(
        [("s1", "x", "MATCHED"), ("s2", "x", "PENDING"), ("s2", "x", "PENDING"), ("s3", "y", None)],
        "settlement_id string, trade_id string, status string",
    ).withColumn("settlement_date", F.lit("2024-01-03").cast("date"))
    plain = R.settlement_recon(t, i)
    # Repeated ids fan out; the id without status counts as missing.
    status = {(r["trade_id"], r["recon_status"]): r["count"] for r in plain.groupBy("trade_id", "recon_status").count().collect()}
    assert status == {("x", "MATCHED"): 2, ("x", "BREAK"): 4, ("y", "MISSING_INSTRUCTION"): 1, ("z", "MISSING_INSTRUCTION"): 1}
    assert counts(R.settlement_report(plain)) == counts(R.settlement_report_from_raw(t, i))
    missing = R.trades_without_instruction(t, i).agg(F.sum("missing_rows")).first()[0]
    assert missing == 2


def test_rows_in_and_not_in(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    keys = spark.createDataFrame([(1,), (1,), (3,)], "k int")
    assert counts(joins.rows_in(df, keys, "k")) == [("1",), ("1",)]
    assert counts(joins.rows_not_in(df, keys, "k")) == [("2",), ("None",)]


def test_cross_count(spark):
    assert joins.cross_count(spark.range(7), spark.range(6)).first()["cnt"] == 42
    assert joins.cross_count(spark.range(0), spark.range(6)).first()["cnt"] == 0


def test_exposure_in_one_pass_equals_the_separate_steps(spark):
    t = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("T"), F.col("id") % 11)).alias("ticker"),
        F.timestamp_seconds(F.col("id") * 7919 % 4001).alias("trade_time"), (F.col("id") % 97 + 1).cast("decimal(18,4)").alias("price"),
        (F.col("id") % 13).cast("int").alias("quantity"),
        F.when(F.col("id") % 29 > 0, F.concat(F.lit("P"), F.col("id") % 5)).alias("buyer_participant"), F.concat(F.lit("P"), F.col("id") % 7).alias("seller_participant"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 4).cast("int")).alias("business_date"), (F.col("id") % 10 > 2).alias("ours"))
    want = R.participant_exposure(
        R.position_recon(R.participant_positions(t.filter("ours")).filter("participant IS NOT NULL"), t), R.close_prices(t))
    got = R.exposure_in_one_pass(t, F.col("ours")).filter("participant_id IS NOT NULL")
    assert counts(got) == counts(want)
    assert R.exposure_in_one_pass(t.limit(0), F.col("ours")).collect() == []
