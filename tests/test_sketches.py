"""Sketches merged from parts against exact counts, and reads of equal depth."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from eventide.operators import sketches as S
from eventide.sources import readers


def test_quantiles_merge_within_the_rank_error(spark):
    n = 200_000
    events = spark.range(0, n, 1, 4).select(
        F.lit("j").alias("job"), (F.col("id") * 7919 % n).cast("double").alias("value"),
        F.timestamp_seconds(F.col("id") % 86_400).alias("ts"))
    parts = S.quantile_sketches(events, ["job"], "value", window="5 minutes", k=200)
    assert parts.count() == 288
    asked = {"p05": 0.05, "p50": 0.5, "p99": 0.99}
    row = S.merge_quantiles(parts, ["job"], "1 day", asked, k=200).first()
    assert row["rows"] == n
    for name, q in asked.items():
        assert abs(row[name] / n - q) <= 2 * S.rank_error(200)  # the bound holds in 99 of 100 cases
    hours = S.merge_quantiles(parts, ["job"], "1 hour", {"p50": 0.5}, k=200)
    assert hours.count() == 24 and hours.agg(F.sum("rows")).first()[0] == n


def test_nulls_and_empty_input_make_no_sketch(spark):
    events = spark.createDataFrame([("j", None, 1), ("k", 2.0, 1)], "job string, value double, t long").withColumn(
        "ts", F.timestamp_seconds("t"))
    parts = S.quantile_sketches(events, ["job"], "value")
    assert [r["job"] for r in parts.collect()] == ["k"]
    assert S.merge_quantiles(parts, ["job"], "1 hour", {"p": 0.95}).first()["p"] == 2.0
    assert S.quantile_sketches(events.limit(0), ["job"], "value").collect() == []


def test_distinct_counts_merge_over_days(spark):
    events = spark.range(0, 100_000, 1, 4).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 10).cast("int")).alias("day"),
        (F.col("id") % 30_000).alias("a"), (F.col("id") % 17).alias("b"))
    columns = {"a": F.col("a"), "b": F.col("b")}
    about = S.distinct_counts(S.distinct_sketches(events, "day", columns), ["a", "b"]).first()
    exact = S.exact_counts(events, columns).first()
    assert (exact["a"], exact["b"], about["b"]) == (30_000, 17, 17)
    assert abs(about["a"] - 30_000) <= 4 * S.distinct_error() * 30_000


@pytest.mark.parametrize("size", [500, 60_000])
def test_set_differences_from_theta_sketches(spark, size):
    rows = spark.range(size).select(
        F.explode(F.array(F.when(F.col("id") % 3 < 2, "input"), F.when(F.col("id") % 3 > 0, "output"))).alias("direction"),
        F.lit("n").alias("namespace"), F.concat(F.lit("d"), F.col("id")).alias("name")).filter("direction IS NOT NULL")
    row = S.external_counts(S.side_sketches(rows, [F.pmod(F.hash("name"), F.lit(5)).alias("g")])).first()
    slack = 0 if size < 2 ** S.LG_ENTRIES else 4 * S.theta_error() * size
    for name, want in (("read_only", (size + 2) // 3), ("written_only", size // 3), ("datasets", size)):
        assert abs(row[name] - want) <= slack


@pytest.mark.parametrize("kind", ["long", "string", "date"])
def test_equal_depth_reads_hold_every_row_once(spark, kind):
    # A third of the rows shares one key, another tenth has none.
    key = F.when(F.col("id") % 3 == 0, F.lit(50)).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 700)
    typed = {"long": key, "string": F.concat(F.lit("k'"), F.lpad(key.cast("string"), 4, "0")),
             "date": F.date_add(F.lit("2024-01-01").cast("date"), key.cast("int"))}[kind]
    spark.range(6000).select("id", typed.alias("k")).createOrReplaceTempView("depth")
    tiles = spark.sql(readers.equal_depth_sql("depth", "k", 8)).collect()
    cuts = readers.equal_depth_predicates("k", [r["low"] for r in tiles])
    parts = [spark.sql(f"SELECT id FROM depth WHERE {c}").collect() for c in cuts]
    ids = [r["id"] for p in parts for r in p]
    assert sorted(ids) == list(range(6000)) and 5 <= len(cuts) <= 8
    assert max(map(len, parts)) <= 2000 + 2 * 6000 // 8


def test_equal_depth_of_odd_tables(spark):
    assert readers.equal_depth_predicates("k", []) == ["1 = 1"]
    assert readers.equal_depth_predicates("k", [3, 3]) == ["1 = 1"]


def test_a_fault_of_the_loader_is_not_taken_for_an_absent_source(spark, tmp_path):
    spark.range(1).write.parquet(f"{tmp_path}/t")
    typo = ("oracle", lambda: spark.read.parquet(f"{tmp_path}/t").select("idd"))
    away = ("oracle", lambda: spark.read.parquet(f"{tmp_path}/none"))
    other = ("mysql_fallback", lambda: spark.range(2))
    with pytest.raises(Exception, match="idd"):
        readers.first_available([typo, other])
    assert readers.first_available([away, other]).first()["dw_source"] == "mysql_fallback"
    no_driver = ("oracle", lambda: readers.read_jdbc(spark, "oracle", "t", env={}))
    assert readers.first_available([no_driver, other]).first()["dw_source"] == "mysql_fallback"

    def broken():
        spark._jvm.java.lang.Integer.parseInt("x")

    with pytest.raises(Exception, match="For input string"):
        readers.first_available([("oracle", broken), other])
