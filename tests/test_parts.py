"""Large tables are worked on in parts, and shuffles go when their query ends."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from eventide import session
from eventide.functions.scalars import add_audit
from eventide.plans import pipeline as P
from eventide.plans.queries import REGISTRY
from eventide.sources import driver_tables as V


@pytest.fixture
def star(spark, tmp_path):
    """Small star tables: repeated trade ids, orders and parts that are missing, empty keys and flags."""
    def put(name, rows, layout):
        df = spark.createDataFrame(rows, layout)
        df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in df.columns if c == "l_shipdate"}).write.parquet(f"{tmp_path}/{name}.parquet")

    lines = [(k % 37, k % 5, k % 3, k % 6, float(k % 50 + 1), 10.25 * k, "ARN"[k % 3], f"199{5 + k % 4}-0{1 + k % 7}-10 00:00:00") for k in range(300)]
    lines += [(None, 1, 1, 1, 5.0, 10.0, "A", "1995-01-10 00:00:00"), (3, 1, 1, None, 5.0, None, None, "1995-01-10 00:00:00"),
              (4, None, 1, 2, 5.0, 1.0, "A", "1995-01-10 00:00:00"), (5, 1, 1, 2, None, 1.0, "A", None)]
    put("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_returnflag string, l_shipdate string")
    put("orders", [(k, k % 4) for k in range(35)] + [(None, 1)], "o_orderkey long, o_custkey long")
    put("nation", [(1, "N"), (2, None)], "n_nationkey int, n_name string")
    put("supplier", [(0, 1), (1, 2), (2, 1)], "s_suppkey long, s_nationkey int")
    put("customer", [(k, 1 + k % 2, 20.0 * k, "M") for k in range(4)], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string")
    put("part", [(k, f"Brand#{k}", "T", 50 - k, 3.0) for k in range(5)], "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double")
    return str(tmp_path)


def listed(df):
    return sorted(map(str, df.collect()))


def test_every_row_is_in_one_part(spark, star, monkeypatch):
    whole = V.src_trade_movements(spark, star)
    assert len(V.src_trade_parts(spark, star)) == 1
    monkeypatch.setattr(session, "PART_BYTES", 1)
    parts = V.src_trade_parts(spark, star)
    assert len(parts) == session.MOST_PARTS and sum(p.count() > 0 for p in parts) > 1
    stored, rows = session.materialise_parts(parts, "t-parts")
    assert rows == whole.count() and listed(stored) == listed(whole)
    keys = spark.createDataFrame([(k,) for k in [*range(50), None, None]], "k long")
    assert sum(keys.filter(session.in_part("k", i, 3)).count() for i in range(3)) == 52


def test_only_files_that_read_the_same_again_are_cut(spark, star, monkeypatch):
    monkeypatch.setattr(session, "PART_BYTES", 1)
    line = V.table(spark, star, "lineitem")
    chosen = line.select((F.col("l_orderkey") + 1).alias("k"), "l_partkey").filter("k > 3")
    assert session.part_count(chosen) == session.MOST_PARTS
    for other in (chosen.withColumn("r", F.rand()), chosen.groupBy("k").count(), spark.range(9),
                  chosen.join(V.table(spark, star, "orders"), F.col("k") == F.col("o_orderkey"))):
        assert session.part_count(other) == 1


def shuffle_files(spark):
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (held.apply(i).getName() for i in range(held.size())) if name.startswith("shuffle_")}


def test_a_run_holds_no_shuffle_of_an_ended_step(spark, star, monkeypatch):
    want = listed(REGISTRY["j11_run_d1_g2"](spark, star))
    monkeypatch.setattr(session, "PART_BYTES", 1)
    before = shuffle_files(spark)
    got = REGISTRY["j11_run_d1_g2"](spark, star)
    until = time.time() + 10
    while shuffle_files(spark) - before and time.time() < until:  # files go in the background
        time.sleep(0.2)
    assert shuffle_files(spark) - before == set()
    assert listed(got) == want and len(want) > 3
    assert spark.conf.get(session.SHUFFLE_CLEANUP) == "false"


def test_hashes_and_load_times_are_not_shuffled(spark, star, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "PART_BYTES", 1)
    source, _ = session.materialise(V.src_trade_movements(spark, star), "t-src")
    dealt, hint = [], type(source).hint
    monkeypatch.setattr(type(source), "hint", lambda self, name, *by: dealt.append((name, by, self.columns)) or hint(self, name, *by))
    paths = P.Paths(f"{tmp_path}/wh")
    out = P.load_trades(source, paths, load_ts="2024-01-03 00:00:00")
    by_date = [columns for name, by, columns in dealt if (name, by) == ("rebalance", ("trade_dt",))]
    assert len(by_date) == session.MOST_PARTS and not any("dw_row_hash" in columns for columns in by_date)
    stored = P.read_table(spark, paths, "dw_trade_movements")
    audited = add_audit(stored.drop("dw_load_dt", "dw_source", "dw_row_hash"), "oracle", ["trade_id", "trade_dt"], "2024-01-03 00:00:00")
    assert listed(stored) == listed(audited.select(*stored.columns)) and stored.count() == out["rows_written"] > 100
    assert out["rows_read"] == source.count() and out["rows_rejected"] > 0
    files = [f for _, _, names in os.walk(f"{tmp_path}/wh/dw_trade_movements") for f in names if f.endswith(".parquet")]
    assert files and all(".zstd." in f for f in files)
