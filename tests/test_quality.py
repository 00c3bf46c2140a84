"""Checks on hand-written rows, one per rule that is easy to get wrong."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventide.operators import quality as Q
from eventide.schemas import RAW_ORDERS_CONTRACT

DAY = "2024-01-02"


def result_rows(spark, rows):
    return spark.createDataFrame(
        rows, "run_id string, business_date string, check_name string, check_type string, severity string, passed boolean, created_at string"
    ).withColumns({"business_date": F.to_date("business_date"), "created_at": F.to_timestamp("created_at")})


def test_three_duplicate_measures_differ_on_null_keys(spark):
    df = spark.createDataFrame([("1",), ("1",), (None,), (None,)], "k string")
    assert Q.excess_duplicates(df, "k").first()[0] == 2
    assert Q.rows_minus_distinct(df, "k").first()[0] == 3
    assert Q.duplicate_keys(df, "k").first()[0] == 2


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 6), max_size=20))
def test_excess_equals_rows_minus_distinct_without_nulls(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k int")
    expected = len(keys) - len(set(keys))
    assert Q.excess_duplicates(df, "k").first()[0] == expected
    assert Q.rows_minus_distinct(df, "k").first()[0] == expected


def test_empty_date_still_yields_a_row(spark):
    cash = spark.createDataFrame([], "position_date date, long_value decimal(18,4), short_value decimal(18,4)")
    row = Q.check_zero_sum(cash, DAY).first()
    assert row["passed"] and row["actual_value"] == "0" and str(row["business_date"]) == DAY
    trades = spark.createDataFrame([], "trade_id string, trade_dt date")
    assert Q.check_duplicate_trades(trades, DAY).first()["passed"]


def test_empty_source_counts_as_no_difference(spark):
    target = spark.createDataFrame([(DAY,)], "d string").select(F.to_date("d").alias("d"))
    source = target.filter(F.lit(False))
    assert Q.check_row_count_tolerance(source, target, "d", "d", DAY).first()["passed"]
    assert not Q.check_row_count_equal(source, target, "d", "d", DAY).first()["passed"]
    unreachable = Q.check_row_count_tolerance(None, target, "d", "d", DAY).first()
    assert unreachable["passed"] and unreachable["expected_value"] == "oracle_unavailable"


def test_overflow_counts_each_row_once(spark):
    t = spark.createDataFrame(
        [("99999999999999.9999", "oracle"), ("100000000000000.0000", "oracle"), ("1", "fault_overflow"),
         ("999999999999999.1", "fault_overflow"), (None, None)], "n string, dw_source string",
    ).select(F.col("n").cast("decimal(24,5)").alias("notional"), "dw_source", F.lit(DAY).cast("date").alias("trade_dt"))
    assert Q.check_overflow(t, DAY).first()["actual_value"] == "3"


def test_old_failure_blocks_only_when_all_runs_count(spark):
    r = result_rows(spark, [
        ("r1", DAY, "c", "uniqueness", "critical", False, f"{DAY} 01:00:00"),
        ("r2", DAY, "c", "uniqueness", "critical", True, f"{DAY} 02:00:00"),
        ("r2", DAY, "w", "row_count", "warning", False, f"{DAY} 02:00:01"),
    ])
    assert Q.publish_allowed(r, DAY)
    assert not Q.publish_allowed(r, DAY, all_runs=True)
    assert {x["run_id"] for x in Q.latest_run(r).collect()} == {"r2"}


def test_gate_fails_on_critical_only(spark):
    warn = result_rows(spark, [("r", DAY, "w", "row_count", "warning", False, f"{DAY} 01:00:00")])
    assert Q.gate(warn, "raise")["gate_status"] == "PASS"
    bad = warn.unionByName(result_rows(spark, [("r", DAY, "dup", "uniqueness", "critical", False, f"{DAY} 01:00:00")]))
    assert Q.gate(bad)["gate_status"] == "FAIL"
    with pytest.raises(Q.QualityGateError, match="dup"):
        Q.gate(bad, "raise")


def test_all_in_one_raises(spark):
    t = spark.createDataFrame([("a", DAY), ("a", DAY)], "trade_id string, d string").select("trade_id", F.to_date("d").alias("trade_dt"))
    drvt = spark.createDataFrame([], "position_date date, settlement_price decimal(18,6)")
    cash = spark.createDataFrame([], "position_date date, long_value decimal(18,4), short_value decimal(18,4)")
    with pytest.raises(Q.QualityGateError, match="dups=1 nulls=0 zeros=0"):
        Q.check_all_in_one(t, drvt, cash, DAY, fail=True)


def test_expectations(spark):
    spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, "d")], "id int, v string").createOrReplaceTempView("expect_rows")
    three = "SELECT id FROM expect_rows WHERE id <= 3 AND '%%ODATE%%' = '2024-01-02' ORDER BY id"
    assert Q.expect_sql(spark, three, "count_gt", 2, DAY).first()["status"] == "success"
    assert Q.expect_sql(spark, three, "count_eq", 3, DAY).first()["status"] == "success"
    row = Q.expect_sql(spark, "SELECT v FROM expect_rows ORDER BY id", "value_eq", "b", DAY).first()
    assert row["status"] == "success" and row["row_count"] == 4 and len(row["sample"]) == 3
    none = Q.expect_sql(spark, "SELECT v FROM expect_rows WHERE id > 9", "value_eq", "b", DAY).first()
    assert none["status"] == "failed" and "None" in none["error"]


def test_contract_rules(spark):
    o = spark.createDataFrame(
        [("1", "T", "BUY", "1.0", 5), ("2", None, "HOLD", "x", 5), ("3", "TOO-LONG-TICKER", "SELL", "100000000000000", None)],
        "order_id string, ticker string, side string, price string, quantity int",
    ).withColumns({"order_time": F.lit(f"{DAY} 00:00:00").cast("timestamp"), "participant": F.lit("P"), "business_date": F.lit(DAY).cast("date")})
    failed = {r["rule"]: r["failures"] for r in Q.check_contract(o, RAW_ORDERS_CONTRACT).filter("failures > 0").collect()}
    assert failed == {
        "ticker:not_null": 1, "ticker:length": 1, "side:domain": 1, "price:type": 2, "quantity:not_null": 1,
    }


def test_samples_hold_five_in_key_order(spark):
    df = spark.range(20).select(F.format_string("k%02d", "id").alias("k"), F.lit("g").alias("g"))
    expected = "k=k00; k=k01; k=k02; k=k03; k=k04"
    assert Q.offender_samples(df, ["k"]).first()["samples"] == expected
    assert Q.offender_samples(df, ["k"], by=["g"]).first()["samples"] == expected


def test_timeliness_placeholder(spark):
    row = Q.check_timeliness_placeholder(spark, DAY).first()
    assert row["passed"] and row["severity"] == "info"
