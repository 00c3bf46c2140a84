"""Every registered query against its SQL twin at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from compare import compare, duck
from eventide.plans.oracle import ORACLE
from eventide.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_twin():
    assert set(REGISTRY) == set(ORACLE) and set(REGISTRY) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, con, name):
    problem, _ = compare(spark, con, name, REGISTRY[name], ORACLE[name], SF)
    assert problem == ""


def test_entry(spark):
    assert E.entry(spark).count() > 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_run_events_do_not_deal_the_runs_out_by_job(spark, tmp_path):
    """The four job names would put all runs into four tasks."""
    from eventide.plans.queries import REGISTRY

    rows = [(i, f"2024-01-0{1 + i % 3} 10:0{i % 10}:00", i % 8, ["error", "purchase", "view"][i % 3], 1.0, f'{{"k": {i}}}') for i in range(30)]
    e = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    e.selectExpr("event_id", "CAST(ts AS timestamp_ntz) AS ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    got = REGISTRY["l5_run_events"](spark, str(tmp_path))
    plan = _plan(got)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    for r in got.collect():
        assert (r["error"] is not None) == (r["event_type"] == "FAIL") and (r["row_count"] is not None) == (r["event_type"] == "COMPLETE")
        assert r["event_time"].endswith(":00.000Z") and r["run_id"] and r["parent_run_id"] and r["first_output"] and r["first_input"]


def test_hash_diff_is_computed_once_on_short_hashes(spark, tmp_path):
    from eventide.plans.queries import REGISTRY
    from eventide.sources import sinks

    lines = [(k, 1, float(q), 10.0, day) for k, (q, day) in enumerate(
        [(7, "1996-01-05"), (9, "1996-01-06"), (50, "1996-01-07"), (1, "1996-01-08"), (7, "1994-01-05"), (1, "1997-02-01")])]
    t = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, day string")
    spark.createDataFrame([(1, "N")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    t.withColumn("l_shipdate", t["day"].cast("timestamp_ntz")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = REGISTRY["b6_hash_diff"](spark, str(tmp_path))
    assert "lineitem" not in _plan(got)  # the sums per date are read, not made twice
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == [
        ("1994-01-01", 1, 0, 0, 0, False), ("1996-01-01", 1, 1, 1, 2, True), ("1997-02-01", 1, 0, 0, 0, False)]
    old = spark.createDataFrame([("d", "a", 1), ("d", "a", 1), ("d", None, 2), (None, "b", 3)], "day string, k string, v int")
    new = spark.createDataFrame([("d", "a", 1), ("d", "a", 4), ("d", None, 2), (None, "b", None)], "day string, k string, v int")
    diff = sinks.hash_diff(old, new, "day", ["k"], ["k", "v"])
    assert "unhex" in diff._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["day"], r["k"]): tuple(r)[2:] for r in diff.collect()} == {("d", "a"): (1, 1, 0, 0), ("d", None): (1, 0, 0, 0), (None, "b"): (0, 1, 0, 0)}
