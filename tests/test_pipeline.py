"""The scenarios: a clean day, and each fault with the count it must report."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from eventide.operators import mapping as M, quality as Q, sampling as D
from eventide.plans import pipeline as P
from eventide.schemas import DQ_RESULTS, SRC_CASH_POSITIONS, SRC_DRVT_POSITIONS, SRC_TRADE_MOVEMENTS, TRADE_MOVEMENTS_CONTRACT, schema
from eventide.sources import readers, sinks

DAY, TS = "2024-01-02", "2024-01-03 00:00:00"


def conform(df, ddl):
    fields = schema(ddl).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


@pytest.fixture(scope="module")
def day(spark):
    date = F.lit(DAY).cast("date")
    trades = spark.range(500).select(
        F.format_string("TRD-%05d", "id").alias("trade_id"), date.alias("trade_dt"), F.lit("PETR4X").alias("instrument_code"),
        F.lit("P1").alias("buy_participant"), F.lit("P2").alias("sell_participant"), (F.col("id") + 1).alias("quantity"),
        F.lit("12.345678").alias("closing_price"), F.date_add(date, 2).alias("settlement_dt"), F.lit("OPEN").alias("status"), date.alias("business_date"))
    drvt = spark.range(50).select(
        F.format_string("POS-DRVT-%04d", "id").alias("position_id"), date.alias("position_date"), F.lit("P1").alias("participant_code"),
        F.lit("WINFUT").alias("instrument_code"), F.lit(5).alias("net_quantity"), F.lit(7).alias("long_quantity"), F.lit(2).alias("short_quantity"),
        F.lit("10.5").alias("market_value"), date.alias("business_date"))
    cash = spark.range(40).select(
        F.format_string("POS-CASH-%04d", "id").alias("position_id"), date.alias("position_date"), F.lit("P1").alias("participant_code"),
        F.lit("PETR4").alias("instrument_code"), F.lit(5).alias("net_quantity"),
        F.when(F.col("id") % 2 == 0, F.lit("100.25")).otherwise("-50.5").alias("settlement_value"), date.alias("business_date"))
    return conform(trades, SRC_TRADE_MOVEMENTS), conform(drvt, SRC_DRVT_POSITIONS), conform(cash, SRC_CASH_POSITIONS)


def run(spark, tmp_path, day, **kw):
    paths = P.Paths(str(tmp_path))
    row = P.run_d1(spark, paths, *day, run_id="r1", load_ts=TS, business_date=DAY, **kw).first()
    return paths, row


def values(spark, paths):
    return {r["check_name"]: (r["actual_value"], r["passed"]) for r in P.read_table(spark, paths, "dq_results").collect()}


def test_clean_day_publishes(spark, tmp_path, day):
    paths, row = run(spark, tmp_path, day)
    assert (row["gate_status"], row["checks_run"], row["checks_failed"], row["published"]) == ("PASS", 5, 0, True)
    assert (row["dw_trade_movements_rows"], row["dw_drvt_positions_rows"], row["dw_cash_positions_rows"]) == (500, 50, 40)
    assert os.path.isdir(paths.export("derivatives/dw_trade_movements") + "_20240102.parquet")
    csv = spark.read.option("header", True).csv(paths.export("spot/dw_cash_positions") + "_20240102.csv")
    assert csv.count() == 40 and csv.columns[0] == "position_id"
    first = P.read_table(spark, paths, "dw_trade_movements").filter("trade_id = 'TRD-00001'").first()
    assert str(first["notional"]) == "24.6914" and first["desk_code"] == "PETR4"
    assert (first["counterparty_id"], first["trader_id"], first["dw_source"]) == ("P1", "P2", "oracle")


def test_reload_is_idempotent(spark, tmp_path, day):
    paths = P.Paths(str(tmp_path))
    for _ in range(2):
        out = P.load_trades(day[0], paths, DAY, load_ts=TS)
    assert out == {"rows_read": 500, "rows_rejected": 0, "rows_written": 500, "duplicates": 0, "dates": [DAY]}
    assert P.read_table(spark, paths, "dw_trade_movements").count() == 500


def test_all_faults_are_reported_and_block(spark, tmp_path, day):
    trades, drvt, cash = day
    bad = (
        D.drill_duplicates(trades, DAY, seed=1),
        D.drill_null_column(drvt, "market_value", DAY, first=8),
        D.drill_force_zero(cash, DAY),
    )
    paths, row = run(spark, tmp_path, bad)
    got = values(spark, paths)
    assert got["caso1_duplicate_trades"] == ("4", False)
    assert got["caso2_null_settlement_price"] == ("8", False)
    assert got["caso3_zero_sum_positions"] == ("6", False)
    assert got["rowcount_trades_oracle_vs_dw"] == ("504", True)
    assert (row["gate_status"], row["critical_failures"], row["published"]) == ("FAIL", 3, False)
    assert not os.path.exists(f"{tmp_path}/exports")


def test_unguarded_run_exports_in_spite_of_a_failed_gate(spark, tmp_path, day):
    bad = (D.drill_duplicates(day[0], DAY, seed=1), *day[1:])
    paths, row = run(spark, tmp_path, bad, guard=False)
    assert row["gate_status"] == "FAIL" and row["published"]
    assert os.path.isdir(paths.export("derivatives/dw_trade_movements") + "_20240102.parquet")


def test_hard_gate_stops_the_run_but_keeps_results(spark, tmp_path, day):
    bad = (D.drill_duplicates(day[0], DAY, seed=1), *day[1:])
    with pytest.raises(Q.QualityGateError, match="caso1_duplicate_trades"):
        run(spark, tmp_path, bad, gate_mode="raise")
    assert values(spark, P.Paths(str(tmp_path)))["caso1_duplicate_trades"] == ("4", False)
    assert not os.path.exists(f"{tmp_path}/exports")


def test_second_generation_gate_has_seven_rows(spark, tmp_path, day):
    mapped = [m.withColumn("business_date", F.col(c)) for m, c in (
        (M.map_trades_g1(day[0]).withColumn("status", F.lit("")), "trade_dt"),
        (M.map_drvt_positions(day[1]), "position_date"), (M.map_cash_positions(day[2]), "position_date"))]
    paths, row = run(spark, tmp_path, mapped, generation="g2")
    assert row["checks_run"] == 7 and row["gate_status"] == "PASS" and row["published"]
    # The second generation's defaults took effect in the load itself.
    assert {r[0] for r in P.read_table(spark, paths, "dw_trade_movements").select("status").distinct().collect()} == {"EXECUTED"}
    P.quality_gate(spark, paths, {"trades": mapped[0], "drvt": mapped[1], "cash": mapped[2]}, "r2", TS, DAY, "g2")
    assert P.read_table(spark, paths, "dq_results").count() == 14


def test_rejects_and_exports_of_other_dates_stay(spark, tmp_path, day):
    trades, _, cash = day
    paths, other = P.Paths(str(tmp_path)), "2024-01-03"
    rejected = F.when(F.col("trade_id") == "TRD-00000", F.lit(None)).otherwise(F.col("status"))
    moved = trades.withColumn("business_date", F.lit(other).cast("date"))
    for df, date in ((trades, DAY), (moved, other)):
        assert P.load_trades(df.withColumn("status", rejected), paths, date, load_ts=TS)["rows_rejected"] == 1
    held = lambda: {str(r[0]) for r in P.read_table(spark, paths, "dw_trade_movements_rejects").select("trade_dt").collect()}
    assert held() == {DAY, other}
    both = trades.unionByName(moved.withColumn("status", rejected))
    assert P.load_trades(both, paths, load_ts=TS)["rows_rejected"] == 1  # all dates: the clean one loses its old reject
    assert held() == {other}
    P.load_trades(moved, paths, other, load_ts=TS)
    assert held() == set()
    report = spark.createDataFrame([(DAY, 1), (other, 2)], "business_date string, n int").withColumn("business_date", F.to_date("business_date"))
    for date in (DAY, other):
        P.publish_reports(report.filter(F.col("business_date") == date), report.filter(F.col("business_date") == date), str(tmp_path / "out"))
    csv = spark.read.option("header", True).csv(f"{tmp_path}/out/exports/participant_exposure_report")
    assert {str(r["dt"]) for r in csv.collect()} == {DAY, other}


def test_a_run_that_dies_between_tables_leaves_the_old_state_of_all(spark, tmp_path, day, monkeypatch):
    paths, _ = run(spark, tmp_path, day)
    state = lambda: {t: sorted(map(str, P.read_table(spark, paths, t).collect()))
                     for n in P.TABLES for t in (n, f"{n}_rejects")}
    before, number = state(), P.versions.current(spark, paths.root).number
    write, calls = P.versions.Change.replace, []

    def fails(self, table, *args, **kw):
        calls.append(table)
        if table == "dw_cash_positions":
            raise OSError("disk full")
        return write(self, table, *args, **kw)

    monkeypatch.setattr(P.versions.Change, "replace", fails)
    fewer = [df.limit(7) for df in day]
    with pytest.raises(OSError, match="disk full"):
        P.run_d1(spark, paths, *fewer, run_id="r2", load_ts=TS, business_date=DAY)
    assert {"dw_trade_movements", "dw_trade_movements_rejects", "dw_drvt_positions", "dw_drvt_positions_rejects"} <= set(calls)
    assert state() == before and P.versions.current(spark, paths.root).number == number
    monkeypatch.undo()
    P.run_d1(spark, paths, *fewer, run_id="r3", load_ts=TS, business_date=DAY)
    assert P.read_table(spark, paths, "dw_trade_movements").count() == 7


def test_exports_of_a_publication_that_dies_stay(spark, tmp_path, day, monkeypatch):
    paths, _ = run(spark, tmp_path, day)
    old = sorted(os.listdir(paths.export("derivatives") + "/dw_trade_movements_20240102.parquet"))

    def broken(*args, **kw):
        raise OSError("disk full")

    monkeypatch.setattr(P, "export_csv", broken)
    with pytest.raises(OSError):
        P.publish(spark, paths, DAY)
    assert sorted(os.listdir(paths.export("derivatives") + "/dw_trade_movements_20240102.parquet")) == old
    monkeypatch.undo()
    monkeypatch.setattr(P, "write_csv", broken)
    with pytest.raises(OSError):
        P.publish_dates(spark, paths)
    assert not os.path.exists(paths.export("derivatives/dw_trade_movements") + "/dt=2024-01-02")


def test_second_load_of_the_same_rows_writes_nothing(spark, tmp_path, day):
    paths, other = P.Paths(str(tmp_path)), "2024-01-03"
    moved = day[0].withColumns({c: F.lit(other).cast("date") for c in ("business_date", "trade_dt")})
    both = M.map_trades_g1(day[0].unionByName(moved))
    load = lambda rows, **kw: P.load_changes(rows, TRADE_MOVEMENTS_CONTRACT, paths, load_ts=TS, **kw)
    assert load(both) == [DAY, other]
    number = P.versions.current(spark, paths.root).number
    assert load(both) == [] and load(both, business_date=DAY) == [] and P.versions.current(spark, paths.root).number == number
    late = F.when((F.col("trade_id") == "TRD-00003") & (F.col("trade_dt") == other), F.lit("LATE")).otherwise(F.col("status"))
    assert load(both.withColumn("status", late)) == [other]
    assert P.read_table(spark, paths, "dw_trade_movements").filter("status = 'LATE'").count() == 1
    gone = both.withColumn("status", F.when(F.col("trade_dt") == DAY, F.col("status")))  # all of a date is rejected
    assert load(gone) == [other] and load(gone) == []
    assert P.read_table(spark, paths, "dw_trade_movements_rejects").count() == 500


def test_hash_diff_of_repeated_keys(spark):
    old = spark.createDataFrame([("d1", 1, "a"), ("d1", 1, "a"), ("d1", 2, "x"), ("d2", 3, "k"), ("d2", 4, "k"), ("d2", 4, "k")], "day string, id int, v string")
    new = spark.createDataFrame([("d1", 1, "a"), ("d1", 1, "b"), ("d1", 2, "x"), ("d2", 4, "k"), ("d2", 4, None), ("d3", 5, None)], "day string, id int, v string")
    diff = sinks.hash_diff(old, new, "day", ["id"], ["v"])
    got = {(r["day"], r["id"]): tuple(r)[2:] for r in diff.collect()}
    assert got == {("d1", 1): (1, 1, 0, 0), ("d1", 2): (1, 0, 0, 0), ("d2", 3): (0, 0, 0, 1), ("d2", 4): (1, 1, 0, 0), ("d3", 5): (0, 0, 1, 0)}
    assert sorted(r[0] for r in sinks.changed_dates(diff, "day").collect()) == ["d1", "d2", "d3"]


def test_runs_look_at_their_own_dates_only(spark, tmp_path, day):
    paths, _ = run(spark, tmp_path, day)
    moved = [df.withColumns({c: F.lit("2024-01-03").cast("date") for c in ("business_date", "position_date") if c in df.columns}) for df in day]
    rows = P.run_d1(spark, paths, *moved, "r2", TS).collect()
    assert [(str(r["business_date"]), r["gate_status"], r["published"]) for r in rows] == [("2024-01-03", "PASS", True)]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from eventide import session

    class Conf:
        def __init__(self, master, folder=None):
            self.values = {"spark.master": master, "spark.checkpoint.dir": folder}

        def get(self, key, default=None):
            return self.values.get(key) or default

    for master in ("local", "local[4]", "local[*]"):
        assert session.scratch_dir(type("S", (), {"conf": Conf(master)}), "x")
    for master in ("local-cluster[2,1,1024]", "yarn", "k8s://host"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            session.scratch_dir(type("S", (), {"conf": Conf(master)}), "x")
        assert session.scratch_dir(type("S", (), {"conf": Conf(master, "s3a://b/c")}), "x").startswith("s3a://b/c/x-")


def test_upsert_takes_the_last_of_repeated_updates(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    updates = spark.createDataFrame([(1, "x", 5), (1, "y", 4), (3, "z", 1), (3, "w", 2)], "k int, v string, n int")
    got = sorted(map(tuple, sinks.upsert(target, updates, ["k"], ["v", "n"], order="n").collect()))
    assert got == [(1, "x", 5), (2, "b", 1), (3, "w", 2)]


def test_jdbc_slices_can_be_split(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(readers, "read_jdbc", lambda spark, kind, table, **kw: seen.update(kw) or day_frame(spark))
    readers.read_slice(spark, "oracle", "t", "business_date", DAY, "id", ("0", "9"), 4)
    assert seen == {"partition_column": "id", "bounds": ("0", "9"), "partitions": 4}


def day_frame(spark):
    return spark.range(1).withColumn("business_date", F.lit(DAY).cast("date"))


def test_stream_reads_a_folder_table(spark, tmp_path):
    from eventide.operators import telemetry as K
    from eventide.sources import driver_tables as V
    from eventide.streaming import alerts

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    keys = ["window_start", "window_end", "job_name"]
    want, got = [alerts.run_available(alerts.job_failures(V.stream_job_runs(spark, d)), keys, "t-folder")
                 for d in ("/root/testdata/sf0.001", str(tmp_path))]
    assert sorted(map(str, want.collect())) == sorted(map(str, got.select(want.columns).collect())) and want.count() > 0
    events.limit(0).write.parquet(f"{tmp_path}/none/events.parquet")
    assert alerts.run_available(alerts.job_failures(V.stream_job_runs(spark, f"{tmp_path}/none")), keys, "t-none").count() == 0


def test_overflow_row_is_rejected_on_load(spark, tmp_path, day):
    big = day[0].withColumn("quantity", F.when(F.col("trade_id") == "TRD-00000", F.lit(999999999999999)).otherwise(F.col("quantity")).cast("decimal(15,0)"))
    paths = P.Paths(str(tmp_path))
    out = P.load_trades(big, paths, DAY, load_ts=TS)
    assert (out["rows_written"], out["rows_rejected"]) == (499, 1)
    reject = P.read_table(spark, paths, "dw_trade_movements_rejects").first()
    assert set(reject["reject_reasons"]) == {"notional:type", "quantity:type"}


def test_overflow_drill_fires_the_check(spark, day):
    dw = M.map_trades_g1(day[0]).withColumn("dw_source", F.lit("oracle"))
    assert Q.check_overflow(D.drill_overflow(dw, DAY), DAY).first()["actual_value"] == "1"


def test_split_valid_loses_nothing(spark, day):
    rows = M.map_trades_g1(day[0]).withColumn("status", F.when(F.col("quantity") > 10, F.col("status")))
    good, rejects = sinks.split_valid(rows, TRADE_MOVEMENTS_CONTRACT)
    assert (good.count(), rejects.count()) == (490, 10)


def test_empty_slice_clears_the_old_one(spark, tmp_path, day):
    path = str(tmp_path)
    other = day[2].withColumn("business_date", F.lit("2024-01-05").cast("date"))
    sinks.replace_slices(day[2].unionByName(other), path, "business_date")
    assert sinks.replace_slice(day[2].filter(F.lit(False)), path, "business_date", DAY) == 0
    left = {str(r["business_date"]): r["count"] for r in spark.read.parquet(path).groupBy("business_date").count().collect()}
    assert left == {"2024-01-05": 40}


def test_exports_skip_empty_slices(spark, tmp_path, day):
    assert sinks.export_parquet(day[2].filter(F.lit(False)), f"{tmp_path}/x", DAY) is None
    assert sinks.export_csv(day[2].filter(F.lit(False)), f"{tmp_path}/x", DAY) is None
    assert os.listdir(tmp_path) == []


def test_csv_writes_null_and_empty_alike(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "")], "k string, v string").coalesce(1)
    target = sinks.export_csv(df, f"{tmp_path}/x", DAY)
    text = "".join(open(os.path.join(target, f)).read() for f in os.listdir(target) if f.endswith(".csv"))
    assert text == "k,v\na,\nb,\n"


def test_dq_results_replace_and_append(spark, tmp_path):
    one = Q.stamp_results(Q.check_timeliness_placeholder(spark, DAY), "r1", TS)
    assert [f.name for f in schema(DQ_RESULTS)] == one.columns
    path = str(tmp_path / "dq")
    sinks.write_dq_results(one, path)
    sinks.write_dq_results(one, path)
    assert spark.read.parquet(path).count() == 1
    sinks.write_dq_results(one, path, "append")
    assert spark.read.parquet(path).count() == 2


def test_first_available_falls_back(spark, tmp_path):
    loaders = [("oracle", lambda: spark.read.parquet(f"{tmp_path}/none")), ("mysql_fallback", lambda: spark.range(2))]
    assert {r["dw_source"] for r in readers.first_available(loaders).collect()} == {"mysql_fallback"}
    with pytest.raises(RuntimeError, match="oracle"):
        readers.first_available(loaders[:1])


def test_jdbc_options_come_from_the_environment():
    options = readers.jdbc_options("oracle", {"ORACLE_HOST": "h", "ORACLE_PASSWORD": "s"})
    assert options["url"] == "jdbc:oracle:thin:@//h:1521/XEPDB1" and options["password"] == "s"
    for kind in ("sqlserver", "mysql", "postgres"):
        assert "password" not in readers.jdbc_options(kind, {})
    with pytest.raises(ValueError):
        readers.jdbc_options("sqlite")


def test_history_round_trip_skips_bad_lines(spark, tmp_path):
    path = str(tmp_path / "h")
    good = '{"timestamp":"2024-01-02T00:00:00Z","run_id":"r","status":"success","job_summary":{"a":{"status":"success","duration_seconds":1.5}}}'
    spark.createDataFrame([(good,), ("",), ("{broken",), (good,)], "value string").write.text(path)
    rows = readers.read_run_history(spark, path).collect()
    assert len(rows) == 2 and rows[0]["job_summary"]["a"]["duration_seconds"] == 1.5


def test_upsert_updates_listed_columns_only(spark):
    old = spark.createDataFrame([("A", 1, "x"), ("B", 2, "y")], "k string, v int, flag string")
    new = spark.createDataFrame([("B", 20, "new"), ("C", 30, "new")], "k string, v int, flag string")
    got = {tuple(r) for r in sinks.upsert(old, new, ["k"], ["v"]).collect()}
    assert got == {("A", 1, "x"), ("B", 20, "y"), ("C", 30, "new")}


def test_insert_missing_keeps_existing(spark):
    old = spark.createDataFrame([("A", "x")], "k string, v string")
    rows = spark.createDataFrame([("A", "z"), ("B", "p"), ("B", "q")], "k string, v string")
    assert {tuple(r) for r in sinks.insert_missing(old, rows, ["k"]).collect()} == {("A", "x"), ("B", "p")}


def test_role_mapping_differs_between_generations(spark):
    raw = spark.createDataFrame([("t", "T", "buyer", "seller")], "trade_id string, ticker string, buyer_participant string, seller_participant string").withColumns(
        {"price": F.lit("2.5").cast("decimal(18,4)"), "quantity": F.lit(4), "business_date": F.lit(DAY).cast("date")})
    row = M.map_trades_g2(M.fallback_trades(raw)).first()
    assert (row["counterparty_id"], row["trader_id"], row["status"]) == ("seller", "buyer", "EXECUTED")


def test_cash_split_and_zero_as_null(spark, day):
    cash = day[2].limit(1).withColumn("settlement_value", F.lit(None).cast("decimal(22,6)"))
    row = M.map_cash_positions(cash).first()
    assert row["long_value"] == 0 and row["short_value"] == 0 and row["net_value"] == 0
    zero = day[1].limit(1).withColumn("market_value", F.lit(0).cast("decimal(22,6)"))
    assert M.map_drvt_positions(zero).first()["settlement_price"] == 0
    assert M.map_drvt_positions(zero, zero_as_null=True).first()["settlement_price"] is None


@pytest.mark.parametrize("repeated", [["a", "b", "c"], ["a"]])
def test_tables_without_an_allowed_date_are_published_empty(spark, tmp_path, repeated):
    """Dates with a repeated trade id, a missing price or a zero sum are not exported, be it all of them."""
    from eventide.plans.queries import REGISTRY

    def put(name, rows, layout):
        df = spark.createDataFrame(rows, layout)
        df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in df.columns if c == "l_shipdate"}).write.parquet(f"{tmp_path}/{name}.parquet")

    days = {"a": "1995-01-10 00:00:00", "b": "1995-02-10 00:00:00", "c": "1995-03-10 00:00:00"}
    lines = [(k, 1, 1, n, 5.0, 10.0, "A", day) for k, (x, day) in enumerate(days.items())
             for n in ([1, 1] if x in repeated else [1, 2])]
    put("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_returnflag string, l_shipdate string")
    put("orders", [(k, 1) for k in range(3)], "o_orderkey long, o_custkey long")
    put("nation", [(1, "N")], "n_nationkey int, n_name string")
    put("supplier", [(1, 1)], "s_suppkey long, s_nationkey int")
    put("customer", [(1, 1, 20.0, "M"), (7, 1, 20.0, "M")], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string")
    put("part", [(1, "B", "T", 50, 3.0), (2, "B", "T", 50, 3.0)], "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double")
    got = REGISTRY["j10_publish"](spark, str(tmp_path)).collect()
    clean = [d[:7] for x, d in days.items() if x not in repeated]
    # Both parts lack a price, and one of the customers sums to zero; the other one's date fails for the part's price.
    assert sorted((r["table_name"], str(r["dt"])[:7]) for r in got) == sorted(("dw_trade_movements", d) for d in clean for _ in range(2))
