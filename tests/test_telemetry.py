"""Telemetry, lineage and scalar functions on small hand-written inputs."""

from __future__ import annotations

import hashlib
import json

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.functions import scalars as S
from eventide.operators import lineage as L, recon as R, telemetry as K
from eventide.sources import readers
from eventide.streaming import alerts


@pytest.fixture(scope="module")
def runs(spark):
    rows = [
        (1, "2024-01-01 00:00:10", "publish_d1_reports", "failed", 5.0, 0, 1),
        (2, "2024-01-01 00:20:00", "publish_d1_reports", "success", 7.0, 1, 1),
        (3, "2024-01-01 00:59:30", "publish_d1_reports", "failed", 9.0, 2, 1),
        (4, "2024-01-01 01:01:00", "quality_gate_d1", "failed", 1.0, 0, 0),
        (5, "2024-01-01 02:30:00", "publish_d1_reports", "failed", 2.0, 0, 0),
        (6, "2024-01-01 02:40:00", "publish_d1_reports", "success", 2.5, 0, 0),
    ]
    return spark.createDataFrame(
        rows, "event_id long, ts string, job_name string, status string, duration_seconds double, retries int, miss int"
    ).withColumns({"ts": F.to_timestamp("ts"), "sla_miss": F.col("miss") == 1})


def test_running_counts_match_a_plain_window(spark, runs):
    expect = {1: (0, 1), 2: (1, 1), 3: (1, 2), 4: (0, 1), 5: (1, 3), 6: (2, 3)}
    got = {r["event_id"]: (r["ended_ok"], r["ended_not_ok"]) for r in K.job_counters(runs).collect()}
    assert got == expect


def test_running_counts_spread_one_hot_hour(spark):
    """Half the rows lie in one second of one key: several tasks share them, with the plain window's totals."""
    hot = F.col("id") % 2 == 0
    events = spark.range(0, 20_000, 1, 6).select(
        F.col("id").alias("event_id"), F.when(hot, "hot").when(F.col("id") % 9 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("job"),
        F.when(hot, F.lit(0)).otherwise(F.col("id") * 7919 % 10_007).cast("timestamp").alias("ts"), (F.col("id") % 3 == 0).alias("flag"))
    got = K.running_counts(events, ["job"], "ts", "event_id", {"n": F.col("flag")})
    tasks = got.filter("job = 'hot'").groupBy(F.spark_partition_id()).count()
    assert tasks.count() > 2
    plain = W.partitionBy("job").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    want = events.withColumn("n", F.sum(F.col("flag").cast("long")).over(plain))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert K.running_counts(events.limit(0), [], "ts", "event_id", {"n": F.col("flag")}).collect() == []


def test_absence_counts_every_silent_minute(runs):
    at = [r["at"].strftime("%H:%M") for r in K.no_publish_alert(runs).orderBy("at").collect()]
    assert at[0] == "00:00" and at[19] == "00:19" and at[20] == "00:50" and at[-1] == "02:39" and len(at) == 20 + 110


def test_renotifications_reopen_after_the_gap(runs):
    got = [(r["job_name"], r["notify_at"].strftime("%H:%M"), r["repeat"]) for r in
           K.renotifications(runs, K.is_failed(), ["job_name"], 60, 30).orderBy("job_name", "notify_at").collect()]
    assert got == [("publish_d1_reports", "00:00", 0), ("publish_d1_reports", "00:30", 1),
                   ("publish_d1_reports", "02:30", 0), ("quality_gate_d1", "01:01", 0)]


def replay(spark, tmp_path, runs):
    """The runs as a stream of one file per event, in time order."""
    path = str(tmp_path / "in")
    for i in range(1, 7):
        runs.filter(F.col("event_id") == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_windows_equal_batch(spark, tmp_path, runs):
    keys = ["window_start", "window_end", "job_name"]
    got = alerts.run_available(alerts.job_failures(replay(spark, tmp_path, runs)), keys, "t-k2")
    want = K.job_failures(runs)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_stream_renotify_timer(spark, tmp_path, runs):
    failed = replay(spark, tmp_path, runs).filter(K.is_failed())
    got = alerts.run_available(alerts.renotify(failed, "job_name", 60, 30), [], "t-k17", "append")
    seen = {(r["job_name"], r["notify_at"].strftime("%H:%M"), r["repeat"]) for r in got.collect()}
    assert seen == {("publish_d1_reports", "00:00", 0), ("publish_d1_reports", "00:30", 1),
                    ("publish_d1_reports", "02:30", 0), ("quality_gate_d1", "01:01", 0)}


def test_stream_absence_timer(spark, tmp_path, runs):
    ok = replay(spark, tmp_path, runs).filter((F.col("job_name") == K.PUBLISH_JOB) & K.is_ok())
    got = alerts.run_available(alerts.absence_alerts(ok, "job_name", 30), [], "t-k6", "append")
    seen = [r["overdue_at"].strftime("%H:%M") for r in got.collect()]
    assert seen == ["00:50"]


def test_stream_totals(spark, tmp_path, runs):
    got = alerts.run_available(
        alerts.running_totals(replay(spark, tmp_path, runs), ["job_name"], {"failed": K.is_failed()}), ["job_name"], "t-k16")
    assert {r["job_name"]: r["failed"] for r in got.collect()} == {"publish_d1_reports": 3, "quality_gate_d1": 1}


def test_stream_of_log_lines(spark, tmp_path):
    path = str(tmp_path / "logs")
    spark.createDataFrame([('{"job_name":"a","status":"failed"}',), ("",)], "value string").write.text(path)
    got = alerts.run_available(readers.stream_job_logs(spark, path).select("job_name", "status"), [], "t-a14", "append")
    assert [tuple(r) for r in got.filter("job_name is not null").collect()] == [("a", "failed")]


def test_parse_logs_fills_defaults(spark):
    line = json.dumps({"timestamp": "2024-01-01T00:00:00Z", "job_name": "j", "status": "failed", "run_id": "r",
                       "business_date": "2024-01-01", "sla_miss": True, "dd.trace_id": "77"})
    row = K.parse_logs(spark.createDataFrame([(line,), ("junk",), (" ",)], "value string")).collect()
    assert len(row) == 1
    r = row[0]
    assert (r["ctm_job"], r["ctm_run_id"], r["trace_id"], r["span_id"]) == ("j", "r", "77", "0")
    assert r["job"]["status"] == "failed" and r["sla"]["miss"] and str(r["ctm_order_date"]) == "2024-01-01"


def test_contract_edges_and_external_io(spark):
    edges = L.lineage_edges(spark)
    ext = {(r["direction"], r["name"]) for r in L.external_io(edges.filter("job <> 'market_data_ingest'")).collect()}
    assert ("input", "src_trade_movements") in ext and ("output", "spot/dw_cash_positions.csv") in ext and len(ext) == 6
    with pytest.raises(ValueError, match="unknown dependency"):
        L.lineage_edges(spark, {"a": {"inputs": [], "outputs": [], "depends_on": ["b"]}})
    with pytest.raises(ValueError, match="unknown namespace"):
        L.lineage_edges(spark, {"a": {"inputs": [("ftp", "x")], "outputs": [], "depends_on": []}})


def test_impact_follows_both_directions_and_cycles(spark):
    edges = L.lineage_edges(spark)
    down = {r["name"]: r["depth"] for r in L.impact(edges, "src_trade_movements").collect()}
    assert down["dw_trade_movements"] == 1 and down["dq_results"] == 2 and down["spot/dw_cash_positions.csv"] == 2
    up = {r["name"] for r in L.impact(edges, "dq_results", "upstream").collect()}
    assert "src_cash_positions" in up and "dw_drvt_positions" in up
    loop = spark.createDataFrame([("j", "input", "n", "a"), ("j", "output", "n", "b"), ("k", "input", "n", "b"), ("k", "output", "n", "a")],
                                 "job string, direction string, namespace string, name string")
    assert {r["name"] for r in L.impact(loop, "a").collect()} == {"b"}


def test_impact_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds, write = [], L.materialise
    monkeypatch.setattr(L, "materialise", lambda df, label: (rounds.append(label), write(df, label))[1])
    chain = spark.range(1000).select(F.concat(F.lit("j"), F.col("id")).alias("job"), F.explode(F.array(
        F.struct(F.lit("input").alias("direction"), F.concat(F.lit("d"), F.col("id")).alias("name")),
        F.struct(F.lit("output").alias("direction"), F.concat(F.lit("d"), F.col("id") + 1).alias("name")))).alias("e")).select(
        "job", "e.direction", F.lit("n").alias("namespace"), "e.name")
    got = {r["name"]: r["depth"] for r in L.impact(chain, "d0").collect()}
    assert got == {f"d{i}": i for i in range(1, 1001)}
    assert sum(r in ("lineage-jump", "lineage-level") for r in rounds) <= 14  # 12 that jump, the start and one empty frontier


def test_impact_of_random_graphs(spark):
    rng = random.Random(3)
    for trial in range(4):
        jobs = {f"j{i}": ({f"d{rng.randrange(14)}" for _ in range(rng.choice([1, 1, 2]))}, {f"d{rng.randrange(14)}" for _ in range(rng.choice([1, 1, 2]))})
                for i in range(14)}
        rows = [(j, side, "n", d) for j, sides in jobs.items() for side, own in zip(("input", "output"), sides) for d in own]
        edges = spark.createDataFrame(rows, "job string, direction string, namespace string, name string")
        got = {(r["direction"], r["name"]): r["depth"] for r in L.impacts(edges, {"downstream": "d1", "upstream": "d2"}).collect()}
        want = {}
        for way, start in (("downstream", "d1"), ("upstream", "d2")):
            seen, level, depth = {start}, {start}, 0
            while level:
                depth += 1
                level = {o for i, o_ in jobs.values() for o in (o_ if way == "downstream" else i)
                         if (i if way == "downstream" else o_) & level} - seen
                seen |= level
                want |= {(way, d): depth for d in level}
        known = {d for i, o in jobs.values() for d in i | o}
        want = {k: v for k, v in want.items() if {"downstream": "d1", "upstream": "d2"}[k[0]] in known}
        assert got == want, trial


def test_run_events_are_nested_json(spark):
    runs = spark.createDataFrame(
        [("close_market_eod", "2024-01-02", "2024-01-03 01:02:03.456", "r1", "p1", "COMPLETE", 500, None),
         ("quality_gate_d1", "2024-01-02", "2024-01-03 01:02:03", "r2", "p1", "FAIL", 5, "boom")],
        "job_name string, business_date string, ts string, run_id string, parent_run_id string, event_type string, row_count long, error string",
    ).withColumns({"ts": F.to_timestamp("ts"), "business_date": F.to_date("business_date")})
    fields = {"dw_trade_movements": [("trade_id", "varchar")]}
    docs = {r["run_id"]: json.loads(r["event"]) for r in L.run_events(runs, L.lineage_edges(spark), fields=fields).collect()}
    ok, bad = docs["r1"], docs["r2"]
    assert ok["eventTime"] == "2024-01-03T01:02:03.456Z"
    assert ok["outputs"][0]["outputFacets"]["outputStatistics"]["rowCount"] == 500
    assert ok["outputs"][0]["facets"]["schema"]["fields"] == [{"name": "trade_id", "type": "varchar"}]
    assert bad["run"]["facets"]["errorMessage"]["message"] == "boom" and len(bad["inputs"]) == 3
    assert "outputFacets" not in bad["outputs"][0]


def test_scalars(spark):
    df = spark.createDataFrame([("a:b:c,x,k:v,k:w", "from T1 join db.T2 x\n\n y", None)], "tags string, text string, n string")
    row = df.select(S.tag_map("tags").alias("m"), S.referenced_tables("text").alias("t"), S.one_line("text").alias("l"),
                    S.uuid_from(F.lit("x")).alias("u"), S.percent(F.lit(1), F.lit(3)).alias("p"), S.percent(F.lit(1), F.lit(0)).alias("z")).first()
    assert row["m"] == {"a": "b:c", "k": "w"} and row["t"] == ["T1", "db.T2"] and row["l"] == "from T1 join db.T2 x y"
    digest = hashlib.md5(b"x").hexdigest()
    assert row["u"].replace("-", "") == digest and str(row["p"]) == "33.33" and row["z"] is None
    d = spark.createDataFrame([("id1", 12345678.5, None)], "k string, v double, n string")
    want = hashlib.sha256(b"id1|12345678.5000|None").hexdigest()
    assert d.select(S.row_hash(d, ["k", "v", "n"]).alias("h")).first()["h"] == want


def test_last_trade_ties_and_zero_volume(spark):
    t = spark.createDataFrame([("A", "2024-01-02 10:00:00", "5"), ("A", "2024-01-02 10:00:00", "7"), ("A", "2024-01-02 09:00:00", "9")],
                              "ticker string, trade_time string, price string").withColumns({
        "trade_time": F.to_timestamp("trade_time"), "price": F.col("price").cast("decimal(18,4)"), "quantity": F.lit(0),
        "business_date": F.lit("2024-01-02").cast("date"), "trade_id": F.lit("t")})
    row = R.close_prices(t).first()
    assert row["closing_price"] == 7 and row["vwap"] is None and row["trade_count"] == 3
