"""One query per operator over the given tables.

Each query takes (spark, sf_dir) and runs on whole tables. Results use plain
types (double for decimals, bigint for integers) so that two engines can be
compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators import joins, lineage as L, mapping as M, quality as Q, recon as R, sampling as D, sketches, telemetry as K
from ..schemas import (
    CLOSE_PRICES_CONTRACT,
    EXPORT_COLUMNS,
    RAW_SETTLEMENTS_CONTRACT,
    RAW_TRADES_CONTRACT,
    RUN_HISTORY,
    TRADE_MOVEMENTS_CONTRACT,
    schema,
)
from ..session import materialise, materialise_parts, prepare, scratch_dir
from ..sources import driver_tables as V, readers, sinks, versions
from ..streaming import alerts
from . import pipeline as P

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# The business date used where one date is the feature.
DAY = "1998-06-01"
CASH_DAY = "2024-01-05"
LOAD_TS = "2024-02-01 00:00:00"


def plain(df: DataFrame) -> DataFrame:
    """Decimals as double, integers as bigint, zoned timestamps as local ones."""
    casts = {T.DecimalType: "double", T.FloatType: "double", T.IntegerType: "bigint", T.ShortType: "bigint",
             T.ByteType: "bigint", T.TimestampType: "timestamp_ntz"}
    return df.select(*[
        F.col(f"`{f.name}`").cast(casts[type(f.dataType)]).alias(f.name) if type(f.dataType) in casts else F.col(f"`{f.name}`")
        for f in df.schema
    ])


def query(name: str):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(prepare(spark), sf_dir))

        REGISTRY[name] = run
        return fn

    return register


# --- shared inputs ----------------------------------------------------------
def close(spark, d):
    return R.close_prices(V.raw_trades(spark, d, "ticker", "trade_time", "price", "quantity", "business_date"))


def recon(spark, d):
    return R.settlement_recon(
        V.raw_trades(spark, d), V.raw_settlement_instructions(spark, d), trade_ids=V.raw_trades(spark, d, "trade_id"))


def dw_trades(spark, d, source="oracle"):
    return S.add_audit(M.map_trades_g1(V.src_trade_movements(spark, d)), source, ["trade_id", "trade_dt"], LOAD_TS)


def dw_drvt(spark, d):
    return M.map_drvt_positions(V.src_drvt_positions(spark, d))


def dw_cash(spark, d):
    return M.map_cash_positions(V.src_cash_positions(spark, d))


def month(c):
    return F.to_date(F.date_trunc("month", F.col(c)))


def dated_orders(spark, d):
    return V.table(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", month("o_orderdate").alias("business_date")
    )


def drop_day(spark, d):
    """Trades with a tenth removed, as the source side of the count checks."""
    return D.drill_drop_rows(V.raw_trades(spark, d, "trade_id", "business_date"), seed=7)


def trade_ids(spark, d):
    """Ids and dates of the mapped trades: no join is needed for them."""
    return M.map_trades_g1(V.src_trade_movements(spark, d, "trade_id", "business_date"), "trade_id", "trade_dt")


def landed_trades(spark, d):
    """The source trades as a stored table, which is what a load reads."""
    return materialise(V.src_trade_movements(spark, d), "src-trades")[0]


# --- A: sources and sinks ---------------------------------------------------
@query("a1_read_slice")
def _(spark, d):
    return readers.read_slice(spark, d, "orders.parquet", "o_orderdate", DAY).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("a2_equal_depth_reads")
def _(spark, d):
    """Rows of every read of a table cut by key into reads of equal depth; a view stands in for the database."""
    V.table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 10 > 0, F.col("o_custkey")).alias("o_custkey")).createOrReplaceTempView("a2_orders")
    tiles = spark.sql(readers.equal_depth_sql("a2_orders", "o_custkey", 12)).collect()
    cuts = readers.equal_depth_predicates("o_custkey", [r["low"] for r in tiles])
    parts = [spark.sql(f"SELECT {i} AS part, o_custkey FROM a2_orders WHERE {cut}") for i, cut in enumerate(cuts)]
    return reduce(DataFrame.unionByName, parts).groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("o_custkey").isNull()).alias("without_key"))


@query("a3_fallback_trades")
def _(spark, d):
    return M.fallback_trades(V.raw_trades(spark, d))


@query("a4_fallback_drvt_positions")
def _(spark, d):
    return M.fallback_drvt_positions(V.raw_participant_positions(spark, d))


@query("a5_fallback_cash_positions")
def _(spark, d):
    return M.fallback_cash_positions(V.raw_participant_positions(spark, d))


@query("a6_first_available")
def _(spark, d):
    loaders = [
        ("oracle", lambda: spark.read.parquet(f"{d}/no_such_table.parquet")),
        ("mysql_fallback", lambda: M.fallback_trades(V.raw_trades(spark, d))),
    ]
    return readers.first_available(loaders).groupBy("dw_source", "trade_dt").agg(F.count(F.lit(1)).alias("rows"))


@query("a7_replace_slice")
def _(spark, d):
    path = scratch_dir(spark, "a7")
    rows = dated_orders(spark, d)
    sinks.replace_slices(rows, path, "business_date")
    sinks.replace_slice(rows.filter("o_orderstatus = 'F'"), path, "business_date", DAY)
    sinks.replace_slice(rows.filter(F.lit(False)), path, "business_date", "1999-01-01")
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus", "business_date")


@query("a7_versioned_slices")
def _(spark, d):
    """Two tables through three changes, one of which replaces dates of both and empties one."""
    root = scratch_dir(spark, "a7-versions")
    rows = dated_orders(spark, d)
    with versions.Change(spark, root) as change:
        change.replace("all", f"{root}/all", rows, "business_date")
        change.replace("open", f"{root}/open", rows.filter("o_orderstatus = 'O'"), "business_date")
    with versions.Change(spark, root) as change:
        done = rows.filter((F.col("business_date") == DAY) & (F.col("o_orderstatus") == "F"))
        change.replace("all", f"{root}/all", done, "business_date", [DAY, "1995-03-01"])
        change.replace("open", f"{root}/open", rows.filter(F.lit(False)), "business_date", [DAY])
    versions.Change(spark, root).replace("all", f"{root}/all", rows.limit(0), "business_date", ["1996-01-01"])  # never committed
    return versions.read(spark, root, "all").withColumn("table_name", F.lit("all")).unionByName(
        versions.read(spark, root, "open").withColumn("table_name", F.lit("open")))


@query("a8_copy_table")
def _(spark, d):
    path = scratch_dir(spark, "a8")
    for day in (DAY, "1998-07-01", DAY):
        sinks.copy_table(dated_orders(spark, d), path, day)
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus", "business_date")


@query("a9_write_dq_results")
def _(spark, d):
    path = scratch_dir(spark, "a9")
    results = V.dq_history(spark, d)
    sinks.write_dq_results(results, path, "replace")
    sinks.write_dq_results(results.filter("run_id = 'run-R'"), path, "replace")
    sinks.write_dq_results(results.filter("run_id = 'run-A'"), path, "append")
    return spark.read.parquet(path).select("business_date", "run_id", "check_name", "severity", "passed", "actual_value")


@query("a10_export_parquet")
def _(spark, d):
    base = scratch_dir(spark, "a10")
    rows = S.for_date(dw_trades(spark, d), "trade_dt", DAY).select(*EXPORT_COLUMNS["dw_trade_movements"])
    target = sinks.export_parquet(rows, f"{base}/derivatives/dw_trade_movements", DAY)
    return spark.read.parquet(target).drop("dw_load_dt")


@query("a11_export_csv")
def _(spark, d):
    base = scratch_dir(spark, "a11")
    rows = S.for_date(V.src_cash_positions(spark, d), "business_date", CASH_DAY).select(
        "position_id", "instrument_code", "settlement_value", "business_date")
    target = sinks.export_csv(rows, f"{base}/spot/cash", CASH_DAY)
    return spark.read.option("header", True).csv(target)


def history(spark, d):
    r = V.job_runs(spark, d)
    runs = K.run_summary(r)
    jobs = r.groupBy("run_id", "job_name").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.sum("duration_seconds").alias("duration_seconds"))
    maps = jobs.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("job_name", F.struct("status", "duration_seconds")))).alias("job_summary"))
    return runs.join(maps, "run_id").select(
        F.col("finished_at").alias("timestamp"), F.lit("d1_pipeline").alias("pipeline"), "run_id", "business_date",
        "status", F.col("duration_seconds").cast("double").alias("duration_seconds"), "finished_at",
        F.size("job_summary").alias("job_count"), "job_summary",
    )


@query("a12_append_run_history")
def _(spark, d):
    path = scratch_dir(spark, "a12")
    h = history(spark, d)
    sinks.append_run_history(h.filter("status = 'ended_ok'"), path)
    sinks.append_run_history(h.filter("status <> 'ended_ok'"), path)
    return spark.read.schema(schema(RUN_HISTORY)).json(path).select(
        "run_id", "business_date", "status", "job_count",
        F.map_contains_key("job_summary", "publish_d1_reports").alias("has_publish"))


def log_lines(runs: DataFrame) -> DataFrame:
    """Job runs as JSON log lines; the nested parts are left to the reader."""
    record = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), "job_name", "run_id",
        F.date_format("business_date", "yyyy-MM-dd").alias("business_date"), "status", "duration_seconds", "retries",
        "sla_miss", "output_rows", "error", "message", "gate_status", F.col("event_id").cast("string").alias("trace_id"),
    )
    return runs.select("event_id", F.to_json(record).alias("value"))


@query("a13_read_job_logs")
def _(spark, d):
    path = scratch_dir(spark, "a13")
    lines = log_lines(V.job_runs(spark, d))
    broken = F.col("event_id") % 10
    lines.select(
        F.when(broken == 0, "").when(broken == 1, F.expr("left(value, 20)")).otherwise(F.col("value")).alias("value")
    ).write.text(path)
    return readers.read_job_logs(spark, path).select("trace_id", "timestamp", "job_name", "status", "duration_seconds", "sla_miss")


@query("a14_stream_job_logs")
def _(spark, d):
    path = scratch_dir(spark, "a14")
    log_lines(V.job_runs(spark, d)).select("value").write.text(path)
    logs = readers.stream_job_logs(spark, path).select("trace_id", "timestamp", "job_name", "status")
    return alerts.run_available(logs, [], "a14", "append")


@query("a15_upsert")
def _(spark, d):
    trades = V.raw_trades(spark, d, "ticker", "trade_time", "price", "quantity", "business_date")
    old = R.close_prices(trades.filter(F.col("business_date") < DAY)).select(
        "ticker", "business_date", F.col("closing_price"), "daily_volume", F.round("vwap", 4).alias("vwap"), "auction_flag")
    new = R.close_by_vwap(trades.filter(F.col("business_date") >= "1998-01-01")).withColumn("auction_flag", F.lit(True))
    return sinks.upsert(old, new, ["ticker", "business_date"], ["closing_price", "daily_volume", "vwap"])


@query("a16_insert_missing")
def _(spark, d):
    c = V.table(spark, d, "customer")
    held = V.table(spark, d, "orders").select(F.col("o_custkey").alias("participant_code")).distinct().withColumn("desk", F.lit("trading"))
    rows = c.select(F.col("c_custkey").alias("participant_code"), F.col("c_mktsegment").alias("desk"))
    return sinks.insert_missing(held, rows.unionByName(rows.withColumn("desk", F.lit("ZZ"))), ["participant_code"])


@query("a17_split_valid")
def _(spark, d):
    rows = M.map_trades_g1(V.src_trade_movements(spark, d)).withColumns({
        "status": F.when(F.col("status") == "", F.lit(None)).otherwise(F.col("status")),
        "notional": F.col("notional") * F.when(F.col("quantity") == 50, F.lit(1000000000)).otherwise(F.lit(1)),
    })
    good, rejects = sinks.split_valid(rows, TRADE_MOVEMENTS_CONTRACT)
    return good.select("trade_dt", F.lit("good").alias("side"), F.lit("").alias("reasons")).unionByName(
        rejects.select("trade_dt", F.lit("rejected").alias("side"), F.array_join("reject_reasons", ",").alias("reasons"))
    ).groupBy("trade_dt", "side", "reasons").agg(F.count(F.lit(1)).alias("rows"))


# --- B: projections and filters ---------------------------------------------
@query("b1_for_date")
def _(spark, d):
    orders = V.table(spark, d, "orders")
    text = orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    exact = S.for_date(orders, "o_orderdate", DAY).select("o_orderkey", F.lit("timestamp").alias("kind"))
    return exact.unionByName(S.for_date(text, "day", DAY).select("o_orderkey", F.lit("text").alias("kind")))


@query("b2_map_trades_g1")
def _(spark, d):
    return M.map_trades_g1(V.src_trade_movements(spark, d))


@query("b3_map_trades_g2")
def _(spark, d):
    rows = M.fallback_trades(V.raw_trades(spark, d)).withColumns({
        "notional": F.when(F.col("quantity") < 49, F.col("notional")),
        "status": F.when(F.col("quantity") > 2, F.when(F.col("quantity") > 4, F.col("status")).otherwise("")),
        "quantity": F.when(F.col("quantity") > 1, F.col("quantity")),
        "trade_dt": F.concat(F.col("trade_dt").cast("string"), F.lit("T00:00:00")),
    })
    return M.map_trades_g2(rows)


@query("b4_map_drvt_positions")
def _(spark, d):
    return M.map_drvt_positions(V.src_drvt_positions(spark, d))


@query("b5_cash_sign_split")
def _(spark, d):
    return M.map_cash_positions(V.src_cash_positions(spark, d))


@query("b6_row_hash")
def _(spark, d):
    t = M.map_trades_g1(V.src_trade_movements(spark, d)).withColumn("notional", F.col("notional").cast("decimal(18,4)"))
    return t.select(
        "trade_id", S.row_hash(t, ["trade_id", "trade_dt"]).alias("hash_g1"),
        S.row_hash(t, ["trade_id", "ticker", "notional", "quantity", "trade_dt"]).alias("hash_g2"),
    )


@query("b6_hash_diff")
def _(spark, d):
    """What a load of changed rows would insert, update and delete per date, beside what stays."""
    t = V.raw_trades(spark, d, "trade_id", "price", "quantity", "business_date")
    fresh = t.filter(F.col("quantity") != 7).withColumns({
        "price": F.when(F.col("quantity") == 50, F.col("price") + 1).otherwise(F.col("price")),
        "trade_id": F.when(F.col("quantity") == 9, F.concat("trade_id", F.lit("-new"))).otherwise(F.col("trade_id"))})
    late = F.col("business_date") >= "1995-06-01"  # earlier dates arrive as they are stored
    fresh = fresh.filter(late).unionByName(t.filter(~late))
    diff = sinks.hash_diff(t, fresh, "business_date", ["trade_id"], ["trade_id", "price", "quantity"])
    by_date, _ = materialise(sinks.diff_by_date(diff, "business_date"), "b6-diff")  # a row per date, read twice
    changed = sinks.changed_dates(by_date, "business_date").withColumn("written", F.lit(True))
    return by_date.join(changed, "business_date", "left").withColumn("written", F.coalesce("written", F.lit(False)))


@query("b7_add_audit")
def _(spark, d):
    cash = dw_cash(spark, d)
    return S.add_audit(cash, "oracle", ["position_id", "position_date"], LOAD_TS).select(
        "position_id", "dw_load_dt", "dw_source", "dw_row_hash")


@query("b8_volume_category")
def _(spark, d):
    o = V.table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,4)")).alias("volume"))
    return o.select("o_custkey", S.volume_category("volume").alias("volume_category"))


@query("b9_export_columns")
def _(spark, d):
    rows = dw_drvt(spark, d)
    return S.add_audit(rows, "oracle", ["position_id", "position_date"], LOAD_TS).select(*EXPORT_COLUMNS["dw_drvt_positions"])


@query("b11_run_sql")
def _(spark, d):
    V.table(spark, d, "orders").createOrReplaceTempView("b11_orders")
    text = """SELECT o_orderstatus, count(*) AS orders, sum(CAST(o_totalprice AS decimal(18,4))) AS total
              FROM b11_orders WHERE o_orderdate >= CAST('%%ODATE%%' AS date) GROUP BY o_orderstatus"""
    return Q.run_sql(spark, text, DAY)


@query("b12_active_participants")
def _(spark, d):
    c = V.table(spark, d, "customer").select(
        F.col("c_name").alias("participant_code"), (F.col("c_acctbal") > 5000).alias("active"))
    none = c.withColumn("active", F.lit(False))
    return M.active_participants(c).withColumn("case", F.lit("some")).unionByName(
        M.active_participants(none).withColumn("case", F.lit("none")))


# --- C: joins ---------------------------------------------------------------
@query("c1_settlement_recon")
def _(spark, d):
    return recon(spark, d).drop("buyer_participant", "seller_participant")


@query("c1_frequent_keys")
def _(spark, d):
    """Parts with more than a 1,500th of all trades: found by the sketch, and how far its counts are off."""
    line = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"))
    found = joins.frequent_keys(line, "k").select("rows", F.explode("items").alias("item")).select(
        F.col("item.item").alias("k"), F.col("item.count").alias("estimate"), "rows")
    true = line.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = true.filter(F.col("n") * 1500 > line.agg(F.count(F.lit(1))).scalar())
    off = F.abs(F.col("estimate") - F.col("n"))
    return hot.join(found, "k", "left").select(
        "k", "n", F.coalesce(off <= F.col("rows") * joins.count_error(1), F.lit(False)).alias("within_error"))


@query("c3_position_recon")
def _(spark, d):
    return R.position_recon(V.raw_participant_positions(spark, d), V.raw_trades(
        spark, d, "ticker", "quantity", "buyer_participant", "seller_participant", "business_date"))


@query("c4_participant_exposure")
def _(spark, d):
    positions = V.raw_participant_positions(spark, d).select(
        F.col("participant").alias("participant_id"), "ticker", "business_date",
        F.col("net_quantity").alias("declared_quantity"), F.lit(0).alias("traded_net_qty"),
        F.col("net_quantity").alias("quantity_diff"), F.lit("BREAK").alias("recon_status"))
    return R.participant_exposure(positions, close(spark, d))


@query("c5_orphan_instructions")
def _(spark, d):
    return R.orphan_instructions(
        V.raw_settlement_instructions(spark, d), V.raw_trades(spark, d, "trade_id", "business_date")
    ).select("instruction_id", "trade_id", "business_date", "status")


@query("c6_rows_in")
def _(spark, d):
    orders = V.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    big = V.table(spark, d, "lineitem").filter("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.rows_in(orders, big, "o_orderkey").withColumn("side", F.lit("in")).unionByName(
        joins.rows_not_in(orders, big, "o_orderkey").withColumn("side", F.lit("out")))


@query("c7_net_positions_full_outer")
def _(spark, d):
    t = V.raw_trades(spark, d, "ticker", "quantity", "buyer_participant", "seller_participant", "business_date")
    return R.net_positions_full_outer(t)


@query("c8_cross_count")
def _(spark, d):
    return joins.cross_count(V.table(spark, d, "lineitem"), V.table(spark, d, "orders").filter("o_orderstatus = 'F'"))


@query("c9_row_count_parity")
def _(spark, d):
    return R.row_count_parity(drop_day(spark, d), V.raw_trades(spark, d, "trade_id", "business_date"), "business_date", "business_date")


@query("c10_enrich_trades")
def _(spark, d):
    t = V.raw_trades(spark, d, "trade_id", "ticker", "price", "business_date")
    return R.enrich_trades(t, close(spark, d)).select(
        "trade_id", "ticker", "business_date", "price", "closing_price", "price_vs_close_pct")


@query("c11_settlement_recon_detailed")
def _(spark, d):
    t = V.raw_trades(spark, d, "trade_id", "ticker", "price", "quantity", "business_date")
    return R.settlement_recon_detailed(t, V.raw_settlement_instructions(spark, d), V.raw_trades(spark, d, "trade_id"))


# --- D: aggregations --------------------------------------------------------
@query("d1_trade_stats")
def _(spark, d):
    t = V.raw_trades(spark, d, "ticker", "price", "quantity", "business_date")
    return R.trade_stats(t).withColumn("vwap", F.round("vwap", 6))


@query("d2_close_by_vwap")
def _(spark, d):
    return R.close_by_vwap(V.raw_trades(spark, d, "ticker", "price", "quantity", "business_date"))


@query("d3_net_traded")
def _(spark, d):
    return R.net_traded(V.raw_trades(
        spark, d, "ticker", "quantity", "buyer_participant", "seller_participant", "business_date"))


@query("d4_participant_positions")
def _(spark, d):
    return V.raw_participant_positions(spark, d)


@query("d5_settlement_report")
def _(spark, d):
    t = V.raw_trades(spark, d, "trade_id", "business_date", "price", "quantity")
    return R.settlement_report_from_raw(t, V.raw_settlement_instructions(spark, d))


@query("d6_excess_duplicates")
def _(spark, d):
    return Q.excess_duplicates(V.raw_trades(spark, d, "trade_id", "business_date"), "trade_id", ["business_date"])


@query("d7_rows_minus_distinct")
def _(spark, d):
    t = V.raw_trades(spark, d, "trade_id", "business_date", "quantity")
    keyed = t.withColumn("trade_id", F.when(F.col("quantity") > 1, F.col("trade_id")))
    return Q.rows_minus_distinct(keyed, "trade_id", ["business_date"])


@query("d8_duplicate_keys")
def _(spark, d):
    return Q.duplicate_keys(V.raw_trades(spark, d, "trade_id", "business_date"), "trade_id", ["business_date"])


@query("d10_dq_summary")
def _(spark, d):
    return Q.dq_summary(V.dq_history(spark, d))


@query("d11_gate_status")
def _(spark, d):
    return Q.gate_status(V.dq_history(spark, d), ["business_date", "run_id"])


def gauges(spark, d):
    return Q.daily_gauges(
        trade_ids(spark, d), dw_drvt(spark, d), dw_cash(spark, d),
        V.src_trade_movements(spark, d, "trade_id", "business_date"), V.src_drvt_positions(spark, d), V.src_cash_positions(spark, d))


@query("d12_daily_gauges")
def _(spark, d):
    return gauges(spark, d).select("business_date", "metric", "value", F.col("tags")["table"].alias("table_name"), F.col("tags")["db"].alias("db"))


# --- E: window-shaped -------------------------------------------------------
@query("e1_last_trade")
def _(spark, d):
    return R.last_trade(V.raw_trades(spark, d, "ticker", "trade_time", "price", "business_date"))


@query("e2_running_counts")
def _(spark, d):
    return K.job_counters(V.job_runs(spark, d)).select("event_id", "job_name", "ended_ok", "ended_not_ok", "sla_violations")


@query("e3_last_value")
def _(spark, d):
    return R.latest_value(V.job_runs(spark, d), ["user_id"], "ts", "output_rows", "event_id")


@query("e4_latest_run")
def _(spark, d):
    return Q.latest_run(V.dq_history(spark, d)).select("business_date", "run_id", "check_name", "passed", "actual_value")


# --- F: sort, limit, sample -------------------------------------------------
@query("f1_recent_runs")
def _(spark, d):
    h = K.run_summary(V.job_runs(spark, d))
    return K.recent_runs(h, "finished_at", 50, "run_id").select("run_id", "finished_at", "status")


@query("f2_top_n")
def _(spark, d):
    r = V.job_runs(spark, d).withColumn("user", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return K.top_n(r, "user", F.sum("retries"), 10, "total_retries")


@query("f3_offender_samples")
def _(spark, d):
    t = V.raw_trades(spark, d, "trade_id", "quantity", "business_date")
    return Q.offender_samples(t, ["trade_id", "quantity"], F.col("quantity") >= 50, ["business_date"])


@query("f4_sample_rows")
def _(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    share = D.sample_rows(o, "o_orderkey", seed=11, fraction=0.05).withColumn("kind", F.lit("share"))
    return share.unionByName(D.sample_rows(o, "o_orderkey", seed=11, n=20).withColumn("kind", F.lit("rows")))


@query("s3_external_io")
def _(spark, d):
    return L.external_io(V.observed_edges(spark, d))


# --- H: scalar functions ----------------------------------------------------
@query("h1_substring")
def _(spark, d):
    return V.table(spark, d, "part").select("p_partkey", F.substring("p_name", 1, 5).alias("prefix"))


@query("h2_lpad_concat")
def _(spark, d):
    return V.table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("TRD-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"),
                               F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("trade_id"))


@query("h3_dates")
def _(spark, d):
    return V.table(spark, d, "orders").select(
        "o_orderkey", F.to_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("parsed"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("text"), F.to_date("o_orderdate").alias("truncated"))


@query("h4_date_add")
def _(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), 2).alias("settles"))


@query("h5_date_tag")
def _(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", S.date_tag("o_orderdate").alias("tag"))


@query("h6_iso_millis")
def _(spark, d):
    return V.job_runs(spark, d).select("event_id", S.iso_millis("ts").alias("utc"), S.iso_millis("ts", -3).alias("shifted"))


@query("h7_numeric")
def _(spark, d):
    v = F.col("c_acctbal").cast("decimal(18,4)") - F.lit(5000)
    return V.table(spark, d, "customer").select(
        "c_custkey", F.abs(v).alias("abs_v"), F.greatest(v, F.lit(0)).alias("greatest_v"),
        F.least(v, F.lit(0)).alias("least_v"), F.round(v, 1).alias("round_v"), (F.col("c_custkey") % 7).alias("mod_v"))


@query("h8_null_functions")
def _(spark, d):
    v = F.nullif(F.col("settlement_value"), F.lit(0))
    return V.src_cash_positions(spark, d).select(
        "position_id", v.alias("nullif_v"), F.coalesce(v, F.lit(-1)).alias("coalesce_v"),
        F.nvl(F.col("settlement_value"), F.lit(0).cast("decimal(22,6)")).alias("nvl_v"))


@query("h9_case_when")
def _(spark, d):
    s = F.col("o_orderstatus")
    return V.table(spark, d, "orders").select(
        "o_orderkey", F.when(s == "F", "MATCHED").when(s == "P", "BREAK").otherwise("MISSING_INSTRUCTION").alias("label"))


@query("h10_casts")
def _(spark, d):
    return V.table(spark, d, "events").select(
        "event_id", F.col("value").cast("decimal(18,4)").alias("exact"), F.col("user_id").cast("string").alias("text"),
        F.col("event_type").try_cast("int").alias("bad_int"), F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("h11_hashes")
def _(spark, d):
    return V.table(spark, d, "customer").select(
        "c_custkey", F.sha2("c_name", 256).alias("sha"), S.uuid_from("c_name", "c_mktsegment").alias("id"))


@query("h12_uuid")
def _(spark, d):
    ids = V.table(spark, d, "orders").select(F.uuid().alias("id"))
    return ids.agg(F.count(F.lit(1)).alias("ids"), F.count_distinct("id").alias("distinct_ids"),
                   F.count_if(F.length("id") == 36).alias("well_formed"))


@query("h13_referenced_tables")
def _(spark, d):
    return V.table(spark, d, "documents").select(
        "doc_id", F.array_join(S.referenced_tables("text"), ",").alias("tables"))


@query("h14_json")
def _(spark, d):
    e = V.table(spark, d, "events")
    parsed = F.from_json("props", "k int")["k"]
    return e.select("event_id", parsed.alias("k"), F.to_json(F.struct(F.col("event_type").alias("type"), parsed.alias("k"))).alias("doc"))


@query("h15_tag_map")
def _(spark, d):
    e = V.table(spark, d, "events")
    tags = F.concat(F.lit("job:"), F.col("event_type"), F.lit(",junk,url:a:b:"), F.col("user_id").cast("string"), F.lit(",job:last"))
    m = S.tag_map(tags)
    return e.select("event_id", m["job"].alias("job"), m["url"].alias("url"), F.size(m).alias("tags"))


@query("h16_tail_text")
def _(spark, d):
    return V.table(spark, d, "documents").select("doc_id", S.tail_text("text", 80).alias("tail"))


@query("h17_one_line")
def _(spark, d):
    return V.table(spark, d, "documents").select("doc_id", S.one_line("text").alias("line"))


# --- I: checks --------------------------------------------------------------
@query("i1_duplicate_trades")
def _(spark, d):
    t = trade_ids(spark, d)
    return Q.check_duplicate_trades(t).unionByName(Q.check_duplicate_trades(t, style="g2"))


@query("i2_duplicate_ids")
def _(spark, d):
    return Q.check_duplicate_ids(V.raw_trades(spark, d, "trade_id", "business_date"))


@query("i3_null_price")
def _(spark, d):
    return Q.check_null_price(dw_drvt(spark, d)).unionByName(Q.check_null_price(dw_drvt(spark, d), style="g2"))


@query("i4_null_close")
def _(spark, d):
    c = close(spark, d).withColumn("closing_price", F.when(F.col("daily_volume") > 300, F.col("closing_price")))
    return Q.check_null_close(c)


@query("i5_required_fields")
def _(spark, d):
    t = V.raw_trades(spark, d, "trade_id", "ticker", "price", "quantity", "business_date")
    return Q.check_required_fields(t.withColumn("quantity", F.when(F.col("quantity") != 50, F.col("quantity"))))


@query("i6_zero_sum")
def _(spark, d):
    return Q.check_zero_sum(dw_cash(spark, d)).unionByName(Q.check_zero_sum(dw_cash(spark, d), style="g2"))


@query("i7_source_zero_sum")
def _(spark, d):
    return Q.source_zero_sum(V.src_cash_positions(spark, d))


@query("i8_source_duplicates")
def _(spark, d):
    return Q.source_duplicates(V.src_trade_movements(spark, d, "trade_id", "business_date"))


@query("i9_row_count_equal")
def _(spark, d):
    return Q.check_row_count_equal(
        drop_day(spark, d), V.raw_trades(spark, d, "trade_id", "business_date"), "business_date", "business_date")


@query("i10_row_count_tolerance")
def _(spark, d):
    t = V.raw_trades(spark, d, "trade_id", "business_date")
    return Q.check_row_count_tolerance(drop_day(spark, d), t, "business_date", "business_date").unionByName(
        Q.check_row_count_tolerance(None, t, "business_date", "business_date"))


@query("i11_overflow")
def _(spark, d):
    t = dw_trades(spark, d).withColumns({
        "notional": F.col("notional") * F.when(F.col("quantity") == 50, F.lit(1000000000)).otherwise(F.lit(1)),
        "dw_source": F.when(F.col("quantity") == 49, "fault_overflow").otherwise(F.col("dw_source")),
    })
    return Q.check_overflow(t)


@query("i12_orphan_instructions")
def _(spark, d):
    return Q.check_orphans(V.raw_settlement_instructions(spark, d), V.raw_trades(spark, d, "trade_id", "business_date"))


@query("i13_trades_without_instruction")
def _(spark, d):
    return Q.check_uninstructed_trades(recon(spark, d).select("business_date", "recon_status"))


@query("i14_positive_values")
def _(spark, d):
    t = V.raw_trades(spark, d, "trade_id", "price", "quantity", "business_date")
    return Q.check_positive(t.withColumns({"price": F.col("price") - 1000, "quantity": F.col("quantity") - 1}))


@query("i15_volume_range")
def _(spark, d):
    return Q.check_volume_range(close(spark, d), bounds=(400, 1200))


@query("i16_quality_table")
def _(spark, d):
    t = V.raw_trades(spark, d, "trade_id", "price", "quantity")
    return Q.quality_table(close(spark, d), t, recon(spark, d).select("recon_status"))


@query("i17_timeliness")
def _(spark, d):
    sla = {j: s / 10 for j, s in V.JOB_SLA_SECONDS.items()}
    return Q.check_timeliness(V.job_runs(spark, d), sla)


@query("i18_expect_sql")
def _(spark, d):
    V.table(spark, d, "orders").createOrReplaceTempView("i18_orders")
    counted = "SELECT o_orderkey FROM i18_orders WHERE o_orderdate >= CAST('$ODATE' AS date) ORDER BY o_orderkey"
    single = "SELECT count(*) AS n FROM i18_orders"
    cases = [(counted, "count_gt", 2), (counted, "count_eq", 3), (single, "value_eq", -1), (counted, None, None)]
    out = None
    for i, (text, check, value) in enumerate(cases):
        row = Q.expect_sql(spark, text, check, value, DAY).select(
            F.lit(i).alias("case_no"), "status", "row_count", F.size("sample").alias("sampled"), "error")
        out = row if out is None else out.unionByName(row)
    return out


@query("i19_contract")
def _(spark, d):
    t = V.raw_trades(spark, d, "trade_id", "order_id", "ticker", "trade_time", "price", "quantity",
                     "buyer_participant", "seller_participant", "business_date")
    bad = t.withColumns({
        "order_id": F.when(F.col("quantity") != 50, F.col("order_id").cast("string")),
        "ticker": F.when(F.col("quantity") == 1, F.concat("ticker", F.lit("-LONGNAME"))).otherwise(F.col("ticker")),
    })
    odd = V.raw_settlement_instructions(spark, d).withColumn(
        "status", F.when(F.col("quantity") == 7, "UNKNOWN").otherwise(F.col("status")))
    prices = close(spark, d).select("ticker", "business_date", "closing_price", "daily_volume", "vwap", "auction_flag")
    return (
        Q.check_contract(bad, RAW_TRADES_CONTRACT)
        .unionByName(Q.check_contract(odd, RAW_SETTLEMENTS_CONTRACT))
        .unionByName(Q.check_contract(prices.unionByName(prices), CLOSE_PRICES_CONTRACT))
    )


@query("i20_all_in_one")
def _(spark, d):
    return Q.check_all_in_one(trade_ids(spark, d), dw_drvt(spark, d), dw_cash(spark, d))


@query("i21_gate")
def _(spark, d):
    return Q.gate_status(Q.latest_run(V.dq_history(spark, d)), ["business_date"])


@query("i22_publish_guard")
def _(spark, d):
    h = V.dq_history(spark, d)
    return Q.publish_guard(h).withColumn("policy", F.lit("latest")).unionByName(
        Q.publish_guard(h, all_runs=True).withColumn("policy", F.lit("all")))


# --- J: models and jobs -----------------------------------------------------
@query("j1_close_prices")
def _(spark, d):
    return close(spark, d).withColumn("vwap", F.round("vwap", 6))


@query("j2_close_snapshot")
def _(spark, d):
    return R.close_snapshot(close(spark, d).withColumn("daily_volume", F.col("daily_volume") * 500)).withColumn("vwap", F.round("vwap", 6))


@query("j3_settlement_recon")
def _(spark, d):
    return recon(spark, d).groupBy("business_date", "recon_status", "settlement_status").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("notional_value").alias("notional"))


@query("j4_position_recon")
def _(spark, d):
    p = R.position_recon(V.raw_participant_positions(spark, d), V.raw_trades(
        spark, d, "ticker", "quantity", "buyer_participant", "seller_participant", "business_date"))
    return p.groupBy("business_date", "recon_status").agg(
        F.count(F.lit(1)).alias("positions"), F.sum("quantity_diff").alias("total_diff"))


@query("j5_d1_settlement_report")
def _(spark, d):
    return R.settlement_report(recon(spark, d))


@query("j6_participant_exposure_report")
def _(spark, d):
    t = V.raw_trades(spark, d)
    return R.participant_exposure(R.position_recon(V.raw_participant_positions(spark, d), t), R.close_prices(t))


@query("j6_exposure_one_pass")
def _(spark, d):
    t = V.raw_trades(spark, d, "ticker", "trade_time", "price", "quantity", "buyer_participant", "seller_participant",
                     "business_date", "returnflag")
    return R.exposure_in_one_pass(t, F.col("returnflag") != "R")


@query("j7_derive_instructions")
def _(spark, d):
    t = V.raw_trades(spark, d, "trade_id", "ticker", "price", "quantity", "buyer_participant", "business_date")
    return M.derive_instructions(t, "MATCHED")


@query("j8_derive_positions")
def _(spark, d):
    return M.derive_positions(V.raw_participant_positions(spark, d))


@query("j9_load_tables")
def _(spark, d):
    paths = P.Paths(scratch_dir(spark, "j9"))
    with versions.Change(spark, paths.root) as change:
        P.load_trades(landed_trades(spark, d), paths, load_ts=LOAD_TS, change=change)
        P.load_positions(V.src_drvt_positions(spark, d), V.src_cash_positions(spark, d), paths, load_ts=LOAD_TS, change=change)
    t = P.read_table(spark, paths, "dw_trade_movements").select(
        F.lit("dw_trade_movements").alias("table_name"), F.col("trade_dt").alias("business_date"), "dw_source",
        F.col("notional").alias("measure"))
    p = P.read_table(spark, paths, "dw_drvt_positions").select(
        F.lit("dw_drvt_positions"), "position_date", "dw_source", "settlement_price")
    c = P.read_table(spark, paths, "dw_cash_positions").select(F.lit("dw_cash_positions"), "position_date", "dw_source", "net_value")
    return t.union(p).union(c).groupBy("table_name", "business_date", "dw_source").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("measure").alias("measure"))


@query("j10_publish")
def _(spark, d):
    """All checks of the gate, two publications of every other date each, and all three exports read back."""
    paths = P.Paths(scratch_dir(spark, "j10"))
    src = {"trades": landed_trades(spark, d), "drvt": V.src_drvt_positions(spark, d), "cash": V.src_cash_positions(spark, d)}
    with versions.Change(spark, paths.root) as change:
        days = P.load_trades(src["trades"], paths, load_ts=LOAD_TS, change=change)["dates"]
        days += P.load_positions(src["drvt"], src["cash"], paths, load_ts=LOAD_TS, change=change)["dates"]
    P.quality_gate(spark, paths, src, "run-1", LOAD_TS)
    for part in (days[0::2], days[1::2]):
        cash = P.publish_dates(spark, paths, dates=part)[-1]
    layout = schema("position_id string, ticker string, participant_code string, position_date string, long_value string, "
                    "short_value string, net_value string, dw_load_dt string, dw_source string, dt date")
    text = F.lit(None).cast("string").alias("text")
    return (
        P.published(spark, paths, "dw_trade_movements").select(
            F.lit("dw_trade_movements").alias("table_name"), F.col("trade_id").alias("id"), F.col("notional").alias("measure"), text, "dt")
        .union(P.published(spark, paths, "dw_drvt_positions").select(F.lit("dw_drvt_positions"), "position_id", "settlement_price", text, "dt"))
        .union(spark.read.schema(layout).option("header", True).csv(cash).select(
            F.lit("dw_cash_positions"), "position_id", F.col("net_value").cast("decimal(18,4)"),
            F.concat_ws("|", "long_value", "short_value"), "dt")))


@query("j11_run_d1")
def _(spark, d):
    paths = P.Paths(scratch_dir(spark, "j11"))
    return P.run_d1(
        spark, paths, landed_trades(spark, d), V.src_drvt_positions(spark, d), V.src_cash_positions(spark, d),
        "run-1", LOAD_TS)


@query("j11_run_d1_g2")
def _(spark, d):
    paths = P.Paths(scratch_dir(spark, "j11-g2"))
    trades, _ = materialise_parts([M.map_trades_g1(part).withColumn("business_date", F.col("trade_dt"))
                                   for part in V.src_trade_parts(spark, d)], "j11-g2-trades")
    drvt, cash = M.map_drvt_positions(V.src_drvt_positions(spark, d)), M.map_cash_positions(V.src_cash_positions(spark, d))
    return P.run_d1(
        spark, paths, trades, drvt.withColumn("business_date", F.col("position_date")),
        cash.withColumn("business_date", F.col("position_date")), "run-1", LOAD_TS, generation="g2")


@query("j12_publish_reports")
def _(spark, d):
    path = scratch_dir(spark, "j12")
    t = V.raw_trades(spark, d, "trade_id", "business_date", "price", "quantity")
    report, _ = materialise(R.settlement_report_from_raw(t, V.raw_settlement_instructions(spark, d)), "j12-report")
    positions = R.position_recon(V.raw_participant_positions(spark, d), V.raw_trades(
        spark, d, "ticker", "quantity", "buyer_participant", "seller_participant", "business_date"))
    exposure, _ = materialise(R.participant_exposure(positions, close(spark, d)), "j12-exposure")
    early = F.col("business_date") < "1995-06-01"  # two publications; the second leaves the first one's dates alone
    for part in (early, ~early):
        P.publish_reports(report.filter(part), exposure.filter(part), path)
    a = spark.read.parquet(f"{path}/exports/d1_settlement_report").select(
        "dt", F.lit("settlement").alias("report"), F.col("total_trades").alias("measure"))
    b = spark.read.option("header", True).csv(f"{path}/exports/participant_exposure_report").select(
        "dt", F.lit("exposure").alias("report"), F.col("quantity_diff").cast("long").alias("measure"))
    return a.unionByName(b).groupBy("dt", "report").agg(F.count(F.lit(1)).alias("rows"), F.sum("measure").alias("measure"))


# --- K: telemetry -----------------------------------------------------------
@query("k1_parse_logs")
def _(spark, d):
    lines = log_lines(V.job_runs(spark, d))
    bad = F.col("event_id") % 10 == 3
    logs = K.parse_logs(lines.select(F.when(bad, "not json").otherwise(F.col("value")).alias("value")))
    return logs.select(
        "trace_id", "timestamp", "ctm_job", "ctm_order_date", "ctm_run_id", F.col("job")["status"].alias("job_status"),
        F.col("sla")["miss"].alias("sla_miss"), "duration_seconds")


@query("k2_job_failures_5m")
def _(spark, d):
    return alerts.run_available(
        alerts.job_failures(V.stream_job_runs(spark, d)), ["window_start", "window_end", "job_name"], "k2")


@query("k3_sla_misses_10m")
def _(spark, d):
    return alerts.run_available(
        alerts.sla_misses(V.stream_job_runs(spark, d)), ["window_start", "window_end", "job_name"], "k3")


@query("k4_gate_failures_10m")
def _(spark, d):
    return alerts.run_available(alerts.gate_failures(V.stream_job_runs(spark, d)), ["window_start", "window_end"], "k4")


@query("k5_log_alerts_5m")
def _(spark, d):
    return alerts.run_available(
        alerts.log_alerts(V.stream_job_runs(spark, d)), ["window_start", "window_end", "alert"], "k5")


@query("k6_no_publish_30m")
def _(spark, d):
    return K.no_publish_alert(V.job_runs(spark, d))


@query("k7_threshold_alert")
def _(spark, d):
    return alerts.run_available(
        alerts.threshold_alert(V.stream_job_runs(spark, d), warn=40.0, critical=60.0), ["window_start", "window_end"], "k7")


@query("k8_duration_by_job")
def _(spark, d):
    return K.duration_by_job(V.job_runs(spark, d))


@query("k8_duration_p95")
def _(spark, d):
    return K.duration_by_job(V.job_runs(spark, d), "1 day", 0.95)


def five_minutes(spark, d):
    """Stored quantile sketches of the run times per job and five minutes."""
    return materialise(sketches.quantile_sketches(V.job_runs(spark, d), ["job_name"], "duration_seconds"), "k8-sketches")[0]


@query("k8_quantile_sketches")
def _(spark, d):
    """Daily quantiles merged from five-minute sketches, judged by their rank among the day's run times."""
    asked = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    merged = sketches.merge_quantiles(five_minutes(spark, d), ["job_name"], "1 day", asked)
    runs = V.job_runs(spark, d).select(
        F.col("job_name"), F.date_trunc("day", "ts").alias("window_start"), "duration_seconds")
    ranks = runs.join(merged, ["job_name", "window_start"]).groupBy("job_name", "window_start").agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("duration_seconds") < F.col(q)).alias(f"b_{q}") for q in asked],
        *[F.count_if(F.col("duration_seconds") <= F.col(q)).alias(f"u_{q}") for q in asked])
    slack = F.lit(2 * sketches.rank_error()) * F.col("n") + 1  # twice the bound of 99 %: many are judged
    near = [((F.col(f"b_{q}") <= share * F.col("n") + slack) & (F.col(f"u_{q}") >= share * F.col("n") - slack)).alias(f"{q}_within")
            for q, share in asked.items()]
    return ranks.select("job_name", "window_start", "rows", *near)


@query("k9_outcome_by_job")
def _(spark, d):
    return K.outcome_by_job(V.job_runs(spark, d))


@query("k10_job_table")
def _(spark, d):
    return K.job_table(V.job_runs(spark, d))


@query("k11_pipeline_table")
def _(spark, d):
    return K.pipeline_table(K.run_summary(V.job_runs(spark, d)))


@query("k12_headline_kpis")
def _(spark, d):
    return K.headline_kpis(V.job_runs(spark, d), V.dq_history(spark, d))


@query("k12_distinct_sketches")
def _(spark, d):
    """Distinct runs, users and hours per month: merged from daily sketches, and counted again."""
    columns = {"runs": F.col("run_id"), "users": F.col("user_id"), "hours": F.date_trunc("hour", "ts")}
    events = V.job_runs(spark, d)
    daily, _ = materialise(sketches.distinct_sketches(events, "business_date", columns), "k12-sketches")
    month = F.date_trunc("month", "day").alias("month")
    about = sketches.distinct_counts(daily, list(columns), [month])
    exact = sketches.exact_counts(events, columns, [F.date_trunc("month", "business_date").alias("month")])
    bound = 4 * sketches.distinct_error()
    exact = exact.select("month", *[F.col(c).alias(f"exact_{c}") for c in columns])
    return about.join(exact, "month").select(F.to_date("month").alias("month"), *[f"exact_{c}" for c in columns], *[
        (F.abs(F.col(c) - F.col(f"exact_{c}")) <= bound * F.col(f"exact_{c}") + 1).alias(f"{c}_within") for c in columns])


@query("s3_external_sketches")
def _(spark, d):
    """Datasets only read and only written, by theta sketches of ten groups of jobs merged, beside the exact numbers."""
    edges = V.observed_edges(spark, d)
    sides, _ = materialise(sketches.side_sketches(edges, [F.pmod(F.xxhash64("job"), F.lit(10)).alias("group")]), "s3-sketches")
    about = sketches.external_counts(sides)
    exact = L.external_io(edges).agg(
        F.count_if(F.col("direction") == "input").alias("n_in"), F.count_if(F.col("direction") == "output").alias("n_out"))
    slack = 4 * sketches.theta_error() * F.col("datasets")
    row = about.withColumns({"n_in": exact.select("n_in").scalar(), "n_out": exact.select("n_out").scalar()})
    return row.select(
        "n_in", "n_out", (F.abs(F.col("read_only") - F.col("n_in")) <= slack).alias("in_within"),
        (F.abs(F.col("written_only") - F.col("n_out")) <= slack).alias("out_within"))


@query("k13_check_failures_over_time")
def _(spark, d):
    return K.check_failures_over_time(V.dq_history(spark, d))


@query("k13_check_detail")
def _(spark, d):
    return K.check_detail(V.dq_history(spark, d))


@query("k13_failures_by_type")
def _(spark, d):
    return K.failures_by_type(V.dq_history(spark, d))


@query("k13_row_count_trend")
def _(spark, d):
    return K.row_count_trend(V.dq_history(spark, d))


@query("k14_pass_rate")
def _(spark, d):
    return K.pass_rate(V.dq_history(spark, d))


@query("k15_gauges_side_by_side")
def _(spark, d):
    return K.gauges_side_by_side(gauges(spark, d), {
        "trades": ("exchange.oracle.trade_mvmt_source_count", "exchange.dw.trade_movements_destination_count"),
        "derivatives": ("exchange.oracle.derivative_position_source_count", "exchange.dw.derivative_positions_destination_count"),
        "cash": ("exchange.oracle.cash_position_source_count", "exchange.dw.cash_positions_destination_count"),
    })


@query("k16_running_totals_stream")
def _(spark, d):
    flags = {"ended_ok": K.is_ok(), "ended_not_ok": K.is_failed(), "sla_violations": F.col("sla_miss")}
    return alerts.run_available(alerts.running_totals(V.stream_job_runs(spark, d), ["job_name"], flags), ["job_name"], "k16")


@query("k6_stream_absence")
def _(spark, d):
    """Silences of the publishing job as the keyed stream timer reports them."""
    published = V.stream_job_runs(spark, d).filter((F.col("job_name") == K.PUBLISH_JOB) & K.is_ok())
    return alerts.run_available(alerts.absence_alerts(published, "job_name", 30), [], "k6-stream", "append")


@query("k17_stream_renotify")
def _(spark, d):
    failed = V.stream_job_runs(spark, d).filter(K.is_failed())
    return alerts.run_available(alerts.renotify(failed, "job_name", 120, 60), [], "k17-stream", "append")


@query("k17_renotifications")
def _(spark, d):
    return K.renotifications(V.job_runs(spark, d), K.is_failed(), ["job_name"], gap_minutes=120, every_minutes=60)


@query("k18_lineage_health")
def _(spark, d):
    r = V.job_runs(spark, d)
    kind = F.when(K.is_ok(), "COMPLETE").when(K.is_failed(), "FAIL").otherwise("START")
    now = r.agg(F.max("ts")).scalar()
    return K.lineage_health(r.withColumn("event_type", kind), now, 1440)


@query("k19_run_summary")
def _(spark, d):
    return K.run_summary(V.job_runs(spark, d))


@query("k20_first_failure")
def _(spark, d):
    return K.first_failure(V.job_runs(spark, d))


@query("k21_retry_accounting")
def _(spark, d):
    return K.retry_accounting(V.job_runs(spark, d))


@query("k22_logs_for_run")
def _(spark, d):
    r = V.job_runs(spark, d)
    busiest = r.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "run_id").limit(1)
    rows = r.filter(F.col("run_id") == busiest.select("run_id").scalar())
    return K.logs_for(rows).select("event_id", "ts", "job_name", "status", "message")


# --- L: lineage -------------------------------------------------------------
@query("l1_lineage_edges")
def _(spark, d):
    """The edges of the job contract with the runs seen of each job, and jobs it does not name."""
    runs = V.job_runs(spark, d).groupBy(F.col("job_name").alias("job")).agg(F.count(F.lit(1)).alias("runs"))
    return L.lineage_edges(spark).join(runs, "job", "full_outer")


@query("l1_observed_edges")
def _(spark, d):
    return V.observed_edges(spark, d)


@query("l2_external_io")
def _(spark, d):
    edges = V.observed_edges(spark, d)
    return L.external_io(edges).groupBy("direction").agg(F.count(F.lit(1)).alias("datasets"))


@query("l3_impact")
def _(spark, d):
    edges = V.observed_edges(spark, d)
    return L.impacts(edges, {"downstream": "ds_1_0", "upstream": "ds_100_0"})


@query("l4_sql_inputs")
def _(spark, d):
    return L.sql_inputs(V.table(spark, d, "documents"), "text", ["doc_id"])


EVENT_FIELDS = """eventTime string,
    run struct<runId: string, facets: struct<orchestration: struct<pipelineRunId: string>, errorMessage: struct<message: string>>>,
    inputs array<struct<name: string>>,
    outputs array<struct<name: string, outputFacets: struct<outputStatistics: struct<rowCount: bigint>>>>"""


@query("l5_run_events")
def _(spark, d):
    r = V.job_runs(spark, d)
    kind = F.when(K.is_ok(), "COMPLETE").when(K.is_failed(), "FAIL").otherwise("START")
    runs = L.run_ids(r).select(
        "job_name", "business_date", "ts", F.col("ol_run_id").alias("run_id"),
        F.col("ol_parent_run_id").alias("parent_run_id"), kind.alias("event_type"),
        F.col("output_rows").alias("row_count"), "error")
    events = L.run_events(runs, L.lineage_edges(spark))
    # Every event is read back once, with the fields that the report shows.
    read = events.select("job_name", "event_type", F.from_json("event", schema(EVENT_FIELDS)).alias("e"))
    output = F.get("e.outputs", F.lit(0))
    return read.select(
        "job_name", "event_type", F.col("e.run.runId").alias("run_id"), F.col("e.eventTime").alias("event_time"),
        F.col("e.run.facets.orchestration.pipelineRunId").alias("parent_run_id"),
        F.col("e.run.facets.errorMessage.message").alias("error"),
        F.get("e.inputs", F.lit(0))["name"].alias("first_input"), output["name"].alias("first_output"),
        output["outputFacets"]["outputStatistics"]["rowCount"].alias("row_count"))


@query("l6_run_ids")
def _(spark, d):
    return L.run_ids(V.job_runs(spark, d)).select("event_id", "ol_run_id", "ol_parent_run_id")


# --- M: drills --------------------------------------------------------------
@query("m1_duplicate_rows")
def _(spark, d):
    o = V.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("trade_id"), "o_custkey", month("o_orderdate").alias("business_date"))
    same = D.drill_duplicates(o, seed=3).withColumn("kind", F.lit("same"))
    changed = D.drill_duplicates(o, seed=4, new_values={"o_custkey": F.col("o_custkey") + 1000000}).withColumn("kind", F.lit("changed"))
    both = same.unionByName(changed)
    repeated = both.groupBy("kind", "trade_id").agg(
        F.count(F.lit(1)).alias("copies"), F.max("o_custkey").alias("o_custkey"))
    return repeated


@query("m2_null_column")
def _(spark, d):
    p = dw_drvt(spark, d).select("position_id", "position_date", "settlement_price")
    share = D.drill_null_column(p, "settlement_price", seed=5).withColumn("kind", F.lit("share"))
    return share.unionByName(D.drill_null_column(p, "settlement_price", first=8).withColumn("kind", F.lit("first")))


@query("m3_zero_sum")
def _(spark, d):
    made = D.drill_zero_sum(dw_cash(spark, d).withColumn("dw_source", F.lit("oracle")), CASH_DAY)
    forced = D.drill_force_zero(V.src_cash_positions(spark, d))
    a = made.groupBy("position_date", "dw_source").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("long_value") + F.col("short_value") == 0).alias("zero_sum"))
    b = forced.groupBy("business_date").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("settlement_value") == 0).alias("zero_sum"))
    return a.unionByName(b.select(F.col("business_date").alias("position_date"), F.lit("forced").alias("dw_source"), "rows", "zero_sum"))


@query("m4_overflow")
def _(spark, d):
    return Q.check_overflow(D.drill_overflow(dw_trades(spark, d), DAY))


@query("m5_drop_fraction")
def _(spark, d):
    return D.drill_drop_rows(V.table(spark, d, "orders").select("o_orderkey", "o_orderdate"), seed=7, key="o_orderkey")


@query("m6_null_close")
def _(spark, d):
    c = close(spark, d).select("ticker", "business_date", "closing_price", F.round("vwap", 6).alias("vwap"))
    return D.drill_null_close(c, seed=2)


@query("m7_late_settlement")
def _(spark, d):
    i = V.raw_settlement_instructions(spark, d).select("instruction_id", "settlement_date", "status", "business_date")
    return D.drill_late_settlement(i, seed=9)


@query("m8_volume_spike")
def _(spark, d):
    t = V.raw_trades(spark, d)
    spiked = D.drill_volume_spike(t, seed=6)
    return spiked.groupBy("ticker").agg(
        F.countDistinct("order_id").alias("orders"),
        F.count(F.lit(1)).alias("trades"), F.sum(F.col("quantity").cast("long")).alias("quantity"), F.sum("price").alias("price"))
