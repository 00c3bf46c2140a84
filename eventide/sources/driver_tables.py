"""The market tables, derived by Spark from the star-schema test tables.

Joins are built only for the columns a caller asks for. Every foreign key of
the given tables resolves, so leaving a join out never changes the row set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import uuid_from
from ..schemas import JOB_SLA_SECONDS
from ..session import in_part, part_count

RAW_TRADE_COLUMNS = [
    "trade_id", "order_id", "ticker", "trade_time", "price", "quantity",
    "buyer_participant", "seller_participant", "business_date",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _month(c: str) -> Column:
    return F.to_date(F.date_trunc("month", F.col(c)))


def _with_nation(df: DataFrame, nation: DataFrame, key: str, out: str) -> DataFrame:
    names = nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(out))
    return df.join(names, key)


def raw_trades(spark: SparkSession, sf_dir: str, *columns: str, part: tuple[int, int] | None = None) -> DataFrame:
    """Trades: one row per line item, repeated ids included. ``part`` (i of n) keeps those of some orders."""
    wanted = list(columns) or RAW_TRADE_COLUMNS
    line = table(spark, sf_dir, "lineitem")
    if part is not None:
        line = line.filter(in_part("l_orderkey", *part))
    if "returnflag" in wanted:
        line = line.withColumn("returnflag", F.col("l_returnflag"))
    nation = table(spark, sf_dir, "nation")
    # Orders meet customers before they meet the far larger line items, so the
    # line items are shuffled once for both.
    if "buyer_participant" in wanted:
        customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        buyers = _with_nation(customer, nation, "c_nationkey", "buyer_participant")
        orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        bought = orders.join(buyers, "o_custkey").select("l_orderkey", "buyer_participant")
        line = line.join(bought, "l_orderkey")
    if "ticker" in wanted:
        part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
        line = line.join(part, "l_partkey")
    if "seller_participant" in wanted:
        supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        sellers = _with_nation(supplier, nation, "s_nationkey", "seller_participant")
        line = line.join(sellers.select("l_suppkey", "seller_participant"), "l_suppkey")
    derived = {
        "trade_id": F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")),
        "order_id": F.col("l_orderkey"),
        "trade_time": F.col("l_shipdate"),
        "price": F.col("l_extendedprice").cast("decimal(18,4)"),
        "quantity": F.col("l_quantity").cast("int"),
        "business_date": _month("l_shipdate"),
    }
    return line.select(*[derived[c].alias(c) if c in derived else F.col(c) for c in wanted])


def raw_settlement_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven instructions per order that is not low priority."""
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") != "5-LOW")
    leg = F.explode(F.sequence(F.lit(1), F.lit(7))).alias("n")
    status = (
        F.when(F.col("o_orderstatus") == "F", "MATCHED")
        .when(F.col("o_orderstatus") == "P", "PENDING")
        .otherwise("FAILED")
    )
    day = F.to_date("o_orderdate")
    return orders.select("*", leg).select(
        F.concat_ws("-", F.lit("SI"), F.col("o_orderkey").cast("string"), F.col("n").cast("string")).alias("instruction_id"),
        F.concat_ws("-", F.lit("SI"), F.col("o_orderkey").cast("string"), F.col("n").cast("string")).alias("settlement_id"),
        F.concat_ws("-", F.col("o_orderkey").cast("string"), F.col("n").cast("string")).alias("trade_id"),
        F.date_add(day, 2).alias("settlement_date"),
        F.col("n").cast("int").alias("quantity"),
        F.col("o_totalprice").cast("decimal(18,4)").alias("amount"),
        status.alias("status"),
        _month("o_orderdate").alias("business_date"),
    )


def raw_participant_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared positions: computed without the returned trades, so that some
    differ from the net traded quantity."""
    from ..operators.recon import participant_positions

    trades = raw_trades(
        spark, sf_dir, "ticker", "price", "quantity", "buyer_participant", "seller_participant",
        "business_date", "returnflag",
    ).filter(F.col("returnflag") != "R")
    return participant_positions(trades)


def src_trade_movements(spark: SparkSession, sf_dir: str, *columns: str, part: tuple[int, int] | None = None) -> DataFrame:
    """Source-layer trades: price at six decimals, settlement in two days.

    Only what the given columns need (all by default) is read and joined, and only ``part`` (i of n) of the orders.
    """
    made = {
        "trade_id": (["trade_id"], F.col("trade_id")),
        "trade_dt": (["trade_time"], F.to_date("trade_time")),
        "instrument_code": (["ticker"], F.col("ticker")),
        "buy_participant": (["buyer_participant"], F.col("buyer_participant")),
        "sell_participant": (["seller_participant"], F.col("seller_participant")),
        "quantity": (["quantity"], F.col("quantity").cast("decimal(15,0)")),
        "closing_price": (["price"], F.col("price").cast("decimal(18,6)")),
        "gross_value": (["price", "quantity"], (F.col("price") * F.col("quantity")).cast("decimal(22,6)")),
        "settlement_dt": (["business_date"], F.date_add("business_date", 2)),
        "status": (["returnflag"], F.when(F.col("returnflag") == "R", "").when(F.col("returnflag") == "A", "OPEN")),
        "business_date": (["business_date"], F.col("business_date")),
    }
    chosen = {c: made[c] for c in columns or made}
    needed = list(dict.fromkeys(x for inputs, _ in chosen.values() for x in inputs))
    return raw_trades(spark, sf_dir, *needed, part=part).select(*[value.alias(c) for c, (_, value) in chosen.items()])


def src_trade_parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """``src_trade_movements`` in parts that hold every row once: their three joins shuffle
    several times what the tables take up, so a large table is joined some orders at a time."""
    n = part_count(table(spark, sf_dir, "lineitem"))
    return [src_trade_movements(spark, sf_dir, part=(i, n) if n > 1 else None) for i in range(n)]


def src_drvt_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source-layer derivative positions: one per part. In the first third of the
    month a part of size 50 has no price."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("decimal(15,0)")
    long_q = F.when(F.col("p_partkey") % 2 == 0, size).otherwise(F.lit(0).cast("decimal(15,0)"))
    short_q = F.when(F.col("p_partkey") % 2 == 1, size).otherwise(F.lit(0).cast("decimal(15,0)"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 30).cast("int"))
    return p.select(
        F.concat(F.lit("DP-"), F.col("p_partkey").cast("string")).alias("position_id"),
        day.alias("position_date"),
        F.col("p_type").alias("participant_code"),
        F.col("p_brand").alias("instrument_code"),
        (long_q - short_q).cast("decimal(15,0)").alias("net_quantity"),
        long_q.alias("long_quantity"), short_q.alias("short_quantity"),
        F.when((F.col("p_size") != 50) | (F.col("p_partkey") % 30 >= 10), F.col("p_retailprice").cast("decimal(22,6)")).alias("market_value"),
        day.alias("business_date"),
    )


def src_cash_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source-layer cash positions: signed customer balances. In the first half of
    the month every seventh one is zero and every eleventh one is missing."""
    c = table(spark, sf_dir, "customer")
    balance = F.col("c_acctbal").cast("decimal(22,6)")
    early = F.col("c_custkey") % 30 < 15
    value = F.when(early & (F.col("c_custkey") % 11 == 0), F.lit(None)).when(
        early & (F.col("c_custkey") % 7 == 0), F.lit(0).cast("decimal(22,6)")
    ).otherwise(F.when(F.col("c_custkey") % 2 == 0, balance).otherwise(-balance))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 30).cast("int"))
    return c.select(
        F.concat(F.lit("CP-"), F.col("c_custkey").cast("string")).alias("position_id"),
        day.alias("position_date"),
        F.col("c_nationkey").cast("string").alias("participant_code"),
        F.col("c_mktsegment").alias("instrument_code"),
        F.col("c_custkey").cast("decimal(15,0)").alias("net_quantity"),
        value.cast("decimal(22,6)").alias("settlement_value"),
        day.alias("business_date"),
    )


# --- telemetry --------------------------------------------------------------
def event_columns(e: DataFrame) -> DataFrame:
    """Job-run columns of an event row; works on a batch and on a stream."""
    k = F.get_json_object("props", "$.k").cast("int")
    jobs = F.array(*[F.lit(j) for j in JOB_SLA_SECONDS])
    # Durations of the test events stay below 500 s, so the limits are a tenth.
    limits = F.array(*[F.lit(s / 10.0) for s in JOB_SLA_SECONDS.values()])
    slot = (F.col("user_id") % 4).cast("int")
    job = F.element_at(jobs, slot + 1)
    status = (
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "purchase", "success")
        .when(F.col("event_type") == "signup", "retry")
        .otherwise("running")
    )
    failed = F.col("event_type") == "error"
    # The two search terms of each alert message.
    terms = F.array(F.lit("Duplicatas"), F.lit("Coluna nula"), F.lit("Soma zero"), F.lit("Diferença de contagem"))
    message = F.when(
        failed,
        F.concat(
            F.lit("[DQ-CASO-"), (k % 4 + 1).cast("string"), F.lit("] "), F.element_at(terms, k % 4 + 1),
            F.lit(": "), k.cast("string"),
        ),
    )
    day = F.to_date("ts")
    run = F.concat_ws("-", F.lit("run"), F.floor(F.col("user_id") / 4).cast("string"), F.date_format(day, "yyyyMMdd"))
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        job.alias("job_name"),
        (slot + 1).alias("position"),
        run.alias("run_id"),
        day.alias("business_date"),
        status.alias("status"),
        F.col("value").alias("duration_seconds"),
        (k % 3).alias("retries"),
        (F.col("value") > F.element_at(limits, slot + 1)).alias("sla_miss"),
        k.cast("long").alias("output_rows"),
        F.when(failed & (job == "quality_gate_d1"), "FAIL").alias("gate_status"),
        F.when(failed, F.concat(F.lit("error code "), k.cast("string"))).alias("error"),
        message.alias("message"),
        F.col("user_id"),
    )


def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_columns(table(spark, sf_dir, "events"))


def stream_job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream; it may be one file or a folder of part files."""
    layout = table(spark, sf_dir, "events").schema
    return event_columns(spark.readStream.schema(layout).parquet(f"{sf_dir}/events.parque[t]"))


def observed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage edges seen in the events: a view reads a dataset of the job one
    level up, a purchase writes one of the job's own datasets."""
    k = (F.get_json_object("props", "$.k").cast("int") % 3).cast("string")
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "purchase"))
    reads = F.col("event_type") == "view"
    owner = F.when(reads, F.floor(F.col("user_id") / 2)).otherwise(F.col("user_id")).cast("string")
    return e.select(
        F.concat(F.lit("job_"), F.col("user_id").cast("string")).alias("job"),
        F.when(reads, "input").otherwise("output").alias("direction"),
        F.lit("events").alias("namespace"),
        F.concat_ws("_", F.lit("ds"), owner, k).alias("name"),
    ).distinct()


def dq_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check results derived from the trades: three runs per month, one per
    return flag, with three checks each."""
    t = raw_trades(spark, sf_dir, "trade_id", "quantity", "business_date", "returnflag")
    per_id = t.groupBy("business_date", "returnflag", "trade_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("quantity") >= 50).alias("big"),
    )
    counts = per_id.groupBy("business_date", "returnflag").agg(
        F.sum(F.col("n") - 1).alias("dups"), F.sum("big").alias("big"), F.sum("n").alias("total"),
    )

    def result(name, kind, severity, passed, actual):
        return F.struct(
            F.lit(name).alias("check_name"), F.lit(kind).alias("check_type"),
            F.lit("raw_trades").alias("target_table"), F.lit(severity).alias("severity"),
            passed.alias("passed"), F.lit("0").alias("expected_value"),
            actual.cast("string").alias("actual_value"),
        )

    rows = F.explode(
        F.array(
            result("duplicate_trades", "uniqueness", "critical", F.col("dups") <= 4, F.col("dups")),
            result("large_quantity", "reasonableness", "warning", F.col("big") <= 3, F.col("big")),
            result("row_count", "completeness", "critical", F.col("total") >= 50, F.col("total")),
        )
    ).alias("r")
    offset = F.when(F.col("returnflag") == "A", 1).when(F.col("returnflag") == "N", 2).otherwise(3)
    return counts.select("business_date", "returnflag", rows, offset.alias("off")).select(
        uuid_from("returnflag", "business_date", "r.check_name").alias("result_id"),
        F.concat(F.lit("run-"), F.col("returnflag")).alias("run_id"),
        "business_date", "r.*",
        F.concat_ws(" ", F.col("r.actual_value"), F.lit("rows")).alias("details"),
        (F.col("business_date").cast("timestamp") + F.make_dt_interval(hours=F.col("off"))).alias("created_at"),
    )
