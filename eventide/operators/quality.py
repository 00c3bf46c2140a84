"""Data-quality counts, checks, result handling and the publication gate.

Every check yields rows of one shape: ``business_date, check_name, check_type,
target_table, severity, passed, expected_value, actual_value, details``. With a
``business_date`` it yields one row for that date, even when the table holds
nothing for it; without one it yields a row per date present.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import for_date, uuid_from
from ..schemas import (
    DAILY_VOLUME_RANGE,
    JOB_SLA_SECONDS,
    NOTIONAL_LIMIT,
    OVERFLOW_SOURCE,
    ROW_COUNT_TOLERANCE,
    Contract,
)
from ..sources.sinks import rule_predicates
from .recon import row_count_parity

RESULT_COLUMNS = [
    "business_date", "check_name", "check_type", "target_table", "severity",
    "passed", "expected_value", "actual_value", "details",
]


class QualityGateError(RuntimeError):
    """A critical check failed and the gate is set to stop the run."""


# --- duplicate counts -------------------------------------------------------
def excess_duplicates(df: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """Rows beyond the first one of each key; NULL is one key."""
    by = by or []
    per_key = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.groupBy(*by).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def rows_minus_distinct(df: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """Row count minus distinct keys; every NULL-key row counts."""
    by = by or []
    per_key = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("_n"))
    excess = F.col("_n") - F.when(F.col(key).isNull(), 0).otherwise(1)
    return per_key.groupBy(*by).agg(F.coalesce(F.sum(excess), F.lit(0)).alias("duplicates"))


def duplicate_keys(df: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """Number of keys that occur more than once."""
    by = by or []
    per_key = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.groupBy(*by).agg(F.count_if(F.col("_n") > 1).alias("duplicates"))


# --- row builder ------------------------------------------------------------
def _per_date(df: DataFrame, date_col: str, business_date: str | None, *aggs: Column) -> DataFrame:
    if business_date is None:
        return df.groupBy(F.col(date_col).alias("business_date")).agg(*aggs)
    one = for_date(df, date_col, business_date).agg(*aggs)
    return one.select(F.lit(business_date).cast("date").alias("business_date"), "*")


def _duplicates_per_date(df: DataFrame, date_col: str, business_date: str | None, count, key: str) -> DataFrame:
    if business_date is None:
        return count(df.withColumn("business_date", F.col(date_col)), key, ["business_date"])
    one = count(for_date(df, date_col, business_date), key)
    return one.select(F.lit(business_date).cast("date").alias("business_date"), "*")


def _result(name: str, kind: str, table: str, severity: str, passed: Column, expected: Column | str,
            actual: Column, details: Column) -> list[Column]:
    expected = F.lit(expected) if isinstance(expected, str) else expected
    return [
        F.lit(name).alias("check_name"), F.lit(kind).alias("check_type"),
        F.lit(table).alias("target_table"), F.lit(severity).alias("severity"),
        passed.alias("passed"), expected.cast("string").alias("expected_value"),
        actual.cast("string").alias("actual_value"), details.alias("details"),
    ]


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _day_text() -> Column:
    return F.date_format("business_date", "yyyy-MM-dd")


def _zero_check(counts: DataFrame, n: str, name: str, kind: str, table: str, severity: str,
                expected: Column | str, actual: Column, details: Column) -> DataFrame:
    """Result row of a check that passes when the count ``n`` is zero."""
    return counts.select(
        "business_date", *_result(name, kind, table, severity, F.col(n) == 0, expected, actual, details)
    )


# --- warehouse checks -------------------------------------------------------
def check_duplicate_trades(
    trades: DataFrame, business_date: str | None = None, style: str = "g1", date_col: str = "trade_dt",
    table: str = "dw_trade_movements", source: str = "src_trade_movements",
) -> DataFrame:
    """Excess rows of repeated trade ids."""
    counts = _duplicates_per_date(trades, date_col, business_date, excess_duplicates, "trade_id")
    n = F.col("duplicates")
    if style == "g1":
        text = F.when(n > 0, _say(n, " duplicate trade_id rows found")).otherwise("No duplicates")
        return _zero_check(counts, "duplicates", "caso1_duplicate_trades", "uniqueness", table, "critical", "0", n, text)
    text = _say("Duplicate trade_id count for ", _day_text(), ": ", n, f". Source: {source}.")
    return _zero_check(counts, "duplicates", "caso_1_duplicate_trade_mvmt", "uniqueness", table, "critical", "0", n, text)


def check_duplicate_ids(
    trades: DataFrame, business_date: str | None = None, date_col: str = "business_date", table: str = "raw_trades"
) -> DataFrame:
    """Number of trade ids that repeat on a date, with up to five of them."""
    per_id = trades.groupBy(F.col(date_col).alias("business_date"), "trade_id").agg(F.count(F.lit(1)).alias("n"))
    if business_date is not None:
        per_id = trades.filter(F.col(date_col) == F.lit(business_date).cast("date")).groupBy(
            F.lit(business_date).cast("date").alias("business_date"), "trade_id"
        ).agg(F.count(F.lit(1)).alias("n"))
    repeated = per_id.filter("n > 1")
    samples = offender_samples(repeated, ["trade_id"], by=["business_date"])
    if business_date is None:
        counts = per_id.groupBy("business_date").agg(F.count_if(F.col("n") > 1).alias("n"))
    else:
        counts = per_id.agg(F.count_if(F.col("n") > 1).alias("n")).select(
            F.lit(business_date).cast("date").alias("business_date"), "n"
        )
    n = F.col("n")
    text = F.concat(
        _say("Found ", n, " duplicate trade_id values for ", _day_text()),
        F.coalesce(F.concat(F.lit(": "), F.col("samples")), F.lit("")),
    )
    return _zero_check(
        counts.join(samples, "business_date", "left"), "n", "trade_id_unique_per_date", "uniqueness", table,
        "critical", "0 duplicate trade_ids", _say(n, " duplicate trade_ids"), text,
    )


def check_null_price(
    positions: DataFrame, business_date: str | None = None, style: str = "g1",
    table: str = "dw_drvt_positions", source: str = "src_drvt_positions",
) -> DataFrame:
    """Derivative positions without a settlement price."""
    counts = _per_date(positions, "position_date", business_date, F.count_if(F.col("settlement_price").isNull()).alias("n"))
    n = F.col("n")
    if style == "g1":
        text = F.when(n > 0, _say(n, " rows with NULL settlement_price")).otherwise("All prices populated")
        name = "caso2_null_settlement_price"
    else:
        text = _say("Null settlement_price count for ", _day_text(), ": ", n, f". Source: {source}.")
        name = "caso_2_null_settlement_price"
    return _zero_check(counts, "n", name, "completeness", table, "critical", "0", n, text)


def check_zero_sum(
    positions: DataFrame, business_date: str | None = None, style: str = "g1",
    table: str = "dw_cash_positions", source: str = "src_cash_positions",
) -> DataFrame:
    """Cash positions whose long and short legs cancel out."""
    zero = F.col("long_value") + F.col("short_value") == 0
    counts = _per_date(positions, "position_date", business_date, F.count_if(zero).alias("n"))
    n = F.col("n")
    if style == "g1":
        text = F.when(n > 0, _say(n, " positions with long_value + short_value = 0")).otherwise("No zero-sum positions")
        return _zero_check(counts, "n", "caso3_zero_sum_positions", "consistency", table, "critical", "0", n, text)
    text = _say("Zero-sum positions for ", _day_text(), ": ", n,
                f" rows where long_value + short_value = 0. Source: {source}.")
    return _zero_check(counts, "n", "caso_3_zero_sum_position", "validity", table, "critical", "0", n, text)


def source_zero_sum(cash: DataFrame, business_date: str | None = None) -> DataFrame:
    """Source-side count of cash positions with a settlement value of zero."""
    return _per_date(cash, "business_date", business_date, F.count_if(F.col("settlement_value") == 0).alias("zero_sum"))


def source_duplicates(trades: DataFrame, business_date: str | None = None) -> DataFrame:
    """Source-side count of excess rows of repeated trade ids."""
    return _duplicates_per_date(trades, "business_date", business_date, excess_duplicates, "trade_id")


def _parity(source: DataFrame, target: DataFrame, source_date: str, target_date: str, business_date: str | None) -> DataFrame:
    if business_date is None:
        return row_count_parity(source, target, source_date, target_date)
    n_s = for_date(source, source_date, business_date).agg(F.count(F.lit(1)).alias("source_count"))
    n_t = for_date(target, target_date, business_date).agg(F.count(F.lit(1)).alias("n"))
    return n_s.select(
        F.lit(business_date).cast("date").alias("business_date"), "source_count", n_t.scalar().alias("target_count")
    )


def check_row_count_equal(
    source: DataFrame, target: DataFrame, source_date: str, target_date: str, business_date: str | None = None,
    name: str = "rowcount_trades_oracle_vs_dw", table: str = "dw_trade_movements",
) -> DataFrame:
    """Source and warehouse must hold the same number of rows."""
    s, t = F.col("source_count"), F.col("target_count")
    return _parity(source, target, source_date, target_date, business_date).select(
        "business_date",
        *_result(name, "completeness", table, "warning", s == t, s, t, _say("Oracle=", s, ", DW=", t)),
    )


def check_row_count_tolerance(
    source: DataFrame | None, target: DataFrame, source_date: str, target_date: str,
    business_date: str | None = None, tolerance: float = ROW_COUNT_TOLERANCE,
    name: str = "caso_4_row_count_diff_mvmt", table: str = "dw_trade_movements",
    source_table: str = "src_trade_movements",
) -> DataFrame:
    """Row counts may differ by ``tolerance`` of the source. An unreachable source
    passes with a note; an empty source counts as no difference."""
    s, t = F.col("source_count"), F.col("target_count")
    if source is None:
        counts = _per_date(target, target_date, business_date, F.count(F.lit(1)).alias("target_count"))
        text = _say("Oracle unavailable; DW row count = ", t, f". Cannot compare against source {source_table}.")
        return counts.select(
            "business_date",
            *_result(name, "row_count", table, "warning", F.lit(True), "oracle_unavailable", t, text),
        )
    diff = F.abs(s - t)
    passed = (s == 0) | (diff <= s * F.lit(str(tolerance)).cast("decimal(10,6)"))
    share = F.when(s > 0, F.round(F.try_divide((diff * 100).cast("decimal(20,0)"), s.cast("decimal(19,0)")), 2)).otherwise(F.lit(0))
    text = _say(f"Source {source_table}: ", s, f" rows; DW {table}: ", t, " rows; diff=", share.cast("decimal(20,2)"), "%")
    return _parity(source, target, source_date, target_date, business_date).select(
        "business_date", *_result(name, "row_count", table, "warning", passed, s, t, text)
    )


def overflowing(notional: Column, source: Column) -> Column:
    """Beyond DECIMAL(18,4), or marked as an injected overflow row."""
    beyond = notional.isNotNull() & (
        notional.try_cast("decimal(18,4)").isNull() | (notional > F.lit(NOTIONAL_LIMIT).cast("decimal(18,4)"))
    )
    return beyond | F.coalesce(source == OVERFLOW_SOURCE, F.lit(False))


def check_overflow(
    trades: DataFrame, business_date: str | None = None, table: str = "dw_trade_movements",
    source: str = "src_trade_movements",
) -> DataFrame:
    """Notionals outside the DECIMAL(18,4) contract; each row counts once."""
    bad = overflowing(F.col("notional"), F.col("dw_source"))
    counts = _per_date(trades, "trade_dt", business_date, F.count_if(bad).alias("n"))
    n = F.col("n")
    text = _say("Overflow check: ", n, " rows violating DECIMAL(18,4) contract for ", _day_text(), f". Source: {source}.")
    return _zero_check(
        counts, "n", "caso_5_overflow_notional", "validity", table, "critical",
        f"notional <= {NOTIONAL_LIMIT} AND dw_source != {OVERFLOW_SOURCE}", n, text,
    )


# --- raw-layer checks -------------------------------------------------------
def _count_check(df: DataFrame, bad: Column, business_date: str | None, name: str, kind: str, table: str,
                 noun: str, found: str) -> DataFrame:
    counts = _per_date(df, "business_date", business_date, F.count_if(bad).alias("n"))
    n = F.col("n")
    return _zero_check(counts, "n", name, kind, table, "critical", f"0 {noun}", _say(n, f" {noun}"),
                       _say("Found ", n, f" {found} for ", _day_text()))


def check_null_close(close: DataFrame, business_date: str | None = None) -> DataFrame:
    return _count_check(close, F.col("closing_price").isNull(), business_date, "closing_price_not_null",
                        "completeness", "raw_close_prices", "NULL closing prices", "tickers with NULL closing_price")


def check_required_fields(
    trades: DataFrame, business_date: str | None = None,
    fields: tuple[str, ...] = ("trade_id", "ticker", "price", "quantity"),
) -> DataFrame:
    missing = reduce(lambda a, b: a | b, [F.col(f).isNull() for f in fields])
    return _count_check(trades, missing, business_date, "trades_required_fields_not_null", "completeness",
                        "raw_trades", "rows with NULL required fields", "trades with NULL required fields")


def check_orphans(instructions: DataFrame, trades: DataFrame, business_date: str | None = None) -> DataFrame:
    """Instructions without a trade of the same id and date. Both sides shrink to
    one counted row per id and date before they meet."""
    on = ["trade_id", "business_date"]
    if business_date is not None:
        instructions = for_date(instructions, "business_date", business_date)
        trades = for_date(trades, "business_date", business_date)
    known = trades.select(*on).distinct().withColumn("_known", F.lit(True))
    per_id = instructions.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    joined = per_id.join(known.hint("merge"), on, "left")
    orphans = F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).alias("n")
    if business_date is None:
        counts = joined.groupBy("business_date").agg(orphans)
    else:
        counts = joined.agg(orphans).select(F.lit(business_date).cast("date").alias("business_date"), "n")
    n = F.col("n")
    return _zero_check(
        counts, "n", "settlement_instructions_have_matching_trade", "consistency", "raw_settlement_instructions",
        "critical", "0 orphan settlement instructions", _say(n, " orphan settlement instructions"),
        _say("Found ", n, " settlement instructions without a matching trade for ", _day_text()),
    )


def check_uninstructed_trades(recon: DataFrame, business_date: str | None = None) -> DataFrame:
    """Reconciled rows without an instruction."""
    return _count_check(recon, F.col("recon_status") == "MISSING_INSTRUCTION", business_date, "settlement_has_trade",
                        "consistency", "settlement_recon", "trades without instruction", "trades without instruction")


def check_positive(trades: DataFrame, business_date: str | None = None) -> DataFrame:
    """Price and quantity must be above zero; both counts come from one scan."""
    counts = _per_date(
        trades, "business_date", business_date,
        F.count_if(F.col("price") <= 0).alias("bad_price"), F.count_if(F.col("quantity") <= 0).alias("bad_quantity"),
    )

    def row(n: str, noun: str, adjective: str) -> Column:
        c = F.col(n)
        return F.struct(*_result(
            f"trade_{noun}_positive", "reasonableness", "raw_trades", "critical", c == 0,
            f"0 trades with {noun} <= 0", _say(c, f" trades with {noun} <= 0"),
            _say("Found ", c, f" trades with {adjective} {noun} for ", _day_text()),
        ))

    rows = F.explode(F.array(row("bad_price", "price", "non-positive"), row("bad_quantity", "quantity", "non-positive")))
    return counts.select("business_date", rows.alias("r")).select("business_date", "r.*")


def check_volume_range(
    close: DataFrame, business_date: str | None = None, bounds: tuple[int, int] = DAILY_VOLUME_RANGE
) -> DataFrame:
    """Daily volume outside the expected range, with up to five offenders."""
    low, high = bounds
    bad = ~F.col("daily_volume").between(low, high)
    counts = _per_date(close, "business_date", business_date, F.count_if(bad).alias("n"))
    rows = close if business_date is None else for_date(close, "business_date", business_date)
    samples = offender_samples(rows.filter(bad), ["ticker", "daily_volume"], by=["business_date"])
    n = F.col("n")
    text = F.concat(
        _say("Found ", n, f" tickers with daily_volume outside [{low}, {high}] for ", _day_text()),
        F.coalesce(F.concat(F.lit(": "), F.col("samples")), F.lit("")),
    )
    return _zero_check(
        counts.join(samples, "business_date", "left"), "n", "daily_volume_in_range", "reasonableness",
        "raw_close_prices", "warning", f"All daily_volume between {low} and {high:,}",
        _say(n, " tickers outside range"), text,
    )


def quality_table(close: DataFrame, trades: DataFrame, recon: DataFrame, checked_at=None) -> DataFrame:
    """Five checks with failures, total, pass flag and pass rate. Each input is
    aggregated once, and its counts are unfolded to rows."""
    c = close.agg(F.count_if(F.col("closing_price").isNull()).alias("f"), F.count(F.lit(1)).alias("t"))
    per_id = trades.groupBy("trade_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("price") <= 0).alias("p"), F.count_if(F.col("quantity") <= 0).alias("q"),
    )
    extra = F.col("n") - F.when(F.col("trade_id").isNull(), 0).otherwise(1)
    t = per_id.agg(*[
        F.coalesce(F.sum(c), F.lit(0)).alias(name)
        for name, c in (("u", extra), ("p", F.col("p")), ("q", F.col("q")), ("t", F.col("n")))
    ])
    r = recon.agg(F.count_if(F.col("recon_status") == "MISSING_INSTRUCTION").alias("f"), F.count(F.lit(1)).alias("t"))

    def row(kind: str, name: str, failures: str, total: str) -> Column:
        return F.struct(
            F.lit(kind).alias("check_type"), F.lit(name).alias("check_name"), F.lit("critical").alias("severity"),
            F.col(failures).alias("failures"), F.col(total).alias("total_rows"),
        )

    def rows(df: DataFrame, *structs: Column) -> DataFrame:
        return df.select(F.explode(F.array(*structs)).alias("r")).select("r.*")

    table = (
        rows(c, row("completeness", "closing_price_not_null", "f", "t"))
        .unionByName(rows(
            t, row("uniqueness", "trade_id_unique", "u", "t"), row("reasonableness", "price_positive", "p", "t"),
            row("reasonableness", "quantity_positive", "q", "t"),
        ))
        .unionByName(rows(r, row("consistency", "settlement_has_trade", "f", "t")))
    )
    f, n = F.col("failures"), F.col("total_rows")
    rate = F.when(
        n > 0, F.round(F.try_divide(((n - f) * 100).cast("decimal(21,0)"), n.cast("decimal(19,0)")), 2).cast("decimal(7,2)")
    ).otherwise(F.lit("100.00").cast("decimal(7,2)"))
    out = table.withColumns({"passed": f == 0, "pass_rate": rate})
    return out if checked_at is None else out.withColumn("checked_at", F.lit(checked_at).cast("timestamp"))


# --- timeliness -------------------------------------------------------------
def check_timeliness_placeholder(spark: SparkSession, business_date: str) -> DataFrame:
    """The constant row that records that SLAs are watched elsewhere."""
    return spark.range(1).select(
        F.lit(business_date).cast("date").alias("business_date"),
        *_result("timeliness_sla_check", "timeliness", "raw_trades", "info", F.lit(True), "SLA met",
                 F.lit("SLA met (monitored externally)"),
                 F.lit(f"Timeliness SLA for {business_date} is monitored externally")),
    )


def check_timeliness(runs: DataFrame, sla: dict[str, float] = JOB_SLA_SECONDS) -> DataFrame:
    """Attempts that ran longer than their job's limit, per date."""
    limit = F.create_map(*[x for job, s in sla.items() for x in (F.lit(job), F.lit(float(s)))])
    late = F.col("duration_seconds") > F.element_at(limit, F.col("job_name"))
    counts = runs.groupBy("business_date").agg(F.count_if(late).alias("n"), F.count(F.lit(1)).alias("total"))
    n = F.col("n")
    return _zero_check(
        counts, "n", "timeliness_sla_check", "timeliness", "job_runs", "info", "0 SLA misses",
        _say(n, " SLA misses"), _say("Found ", n, " of ", F.col("total"), " attempts over their SLA for ", _day_text()),
    )


# --- user SQL expectations --------------------------------------------------
def run_sql(spark: SparkSession, query: str, business_date: str) -> DataFrame:
    """User SQL with a date placeholder (``%%ODATE%%``, ``$ODATE`` or ``:odate``),
    always bound as a parameter."""
    for marker in ("'%%ODATE%%'", "%%ODATE%%", "'$ODATE'", "$ODATE"):
        query = query.replace(marker, ":odate")
    return spark.sql(query, args={"odate": business_date})


def expect_sql(spark: SparkSession, query: str, check: str | None, value, business_date: str) -> DataFrame:
    """One result row for a user query: row count, three sample rows, verdict."""
    rows = run_sql(spark, query, business_date)
    first_cell = F.col(f"`{rows.columns[0]}`").cast("string")
    head = rows.limit(3).agg(
        F.collect_list(F.struct(F.to_json(F.struct("*")).alias("row"), first_cell.alias("cell"))).alias("h")
    )
    n = F.col("row_count")
    if check == "count_gt":
        ok, error = n > int(value), _say("DQ check failed: row_count=", n, f", expected > {value}")
    elif check == "count_eq":
        ok, error = n == int(value), _say("DQ check failed: row_count=", n, f", expected == {value}")
    elif check == "value_eq":
        first = F.col("first_cell")
        ok = F.coalesce(first == str(value), F.lit(False))
        error = _say("DQ check failed: first cell=", F.coalesce(first, F.lit("None")), f", expected == {value}")
    elif check is None:
        ok, error = F.lit(True), F.lit(None).cast("string")
    else:
        raise ValueError(f"unknown check: {check}")
    # ``get`` is NULL beyond the end, so an empty result has no first cell.
    base = rows.agg(F.count(F.lit(1)).alias("row_count")).withColumn("_h", head.scalar()).select(
        "row_count", F.transform("_h", lambda r: r["row"]).alias("sample"), F.get("_h", F.lit(0))["cell"].alias("first_cell")
    )
    return base.select(
        F.when(ok, "success").otherwise("failed").alias("status"), "row_count", "sample",
        F.when(~ok, error).alias("error"),
    )


# --- contract check ---------------------------------------------------------
def check_contract(df: DataFrame, contract: Contract) -> DataFrame:
    """Number of rows breaking each rule of a contract, in one aggregation; the
    unique key adds one grouped count."""
    rules = rule_predicates(contract)
    counts = df.agg(*[F.count_if(broken).alias(f"r{i}") for i, (_, broken) in enumerate(rules)])
    out = counts.select(
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("failures")) for i, (name, _) in enumerate(rules)
        ])).alias("r")
    ).select("r.*")
    if contract.unique_key:
        key = df.select(F.struct(*contract.unique_key).alias("_key"))
        name = ",".join(contract.unique_key) + ":unique"
        out = out.unionByName(excess_duplicates(key, "_key").select(F.lit(name).alias("rule"), F.col("duplicates").alias("failures")))
    return out.select(F.lit(contract.table).alias("target_table"), "rule", "failures", (F.col("failures") == 0).alias("passed"))


# --- combined variants ------------------------------------------------------
def check_all_in_one(
    trades: DataFrame, drvt: DataFrame, cash: DataFrame, business_date: str | None = None, fail: bool = False
) -> DataFrame:
    """Duplicates, missing prices and zero sums of a date together. With ``fail``
    (one date only) a violation raises instead."""
    dups = _duplicates_per_date(trades, "trade_dt", business_date, rows_minus_distinct, "trade_id").withColumnRenamed("duplicates", "dups")
    nulls = _per_date(drvt, "position_date", business_date, F.count_if(F.col("settlement_price").isNull()).alias("nulls"))
    zero = F.col("long_value") + F.col("short_value") == 0
    zeros = _per_date(cash, "position_date", business_date, F.count_if(zero).alias("zeros"))
    joined = dups.join(nulls, "business_date", "full_outer").join(zeros, "business_date", "full_outer")
    names = ["dups", "nulls", "zeros"]
    filled = joined.select("business_date", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    out = filled.withColumn("passed", reduce(lambda a, b: a & b, [F.col(c) == 0 for c in names]))
    if fail:
        if business_date is None:
            raise ValueError("fail needs a business_date")
        row = out.first()
        if row is not None and not row["passed"]:
            raise QualityGateError(f"DQ FAIL: dups={row['dups']} nulls={row['nulls']} zeros={row['zeros']}")
    return out


def stamp_results(results: DataFrame, run_id: str, created_at) -> DataFrame:
    """Check rows as stored: run id, repeatable result id and creation time."""
    return results.select(
        uuid_from(F.lit(run_id), "business_date", "check_name").alias("result_id"),
        F.lit(run_id).alias("run_id"), *RESULT_COLUMNS,
        F.lit(created_at).cast("timestamp").alias("created_at"),
    )


# --- samples ----------------------------------------------------------------
def offender_samples(
    df: DataFrame, cols: list[str], pred: Column | None = None, by: list[str] | None = None, n: int = 5
) -> DataFrame:
    """Up to ``n`` offending rows per group as one text, in order of ``cols``.

    The rank is limited map-side, so a group of any size reaches its task as at
    most ``n`` rows per input partition.
    """
    bad = df if pred is None else df.filter(pred)
    by = by or []
    text = F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in cols])
    if not by:
        top = bad.select(*cols).orderBy(*cols).limit(n).select(F.struct(*cols).alias("_k"), text.alias("_t"))
        groups = top.agg(F.sort_array(F.collect_list(F.struct("_k", "_t"))).alias("_s"))
        return groups.select(F.array_join(F.transform("_s", lambda s: s["_t"]), "; ").alias("samples"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*cols))
    top = bad.select(*by, *cols).withColumn("_rank", rank).filter(F.col("_rank") <= n)
    return top.groupBy(*by).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rank", text.alias("_t")))), lambda s: s["_t"]), "; ").alias("samples")
    )


# --- results ----------------------------------------------------------------
def latest_run(results: DataFrame) -> DataFrame:
    """All rows of the newest run of each date.

    The newest run is found on one row per date and run, so no date's rows are
    gathered in one place.
    """
    runs = results.groupBy("business_date", "run_id").agg(F.max("created_at").alias("_at"))
    newest = runs.groupBy("business_date").agg(F.max_by("run_id", F.struct("_at", "run_id")).alias("run_id"))
    return results.join(newest, ["business_date", "run_id"], "left_semi")


def dq_summary(results: DataFrame, business_date: str | None = None) -> DataFrame:
    """Checks run and failed per date, type and severity."""
    rows = results if business_date is None else for_date(results, "business_date", business_date)
    return rows.groupBy("business_date", "check_type", "severity").agg(
        F.count(F.lit(1)).alias("checks_run"), F.count_if(~F.col("passed")).alias("checks_failed")
    )


def gate_status(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Checks run, failed and critically failed, and the verdict."""
    failed = ~F.col("passed")
    critical = F.count_if(failed & (F.col("severity") == "critical"))
    return results.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("checks_run"), F.count_if(failed).alias("checks_failed"),
        critical.alias("critical_failures"), F.when(critical == 0, "PASS").otherwise("FAIL").alias("gate_status"),
    )


def gate(results: DataFrame, mode: str = "report"):
    """Gate verdict of one run. ``raise`` stops the run on a critical failure."""
    if mode not in ("report", "raise"):
        raise ValueError(f"unknown mode: {mode}")
    verdict = gate_status(results).first()
    if mode == "raise" and verdict["critical_failures"] > 0:
        names = results.filter(~F.col("passed") & (F.col("severity") == "critical")).select("check_name").distinct()
        listed = ", ".join(r[0] for r in names.orderBy("check_name").collect())
        raise QualityGateError(
            f"quality gate failed: {verdict['critical_failures']} critical check(s) did not pass: {listed}"
        )
    return verdict


def publish_guard(results: DataFrame, all_runs: bool = False) -> DataFrame:
    """Failed critical checks per date and whether publication may go ahead.

    Only the newest run of a date decides, unless ``all_runs`` asks for the
    stricter reading in which an old failure keeps blocking.
    """
    rows = results if all_runs else latest_run(results)
    failed = F.count_if(~F.col("passed") & (F.col("severity") == "critical"))
    return rows.groupBy("business_date").agg(failed.alias("failed_critical"), (failed == 0).alias("publish_allowed"))


def publish_allowed(results: DataFrame, business_date: str, all_runs: bool = False) -> bool:
    rows = for_date(results, "business_date", business_date)
    rows = rows if all_runs else latest_run(rows)
    return rows.filter(~F.col("passed") & (F.col("severity") == "critical")).isEmpty()


# --- gauges -----------------------------------------------------------------
# Gauge names of both sides.
def _gauges(df: DataFrame, side: str, table: str, metrics: dict[str, str]) -> DataFrame:
    rows = F.array(*[
        F.struct(
            F.lit(metric).alias("metric"), F.col(c).cast("double").alias("value"),
            F.create_map(F.lit("db"), F.lit(side), F.lit("table"), F.lit(table)).alias("tags"),
        )
        for metric, c in metrics.items()
    ])
    return df.select("business_date", F.explode(rows).alias("g")).select("business_date", "g.*")


def daily_gauges(
    dw_trades: DataFrame, dw_drvt: DataFrame, dw_cash: DataFrame,
    src_trades: DataFrame, src_drvt: DataFrame, src_cash: DataFrame, business_date: str | None = None,
) -> DataFrame:
    """Loaded rows, duplicates, missing prices and zero sums of both sides as
    (date, metric, value, tags) rows; every table is aggregated once."""
    def trade_counts(df: DataFrame, date_col: str) -> DataFrame:
        df = df if business_date is None else for_date(df, date_col, business_date)
        per_id = df.groupBy(F.col(date_col).alias("business_date"), "trade_id").agg(F.count(F.lit(1)).alias("_n"))
        return per_id.groupBy("business_date").agg(F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("dups"))

    def counts(df: DataFrame, date_col: str, *extra: Column) -> DataFrame:
        df = df if business_date is None else for_date(df, date_col, business_date)
        return df.groupBy(F.col(date_col).alias("business_date")).agg(F.count(F.lit(1)).alias("rows"), *extra)

    nulls = F.count_if(F.col("settlement_price").isNull()).alias("nulls")
    zeros = F.count_if(F.col("long_value") + F.col("short_value") == 0).alias("zeros")
    src_zeros = F.count_if(F.col("settlement_value") == 0).alias("zeros")
    parts = [
        _gauges(trade_counts(dw_trades, "trade_dt"), "sqlserver", "dw_trade_movements", {
            "exchange.dw.trade_movements_loaded": "rows",
            "exchange.dw.trade_movements_destination_count": "rows",
            "exchange.dq.duplicate_trades": "dups",
        }),
        _gauges(counts(dw_drvt, "position_date", nulls), "sqlserver", "dw_drvt_positions", {
            "exchange.dw.derivative_positions_loaded": "rows",
            "exchange.dw.derivative_positions_destination_count": "rows",
            "exchange.dq.null_settlement_price": "nulls",
        }),
        _gauges(counts(dw_cash, "position_date", zeros), "sqlserver", "dw_cash_positions", {
            "exchange.dw.market_positions_loaded": "rows",
            "exchange.dw.cash_positions_destination_count": "rows",
            "exchange.dq.zero_sum_positions": "zeros",
        }),
        _gauges(trade_counts(src_trades, "business_date"), "oracle", "src_trade_movements", {
            "exchange.oracle.trade_mvmt_source_count": "rows",
            "exchange.oracle.duplicate_trades_source_count": "dups",
        }),
        _gauges(counts(src_drvt, "business_date"), "oracle", "src_drvt_positions", {
            "exchange.oracle.derivative_position_source_count": "rows",
        }),
        _gauges(counts(src_cash, "business_date", src_zeros), "oracle", "src_cash_positions", {
            "exchange.oracle.cash_position_source_count": "rows",
            "exchange.oracle.cash_zero_sum_source_count": "zeros",
        }),
    ]
    return reduce(DataFrame.unionByName, parts)
