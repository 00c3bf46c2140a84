"""Closing prices, net positions, reconciliations and the daily reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import percent, quotient, volume_category
from ..session import materialise
from .joins import bloom_anti_join, salted_left_join, split_join

TICKER_DAY = ["ticker", "business_date"]
POSITION_KEY = ["business_date", "participant_id", "ticker"]


def _stamp(df: DataFrame, name: str, stamp) -> DataFrame:
    """Append an injected timestamp column, or nothing when none is given."""
    return df if stamp is None else df.withColumn(name, F.lit(stamp).cast("timestamp"))


def _notional() -> Column:
    return (F.col("price") * F.col("quantity")).cast("decimal(28,4)")


def _last_price() -> Column:
    """Price of the latest trade; equal times are settled by the higher price.

    Time and price are packed into one decimal, because an ordering of fixed
    width keeps the aggregation hash-based; a struct would sort every input.
    """
    time = F.unix_micros(F.col("trade_time").cast("timestamp")).cast("decimal(18,0)")
    order = (time * F.lit(10**14).cast("decimal(15,0)")).cast("decimal(34,4)") + F.coalesce("price", F.lit(0).cast("decimal(18,4)"))
    return F.max_by("price", order)


def _stats() -> list[Column]:
    volume = F.sum(F.col("quantity").cast("long"))
    notional = F.sum(_notional())
    return [
        F.count(F.lit(1)).alias("trade_count"),
        volume.alias("daily_volume"),
        quotient(notional, volume).alias("vwap"),
        notional.alias("total_notional"),
    ]


# --- closing prices ---------------------------------------------------------
def last_trade(trades: DataFrame) -> DataFrame:
    """Last traded price per ticker and day."""
    return trades.groupBy(*TICKER_DAY).agg(_last_price().alias("closing_price"))


def trade_stats(trades: DataFrame) -> DataFrame:
    """Trade count, volume, VWAP and notional per ticker and day."""
    return trades.groupBy(*TICKER_DAY).agg(*_stats())


def close_prices(trades: DataFrame, created_at=None) -> DataFrame:
    """Last price and statistics per ticker and day, in one aggregation."""
    out = trades.groupBy(*TICKER_DAY).agg(_last_price().alias("closing_price"), *_stats())
    return _stamp(out.withColumn("auction_flag", F.lit(False)), "created_at", created_at)


def close_snapshot(close: DataFrame, snapshot_time=None) -> DataFrame:
    out = close.select(
        "ticker", "business_date", "closing_price", "daily_volume", "vwap", "trade_count",
        "total_notional", volume_category("daily_volume").alias("volume_category"),
    )
    return _stamp(out, "snapshot_time", snapshot_time)


def close_by_vwap(trades: DataFrame) -> DataFrame:
    """Closing price as the VWAP at two decimals (half-even), volume and VWAP at four."""
    volume = F.sum(F.col("quantity").cast("long"))
    exact = quotient(F.sum(_notional()), volume)
    return trades.groupBy(*TICKER_DAY).agg(
        F.bround(exact, 2).cast("decimal(18,4)").alias("closing_price"),
        volume.alias("daily_volume"),
        F.bround(exact, 4).cast("decimal(18,4)").alias("vwap"),
    )


def enrich_trades(trades: DataFrame, close: DataFrame) -> DataFrame:
    """Trades with the day's closing price and the distance to it in percent."""
    price = F.col("price").cast("decimal(18,4)")
    closing = F.col("closing_price").cast("decimal(18,4)")
    return split_join(trades, close.select(*TICKER_DAY, "closing_price"), TICKER_DAY, "left").withColumn(
        "price_vs_close_pct",
        F.round(F.try_divide((price - closing) * 100, closing), 4).cast("decimal(20,4)"),
    )


# --- positions --------------------------------------------------------------
def _legs(trades: DataFrame) -> DataFrame:
    """One buy and one sell row per trade, read in a single scan."""
    q = F.col("quantity").cast("long")
    leg = F.explode(
        F.array(
            F.struct(F.col("buyer_participant").alias("participant_id"), q.alias("signed"), F.lit("B").alias("side")),
            F.struct(F.col("seller_participant").alias("participant_id"), (-q).alias("signed"), F.lit("S").alias("side")),
        )
    )
    keep = [c for c in ("business_date", "ticker", "price") if c in trades.columns]
    return trades.select(*keep, leg.alias("leg")).select(*keep, "leg.*")


def net_traded(trades: DataFrame) -> DataFrame:
    """Bought minus sold quantity per day, participant and ticker."""
    return _legs(trades).groupBy(*POSITION_KEY).agg(F.sum("signed").alias("traded_net_qty"))


def net_positions_full_outer(trades: DataFrame) -> DataFrame:
    """Net positions from separate buy and sell totals; an absent side counts as zero."""

    def side(column: str, name: str) -> DataFrame:
        return trades.groupBy("business_date", F.col(column).alias("participant_id"), "ticker").agg(
            F.sum(F.col("quantity").cast("long")).alias(name)
        )

    bought = F.coalesce("bought", F.lit(0))
    sold = F.coalesce("sold", F.lit(0))
    return (
        side("buyer_participant", "bought")
        .join(side("seller_participant", "sold"), POSITION_KEY, "full_outer")
        .select(*POSITION_KEY, bought.alias("bought"), sold.alias("sold"), (bought - sold).alias("net_quantity"))
    )


def participant_positions(trades: DataFrame) -> DataFrame:
    """Net quantity, and the plain mean of the buy-side and sell-side mean prices.

    Both sides come from one aggregation with conditional means, so no second
    grouping level or union is needed.
    """
    buy, sell = F.col("side") == "B", F.col("side") == "S"
    means = F.array_compact(F.array("buy_mean", "sell_mean"))
    total = F.coalesce("buy_mean", F.lit(0)) + F.coalesce("sell_mean", F.lit(0))
    return (
        _legs(trades)
        .groupBy(*POSITION_KEY)
        .agg(
            F.sum("signed").alias("net_quantity"),
            F.avg(F.when(buy, F.col("price"))).alias("buy_mean"),
            F.avg(F.when(sell, F.col("price"))).alias("sell_mean"),
        )
        .select(
            F.col("participant_id").alias("participant"), "ticker", "business_date", "net_quantity",
            F.bround(
                F.try_divide(total.cast("decimal(23,8)"), F.size(means).cast("decimal(1,0)")), 4
            ).cast("decimal(18,4)").alias("avg_price"),
        )
    )


def position_recon(positions: DataFrame, trades: DataFrame, reconciled_at=None) -> DataFrame:
    """Declared positions against net traded quantities."""
    declared = positions.select(
        F.col("participant").alias("participant_id") if "participant" in positions.columns else "participant_id",
        "ticker", "business_date", F.col("net_quantity").cast("long").alias("declared_quantity"),
    )
    traded = F.coalesce("traded_net_qty", F.lit(0))
    diff = F.col("declared_quantity") - traded
    out = declared.join(net_traded(trades), POSITION_KEY, "left").select(
        "participant_id", "ticker", "business_date", "declared_quantity",
        traded.alias("traded_net_qty"), diff.alias("quantity_diff"),
        F.when(F.abs(diff) < 1, "MATCHED").otherwise("BREAK").alias("recon_status"),
    )
    return _stamp(out, "reconciled_at", reconciled_at)


def participant_exposure(recon: DataFrame, close: DataFrame, generated_at=None) -> DataFrame:
    """Mark-to-market and exposure difference of each reconciled position."""
    price = F.coalesce(F.col("closing_price").cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)"))
    out = split_join(recon, close.select(*TICKER_DAY, "closing_price"), TICKER_DAY, "left").select(
        "participant_id", "ticker", "business_date", "declared_quantity", "traded_net_qty",
        "quantity_diff", "recon_status", "closing_price",
        (F.col("declared_quantity") * price).alias("mark_to_market"),
        (F.col("quantity_diff") * price).alias("exposure_diff"),
    )
    return _stamp(out, "report_generated_at", generated_at)


def exposure_in_one_pass(trades: DataFrame, declared: Column) -> DataFrame:
    """Position reconciliation and exposure from one scan of the trades and one shuffle.

    ``declared`` marks the trades that make up the declared positions. Each trade gives a
    buy leg, a sell leg and a row for its ticker's close; one aggregation by (date, ticker,
    participant) yields declared and traded quantities and closing prices together, summed
    before they travel, however hot a ticker is. Its result, a row per position and ticker
    day, meets itself for the prices.
    """
    q = F.col("quantity").cast("long")
    none = F.lit(None).cast("string")
    legs = F.explode(F.array(
        F.struct(F.col("buyer_participant").alias("participant_id"), q.alias("signed"), F.lit(False).alias("close")),
        F.struct(F.col("seller_participant").alias("participant_id"), (-q).alias("signed"), F.lit(False).alias("close")),
        F.struct(none.alias("participant_id"), F.lit(0).cast("long").alias("signed"), F.lit(True).alias("close"))))
    rows = trades.withColumn("_declared", F.coalesce(declared, F.lit(False))).select(
        "business_date", "ticker", "price", "trade_time", "_declared", legs.alias("leg")).select("*", "leg.*")
    summed, _ = materialise(rows.groupBy("business_date", "ticker", "participant_id", "close").agg(
        F.sum(F.when(F.col("_declared"), F.col("signed"))).alias("declared_quantity"),
        F.count_if("_declared").alias("_n"), F.sum("signed").alias("traded_net_qty"), _last_price().alias("closing_price")), "exposure")
    diff = F.col("declared_quantity") - F.col("traded_net_qty")
    recon = summed.filter("NOT close AND _n > 0").select(
        "participant_id", "ticker", "business_date", "declared_quantity", "traded_net_qty", diff.alias("quantity_diff"),
        F.when(F.abs(diff) < 1, "MATCHED").otherwise("BREAK").alias("recon_status"))
    return participant_exposure(recon, summed.filter("close"))


# --- settlement -------------------------------------------------------------
def settlement_recon(
    trades: DataFrame, instructions: DataFrame, reconciled_at=None, trade_ids: DataFrame | None = None
) -> DataFrame:
    """Trades against settlement instructions by trade id.

    The id alone is compared, so repeated ids fan out; ids that hold many rows on
    either side are split (``salted_left_join``). An instruction without a status is
    reported like a missing one.
    """
    side = instructions.select(
        "trade_id", "settlement_id", "settlement_date", F.col("status").alias("settlement_status"),
        F.lit(True).alias("_found"),
    )
    found = F.col("_found").isNotNull()
    status = F.col("settlement_status")
    out = salted_left_join(trades, side, "trade_id", left_keys=trade_ids).select(
        "trade_id", "ticker", "business_date", "price", "quantity", "buyer_participant",
        "seller_participant", "settlement_id", "settlement_date", "settlement_status",
        F.when(found & (status == "MATCHED"), "MATCHED")
        .when(found & (status != "MATCHED"), "BREAK")
        .otherwise("MISSING_INSTRUCTION").alias("recon_status"),
        _notional().alias("notional_value"),
    )
    return _stamp(out, "reconciled_at", reconciled_at)


def settlement_recon_detailed(trades: DataFrame, instructions: DataFrame, trade_ids: DataFrame | None = None) -> DataFrame:
    """Reconciliation with separate quantity and amount match flags."""
    side = instructions.select(
        "trade_id", "instruction_id", F.col("quantity").alias("settlement_quantity"),
        F.col("amount").alias("settlement_amount"), F.col("status").alias("_status"),
    )
    amount = _notional()
    present = F.col("instruction_id").isNotNull()
    return salted_left_join(
        trades.select("trade_id", "ticker", "price", "quantity", "business_date"), side, "trade_id", left_keys=trade_ids
    ).select(
        "trade_id", "instruction_id", "ticker", F.col("quantity").alias("trade_quantity"),
        "settlement_quantity",
        F.when(present, F.col("quantity").eqNullSafe(F.col("settlement_quantity"))).alias("quantity_match"),
        amount.alias("trade_amount"), "settlement_amount",
        F.when(present, amount.eqNullSafe(F.col("settlement_amount"))).alias("amount_match"),
        F.when(present & (F.col("_status") == "MATCHED"), "MATCHED")
        .when(present & (F.col("_status") != "MATCHED"), "BREAK")
        .otherwise("MISSING_INSTRUCTION").alias("recon_status"),
        "business_date",
    )


def settlement_report(recon: DataFrame, generated_at=None) -> DataFrame:
    """Daily counts per status, match rate and notionals from reconciled rows."""
    status, notional = F.col("recon_status"), F.col("notional_value")
    out = recon.groupBy("business_date").agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.count_if(status == "MATCHED").alias("matched_count"),
        F.count_if(status == "BREAK").alias("break_count"),
        F.count_if(status == "MISSING_INSTRUCTION").alias("missing_count"),
        F.sum(F.when(status == "BREAK", notional).otherwise(F.lit(0))).alias("break_notional"),
        F.sum(notional).alias("total_notional"),
    )
    return _stamp(_report_columns(out), "report_generated_at", generated_at)


def settlement_report_from_raw(trades: DataFrame, instructions: DataFrame, generated_at=None) -> DataFrame:
    """The same report without building the fanned-out reconciliation.

    Instructions shrink to one row of status counts per trade id, so a trade id
    repeated without end costs one row, and the join never multiplies. The counts
    meet the trades by a shuffle of their own, so AQE can split a hot id there.
    """
    per_id = instructions.groupBy("trade_id").agg(
        F.count_if(F.col("status") == "MATCHED").alias("_matched"),
        F.count_if(F.col("status") != "MATCHED").alias("_break"),
        F.count(F.lit(1)).alias("_all"),
    )
    copies = F.coalesce("_all", F.lit(1))
    matched, broken = F.coalesce("_matched", F.lit(0)), F.coalesce("_break", F.lit(0))
    notional = _notional()
    out = (
        split_join(trades.select("trade_id", "business_date", "price", "quantity"), per_id, "trade_id", "left")
        .groupBy("business_date")
        .agg(
            F.sum(copies).alias("total_trades"),
            F.sum(matched).alias("matched_count"),
            F.sum(broken).alias("break_count"),
            F.sum(copies - matched - broken).alias("missing_count"),
            F.sum(F.when(broken > 0, (notional * broken).cast("decimal(28,4)")).otherwise(F.lit(0))).alias("break_notional"),
            F.sum((notional * copies).cast("decimal(28,4)")).alias("total_notional"),
        )
    )
    return _stamp(_report_columns(out), "report_generated_at", generated_at)


def _report_columns(counts: DataFrame) -> DataFrame:
    return counts.select(
        "business_date", "total_trades", "matched_count", "break_count", "missing_count",
        percent(F.col("matched_count"), F.col("total_trades")).alias("match_rate_pct"),
        "break_notional", "total_notional",
    )


def orphan_instructions(instructions: DataFrame, trades: DataFrame) -> DataFrame:
    """Instructions whose trade id has no trade on the same business date.

    Instructions are few beside the trades: of those only keys that pass a Bloom filter
    of the instructions' keys travel, one row each.
    """
    return bloom_anti_join(instructions, trades, ["trade_id", "business_date"])


def trades_without_instruction(trades: DataFrame, instructions: DataFrame) -> DataFrame:
    """Trades no instruction refers to, or that are named only by ones without a status.

    Counts each trade once per status-less instruction, as the reconciliation does.
    """
    per_id = instructions.groupBy("trade_id").agg(
        F.count(F.lit(1)).alias("_all"), F.count("status").alias("_with_status")
    )
    return split_join(trades, per_id, "trade_id", "left").withColumn(
        "missing_rows", F.coalesce(F.col("_all") - F.col("_with_status"), F.lit(1))
    ).drop("_all", "_with_status").filter("missing_rows > 0")


# --- row-count parity -------------------------------------------------------
def row_count_parity(source: DataFrame, target: DataFrame, source_date: str, target_date: str) -> DataFrame:
    """Row counts of two tables per date, side by side, from one aggregation.

    Rows without a date are counted apart for each table: no date equals another then.
    """
    sides = source.select(F.col(source_date).alias("business_date"), F.lit(1).alias("_s")).unionByName(
        target.select(F.col(target_date).alias("business_date"), F.lit(0).alias("_s")))
    apart = F.when(F.col("business_date").isNull(), F.col("_s")).alias("_apart")
    counts = sides.groupBy("business_date", apart).agg(
        F.sum("_s").cast("long").alias("source_count"), F.sum(1 - F.col("_s")).cast("long").alias("target_count"))
    return counts.select(
        "business_date", "source_count", "target_count", (F.col("source_count") - F.col("target_count")).alias("count_diff"))


# --- derived inputs ---------------------------------------------------------
def latest_value(df: DataFrame, keys: list[str], ts: str, value: str, tie: str | None = None) -> DataFrame:
    """Last value of a series per key."""
    order = F.struct(ts, *([tie] if tie else []), value)
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(ts).alias(ts))
