"""Mappings between the source, raw and warehouse layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import uuid_from

# Trading members assumed active when the reference table is empty.
DEFAULT_PARTICIPANTS = [f"PART{i:03d}" for i in range(1, 11)]


def _zero_null(name: str, zero_as_null: bool) -> Column:
    c = F.col(name)
    return F.nullif(c, F.lit(0)) if zero_as_null else c


# --- source layer to warehouse ----------------------------------------------
def map_trades_g1(src: DataFrame, *columns: str) -> DataFrame:
    """Source trade movements: notional from price and quantity, desk from the
    instrument prefix, buyer as counterparty and seller as trader.

    With ``columns`` only those are made, from a source that holds their inputs.
    """
    made = {
        "trade_id": F.col("trade_id"),
        "ticker": F.col("instrument_code"),
        "notional": F.coalesce(F.col("closing_price") * F.col("quantity"), F.lit(0)),
        "quantity": F.col("quantity"),
        "trade_dt": F.col("business_date"),
        "settlement_dt": F.col("settlement_dt"),
        "counterparty_id": F.col("buy_participant"),
        "trader_id": F.col("sell_participant"),
        "desk_code": F.substring("instrument_code", 1, 5),
        "status": F.col("status"),
    }
    return src.select(*[made[c].alias(c) for c in columns or made])


def map_trades_g2(rows: DataFrame, business_date: str | Column | None = None) -> DataFrame:
    """Warehouse-shaped trade rows with defaults for absent values."""
    day = F.to_date(F.substring(F.col("trade_dt").cast("string"), 1, 10))
    if business_date is not None:
        fallback = F.lit(business_date).cast("date") if isinstance(business_date, str) else business_date
        day = F.coalesce(day, fallback)
    return rows.select(
        "trade_id", "ticker",
        F.coalesce("notional", F.lit(0)).alias("notional"),
        F.coalesce("quantity", F.lit(0)).alias("quantity"),
        day.alias("trade_dt"),
        "settlement_dt", "counterparty_id", "trader_id", "desk_code",
        F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("EXECUTED")).alias("status"),
    )


def map_drvt_positions(src: DataFrame, zero_as_null: bool = False) -> DataFrame:
    """Source derivative positions. Price and margin both carry the market value;
    a missing price stays missing so that the completeness check sees it."""
    price = _zero_null("market_value", zero_as_null)
    return src.select(
        "position_id",
        F.col("instrument_code").alias("instrument_id"),
        "participant_code",
        F.col("business_date").alias("position_date"),
        F.coalesce("long_quantity", F.lit(0)).alias("long_qty"),
        F.coalesce("short_quantity", F.lit(0)).alias("short_qty"),
        F.coalesce("net_quantity", F.lit(0)).alias("net_qty"),
        price.alias("settlement_price"),
        price.alias("margin_value"),
    )


def map_drvt_rows(rows: DataFrame, zero_as_null: bool = False) -> DataFrame:
    """Warehouse-shaped derivative positions with zero quantities for absent ones."""
    return rows.select(
        "position_id",
        F.coalesce("instrument_id", F.lit("")).alias("instrument_id"),
        F.coalesce("participant_code", F.lit("")).alias("participant_code"),
        "position_date",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("long_qty", "short_qty", "net_qty")],
        _zero_null("settlement_price", zero_as_null).alias("settlement_price"),
        _zero_null("margin_value", zero_as_null).alias("margin_value"),
    )


def map_cash_positions(src: DataFrame) -> DataFrame:
    """Source cash positions: the signed settlement value becomes a long or a
    short leg; a missing value counts as zero."""
    v = F.coalesce(F.col("settlement_value"), F.lit(0).cast("decimal(22,6)"))
    zero = F.lit(0).cast("decimal(22,6)")
    long_leg = F.when(v >= 0, v).otherwise(zero)
    short_leg = F.when(v < 0, v).otherwise(zero)
    return src.select(
        "position_id",
        F.col("instrument_code").alias("ticker"),
        "participant_code",
        F.col("business_date").alias("position_date"),
        long_leg.alias("long_value"),
        short_leg.alias("short_value"),
        (long_leg + short_leg).alias("net_value"),
    )


def map_cash_rows(rows: DataFrame) -> DataFrame:
    """Warehouse-shaped cash positions with zero for absent legs."""
    return rows.select(
        "position_id",
        F.coalesce("ticker", F.lit("")).alias("ticker"),
        F.coalesce("participant_code", F.lit("")).alias("participant_code"),
        "position_date",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("long_value", "short_value", "net_value")],
    )


# --- fallback readers over the raw layer ------------------------------------
def fallback_trades(raw_trades: DataFrame) -> DataFrame:
    """Raw trades in warehouse shape: seller as counterparty, buyer as trader."""
    return raw_trades.select(
        "trade_id", "ticker",
        (F.col("price") * F.col("quantity")).alias("notional"),
        "quantity",
        F.col("business_date").alias("trade_dt"),
        F.lit(None).cast("date").alias("settlement_dt"),
        F.col("seller_participant").alias("counterparty_id"),
        F.col("buyer_participant").alias("trader_id"),
        F.lit(None).cast("string").alias("desk_code"),
        F.lit("EXECUTED").alias("status"),
    )


def fallback_drvt_positions(raw_positions: DataFrame) -> DataFrame:
    """Raw participant positions as derivative positions. The id is derived from
    the business key, so a rerun produces the same rows."""
    q = F.col("net_quantity")
    return raw_positions.select(
        uuid_from(F.lit("drvt"), "participant", "ticker", "business_date").alias("position_id"),
        F.col("ticker").alias("instrument_id"),
        F.col("participant").alias("participant_code"),
        F.col("business_date").alias("position_date"),
        F.greatest(q, F.lit(0)).alias("long_qty"),
        F.abs(F.least(q, F.lit(0))).alias("short_qty"),
        q.alias("net_qty"),
        F.col("avg_price").alias("settlement_price"),
        F.lit(None).cast("decimal(18,4)").alias("margin_value"),
    )


def fallback_cash_positions(raw_positions: DataFrame) -> DataFrame:
    """Raw participant positions as cash positions valued at the average price."""
    value = F.col("net_quantity") * F.col("avg_price")
    return raw_positions.select(
        uuid_from(F.lit("cash"), "participant", "ticker", "business_date").alias("position_id"),
        "ticker",
        F.col("participant").alias("participant_code"),
        F.col("business_date").alias("position_date"),
        F.when(value.isNotNull(), F.greatest(value, F.lit(0))).alias("long_value"),
        F.when(value.isNotNull(), F.least(value, F.lit(0))).alias("short_value"),
        value.alias("net_value"),
    )


# --- producers --------------------------------------------------------------
def derive_instructions(trades: DataFrame, status: str = "PENDING") -> DataFrame:
    """One settlement instruction per trade, due two days after the trade."""
    return trades.select(
        uuid_from(F.lit("instruction"), "trade_id", "business_date").alias("instruction_id"),
        "trade_id",
        F.date_add("business_date", 2).alias("settlement_date"),
        F.col("buyer_participant").alias("participant"),
        "ticker", "quantity",
        F.round(F.col("price") * F.col("quantity"), 4).cast("decimal(18,4)").alias("amount"),
        F.lit(status).alias("status"),
        "business_date",
    )


def derive_positions(net: DataFrame) -> DataFrame:
    """Quantity and value legs of net positions, for both position tables."""
    q, p = F.col("net_quantity"), F.col("avg_price")
    long_qty = F.greatest(q, F.lit(0))
    short_qty = F.abs(F.least(q, F.lit(0)))
    return net.select(
        uuid_from(F.lit("position"), "participant", "ticker", "business_date").alias("position_id"),
        "ticker", "participant", "business_date",
        long_qty.alias("long_qty"), short_qty.alias("short_qty"), q.alias("net_qty"),
        p.alias("settlement_price"),
        (long_qty * p).alias("long_value"), (-short_qty * p).alias("short_value"),
        (q * p).alias("net_value"),
    )


def active_participants(participants: DataFrame) -> DataFrame:
    """Codes of active members; the default members when none is active."""
    spark = participants.sparkSession
    active = participants.filter("active").select("participant_code")
    default = spark.createDataFrame([(p,) for p in DEFAULT_PARTICIPANTS], "participant_code string")
    any_active = active.limit(1).agg(F.count(F.lit(1)))
    return active.unionByName(default.filter(any_active.scalar() == 0))
