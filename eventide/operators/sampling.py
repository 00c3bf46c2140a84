"""Repeatable sampling by hash order, and the data-quality drills built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import for_date, uuid_from
from ..schemas import OVERFLOW_SOURCE

# Hex digits of one histogram level.
BUCKET_DIGITS = 4
# Largest sample that one task may hold whole.
TOP = 10_000


def hash_order(key: str, seed: int) -> Column:
    """Pseudo-random but repeatable position of a key, as 32 hex digits."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def hash_mod(key: str, seed: int, n: int) -> Column:
    return F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("long") % n


def sample_cut(df: DataFrame, key: str, seed: int, n: int | None = None, fraction: float | None = None) -> DataFrame:
    """One row with the hash position ``cut`` up to which keys belong to the sample, and how many
    ``rows`` of the cut itself fill it up.

    Keys are taken in hash order until ``n`` rows (or ``max(1, int(rows *
    fraction))``) are covered. A histogram over the leading hex digits finds
    the bucket of the last key, and only that bucket is looked at in detail, so
    no full sort and no large limit is needed.
    """
    h = hash_order(key, seed)
    positions = df.select(h.alias("h"))
    bucket = F.substring("h", 1, BUCKET_DIGITS)
    histogram = positions.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    everything = W.partitionBy(F.lit(0))
    upto = everything.orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    if n is not None:
        target = F.lit(n).cast("long")
    else:
        target = F.greatest(F.lit(1).cast("long"), F.floor(F.sum("c").over(everything) * F.lit(float(fraction))))
    edge = (
        histogram.select("b", "c", target.alias("n"), F.sum("c").over(upto).alias("cum"))
        .filter((F.col("cum") >= F.col("n")) & (F.col("cum") - F.col("c") < F.col("n")))
        .select("b", "n", (F.col("cum") - F.col("c")).alias("before"))
    )
    # The same once more inside the bucket, so that the keys ranked at the end are few.
    inner = positions.filter(bucket == edge.select("b").scalar())
    deeper = F.substring("h", BUCKET_DIGITS + 1, BUCKET_DIGITS)
    rest = edge.select((F.col("n") - F.col("before")).alias("n")).scalar()
    fine = (
        inner.groupBy(deeper.alias("b")).agg(F.count(F.lit(1)).alias("c"))
        .select("b", "c", F.sum("c").over(upto).alias("cum"))
        .filter((F.col("cum") >= rest) & (F.col("cum") - F.col("c") < rest))
        .select("b", (rest - F.col("cum") + F.col("c")).alias("need"))
    )
    inside = (
        inner.filter(deeper == fine.select("b").scalar())
        .groupBy("h").agg(F.count(F.lit(1)).alias("c"))
        .withColumn("cum", F.sum("c").over(everything.orderBy("h").rowsBetween(W.unboundedPreceding, 0)))
    )
    need = fine.select("need").scalar()
    last = inside.filter(F.col("cum") - F.col("c") < need).agg(F.max("h").alias("cut"))
    # No edge bucket: the whole input is asked for ('g' sorts after every hex digit).
    before = inside.filter(F.col("cum") - F.col("c") < need).agg(F.max(F.col("cum") - F.col("c")).alias("b"))
    return last.select(
        F.coalesce("cut", F.lit("g")).alias("cut"), F.coalesce(need - before.scalar(), F.lit(0)).alias("rows"))


def sample_rows(
    df: DataFrame, key: str, seed: int = 0, n: int | None = None, fraction: float | None = None
) -> DataFrame:
    """``n`` rows or a share of the rows, picked by hash order of ``key``.

    ``n`` is exact at every size: rows of the last key are taken in the order of
    all their columns. Rows sharing the last key of a share stay together.
    """
    h = hash_order(key, seed)
    if n is not None and n <= TOP:  # every task keeps its first rows only
        return df.withColumn("_h", h).orderBy("_h", *df.columns).limit(n).drop("_h")
    cut = sample_cut(df, key, seed, n, fraction)
    if n is None:
        return df.filter(h <= cut.select("cut").scalar())
    # All rows below the cut, and of the cut's key as many as are missing.
    taken = df.withColumn("_h", h).filter(F.col("_h") <= cut.select("cut").scalar())
    place = F.row_number().over(W.partitionBy("_h").orderBy(*df.columns))
    return taken.withColumn("_n", place).filter(
        (F.col("_h") < cut.select("cut").scalar()) | (F.col("_n") <= cut.select("rows").scalar())).select(*df.columns)


# --- drills -----------------------------------------------------------------
def _slice(df: DataFrame, date_col: str, business_date: str | None) -> DataFrame:
    return df if business_date is None else for_date(df, date_col, business_date)


def drill_duplicates(
    df: DataFrame, business_date: str | None = None, seed: int = 0, n: int = 4, key: str = "trade_id",
    date_col: str = "business_date", new_values: dict[str, Column] | None = None,
) -> DataFrame:
    """Repeat ``n`` rows: unchanged, or under the same key with new values."""
    again = sample_rows(_slice(df, date_col, business_date), key, seed, n=n)
    if new_values:
        again = again.withColumns({c: v.cast(df.schema[c].dataType) for c, v in new_values.items()})
    return df.unionByName(again)


def drill_null_column(
    df: DataFrame, column: str, business_date: str | None = None, seed: int = 0, fraction: float = 0.05,
    first: int | None = None, key: str = "position_id", date_col: str = "position_date",
) -> DataFrame:
    """Blank a column on a share of the rows (at least one), or on the first rows by key."""
    rows = _slice(df, date_col, business_date)
    if first is not None:
        chosen = rows.select(key).orderBy(key).limit(first).distinct().withColumn("_hit", F.lit(True))
        marked = df.join(chosen, key, "left")
        hit = F.col("_hit").isNotNull()
    else:
        marked = df
        hit = hash_order(key, seed) <= sample_cut(rows, key, seed, fraction=fraction).select("cut").scalar()
    if business_date is not None:
        hit = hit & (F.col(date_col) == F.lit(business_date).cast("date"))
    blank = F.when(hit, F.lit(None)).otherwise(F.col(column)).cast(df.schema[column].dataType)
    return marked.withColumn(column, blank).select(*df.columns)


def drill_zero_sum(
    df: DataFrame, business_date: str, seed: int = 0, n: int = 5, source: str = "fault_injection"
) -> DataFrame:
    """Add ``n`` warehouse cash positions whose legs cancel out."""
    spark = df.sparkSession
    # The members and tickers of the added rows.
    parts = F.array(F.lit("PART001"), F.lit("PART002"), F.lit("PART003"))
    tickers = F.array(F.lit("PETR4"), F.lit("VALE3"), F.lit("ITUB4"))
    i = F.col("id")
    value = (F.lit(1000) + F.conv(F.substring(hash_order("id", seed), 1, 8), 16, 10).cast("long") % 49000)
    made = {
        "position_id": uuid_from(F.lit("zero-sum"), F.lit(business_date), F.lit(str(seed)), i),
        "ticker": F.element_at(tickers, (i % 3 + 1).cast("int")),
        "participant_code": F.element_at(parts, (i % 3 + 1).cast("int")),
        "position_date": F.lit(business_date).cast("date"),
        "long_value": value, "short_value": -value, "net_value": F.lit(0),
        "dw_source": F.lit(source),
    }
    rows = spark.range(n).select(*[
        made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema
    ])
    return df.unionByName(rows)


def drill_force_zero(
    df: DataFrame, business_date: str | None = None, first: int = 6, key: str = "position_id",
    date_col: str = "business_date",
) -> DataFrame:
    """Set the settlement value of the first rows by key to zero (source side)."""
    chosen = _slice(df, date_col, business_date).select(key).orderBy(key).limit(first).distinct()
    marked = df.join(chosen.withColumn("_hit", F.lit(True)), key, "left")
    kind = df.schema["settlement_value"].dataType
    value = F.when(F.col("_hit").isNotNull(), F.lit(0).cast(kind)).otherwise(F.col("settlement_value"))
    return marked.withColumn("settlement_value", value).select(*df.columns)


def drill_overflow(df: DataFrame, business_date: str) -> DataFrame:
    """Add one trade whose notional does not fit DECIMAL(18,4). The column is
    widened, because the row must survive until the check sees it."""
    spark = df.sparkSession
    made = {
        "trade_id": uuid_from(F.lit("overflow"), F.lit(business_date)),
        "ticker": F.lit("OVERFLOW_TEST"),
        "notional": F.lit("999999999999999.12345").cast("decimal(24,5)"),
        "quantity": F.lit(1), "trade_dt": F.lit(business_date).cast("date"),
        "status": F.lit("EXECUTED"), "dw_source": F.lit(OVERFLOW_SOURCE),
    }
    wide = df.withColumn("notional", F.col("notional").cast("decimal(24,5)"))
    row = spark.range(1).select(*[
        made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in wide.schema
    ])
    return wide.unionByName(row)


def drill_drop_rows(
    df: DataFrame, business_date: str | None = None, seed: int = 0, fraction: float = 0.10,
    key: str = "trade_id", date_col: str = "business_date",
) -> DataFrame:
    """Remove a share of the rows (at least one), with every row of a picked key."""
    cut = sample_cut(_slice(df, date_col, business_date), key, seed, fraction=fraction).select("cut")
    gone = hash_order(key, seed) <= cut.scalar()
    if business_date is not None:
        gone = gone & (F.col(date_col) == F.lit(business_date).cast("date"))
    return df.filter(~gone)


def drill_null_close(df: DataFrame, business_date: str | None = None, seed: int = 0, tickers: int = 2) -> DataFrame:
    """Blank closing price and VWAP of a few tickers."""
    rows = _slice(df, "business_date", business_date)
    chosen = rows.groupBy("ticker").agg(F.lit(True).alias("_hit")).orderBy(hash_order("ticker", seed)).limit(tickers)
    hit = F.col("_hit").isNotNull()
    if business_date is not None:
        hit = hit & (F.col("business_date") == F.lit(business_date).cast("date"))
    return df.join(chosen, "ticker", "left").withColumns({
        c: F.when(hit, F.lit(None)).otherwise(F.col(c)).cast(df.schema[c].dataType) for c in ("closing_price", "vwap")
    }).select(*df.columns)


def drill_late_settlement(df: DataFrame, business_date: str | None = None, seed: int = 0, n: int = 50) -> DataFrame:
    """Delay some instructions by one to three days and mark them failed."""
    chosen = sample_rows(_slice(df, "business_date", business_date).select("instruction_id"), "instruction_id", seed, n=n)
    marked = df.join(chosen.distinct().withColumn("_hit", F.lit(True)), "instruction_id", "left")
    hit = F.col("_hit").isNotNull()
    delay = (hash_mod("instruction_id", seed, 3) + 1).cast("int")
    return marked.withColumns({
        "settlement_date": F.when(hit, F.date_add("settlement_date", delay)).otherwise(F.col("settlement_date")),
        "status": F.when(hit, "FAILED").otherwise(F.col("status")),
    }).select(*df.columns)


def drill_volume_spike(df: DataFrame, business_date: str | None = None, seed: int = 0, factor: int = 10) -> DataFrame:
    """Add ``factor`` times the trades of one ticker, all copies of one of them with ids and order ids of their own.

    Each existing trade of the ticker gives rise to ``factor`` copies of the
    template, so the new rows are made where the old ones are, however many.
    """
    copied = ["price", "quantity", "buyer_participant", "seller_participant", "trade_time"]
    # One pass finds the ticker and the trade to copy, another gives every row and its copies.
    least = F.min_by(F.struct(*copied), F.struct("trade_id", "order_id", *copied)).alias("t")
    per_ticker = _slice(df, "business_date", business_date).groupBy("ticker").agg(least)
    pick = per_ticker.orderBy(hash_order("ticker", seed)).limit(1).select(F.struct("ticker", "t")).scalar()
    hit = F.col("ticker") == F.col("_pick.ticker")
    if business_date is not None:
        hit = hit & (F.to_date("business_date") == F.lit(business_date).cast("date"))
    row = F.xxhash64(*df.columns)  # trade ids can repeat
    number = not isinstance(df.schema["order_id"].dataType, T.StringType)  # texts get a UUID, numbers a hash

    def copy(k: Column) -> Column:
        made = {
            "trade_id": uuid_from(F.lit("spike"), "trade_id", row, k),
            "order_id": F.xxhash64(F.lit("spike-order"), "trade_id", row, k) if number else uuid_from(F.lit("spike-order"), "trade_id", row, k),
        } | {c: F.col(f"_pick.t.{c}") for c in copied}
        return F.struct(*[made.get(c, F.col(c)).cast(df.schema[c].dataType).alias(c) for c in df.columns])

    own = F.array(F.struct(*df.columns))
    copies = F.transform(F.sequence(F.lit(1), F.lit(factor)), copy)
    return df.withColumn("_pick", pick).select(F.explode(F.when(hit, F.concat(own, copies)).otherwise(own)).alias("r")).select("r.*")
