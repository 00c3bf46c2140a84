"""Column functions shared by the mappings, reports and lineage events."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def for_date(df: DataFrame, date_col: str, business_date: str) -> DataFrame:
    """Rows of one business date. A date column keeps the bare comparison, so
    the filter reaches the scan and prunes partitions; a timestamp column gets
    a half-open range, which is pushed down too."""
    day = F.lit(business_date).cast("date")
    kind = df.schema[date_col].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.col(date_col)
        return df.filter((c >= day.cast(kind)) & (c < F.date_add(day, 1).cast(kind)))
    if isinstance(kind, T.StringType):
        return df.filter(F.to_date(date_col) == day)
    return df.filter(F.col(date_col) == day)


def canonical(c: Column, kind: T.DataType) -> Column:
    """Engine-neutral text of a value: plain decimals, ISO dates, NULL as ``None``."""
    if isinstance(kind, T.DateType):
        text = F.date_format(c, "yyyy-MM-dd")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        text = c.cast("decimal(38,4)").cast("string")
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("None"))


def row_hash(df: DataFrame, columns: Iterable[str]) -> Column:
    """SHA-256 over the pipe-joined business key."""
    parts = [canonical(F.col(c), df.schema[c].dataType) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def add_audit(df: DataFrame, source: str | None, key_cols: Iterable[str], load_ts) -> DataFrame:
    """Append ``dw_load_dt``, ``dw_source`` and ``dw_row_hash``.

    ``load_ts`` is injected so that a rerun writes the same bytes. With
    ``source=None`` an existing ``dw_source`` column is kept.
    """
    out = {"dw_load_dt": F.lit(load_ts).cast("timestamp"), "dw_row_hash": row_hash(df, key_cols)}
    if source is not None:
        out["dw_source"] = F.lit(source)
    return df.withColumns(out)


def volume_category(volume: Column | str) -> Column:
    v = col_of(volume)
    return F.when(v > 1_000_000, "HIGH").when(v > 100_000, "MEDIUM").otherwise("LOW")


def uuid_from(*parts: Column | str) -> Column:
    """Repeatable identifier: MD5 of the dash-joined parts, laid out as a UUID."""
    digest = F.md5(F.concat_ws("-", *[col_of(p).cast("string") for p in parts]))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.substring(digest, 13, 4),
        F.substring(digest, 17, 4),
        F.substring(digest, 21, 12),
    )


def quotient(numerator: Column, denominator: Column) -> Column:
    """Exact decimal ratio, NULL for a zero denominator.

    The operands are narrowed first: left at decimal(38) Spark keeps only six
    fraction digits, which is too few to round a VWAP once and correctly.
    """
    den = denominator.cast("decimal(19,0)")
    return F.try_divide(numerator.cast("decimal(28,4)"), den)


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` at two decimals, NULL when ``whole`` is zero."""
    ratio = F.try_divide((part * 100).cast("decimal(20,0)"), whole.cast("decimal(19,0)"))
    return F.round(ratio, 2).cast("decimal(7,2)")


def iso_millis(ts: Column | str, shift_hours: int = 0) -> Column:
    """UTC timestamp as ``yyyy-MM-ddTHH:mm:ss.SSSZ``, optionally shifted by hours."""
    moved = col_of(ts) + F.make_interval(hours=F.lit(shift_hours))
    return F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def date_tag(d: Column | str) -> Column:
    return F.date_format(col_of(d), "yyyyMMdd")


def one_line(text: Column | str, width: int = 500) -> Column:
    """Whitespace collapsed to single blanks, cut at ``width`` characters."""
    return F.substring(F.regexp_replace(col_of(text), r"\s+", " "), 1, width)


def tail_text(text: Column | str, n: int) -> Column:
    return F.right(col_of(text), F.lit(n))


def tag_map(text: Column | str) -> Column:
    """``k:v,k:v`` to a map. Entries without a colon are dropped, later keys win,
    and a value may itself contain colons."""
    pairs = F.filter(F.split(col_of(text), ","), lambda p: F.contains(p, F.lit(":")))
    entries = F.transform(
        pairs,
        lambda p: F.struct(
            F.substring_index(p, ":", 1).alias("key"),
            F.substr(p, F.instr(p, ":") + 1).alias("value"),
        ),
    )
    return F.aggregate(
        entries,
        F.create_map().cast("map<string,string>"),
        lambda acc, e: F.map_concat(
            F.map_filter(acc, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])
        ),
    )


# Fixed value: the pattern that finds the tables a query text reads.
TABLE_REFERENCE = r"(?i)\b(?:FROM|JOIN)\s+([A-Za-z0-9_.]+)"


def referenced_tables(sql_text: Column | str) -> Column:
    return F.regexp_extract_all(col_of(sql_text), F.lit(TABLE_REFERENCE), F.lit(1))
