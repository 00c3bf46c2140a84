"""Writers: slice replacement, result tables, exports, upserts and rejects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import for_date, row_hash
from ..schemas import Contract


def _partitioned(df: DataFrame, part_col: str) -> DataFrame:
    """Few files per date without sending one date to one task: AQE splits the
    large partitions of a rebalance and merges the small ones."""
    return df.hint("rebalance", part_col)


def replace_slices(df: DataFrame, path: str, part_col: str) -> None:
    """Replace every date present in ``df``; other dates stay as they are."""
    (
        _partitioned(df, part_col).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(part_col).parquet(path)
    )


def replace_slice(df: DataFrame, path: str, part_col: str, business_date: str) -> int:
    """Replace one date with the rows of ``df`` and return how many were written.

    The new files are written beside the old slice, which goes only when all of them
    are there. A date without rows is emptied. The count is that of the files written,
    whatever tasks ran twice.
    """
    spark = df.sparkSession
    day = F.lit(business_date).cast(df.schema[part_col].dataType)
    rows = for_date(df, part_col, business_date).withColumn(part_col, day)
    replace_slices(rows, path, part_col)
    target = f"{path}/{part_col}={business_date}"
    stored = spark.read.schema(T.StructType([f for f in rows.schema if f.name != part_col]))
    if rows.isEmpty():
        clear_slices(spark, path, part_col, [business_date], rows.schema)
        return 0
    return stored.parquet(target).count()


def clear_slices(spark: SparkSession, path: str, part_col: str, dates: list[str], layout: T.StructType) -> None:
    """Empty the given dates of a partitioned table, as far as it holds them."""
    if not dates:
        return
    empty = spark.createDataFrame([], T.StructType([f for f in layout if f.name != part_col]))
    held = spark.read.schema(layout).parquet(path).filter(F.col(part_col).cast("string").isin(dates))
    for date in [str(r[0]) for r in held.select(part_col).distinct().collect()]:
        empty.write.mode("overwrite").parquet(f"{path}/{part_col}={date}")


def copy_table(source: DataFrame, path: str, business_date: str, date_col: str = "business_date") -> int:
    """Copy one date of a table to another, replacing what the target holds."""
    return replace_slice(source, path, date_col, business_date)


def write_dq_results(results: DataFrame, path: str, mode: str = "replace") -> None:
    """Store check results: replace the dates they cover, or append the run."""
    if mode == "replace":
        replace_slices(results, path, "business_date")
    elif mode == "append":
        _partitioned(results, "business_date").write.mode("append").partitionBy("business_date").parquet(path)
    else:
        raise ValueError(f"unknown mode: {mode}")


def _tagged(path: str, business_date: str, suffix: str) -> str:
    return f"{path}_{business_date.replace('-', '')}.{suffix}"


def export_parquet(df: DataFrame, path: str, business_date: str) -> str | None:
    """Write a slice under a date-tagged name; nothing is written when it is empty."""
    if df.isEmpty():
        return None
    target = _tagged(path, business_date, "parquet")
    df.write.mode("overwrite").parquet(target)
    return target


def export_csv(df: DataFrame, path: str, business_date: str) -> str | None:
    """Like :func:`export_parquet`, as CSV with a header and empty text for NULL."""
    if df.isEmpty():
        return None
    target = _tagged(path, business_date, "csv")
    write_csv(df, target)
    return target


def write_csv(df: DataFrame, path: str, part_col: str | None = None) -> None:
    """CSV with a header; with a partition column only the dates in ``df`` are replaced."""
    writer = df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "")
    if part_col:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(part_col)
    writer.csv(path)


def append_run_history(runs: DataFrame, path: str) -> None:
    """Append run records, one JSON object per line."""
    runs.write.mode("append").json(path)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], cols: list[str],
           order: str | None = None) -> DataFrame:
    """Update ``cols`` of rows whose key exists, insert the other rows.

    ``target`` must be unique on ``keys``. Repeated updates of a key take effect in the
    order of ``order`` (by default of all their columns): the last one stands.
    """
    rest = [c for c in updates.columns if c not in keys]
    if rest:
        rank = F.struct(*([order] if order else []), *rest)
        updates = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_last")).select(*keys, "_last.*")
    else:
        updates = updates.select(*keys).distinct()
    marked = updates.select(
        *keys, F.lit(True).alias("_updated"),
        *[F.col(c).alias(f"_new_{c}") for c in target.columns if c not in keys and c in updates.columns],
    )
    joined = target.withColumn("_present", F.lit(True)).join(marked, keys, "full_outer")

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c not in updates.columns:
            return F.col(c)
        fresh = F.col("_updated").isNotNull() if c in cols else F.col("_present").isNull()
        return F.when(fresh, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*[value(c) for c in target.columns])


def insert_missing(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` plus the rows whose key it does not hold yet (the first one per key)."""
    rest = [c for c in target.columns if c not in keys]
    fresh = rows.join(target.select(*keys), keys, "left_anti")
    first = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*") if rest else fresh.select(*keys).distinct()
    return target.unionByName(first.select(*target.columns))


# --- what a load changes ----------------------------------------------------
def hash_diff(stored: DataFrame, fresh: DataFrame, day: str, keys: list[str], columns: list[str]) -> DataFrame:
    """``day, keys, unchanged, updated, inserted, deleted`` rows, for every date and key of either side.

    Rows are compared by the hash of ``columns``. A key may repeat: its rows are two
    multisets, equal rows are unchanged, and of the others as many as both sides hold are
    updates. Dates, keys and hashes (32 bytes) are shuffled once, then dates, keys and counts.
    """
    def side(df: DataFrame, old: int) -> DataFrame:
        return df.select(day, *keys, F.unhex(row_hash(df, columns)).alias("_h"), F.lit(old).alias("_old"))

    both = side(stored, 1).unionByName(side(fresh, 0))
    per_hash = both.groupBy(day, *keys, "_h").agg(
        F.sum("_old").alias("_o"), F.sum(1 - F.col("_old")).alias("_n"))
    same = F.least("_o", "_n")
    per_key = per_hash.groupBy(day, *keys).agg(
        F.sum(same).alias("unchanged"), F.sum(F.col("_o") - same).alias("_o"), F.sum(F.col("_n") - same).alias("_n"))
    updated = F.least("_o", "_n")
    return per_key.select(
        day, *keys, "unchanged", updated.alias("updated"),
        (F.col("_n") - updated).alias("inserted"), (F.col("_o") - updated).alias("deleted"))


def diff_by_date(diff: DataFrame, day: str) -> DataFrame:
    """The rows of ``hash_diff`` summed per date."""
    return diff.groupBy(day).agg(*[F.sum(c).alias(c) for c in ("unchanged", "updated", "inserted", "deleted")])


def changed_dates(diff: DataFrame, day: str) -> DataFrame:
    """Dates with any difference, from the rows of ``hash_diff`` or their sums per date."""
    return diff.filter("updated + inserted + deleted > 0").select(day).distinct()


def rule_predicates(contract: Contract) -> list[tuple[str, Column]]:
    """Every rule of a contract as (``column:rule``, the row breaks it)."""
    rules = []
    for c in contract.columns:
        value = F.col(c.name)
        if c.required:
            rules.append((f"{c.name}:not_null", value.isNull()))
        if c.max_length is not None:
            rules.append((f"{c.name}:length", F.length(value) > c.max_length))
        if c.domain is not None:
            rules.append((f"{c.name}:domain", ~value.isin(*c.domain)))
        if c.type != "string":
            rules.append((f"{c.name}:type", value.isNotNull() & value.try_cast(c.type).isNull()))
    return rules


def violations(contract: Contract) -> Column:
    """Array of the rules a row breaks."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rule_predicates(contract)]))


def split_valid(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the contract, cast to its types, and the rejected rows with
    their reasons. Nothing is dropped: every input row is in one of the two."""
    # The reasons are listed for rejected rows only: arrays of all rows would be most of a load's work.
    rejected = reduce(lambda a, b: a | b, [F.coalesce(broken, F.lit(False)) for _, broken in rule_predicates(contract)], F.lit(False))
    types = {c.name: c.type for c in contract.columns}
    good = df.filter(~rejected).select(
        *[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns]
    )
    return good, df.filter(rejected).withColumn("reject_reasons", violations(contract))
