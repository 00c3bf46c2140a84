"""The daily jobs: loads, quality gate, publication and the whole run.

Every job takes one ``business_date``, or None for all dates its source holds.
Steps are plain driver functions; Spark retries tasks, the caller re-runs jobs.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import add_audit, for_date
from ..operators import quality as Q
from ..operators.mapping import (
    map_cash_positions,
    map_cash_rows,
    map_drvt_positions,
    map_drvt_rows,
    map_trades_g1,
    map_trades_g2,
)
from ..schemas import (
    CASH_POSITIONS_CONTRACT,
    DATE_COLUMN,
    DRVT_POSITIONS_CONTRACT,
    EXPORT_COLUMNS,
    TRADE_MOVEMENTS_CONTRACT,
    Contract,
)
from ..session import brief_shuffles, in_part, part_count, together
from ..sources import versions
from ..sources.sinks import (
    changed_dates,
    export_csv,
    export_parquet,
    hash_diff,
    split_valid,
    write_csv,
)

TABLES = ("dw_trade_movements", "dw_drvt_positions", "dw_cash_positions")


@dataclass
class Paths:
    """Where a warehouse keeps its tables, rejects and exports."""

    root: str
    tables: dict[str, str] = field(default_factory=dict)

    def table(self, name: str) -> str:
        return self.tables.get(name, f"{self.root}/{name}")

    def export(self, name: str) -> str:
        return f"{self.root}/exports/{name}"


# Key columns of the row hash per generation.
HASH_KEYS = {
    ("dw_trade_movements", "g1"): ["trade_id", "trade_dt"],
    ("dw_trade_movements", "g2"): ["trade_id", "ticker", "notional", "quantity", "trade_dt"],
    ("dw_drvt_positions", "g1"): ["position_id", "position_date"],
    ("dw_drvt_positions", "g2"): ["position_id", "instrument_id", "participant_code", "position_date"],
    ("dw_cash_positions", "g1"): ["position_id", "position_date"],
    ("dw_cash_positions", "g2"): ["position_id", "ticker", "participant_code", "position_date"],
}


def _load(change: versions.Change, mapped: DataFrame, contract: Contract, paths: Paths, generation: str, source: str,
          business_date: str | None, load_ts) -> list[str]:
    """Conform, audit and write mapped rows and their rejects as new slices; returns the dates loaded.

    A load replaces the slices of its dates in both tables, so a clean load also clears the
    rejects of an earlier one. Nothing is live before the change commits.
    """
    table = contract.table
    day = DATE_COLUMN[table]
    if business_date is not None:
        mapped = for_date(mapped, day, business_date)
    good, rejects = split_valid(mapped, contract)
    n = part_count(mapped)
    parts = [split_valid(mapped.filter(in_part(contract.columns[0].name, i, n)), contract)[0] for i in range(n)] if n > 1 else [good]
    audit = partial(add_audit, source=source, key_cols=HASH_KEYS[(table, generation)], load_ts=load_ts)
    loaded = [business_date] if business_date is not None else []
    undated = [None] if business_date is None else []
    written = together(
        mapped.sparkSession, lambda: change.replace(table, paths.table(table), parts, day, loaded, finish=audit),
        lambda: change.replace(f"{table}_rejects", paths.table(f"{table}_rejects"), rejects, day, loaded + undated, flat=True))
    dates = sorted({*loaded, *written[0], *written[1]} - {versions.NO_DATE})
    for name in (table, f"{table}_rejects"):
        change.clear(name, dates)
    return dates


def _stored(change: versions.Change, table: str, dates: list[str], *aggs: Column) -> dict[str, int]:
    """Counts over the slices as written: rows, rejects and ``aggs``, in one job."""
    apart = change.read(f"{table}_rejects", [*dates, versions.NO_DATE]).agg(F.count(F.lit(1)))
    counts = change.read(table, dates).agg(F.count(F.lit(1)).alias("rows_written"), *aggs).withColumn(
        "rows_rejected", apart.scalar()).first().asDict()
    counts["rows_read"] = counts["rows_written"] + counts["rows_rejected"]
    return {k: int(v) for k, v in counts.items()}


def on_dates(df: DataFrame, column: str, dates: list[str]) -> DataFrame:
    """Rows of the given dates (a list of days, bounded by the calendar)."""
    return df.filter(F.col(column).cast("string").isin(dates))


def load_trades(source: DataFrame, paths: Paths, business_date: str | None = None, generation: str = "g1",
                label: str = "oracle", load_ts="1970-01-01 00:00:00", change: versions.Change | None = None) -> dict:
    """Load trade movements. Repeated trade ids are kept on purpose, and counted:
    the quality gate reports them. Without a ``change`` to join, the load is one of its own."""
    own = change or versions.Change(source.sparkSession, paths.root)
    mapped = map_trades_g1(source) if generation == "g1" else map_trades_g2(source, business_date)
    table = TRADE_MOVEMENTS_CONTRACT.table
    dates = _load(own, mapped, TRADE_MOVEMENTS_CONTRACT, paths, generation, label, business_date, load_ts)
    # One grouping by (date, id) gives rows and repeated ids.
    per_id = own.read(table, dates).groupBy(DATE_COLUMN[table], "trade_id").agg(F.count(F.lit(1)).alias("n"))
    rejected = own.read(f"{table}_rejects", [*dates, versions.NO_DATE]).agg(F.count(F.lit(1)))
    n = per_id.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra")).withColumn(
        "rejected", rejected.scalar()).first()
    if change is None:
        own.commit()
    return {"rows_read": n["rows"] + n["rejected"], "rows_rejected": n["rejected"], "rows_written": n["rows"],
            "duplicates": n["extra"], "dates": dates}


def load_positions(drvt: DataFrame, cash: DataFrame, paths: Paths, business_date: str | None = None,
                   generation: str = "g1", label: str = "oracle", load_ts="1970-01-01 00:00:00",
                   change: versions.Change | None = None) -> dict:
    """Load both position tables, which change together; missing prices and zero sums are counted."""
    own = change or versions.Change(drvt.sparkSession, paths.root)
    g1 = generation == "g1"

    def load(rows: DataFrame, contract: Contract, found: Column) -> tuple[list[str], dict[str, int]]:
        dates = _load(own, rows, contract, paths, generation, label, business_date, load_ts)
        return dates, _stored(own, contract.table, dates, found)

    (days_d, d), (days_c, c) = together(
        drvt.sparkSession,
        lambda: load(map_drvt_positions(drvt) if g1 else map_drvt_rows(drvt, zero_as_null=True), DRVT_POSITIONS_CONTRACT,
                     F.count_if(F.col("settlement_price").isNull()).alias("nulls_found")),
        lambda: load(map_cash_positions(cash) if g1 else map_cash_rows(cash), CASH_POSITIONS_CONTRACT,
                     F.count_if(F.col("long_value") + F.col("short_value") == 0).alias("zero_sum_found")))
    if change is None:
        own.commit()
    return {
        "drvt_rows_read": d["rows_read"], "drvt_rows_written": d["rows_written"],
        "cash_rows_read": c["rows_read"], "cash_rows_written": c["rows_written"],
        "rows_rejected": d["rows_rejected"] + c["rows_rejected"],
        "nulls_found": d["nulls_found"], "zero_sum_found": c["zero_sum_found"],
        "dates": sorted({*days_d, *days_c}),
    }


def load_changes(mapped: DataFrame, contract: Contract, paths: Paths, business_date: str | None = None,
                 generation: str = "g1", label: str = "oracle", load_ts="1970-01-01 00:00:00") -> list[str]:
    """Load mapped rows, but write only the dates whose rows differ from those stored; returns these dates.

    A date that holds the same rows keeps its files and load time. Rows are compared by
    a hash of all contract columns, as multisets per key.
    """
    spark, table = mapped.sparkSession, contract.table
    day = DATE_COLUMN[table]
    change = versions.Change(spark, paths.root)
    if table not in change.base.tables:
        dates = _load(change, mapped, contract, paths, generation, label, business_date, load_ts)
        change.commit()
        return dates
    if business_date is not None:
        mapped = for_date(mapped, day, business_date)
    good, rejects = split_valid(mapped, contract)
    scope = None if business_date is None else [business_date]
    differ: set[str] = set()
    for name, fresh in ((table, good), (f"{table}_rejects", rejects)):
        columns = [c for c in fresh.columns if c != day]
        stored = change.read(name, scope).select(*columns, day)
        diff = hash_diff(stored, fresh, day, [contract.columns[0].name], columns)
        differ |= {versions.NO_DATE if r[0] is None else str(r[0]) for r in changed_dates(diff, day).collect()}
    if not differ:
        return []
    dates = sorted(differ - {versions.NO_DATE})
    undated = [None] if versions.NO_DATE in differ else []
    good = add_audit(on_dates(good, day, dates), label, HASH_KEYS[(table, generation)], load_ts)
    hit = F.col(day).cast("string").isin(dates)
    rejects = rejects.filter(hit | F.col(day).isNull() if undated else hit)
    change.replace(table, paths.table(table), good, day, dates)
    change.replace(f"{table}_rejects", paths.table(f"{table}_rejects"), rejects, day, dates + undated, flat=True)
    change.commit()
    return dates + [versions.NO_DATE] * len(undated)


def read_table(spark: SparkSession, paths: Paths, name: str, business_date: str | None = None) -> DataFrame:
    """A table as the newest change left it."""
    return versions.read(spark, paths.root, name, None if business_date is None else [business_date])


def gate_checks(
    dw: dict[str, DataFrame], src: dict[str, DataFrame | None], business_date: str | None = None,
    generation: str = "g1", src_dates: dict[str, str] | None = None,
) -> DataFrame:
    """All checks of one generation's gate: five in G1, seven rows in G2."""
    trades, drvt, cash = dw["dw_trade_movements"], dw["dw_drvt_positions"], dw["dw_cash_positions"]
    dates = {"trades": "business_date", "drvt": "business_date", "cash": "business_date"} | (src_dates or {})
    checks = [
        Q.check_duplicate_trades(trades, business_date, generation),
        Q.check_null_price(drvt, business_date, generation),
        Q.check_zero_sum(cash, business_date, generation),
    ]
    if generation == "g1":
        checks += [
            Q.check_row_count_equal(src["trades"], trades, dates["trades"], "trade_dt", business_date),
            Q.check_row_count_equal(
                src["drvt"], drvt, dates["drvt"], "position_date", business_date,
                "rowcount_positions_oracle_vs_dw", "dw_drvt_positions",
            ),
        ]
    else:
        checks += [
            Q.check_row_count_tolerance(src["trades"], trades, dates["trades"], "trade_dt", business_date),
            Q.check_row_count_tolerance(
                src["drvt"], drvt, dates["drvt"], "position_date", business_date,
                name="caso_4_row_count_diff_drvt", table="dw_drvt_positions", source_table="src_drvt_positions",
            ),
            Q.check_row_count_tolerance(
                src["cash"], cash, dates["cash"], "position_date", business_date,
                name="caso_4_row_count_diff_cash", table="dw_cash_positions", source_table="src_cash_positions",
            ),
            Q.check_overflow(trades, business_date),
        ]
    return reduce(DataFrame.unionByName, checks)


def quality_gate(
    spark: SparkSession, paths: Paths, src: dict[str, DataFrame | None], run_id: str, created_at,
    business_date: str | None = None, generation: str = "g1", mode: str = "report",
    dates: list[str] | None = None,
) -> DataFrame:
    """Run the checks, store their results, and return the verdict per date.

    ``dates`` restricts the warehouse to the dates at hand. The results are stored
    before a ``raise`` gate stops the run.
    """
    scope = dates if dates is not None else None if business_date is None else [business_date]
    dw = {n: versions.read(spark, paths.root, n, scope) for n in TABLES}
    results = Q.stamp_results(gate_checks(dw, src, business_date, generation), run_id, created_at)
    with versions.Change(spark, paths.root) as change:
        write = change.replace if generation == "g1" else change.append
        write("dq_results", paths.table("dq_results"), results, "business_date", flat=True)
    stored = read_table(spark, paths, "dq_results", business_date).filter(F.col("run_id") == run_id)
    if mode == "raise":
        Q.gate(stored, "raise")
    return Q.gate_status(stored, ["business_date"])


def publish(spark: SparkSession, paths: Paths, business_date: str, guard: bool = True, all_runs: bool = False,
            formats: dict[str, str] | None = None) -> dict:
    """Export the three tables of one date unless a critical check failed."""
    if guard:
        results = read_table(spark, paths, "dq_results")
        if not Q.publish_allowed(results, business_date, all_runs):
            return {"status": "failed", "reason": f"quality gate failed for {business_date}", "files_exported": []}
    formats = formats or EXPORT_FORMATS
    drafts, files = f"{paths.root}/exports-{uuid.uuid4().hex}", []
    for table, fmt in formats.items():
        rows = read_table(spark, paths, table, business_date).select(*EXPORT_COLUMNS[table])
        write = export_parquet if fmt == "parquet" else export_csv
        target = write(rows, f"{drafts}/{_folder(table)}/{table}", business_date)
        if target:
            files.append((target, target.replace(drafts, f"{paths.root}/exports", 1)))
    versions.move_all(spark, files, drafts)
    return {"status": "success", "files_exported": [new for _, new in files]}


EXPORT_FORMATS = {"dw_trade_movements": "parquet", "dw_drvt_positions": "parquet", "dw_cash_positions": "csv"}


def _folder(table: str) -> str:
    return "spot" if table == "dw_cash_positions" else "derivatives"


def publish_dates(spark: SparkSession, paths: Paths, guard: bool = True, all_runs: bool = False,
                  dates: list[str] | None = None) -> list[str]:
    """Export every date (of ``dates``, if given) whose gate allows it, as ``dt=<date>`` partitions.

    All three tables are written aside first; the dates appear when every file is there.
    A table of which no date is allowed gets an empty folder. The stored files hold one date
    each, so they are exported as they are read, without a shuffle.
    """
    allowed = None
    if guard:
        verdicts = Q.publish_guard(read_table(spark, paths, "dq_results"), all_runs)
        allowed = verdicts.filter("publish_allowed").select("business_date")
    drafts = f"{paths.root}/exports-{uuid.uuid4().hex}"

    def export(table: str, fmt: str) -> tuple[str, list[tuple[str, str]]]:
        rows = versions.read(spark, paths.root, table, dates).select(*EXPORT_COLUMNS[table])
        rows = rows.withColumn("dt", F.col(DATE_COLUMN[table]))
        if allowed is not None:
            rows = rows.join(allowed.withColumnRenamed("business_date", "dt"), "dt", "left_semi")
        draft, target = f"{drafts}/{table}", paths.export(f"{_folder(table)}/{table}")
        if fmt == "parquet":
            rows.write.partitionBy("dt").parquet(draft)
        else:
            write_csv(rows, draft, "dt")
        return target, [(f"{draft}/{n}", f"{target}/{n}") for n in versions.names(spark, draft) if n.startswith("dt=")]

    done = together(spark, *[partial(export, table, fmt) for table, fmt in EXPORT_FORMATS.items()])
    versions.move_all(spark, [m for _, moves in done for m in moves], drafts)
    for target, _ in done:
        versions.make_folder(spark, target)
    return [target for target, _ in done]


def published(spark: SparkSession, paths: Paths, table: str) -> DataFrame:
    """The Parquet export of a table read back with its date ``dt``; empty when no date was allowed."""
    layout = read_table(spark, paths, table).select(*EXPORT_COLUMNS[table], F.col(DATE_COLUMN[table]).alias("dt")).schema
    return spark.read.schema(layout).parquet(paths.export(f"{_folder(table)}/{table}"))


def publish_reports(report: DataFrame, exposure: DataFrame, path: str, date_col: str = "business_date") -> None:
    """Settlement report as Parquet and exposure as CSV under ``exports/dt=<date>/``."""
    dated = [df.withColumn("dt", F.col(date_col)).hint("rebalance", "dt") for df in (report, exposure)]
    dated[0].write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(
        f"{path}/exports/d1_settlement_report")
    write_csv(dated[1], f"{path}/exports/participant_exposure_report", "dt")


def run_d1(
    spark: SparkSession, paths: Paths, trades: DataFrame, drvt: DataFrame, cash: DataFrame, run_id: str,
    load_ts, business_date: str | None = None, generation: str = "g1", gate_mode: str = "report",
    guard: bool = True,
) -> DataFrame:
    """Loads, checks, gate and publication in order; one summary row per date.

    Only the dates loaded are checked and published, whatever else the warehouse holds.
    """
    with brief_shuffles(spark):
        with versions.Change(spark, paths.root) as change:  # trades, positions and rejects change together
            loaded, positions = together(
                spark, lambda: load_trades(trades, paths, business_date, generation, load_ts=load_ts, change=change),
                lambda: load_positions(drvt, cash, paths, business_date, generation, load_ts=load_ts, change=change))
        dates = sorted({*loaded["dates"], *positions["dates"]})
        src = {"trades": trades, "drvt": drvt, "cash": cash}
        verdict = quality_gate(spark, paths, src, run_id, load_ts, business_date, generation, gate_mode, dates)
        if business_date is None:
            publish_dates(spark, paths, guard, dates=dates)
        else:
            done = publish(spark, paths, business_date, guard)
    if business_date is not None:
        verdict = verdict.withColumn("_out", F.lit(done["status"] == "success"))
    elif guard:
        allowed = Q.publish_guard(read_table(spark, paths, "dq_results")).filter("publish_allowed")
        verdict = verdict.join(allowed.select("business_date", F.lit(True).alias("_out")), "business_date", "left")
    else:
        verdict = verdict.withColumn("_out", F.lit(True))
    counts = [
        versions.read(spark, paths.root, t, dates).groupBy(
            F.col(DATE_COLUMN[t]).alias("business_date")).agg(F.count(F.lit(1)).alias(f"{t}_rows"))
        for t in TABLES
    ]
    joined = reduce(lambda a, b: a.join(b, "business_date", "left"), counts, verdict)
    published = F.coalesce("_out", F.lit(False))
    return joined.select(
        "business_date", "checks_run", "checks_failed", "critical_failures", "gate_status",
        *[F.coalesce(f"{t}_rows", F.lit(0)).alias(f"{t}_rows") for t in TABLES],
        published.alias("published"),
    )
