"""Run telemetry: parsed logs, alerts, panels and run summaries.

The window functions work on batch and streaming frames alike; the streaming
package adds watermarks and sinks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import quotient
from ..schemas import JOB_LOG, JOB_SLA_SECONDS, schema
from ..session import materialise

PUBLISH_JOB = "publish_d1_reports"
GATE_JOB = "quality_gate_d1"
# The two terms a log message must contain, per alert.
LOG_ALERTS = {
    "duplicates": ("DQ-CASO-1", "Duplicatas"),
    "null_column": ("DQ-CASO-2", "Coluna nula"),
    "zero_sum": ("DQ-CASO-3", "Soma zero"),
    "row_count": ("DQ-CASO-4", "Diferença de contagem"),
}


def is_ok() -> Column:
    return F.col("status") == "success"


def is_failed() -> Column:
    return F.col("status") == "failed"


def mean(c: Column | str) -> Column:
    """Mean of a measure at six decimals, the same in any order of summation."""
    v = (F.col(c) if isinstance(c, str) else c).cast("decimal(18,6)")
    return F.round(F.try_divide(F.sum(v), F.count(v).cast("decimal(19,0)")), 6).cast("decimal(24,6)")


# --- logs -------------------------------------------------------------------
def parse_logs(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON log lines as typed columns, with the defaults the writer fills in.
    Blank and broken lines are skipped."""
    record = F.from_json(F.col(column), schema(JOB_LOG), {"mode": "PERMISSIVE"})
    rows = lines.filter(F.trim(column) != "").select(record.alias("r")).filter(
        F.col("r.timestamp").isNotNull()
    ).select("r.*")
    name = F.coalesce("ctm_job", "job_name", F.col("job.name"))
    return rows.withColumns({
        "ctm_job": name,
        "ctm_order_date": F.coalesce("ctm_order_date", "business_date"),
        "ctm_run_id": F.coalesce("ctm_run_id", "run_id"),
        "trace_id": F.coalesce("trace_id", F.col("`dd.trace_id`"), F.lit("0")),
        "span_id": F.coalesce("span_id", F.col("`dd.span_id`"), F.lit("0")),
        "job": F.struct(
            F.coalesce(F.col("job.name"), F.col("job_name")).alias("name"),
            F.coalesce(F.col("job.status"), F.col("status")).alias("status"),
        ),
        "sla": F.struct(F.coalesce(F.col("sla.miss"), F.col("sla_miss")).alias("miss")),
    })


def logs_for(logs: DataFrame, ts: str = "ts", run_id: str | None = None, trace_id: str | None = None) -> DataFrame:
    """Log rows of a run or a trace, newest first."""
    rows = logs
    if run_id is not None:
        rows = rows.filter(F.col("run_id") == run_id)
    if trace_id is not None:
        rows = rows.filter(F.col("trace_id") == trace_id)
    return rows.orderBy(F.desc(ts))


# --- windows ----------------------------------------------------------------
def _window(length: str, slide: str | None = None) -> Column:
    return F.window("ts", length, slide) if slide else F.window("ts", length)


def _unfold(df: DataFrame, *cols) -> DataFrame:
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *cols)


def windowed_alert(events: DataFrame, pred: Column, by: list[str], length: str, slide: str | None = "1 minute") -> DataFrame:
    """Windows in which at least one event matches, per group."""
    hits = events.filter(pred).groupBy(_window(length, slide), *by).agg(F.count(F.lit(1)).alias("hits"))
    return _unfold(hits.filter("hits > 0"), *by, "hits")


def job_failures(events: DataFrame, length: str = "5 minutes", slide: str | None = "1 minute") -> DataFrame:
    return windowed_alert(events, is_failed(), ["job_name"], length, slide)


def sla_misses(events: DataFrame, length: str = "10 minutes", slide: str | None = "1 minute") -> DataFrame:
    return windowed_alert(events, F.col("sla_miss"), ["job_name"], length, slide)


def gate_failures(events: DataFrame, length: str = "10 minutes", slide: str | None = "1 minute") -> DataFrame:
    pred = (F.col("gate_status") == "FAIL") & (F.col("job_name") == GATE_JOB)
    return windowed_alert(events, pred, [], length, slide)


def log_alerts(events: DataFrame, length: str = "5 minutes", slide: str | None = "1 minute") -> DataFrame:
    """Windows per alert whose two terms both occur in a message. The message is
    matched once, in a single pass over the events."""
    case = reduce(
        lambda acc, item: acc.when(
            F.contains(F.col("message"), F.lit(item[1][0])) & F.contains(F.col("message"), F.lit(item[1][1])), item[0]
        ),
        LOG_ALERTS.items(), F.when(F.lit(False), F.lit(None).cast("string")),
    )
    return windowed_alert(events.withColumn("alert", case), F.col("alert").isNotNull(), ["alert"], length, slide)


def threshold_alert(
    events: DataFrame, value: str = "duration_seconds", warn: float = 2.0, critical: float = 5.0,
    length: str = "5 minutes", slide: str | None = None, by: list[str] | None = None,
) -> DataFrame:
    """Mean of a measure per window against a warning and a critical limit."""
    by = by or []
    grouped = events.groupBy(_window(length, slide), *by).agg(mean(value).alias("mean_value"))
    level = F.when(F.col("mean_value") > critical, "critical").when(F.col("mean_value") > warn, "warning").otherwise("ok")
    return _unfold(grouped, *by, "mean_value", level.alias("level"))


def absence_alert(events: DataFrame, pred: Column, minutes: int = 30) -> DataFrame:
    """Minutes at which no matching event was seen in the ``minutes`` before.

    Events shrink to distinct minutes first, so the spine and the cover grow
    with the time span and not with the number of events.
    """
    minute = F.date_trunc("minute", "ts")
    span = events.agg(F.min(minute).alias("first"), F.max(minute).alias("last"))
    step = F.expr("interval 1 minute")
    spine = span.filter("first is not null").select(F.explode(F.sequence("first", "last", step)).alias("at"))
    reach = F.make_dt_interval(mins=F.lit(minutes - 1))
    seen = events.filter(pred).select(minute.alias("m")).distinct()
    covered = seen.select(F.explode(F.sequence("m", F.col("m") + reach, step)).alias("at")).distinct()
    return spine.join(covered, "at", "left_anti")


def no_publish_alert(events: DataFrame, minutes: int = 30) -> DataFrame:
    return absence_alert(events, (F.col("job_name") == PUBLISH_JOB) & is_ok(), minutes)


def renotifications(
    events: DataFrame, pred: Column, by: list[str], gap_minutes: int = 30, every_minutes: int = 60
) -> DataFrame:
    """Notifications of an alert: when it opens and every ``every_minutes`` while
    it stays open. It closes after ``gap_minutes`` without a matching event."""
    minute = F.date_trunc("minute", "ts")
    seen = events.filter(pred).select(*by, minute.alias("m")).distinct()
    order = W.partitionBy(*by).orderBy("m") if by else W.orderBy("m")
    gap = F.col("m").cast("long") - F.lag("m").over(order).cast("long")
    opened = F.coalesce(gap > gap_minutes * 60, F.lit(True))
    episodes = seen.withColumn("_e", F.sum(opened.cast("int")).over(order)).groupBy(*by, "_e").agg(
        F.min("m").alias("opened_at"), F.max("m").alias("last_seen")
    )
    step = F.expr(f"interval {every_minutes} minutes")
    at = F.posexplode(F.sequence("opened_at", "last_seen", step)).alias("repeat", "notify_at")
    return episodes.select(*by, "opened_at", at).select(
        *by, "opened_at", "notify_at", F.col("repeat").cast("long").alias("repeat"),
        F.when(F.col("repeat") > 0, F.format_string("ESCALATION: unresolved after %d minutes", F.col("repeat") * every_minutes))
        .otherwise("ALERT").alias("text"),
    )


# --- running counts ---------------------------------------------------------
RANGES = 4  # ranges per shuffle partition: some meet in a task by chance


def running_counts(df: DataFrame, keys: list[str], ts: str, tie: str, flags: dict[str, Column]) -> DataFrame:
    """Running totals of flags per key in time order, as a prefix scan in two levels.

    The rows are cut into ranges of (key, time, tie) with about equal numbers of rows,
    whatever a key or an hour holds. Inside a range they are counted in order; what a key
    has in earlier ranges is added from one row of totals per (range, key). The ranges are
    written to the shared folder, so that both readings of them agree.
    """
    n = RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = df.withColumns({f"_f_{name}": F.coalesce(c.cast("long"), F.lit(0)) for name, c in flags.items()})
    ranged, _ = materialise(marked.repartitionByRange(n, *keys, ts, tie).withColumn("_p", F.spark_partition_id()), "running-counts")
    totals = ranged.groupBy("_p", *keys).agg(*[F.sum(f"_f_{name}").alias(f"_t_{name}") for name in flags])
    # One row per range that a key touches: a hot key has at most ``n``.
    before = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_p", *keys, *[
        F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in flags])
    offsets = offsets.select("_p", *[F.col(k).alias(f"_k_{k}") for k in keys], *[f"_o_{name}" for name in flags])
    inside = W.partitionBy("_p", *keys).orderBy(ts, tie).rowsBetween(W.unboundedPreceding, 0)
    counted = ranged.withColumns({f"_r_{name}": F.sum(f"_f_{name}").over(inside) for name in flags})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = counted.join(offsets.withColumnRenamed("_p", "_q"), [F.col("_p") == F.col("_q"), *same])
    return joined.select(*df.columns, *[(F.col(f"_r_{name}") + F.col(f"_o_{name}")).alias(name) for name in flags])


def job_counters(runs: DataFrame) -> DataFrame:
    """Counters of ended-ok, ended-not-ok and SLA violations as each run ends."""
    return running_counts(
        runs, ["job_name"], "ts", "event_id",
        {"ended_ok": is_ok(), "ended_not_ok": is_failed(), "sla_violations": F.col("sla_miss") & (is_ok() | is_failed())})


# --- panels -----------------------------------------------------------------
def recent_runs(history: DataFrame, ts: str = "ts", n: int = 50, tie: str | None = None) -> DataFrame:
    order = [F.desc(ts)] + ([F.desc(tie)] if tie else [])
    return history.orderBy(*order).limit(n)


def top_n(df: DataFrame, key: str, agg: Column, n: int = 10, name: str = "value") -> DataFrame:
    """The ``n`` groups with the largest aggregate; equal values in key order."""
    return df.groupBy(key).agg(agg.alias(name)).orderBy(F.desc(name), key).limit(n)


def duration_by_job(runs: DataFrame, bucket: str = "1 hour", percentile: float | None = None) -> DataFrame:
    """Mean duration per job and time bucket, optionally with a percentile."""
    aggs = [mean("duration_seconds").alias("avg_duration")]
    names = ["job_name", "avg_duration"]
    if percentile is not None:
        aggs.append(F.percentile_approx("duration_seconds", percentile, 10000).alias("p_duration"))
        names.append("p_duration")
    return _unfold(runs.groupBy(_window(bucket), "job_name").agg(*aggs), *names)


def outcome_by_job(runs: DataFrame, bucket: str = "1 hour") -> DataFrame:
    counts = runs.groupBy(_window(bucket), "job_name").agg(
        F.count_if(is_ok()).alias("ended_ok"), F.count_if(is_failed()).alias("ended_not_ok")
    )
    return _unfold(counts, "job_name", "ended_ok", "ended_not_ok")


def job_table(runs: DataFrame) -> DataFrame:
    """Per job: outcomes, mean duration, last row count, highest retry."""
    return runs.groupBy("job_name").agg(
        F.count_if(is_ok()).alias("ended_ok"), F.count_if(is_failed()).alias("ended_not_ok"),
        mean("duration_seconds").alias("avg_duration"),
        F.max_by("output_rows", F.struct("ts", "event_id")).alias("last_output_rows"),
        F.max("retries").cast("long").alias("max_retries"),
    )


def run_summary(runs: DataFrame) -> DataFrame:
    """Per pipeline run: jobs ok and not ok, status, first and last event."""
    return runs.groupBy("run_id", "business_date").agg(
        F.count_if(is_ok()).alias("jobs_ok"), F.count_if(is_failed()).alias("jobs_notok"),
        F.count(F.lit(1)).alias("total_rows"),
        F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"),
    ).withColumns({
        "status": F.when(F.col("jobs_notok") == 0, "ended_ok").otherwise("ended_not_ok"),
        "duration_seconds": (F.unix_micros("finished_at") - F.unix_micros("started_at")).cast("decimal(24,6)") / 1000000,
    }).withColumn("duration_seconds", F.col("duration_seconds").cast("decimal(24,6)"))


def pipeline_table(summaries: DataFrame) -> DataFrame:
    """Per order date: last pipeline counters, last duration, most jobs ok and not ok."""
    counted = running_counts(
        summaries, [], "finished_at", "run_id",
        {"ok_counter": F.col("jobs_notok") == 0, "notok_counter": F.col("jobs_notok") > 0},
    )
    last = F.struct("finished_at", "run_id")
    return counted.groupBy("business_date").agg(
        F.max_by("ok_counter", last).alias("last_ok"), F.max_by("notok_counter", last).alias("last_notok"),
        F.max_by("duration_seconds", last).alias("last_duration"),
        F.max("jobs_ok").alias("max_jobs_ok"), F.max("jobs_notok").alias("max_jobs_notok"),
    )


def headline_kpis(runs: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Executions, outcomes, SLA violations and failed checks as one row."""
    out = runs.agg(
        F.count(F.lit(1)).alias("executions"), F.count_if(is_ok()).alias("ended_ok"),
        F.count_if(is_failed()).alias("ended_not_ok"), F.count_if(F.col("sla_miss")).alias("sla_violations"),
    )
    if results is None:
        return out
    failed = results.agg(F.count_if(~F.col("passed")).alias("n"))
    return out.withColumn("dq_failed", failed.scalar())


# --- quality panels ---------------------------------------------------------
def check_failures_over_time(results: DataFrame, bucket: str = "1 day") -> DataFrame:
    rows = results.withColumn("ts", F.col("created_at"))
    counts = rows.groupBy(_window(bucket), "check_name").agg(F.count_if(~F.col("passed")).alias("failures"))
    return _unfold(counts, "check_name", "failures")


def check_detail(results: DataFrame) -> DataFrame:
    """Last outcome and value per check, table and severity, and runs so far."""
    last = F.struct("created_at", "result_id")
    return results.groupBy("check_name", "target_table", "severity").agg(
        F.count(F.lit(1)).alias("runs"), F.max_by(~F.col("passed"), last).alias("last_failed"),
        F.max_by("actual_value", last).alias("last_value"),
    )


def failures_by_type(results: DataFrame, n: int = 10) -> DataFrame:
    return top_n(results, "check_type", F.count_if(~F.col("passed")), n, "failures")


def row_count_trend(results: DataFrame, check_name: str = "row_count", bucket: str = "1 day") -> DataFrame:
    rows = results.filter(F.col("check_name") == check_name).withColumn("ts", F.col("created_at"))
    value = F.max(F.col("actual_value").try_cast("double"))
    return _unfold(rows.groupBy(_window(bucket)).agg(value.alias("max_value")), "max_value")


def pass_rate(results: DataFrame) -> DataFrame:
    """Pass rate from the run averages, and mean critical failures per run."""
    runs = results.groupBy("business_date", "run_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("passed")).alias("failed"),
        F.count_if(~F.col("passed") & (F.col("severity") == "critical")).alias("critical"),
    )
    total, failed = F.sum("total"), F.sum("failed")
    return runs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(quotient((total - failed) * 100, total), 4).alias("pass_rate"),
        F.round(quotient(F.sum("critical"), F.count(F.lit(1))), 4).alias("avg_critical_failures"),
    )


def gauges_side_by_side(gauges: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Source and warehouse gauges of one measure next to each other per date."""
    names = {m: (measure, side) for measure, (s, d) in pairs.items() for m, side in ((s, "source"), (d, "dw"))}
    measure = F.create_map(*[x for m, (name, _) in names.items() for x in (F.lit(m), F.lit(name))])
    rows = gauges.filter(F.col("metric").isin(list(names)))
    source = F.col("metric").isin([m for m, (_, side) in names.items() if side == "source"])
    return rows.groupBy("business_date", F.element_at(measure, F.col("metric")).alias("measure")).agg(
        F.max(F.when(source, F.col("value"))).alias("source_value"), F.max(F.when(~source, F.col("value"))).alias("dw_value")
    )


# --- runs -------------------------------------------------------------------
def lineage_health(events: DataFrame, now: Column | str, minutes: int = 15) -> DataFrame:
    """Lineage events per job and type in the last minutes, with the last time seen."""
    start = (F.lit(now).cast("timestamp") if isinstance(now, str) else now) - F.make_dt_interval(mins=F.lit(minutes))
    return events.filter(F.col("ts") > start).groupBy("job_name", "event_type").agg(
        F.count(F.lit(1)).alias("total"), F.max("ts").alias("last_seen")
    )


def first_failure(runs: DataFrame, jobs: int = len(JOB_SLA_SECONDS)) -> DataFrame:
    """First failed job of each failed run in dependency order, and how many
    later jobs could not run."""
    return runs.filter(is_failed()).groupBy("run_id").agg(F.min("position").alias("position")).select(
        "run_id",
        F.element_at(F.array(*[F.lit(j) for j in JOB_SLA_SECONDS]), F.col("position").cast("int")).alias("first_failed_job"),
        (F.lit(jobs) - F.col("position")).cast("long").alias("jobs_not_run"),
    )


def retry_accounting(runs: DataFrame) -> DataFrame:
    """Attempts, highest retry, final status and SLA misses per run and job."""
    return runs.groupBy("run_id", "job_name").agg(
        F.count(F.lit(1)).alias("attempts"), F.max("retries").cast("long").alias("max_retries"),
        F.max_by("status", F.struct("ts", "status")).alias("final_status"),
        F.count_if("sla_miss").alias("attempts_over_sla"),
        F.sum(F.col("duration_seconds").cast("decimal(18,6)")).alias("total_duration"),
    )
