"""Streaming forms of the alerts and counters, and a replayable result sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import telemetry as K
from ..session import scratch_dir

# Rows older than this behind the newest event no longer enter a window.
WATERMARK = "10 minutes"


def watermarked(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    return events.withWatermark("ts", delay)


def job_failures(events: DataFrame, **window) -> DataFrame:
    return K.job_failures(watermarked(events), **window)


def sla_misses(events: DataFrame, **window) -> DataFrame:
    return K.sla_misses(watermarked(events), **window)


def gate_failures(events: DataFrame, **window) -> DataFrame:
    return K.gate_failures(watermarked(events), **window)


def log_alerts(events: DataFrame, **window) -> DataFrame:
    return K.log_alerts(watermarked(events), **window)


def threshold_alert(events: DataFrame, **params) -> DataFrame:
    return K.threshold_alert(watermarked(events), **params)


def running_totals(events: DataFrame, keys: list[str], flags: dict) -> DataFrame:
    """Totals per key so far (update mode: each batch emits the changed keys)."""
    return events.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in flags.items()])


# --- keyed timers -----------------------------------------------------------
def _minutes(events: DataFrame, by: str) -> DataFrame:
    """The first row of each key and minute, passed on at once, so that a busy key
    costs its timer a row a minute. The dedup state is spread over key and minute."""
    minute = watermarked(events).select("ts", F.date_trunc("minute", "ts").alias("minute"), by)
    return minute.dropDuplicatesWithinWatermark([by, "minute"])


def absence_alerts(events: DataFrame, by: str, minutes: int = 30) -> DataFrame:
    """One row when a key has been silent for ``minutes``, at the minute it became overdue.

    State per key is the last minute seen. A timer fires when the watermark
    passes the deadline; rows that arrive in one batch are compared in order.
    """
    limit = pd.Timedelta(minutes=minutes)

    def watch(key, batches: Iterator[pd.DataFrame], state: GroupState):
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        alerts = []
        if state.hasTimedOut:
            alerts.append(last + limit)
            state.remove()
        else:
            for minute in sorted(m for b in batches for m in b["minute"]):
                if last is not None and minute - last > limit:
                    alerts.append(last + limit)
                last = max(last, minute) if last is not None else minute
            state.update((int(last.value // 1000),))
            deadline = int((last + limit).value // 1_000_000)
            if deadline > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(deadline)
            else:
                alerts.append(last + limit)
                state.remove()
        yield pd.DataFrame({by: [key[0]] * len(alerts), "overdue_at": pd.Series(alerts, dtype="datetime64[ns]")})

    return _minutes(events, by).groupBy(by).applyInPandasWithState(
        watch, f"{by} string, overdue_at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def renotify(events: DataFrame, by: str, gap_minutes: int = 30, every_minutes: int = 60) -> DataFrame:
    """Notifications of open alerts: at the first event, then every ``every_minutes``
    up to the last event; an alert closes after ``gap_minutes`` of silence.

    State per key is the opening minute, the last minute seen and the number of
    notifications sent; a timer forgets closed alerts.
    """
    gap, every = pd.Timedelta(minutes=gap_minutes), pd.Timedelta(minutes=every_minutes)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            opened, last, sent = state.get if state.exists else (None, None, 0)
            opened = pd.Timestamp(opened, unit="us") if opened is not None else None
            last = pd.Timestamp(last, unit="us") if last is not None else None
            for minute in sorted(m for b in batches for m in b["minute"]):
                if last is None or minute - last > gap:
                    opened, sent = minute, 0
                while opened + sent * every <= minute:
                    out.append((key[0], opened, opened + sent * every, sent))
                    sent += 1
                last = minute
            state.update((int(opened.value // 1000), int(last.value // 1000), sent))
            deadline = int((last + gap).value // 1_000_000)
            state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[by, "opened_at", "notify_at", "repeat"]).astype(
            {"opened_at": "datetime64[ns]", "notify_at": "datetime64[ns]", "repeat": "int64"}
        )

    return _minutes(events, by).groupBy(by).applyInPandasWithState(
        step, f"{by} string, opened_at timestamp, notify_at timestamp, repeat long",
        "opened long, last long, sent long", "append", GroupStateTimeout.EventTimeTimeout,
    )


# --- result table -----------------------------------------------------------
def run_available(stream: DataFrame, keys: list[str], label: str, output_mode: str = "update") -> DataFrame:
    """Process everything available and return the latest row per key.

    Each micro-batch owns one folder and overwrites it when it is retried, so
    the table holds every batch exactly once. Checkpoint and table live in the
    shared folder.
    """
    spark: SparkSession = stream.sparkSession
    path = scratch_dir(spark, label)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(output_mode).foreachBatch(store)
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    layout = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    if not any(p.numInputRows for p in query.recentProgress):  # no batch ran: nothing was stored
        spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/table/batch_id=-1")
    rows = spark.read.schema(layout).parquet(f"{path}/table")
    if output_mode == "append" or not keys:
        return rows.drop("batch_id")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")
