"""Mixing sources to target weights by Pfair scheduling.

The documents of a source are shuffled (by hash) and cut into blocks. In an ideal,
fluid mix every source flows at its target weight; a source that runs out leaves its
share to the others in proportion. Block i of a source may start when the fluid has
delivered i - 1 blocks of it (release) and must be out when it has delivered i
(deadline). Earliest deadline first among the released blocks gives each block one
slot, and at every slot each source is less than one block away from the fluid.

The schedule is cut into segments: how many blocks of each source lie before a
segment follows from the fluid alone, so segments are scheduled apart, in parallel.
Ranks inside a source come from ranges of (source, hash order) with about equal numbers of
rows, whatever a source holds, so no task holds a whole source.

Defined results
- every document keeps exactly one place, repeated rows included. Nothing is dropped.
- a null source is a source of its own. A source without a given weight has none of
  the flow until the others have run out.
- ties in hash order are broken by doc_id, then by the text's hash if there are texts, then
  by where a row lies. Any number of sources is taken; a text id is as good as a number.
- an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import land, partitions

SEED = 11
BLOCK = 64
SEGMENT = 4096  # slots scheduled by one task
CHUNK = 1 << 18  # slots looked at together
SMOOTHING = 0.5  # default weights: source size to this power
TINY = 1e-7
NO_SOURCE = "\x00"


class Fluid:
    """The ideal mix: how many blocks of each source are out after t slots."""

    def __init__(self, sizes: np.ndarray, weights: np.ndarray):
        self.sizes = sizes.astype(float)
        # Sources without weight flow after all others.
        self.weights = np.where(weights > 0, weights / max(weights.sum(), 1e-300), 1e-12)
        ends = self.sizes / self.weights
        order = np.argsort(ends, kind="stable")
        self.ends = np.concatenate([[0.0], ends[order]])
        rate = self.weights.sum() - np.concatenate([[0.0], np.cumsum(self.weights[order])])
        self.rates = np.maximum(rate[:-1], 0)
        self.times = np.concatenate([[0.0], np.cumsum(np.diff(self.ends) * self.rates)])

    def slots(self, virtual: np.ndarray) -> np.ndarray:
        """Slots used when the virtual clock stands at ``virtual``."""
        return np.interp(virtual, self.ends, self.times)

    def delivered(self, t: float | np.ndarray) -> np.ndarray:
        """Blocks of each source out after ``t`` slots (a row per entry of an array)."""
        virtual = np.interp(t, self.times, self.ends)
        out = np.minimum(self.sizes, self.weights * (virtual[:, None] if np.ndim(t) else virtual))
        near = np.rint(out)
        return np.where(np.abs(out - near) < TINY * np.maximum(1, near), near, out)

    def windows(self, sources: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Releases and deadlines of blocks (from 1)."""
        start = self.slots((blocks - 1) / self.weights[sources])
        end = self.slots(blocks / self.weights[sources])
        slack = TINY * np.maximum(1.0, end)
        return np.floor(start + slack).astype(np.int64), np.ceil(end - slack).astype(np.int64)

    def window(self, source: int, block: int) -> tuple[int, int]:
        """Release and deadline of a block (from 1)."""
        release, deadline = self.windows(np.array([source]), np.array([block]))
        return int(release[0]), int(deadline[0])

    def released(self, low: int, high: int, done: np.ndarray) -> np.ndarray:
        """How many of the first ``done`` blocks of the sources are released at each slot from ``low`` to ``high``."""
        first = np.maximum(0, np.floor(self.delivered(float(low))).astype(np.int64) - 1)
        last = np.minimum(done, np.ceil(self.delivered(float(high))).astype(np.int64) + 1)
        n = np.maximum(0, last - first)
        sources = np.repeat(np.arange(len(done)), n)
        blocks = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[sources] + 1
        at = self.windows(sources, blocks)[0]
        return np.bincount(at[(at >= low) & (at < high)] - low, minlength=high - low)

    def before(self, t: int) -> np.ndarray:
        """Whole blocks of each source that lie before slot ``t``.

        Blocks that the fluid has finished do, and so many of those it has begun that ``t``
        slots are full: the earliest deadlines first, but only those for which there is a slot
        left. From any slot u on, at most t - u of the blocks released since can lie before t.
        """
        flow = self.delivered(float(t))
        done = np.floor(flow).astype(np.int64)
        extra = int(t - done.sum())
        if extra <= 0:
            return done
        begun = np.flatnonzero((flow > done) & (done < self.sizes))
        releases, deadlines = self.windows(begun, done[begun] + 1)
        # The room from u on binds the blocks released at u or later: of all u between two
        # releases only the least room counts. The slots are gone through in chunks, backwards.
        points, place = np.unique(np.minimum(releases, t - 1), return_inverse=True)
        least = np.full(len(points) + 1, t, np.int64)
        later, high = 0, t
        while high > points[0]:
            low = max(int(points[0]), high - CHUNK)
            since = np.cumsum(self.released(low, high, done)[::-1])[::-1] + later
            u = np.arange(low, high)
            np.minimum.at(least, np.searchsorted(points, u), t - u - since)
            later, high = int(since[0]), low
        chosen = np.zeros(len(begun), bool)
        for k in np.lexsort((begun, deadlines)).tolist():
            room = least[: place[k] + 1]
            if room.min() >= 1:
                room -= 1
                chosen[k] = True
                extra -= 1
                if not extra:
                    break
        rest = np.lexsort((begun, deadlines, releases))
        chosen[rest[~chosen[rest]][:extra]] = True
        done[begun[chosen]] += 1
        return done


def schedule(fluid: Fluid, start: int, end: int) -> list[tuple[int, int, int, int, int]]:
    """(source, block, slot, release, deadline) of slots ``start`` to ``end``, earliest deadline first."""
    first, last = fluid.before(start), fluid.before(end)
    waiting: list[tuple[int, int, int, int]] = []
    for s in np.flatnonzero(last > first).tolist():
        release, deadline = fluid.window(s, int(first[s]) + 1)
        waiting.append((release, deadline, s, int(first[s]) + 1))
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    out = []
    for slot in range(start, end):
        while waiting and (waiting[0][0] <= slot or not ready):
            release, deadline, s, block = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, block, release))
        deadline, s, block, release = heapq.heappop(ready)
        out.append((s, block, slot, release, deadline))
        if block < last[s]:
            r, d = fluid.window(s, block + 1)
            heapq.heappush(waiting, (r, d, s, block + 1))
    return out


def _identified(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``row`` (all columns of a document) beside columns that identify the row, and their names.

    Rows of files are known by file and place in it; others are landed under a number.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    file = F.col("_metadata.file_path")
    try:
        found = docs.select(
            row, F.xxhash64(file).alias("f1"), F.xxhash64(F.lit(1), file).alias("f2"), F.col("_metadata.row_index").alias("at"))
        found.schema
    except AnalysisException:  # not rows of files
        return land(docs.select(row, F.monotonically_increasing_id().alias("at")), "mixing-rows"), ["at"]
    return found, ["f1", "f2", "at"]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the number of their range and their place among those of their source in it, from 0."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        codes = batch.column(0).dictionary_encode()
        at = codes.indices.to_numpy()
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        first = np.repeat(starts, np.diff(np.append(starts, n)))
        place = np.arange(n) - first
        if codes.dictionary[int(at[0])].as_py() == last:
            place[first == 0] += seen
        last, seen = codes.dictionary[int(at[-1])].as_py(), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(place)], names=[*batch.schema.names, "part", "place"])


def place(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``row`` (all columns of a document) with ``source_key, block, in_block, slot, release, deadline``.

    ``weights`` maps sources to target weights; by default source sizes to the power
    ``SMOOTHING``. Reading the rows by (slot, in_block) is the mix. Rows are ranked without
    their texts; 16 bytes per source travel with the job, names stay in the tables.
    """
    spark = docs.sparkSession
    rows, known = _identified(docs)
    source = F.coalesce(F.col("row.source"), F.lit(NO_SOURCE))
    text = F.coalesce("row.text", F.lit("")) if "text" in docs.columns else F.lit("")
    light = rows.select(
        source.alias("source_key"), F.xxhash64(F.lit(seed), "row.doc_id", "row.source").alias("mixed"),
        F.col("row.doc_id").cast("string").alias("id"), F.xxhash64(text).alias("hash"), *known)
    order = ["source_key", "mixed", "id", "hash", *known]
    ranged = light.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in light.schema if f.name not in ("mixed", "id", "hash"))
    ranked = land(ranged.select("source_key", *known).mapInArrow(_counted, f"{kinds}, part int, place long"), "mixing-ranks")

    # Where each source begins in each range, and a number for each source.
    running = W.partitionBy("source_key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = ranked.groupBy("source_key", "part").agg(F.count(F.lit(1)).alias("n"))
    sources = counts.groupBy("source_key").agg(F.sum("n").alias("n"))
    if weights is not None:
        given = spark.createDataFrame([(NO_SOURCE if k is None else k, float(v)) for k, v in weights.items()], "source_key string, weight double")
        sources = sources.join(given, "source_key", "left").fillna(0.0, ["weight"])
    else:
        sources = sources.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(SMOOTHING)))
    sources = land(sources.withColumn("sid", F.monotonically_increasing_id()), "mixing-sources")
    table = sources.select("sid", "n", "weight", F.xxhash64("source_key").alias("h")).toArrow()
    sid, n, weight, h = (table.column(c).to_numpy() for c in ("sid", "n", "weight", "h"))
    numbered = np.lexsort((sid, h))  # an order that does not hang on which task saw a source
    sid, blocks = sid[numbered], -(-n[numbered] // block)
    fluid = Fluid(blocks, weight[numbered]) if len(sid) else None
    total = int(blocks.sum())

    def segments(batches):
        for pdf in batches:
            for k in pdf["id"]:
                found = schedule(fluid, int(k) * SEGMENT, min(total, (int(k) + 1) * SEGMENT))
                yield pd.DataFrame([(int(sid[s]), *rest) for s, *rest in found], columns=["sid", "block", "slot", "release", "deadline"])

    n_segments = -(-total // SEGMENT)
    slots = spark.range(0, n_segments, 1, min(partitions(spark), max(1, n_segments))).mapInPandas(
        segments, "sid long, block long, slot long, release long, deadline long")
    begins = counts.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0))).drop("n")
    rank = F.col("before") + F.col("place")
    placed = ranked.join(begins, ["source_key", "part"]).join(sources.select("source_key", "sid"), "source_key").select(
        *known, "source_key", "sid", (F.floor(rank / block) + 1).cast("long").alias("block"), F.pmod(rank, F.lit(block)).alias("in_block"))
    placed = placed.join(slots, ["sid", "block"]).drop("sid")
    return rows.join(placed, known).select("row", "source_key", "block", "in_block", "slot", "release", "deadline")


def in_order(placed: DataFrame, columns: list[str]) -> DataFrame:
    """The documents, laid out in mix order: partition by partition and sorted inside."""
    n = partitions(placed.sparkSession)
    rows = placed.repartitionByRange(n, "slot", "in_block").sortWithinPartitions("slot", "in_block")
    return rows.select(*[_field(c) for c in columns])


def _field(name: str) -> Column:
    return F.col("row").getField(name).alias(name)
