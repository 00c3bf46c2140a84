"""Filter interaction audit over sorted posting lists.

Every document gets a row of light columns: its part, its id, which filters it fails and
its labels. The rows are range-partitioned by (part, id) and sorted, so a task holds id
ranges of parts, and each range gets one ascending list of failing ids per filter. Within
an id range the lists are merged: a galloping k-way merge gives the union of every set of
filters, and galloping differences what a filter removes after such a set. Only the sizes
leave a task. A filter's place in an order matters only through the set of filters before
it, so 80 differences answer all 120 orders.

Words are maximal runs without ASCII white space. Failure conditions:
A under 100 words; B under 80 % distinct words; C over 10 % capitals A-Z among the code
points; D holds any of ``#$%&*|``; E identical to the text of any smaller doc_id.

Defined results
- null text: empty; null part: the empty string, together with empty parts.
- a null doc_id comes after all ids; rows that repeat an id or have none are documents of
  their own, and never fail E because of each other.
- a label held by any of a document's label rows counts; documents without labels have none.
- texts are compared by two 64-bit hashes. An empty table has no parts and no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import split_join
from .common import land, order_id, partitions

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PCT, CAPITALS_PCT = 100, 80, 10
MARKS = re.compile(rb"[#$%&*|]")
RANGE = 4096  # ids that the longest list holds within one merged id range
CHUNK = 1 << 20  # rows whose lists are held at once
SUM_PARTS = 64

_NOT_CAPITAL = bytes(i for i in range(256) if not 65 <= i <= 90)
_CONTINUES = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point


@F.pandas_udf(T.IntegerType())
def _text_failures(text: pd.Series) -> pd.Series:
    """Bits 0 to 3: the filters A to D that each UTF-8 text fails."""
    out = []
    for raw in text:
        raw = raw or b""
        words = raw.split()  # bytes split at ASCII white space only
        distinct = len(set(words))
        capitals = len(raw.translate(None, _NOT_CAPITAL))
        points = len(raw.translate(None, _CONTINUES))
        out.append((len(words) < MIN_WORDS) | (100 * distinct < DISTINCT_PCT * len(words)) << 1
                   | (100 * capitals > CAPITALS_PCT * points) << 2 | (MARKS.search(raw) is not None) << 3)
    return pd.Series(out, dtype="int32")


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """``part, id, fails, good, toxic`` of every document; bit i of ``fails`` is filter i of A to E."""
    text = F.coalesce("text", F.lit(""))
    rows = land(docs.select(
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"),
        order_id().alias("id"), _text_failures(text.cast("binary")).alias("fails"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")), "audit-texts")
    copies = rows.groupBy("h1", "h2").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    found = split_join(split_join(rows, copies, ["h1", "h2"], "left"), marks, "doc_id", "left")
    repeats = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).cast("int")
    return land(found.select(
        "part", "id", F.col("fails").bitwiseOR(F.shiftleft(repeats, 4)).cast("byte").alias("fails"),
        (F.coalesce("good", F.lit(0)) + F.coalesce("toxic", F.lit(0)) * 2).cast("byte").alias("marks")), "audit-failures")


def gallop(ids: np.ndarray, start: int, value: int) -> int:
    """First place from ``start`` whose id reaches ``value``: doubling steps, then a binary search."""
    step, low = 1, start
    while low + step < len(ids) and ids[low + step] < value:
        low, step = low + step, step * 2
    return low + int(np.searchsorted(ids[low : low + step + 1], value))


def ranges(lists: list[np.ndarray], width: int = RANGE) -> Iterator[list[np.ndarray]]:
    """Cut sorted lists into common id ranges; the longest list left gives ``width`` ids to each."""
    at = [0] * len(lists)
    while any(a < len(x) for a, x in zip(at, lists)):
        k = max(range(len(lists)), key=lambda i: len(lists[i]) - at[i])
        end = lists[k][at[k] + width] if at[k] + width < len(lists[k]) else None
        to = [len(x) if end is None else gallop(x, a, end) if a < len(x) else a for a, x in zip(at, lists)]
        yield [x[a:b] for a, b, x in zip(at, to, lists)]
        at = to


def merge(lists: list[np.ndarray]) -> np.ndarray:
    """Union of sorted lists without repeats: the shorter ones gallop into the longest.

    Every list is placed by search and what is new is put between, so a list costs its
    own length times the logarithm of the other's.
    """
    lists = sorted((x for x in lists if len(x)), key=len, reverse=True)
    if not lists:
        return np.zeros(0, np.int64)
    out = lists[0]
    for x in lists[1:]:
        fresh = minus(x, out)
        if len(fresh):
            out = np.insert(out, np.searchsorted(out, fresh), fresh)
    return out


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The ids of sorted ``a`` that sorted ``b`` lacks."""
    if not len(a) or not len(b):
        return a
    at = np.searchsorted(b, a)
    return a[b[np.minimum(at, len(b) - 1)] != a]


def sizes(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Over the sorted failing ids of the filters: (set before, filter) -> removed, good and toxic among them.

    ``out[s, f]`` holds for the set of filters in the bits of ``s``, which lacks ``f``,
    the numbers of ids that fail ``f`` and none of ``s``; ``good`` and ``toxic`` are flags by id.
    """
    n = len(lists)
    out = np.zeros((1 << n, n, 3), np.int64)
    for cut in ranges(lists):
        for s in range(1 << n):
            union = merge([cut[f] for f in range(n) if s >> f & 1])
            for f in range(n):
                if not s >> f & 1:
                    left = minus(cut[f], union)
                    out[s, f] += (len(left), int(good[left].sum()), int(toxic[left].sum()))
    return out


def _part_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (part, id, fails, marks) -> ``part, seen, failing, cell`` sums of each id range."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    part, size = None, 0

    def flush() -> pa.RecordBatch:
        # Ids repeat where rows do: a row's place in the sorted range stands for it.
        fails, marks = (np.concatenate(c) for c in zip(*held))
        lists = [np.flatnonzero(fails >> f & 1) for f in range(len(FILTERS))]
        cells = sizes(lists, marks & 1 > 0, marks & 2 > 0)
        held.clear()
        return pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.string()), "seen": pa.array([len(fails)], pa.int64()),
            "failing": pa.array([[len(x) for x in lists]], pa.list_(pa.int64())),
            "cell": pa.array([cells.reshape(-1).tolist()], pa.list_(pa.int64()))})

    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column(0).dictionary_encode()
        code = parts.indices.to_numpy()
        fails, marks = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
        bounds = np.flatnonzero(np.diff(code)) + 1
        for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), len(code)]):
            own = parts.dictionary[int(code[a])].as_py()
            if held and (own != part or size >= CHUNK):
                yield flush()
                size = 0
            part = own
            held.append((fails[a:b], marks[a:b]))
            size += b - a
    if held:
        yield flush()


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row with the sums of a group's rows."""
    return pd.DataFrame({
        "part": pdf["part"].iloc[:1], "seen": [int(pdf["seen"].sum())],
        "failing": [np.sum(np.stack(pdf["failing"].to_list()), axis=0)],
        "cell": [np.sum(np.stack(pdf["cell"].to_list()), axis=0)]})


def orders() -> list[tuple[str, list[tuple[int, int]]]]:
    """Every order of the filters with its steps: (filter, set of the filters before it)."""
    out = []
    for order in permutations(range(len(FILTERS))):
        steps, before = [], 0
        for f in order:
            steps.append((f, before))
            before |= 1 << f
        out.append(("".join(FILTERS[f] for f in order), steps))
    return out


def _report(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of one part, from its sums."""
    total, n = _added(pdf), len(FILTERS)
    part, seen, failing = total["part"].iloc[0], int(total["seen"].iloc[0]), total["failing"].iloc[0]
    cell = total["cell"].iloc[0].reshape(1 << n, n, 3)
    # Orders in which exactly the filters of a set come before a given one.
    weight = [factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) if s.bit_count() < n else 0 for s in range(1 << n)]
    shapley = [sum(weight[s] * int(cell[s, f, 0]) for s in range(1 << n) if not s >> f & 1) for f in range(n)]
    rows = []
    for order, steps in orders():
        kept = seen
        for step, (f, before) in enumerate(steps, 1):
            removed, good, toxic = (int(x) for x in cell[before, f])
            kept -= removed
            alone = int(cell[(1 << n) - 1 - (1 << f), f, 0])
            rows.append((part, order, step, kept, removed, int(failing[f]) - removed, alone, good, toxic, shapley[f]))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in REPORT.split(", ")])


SUMS = "part string, seen long, failing array<long>, cell array<long>"
REPORT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, filter order and step with the counts of the filter at that step."""
    rows = failures(docs, labels, part).withColumn("row", F.monotonically_increasing_id())  # spreads rows of one id
    key = ["part", "id", "row"]
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), *key).sortWithinPartitions(*key)
    sums = ordered.select("part", "id", "fails", "marks").mapInArrow(_part_sizes, SUMS)
    # Sums of sums: the ranges of a large part never meet in one task at once.
    sums = sums.groupBy("part", (F.spark_partition_id() % SUM_PARTS).alias("some")).applyInPandas(_added, SUMS)
    return sums.groupBy("part").applyInPandas(_report, REPORT)
