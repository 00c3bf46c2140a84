"""Line deduplication over range-partitioned line hashes, answered as bitmaps.

Each document sends (key hash, document, position) for its long lines. The rows
are range-partitioned by (hash, document, position) and sorted, so a line that
a third of all documents hold spreads over many tasks. A task streams its sorted
rows once: the first document of a hash keeps its lines, later documents lose
theirs. A hash that runs on from an earlier range is settled afterwards from the
first rows of all ranges, which are a few rows per task. What returns are the
dropped positions only, as one compressed keep bitmap per document.

Defined results
- null or empty text: one empty line, kept.
- a null doc_id comes after all ids; all rows with a null id count as one
  document, and so do rows that repeat a doc_id: they never lose lines to each
  other, and each row gets its own bitmap.
- extra columns pass through ``apply_bitmaps`` untouched.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import land, order_id, partitions

# Fixed values of the line key: what is stripped, and the ASCII capitals.
STRIPPED = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_CHARS = 10


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, UPPER.lower())


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(order_id().alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))


def _first_documents(batches):
    """Stream rows sorted by (h1, h2, id): emit what a later document repeats.

    Rows of the range's first hash cannot be settled here and are passed on as
    open, one row per document line; ``head`` marks the smallest document that
    this range holds of its first and of its last hash.
    """
    schema = pa.schema([("kind", pa.int8()), ("h1", pa.int64()), ("h2", pa.int64()), ("_id", pa.int64()),
                        ("_th", pa.int64()), ("pos", pa.int32())])
    first = last = None  # (h1, h2, smallest id)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "_id", "_th", "pos")}
        new = np.ones(n, bool)
        new[1:] = (col["h1"][1:] != col["h1"][:-1]) | (col["h2"][1:] != col["h2"][:-1])
        carried = last is not None and (col["h1"][0], col["h2"][0]) == last[:2]
        new[0] = not carried
        run = np.cumsum(new) - 1 + carried
        starts = np.flatnonzero(new)
        smallest = col["_id"][starts]
        if carried:
            smallest = np.concatenate([[last[2]], smallest])
        owner = smallest[run]
        if first is None:
            first = (col["h1"][0], col["h2"][0], owner[0])
        opened = (col["h1"] == first[0]) & (col["h2"] == first[1])
        dropped = ~opened & (col["_id"] != owner)
        out = opened | dropped
        last = (col["h1"][-1], col["h2"][-1], owner[-1])
        if out.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(opened[out], 1, 0).astype(np.int8))]
                + [pa.array(col[c][out]) for c in ("h1", "h2", "_id", "_th")]
                + [pa.array(col["pos"][out].astype(np.int32))], schema=schema)
    if first is not None:
        ends = [first] if last[:2] == first[:2] else [first, last]
        yield pa.RecordBatch.from_arrays(
            [pa.array([2] * len(ends), pa.int8()), pa.array([e[0] for e in ends], pa.int64()),
             pa.array([e[1] for e in ends], pa.int64()), pa.array([e[2] for e in ends], pa.int64()),
             pa.array([0] * len(ends), pa.int64()), pa.array([0] * len(ends), pa.int32())], schema=schema)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``_id, _th, pos``: every line that goes, once per distinct (document id, text)."""
    spark = docs.sparkSession
    lines = _rows(docs).select("_id", "_th", F.posexplode(F.split("_text", "\n")).alias("pos", "line"))
    key = line_key(F.col("line"))
    lines = (
        lines.withColumn("key", key).filter(F.length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "_id", "_th", "pos")
    )
    ordered = lines.repartitionByRange(partitions(spark), "h1", "h2", "_id", "_th", "pos").sortWithinPartitions(
        "h1", "h2", "_id", "_th", "pos")
    found = land(ordered.mapInArrow(
        _first_documents, "kind byte, h1 long, h2 long, _id long, _th long, pos int"), "lines")
    # A hash that spans ranges has an entry for each of them: its owner is the smallest.
    owners = found.filter("kind = 2").groupBy("h1", "h2").agg(F.min("_id").alias("owner"))
    # At most two rows per range, so the table is bounded by the number of partitions.
    settled = (
        found.filter("kind = 1").join(F.broadcast(owners), ["h1", "h2"]).filter("_id != owner").select("_id", "_th", "pos")
    )
    return found.filter("kind = 0").select("_id", "_th", "pos").unionByName(settled)


@F.pandas_udf(T.BinaryType())
def _bitmap(n_lines: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for n, drop in zip(n_lines, gone):
        keep = np.ones(n, np.uint8)
        if drop is not None and len(drop):
            keep[np.asarray(drop, np.int64)] = 0
        out.append(zlib.compress(np.packbits(keep).tobytes()))
    return pd.Series(out, dtype=object)


def read_bitmap(packed: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per distinct (document id, text): ``_id, _th, n_lines, n_dropped, keep_bitmap``.

    ``keep_bitmap`` is a zlib-compressed bit string, first line first, 1 = keep.
    """
    gone = dropped_lines(docs, min_chars).groupBy("_id", "_th").agg(F.collect_set("pos").alias("gone"))
    heads = _rows(docs).select("_id", "_th", F.size(F.split("_text", "\n")).alias("n_lines")).groupBy("_id", "_th").agg(
        F.max("n_lines").alias("n_lines"))
    return heads.join(gone, ["_id", "_th"], "left").select(
        "_id", "_th", F.col("n_lines").cast("long"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        _bitmap("n_lines", "gone").alias("keep_bitmap"))


@F.pandas_udf(T.StringType())
def _kept(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    out = []
    for value, packed in zip(text, bitmap):
        lines = value.split("\n")
        keep = read_bitmap(packed, len(lines))
        out.append(value if keep.all() else "\n".join(x for x, k in zip(lines, keep) if k))
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def _kept_sha256(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    out = []
    for value, packed in zip(text, bitmap):
        lines = value.split("\n")
        keep = read_bitmap(packed, len(lines))
        kept = value if keep.all() else "\n".join(x for x, k in zip(lines, keep) if k)
        out.append(hashlib.sha256(kept.encode()).hexdigest())
    return pd.Series(out, dtype=object)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``row`` (all columns of a document) beside ``line`` (n_lines, n_dropped, keep_bitmap)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.struct("*").alias("row"), order_id().alias("_id"), F.xxhash64(text).alias("_th"))
    maps = bitmaps.select("_id", "_th", F.struct("n_lines", "n_dropped", "keep_bitmap").alias("line"))
    return keyed.join(maps, ["_id", "_th"]).select("row", "line")


def kept_sha256() -> Column:
    """Digest of the kept text, over the columns of ``with_bitmaps``."""
    return _kept_sha256(F.coalesce(F.col("row.text"), F.lit("")), F.col("line.keep_bitmap"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with only the kept lines in ``text``; ``n_chars`` follows if present."""
    cut = F.col("line.n_dropped") > 0
    text = F.when(cut, _kept(F.coalesce(F.col("row.text"), F.lit("")), F.col("line.keep_bitmap"))).otherwise(
        F.col("row.text"))
    out = with_bitmaps(docs, bitmaps).withColumn("kept", text)
    columns = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("kept")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(cut, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(
            columns["n_chars"])
    return out.select(*[columns[c].alias(c) for c in docs.columns])
