"""Target-distribution importance resampling over hashed word n-grams.

Features are all runs of one to three words; a feature's bucket is the CRC-32 of its
bytes modulo ``BUCKETS``. Counting the buckets of all documents and of the target texts
gives every bucket a gain, the logarithm of how much more frequent it is in the target; a
document weighs the sum of the gains of its features. A Gumbel draw fixed by the document's
id is added, and the documents with the highest sums are the sample.

CRCs are computed over length-bucketed matrices. The words of a batch are laid end to end,
so that each feature is a slice; distinct features are grouped by length, and all CRCs of
a group advance column by column over its two-dimensional uint8 array; then they are
scattered back to the places of their features. A feature longer than ``SPAN`` bytes is
cut into rows of that length, whose CRCs are folded together.

Defined results
- null text: no words. A document without features weighs 0.
- a null doc_id draws like the empty text after the seed, and comes after all ids on ties;
  rows of one id with equal scores follow each other by features and weight.
- every row is a document of its own, repeated rows included. An empty table gives an
  empty result; an empty target gives every bucket the gain of no occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import land, order_id, partitions

BUCKETS = 10_000
RUN = 3  # words of the longest feature
MIN_WORDS = 20
DRAWN_PCT = 5
SEED = 42
SPAN = 512  # bytes of the widest matrix
BATCH = 1 << 20  # bytes of text whose features are hashed together
CELLS = 1 << 22  # bytes of one matrix

# What a word is made of: ASCII letters (lower case) and digits, and all bytes of longer code points.
_WORDS = bytes(
    i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def _zeros(n: int) -> np.ndarray:
    """How the CRC register moves over ``n`` zero bytes: four tables, one per byte of the register."""
    step = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    for _ in range(n):
        step = CRC[step & 255] ^ step >> 8
    return step


def _shift(crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


_SPAN_ZEROS = _zeros(SPAN)


def crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices of ``data`` (uint8), grouped by equal length."""
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    bounds = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, bounds):
        if not len(group):
            continue
        length = int(lengths[group[0]])
        head, spans = (length, 0) if length <= SPAN else (length % SPAN, length // SPAN)
        for at in range(0, len(group), max(1, CELLS // max(1, min(length, SPAN)))):
            rows = group[at : at + max(1, CELLS // max(1, min(length, SPAN)))]
            crc = _columns(data, starts[rows], head, np.full(len(rows), 0xFFFFFFFF, np.uint32))
            for k in range(spans):
                crc = _shift(crc, _SPAN_ZEROS)
                if len(rows) * spans <= CELLS // SPAN:  # all spans of the group are one matrix
                    if k == 0:
                        begin = (starts[rows][None, :] + head + SPAN * np.arange(spans)[:, None]).reshape(-1)
                        parts = _columns(data, begin, SPAN, np.zeros(len(begin), np.uint32)).reshape(spans, -1)
                    crc ^= parts[k]
                else:
                    crc ^= _columns(data, starts[rows] + head + SPAN * k, SPAN, np.zeros(len(rows), np.uint32))
            out[rows] = ~crc
    return out


def _columns(data: np.ndarray, starts: np.ndarray, width: int, crc: np.ndarray) -> np.ndarray:
    """Advance the registers over the matrix of ``width`` bytes from each start, column by column."""
    matrix = data[starts[None, :] + np.arange(width)[:, None]]
    for column in matrix:
        crc = CRC[(crc ^ column) & 255] ^ crc >> 8
    return crc


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, the text each belongs to, and the number of words of each text."""
    words = [(t or b"").translate(_WORDS).split() for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    flat = [x for w in words for x in w]
    if not flat:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_words
    data = np.frombuffer(b" ".join(flat), np.uint8)
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    owner = np.repeat(np.arange(len(texts)), n_words)
    word = pd.factorize(np.array(flat, object))[0].astype(np.int64)
    buckets, owners = [], []
    key, kinds = word, int(word.max()) + 1
    for n in range(1, RUN + 1):
        if n > 1:  # runs that stay inside a text; their keys are pairs of distinct shorter runs and words
            inside = owner[: len(flat) - n + 1] == owner[n - 1 :]
            key = key[: len(flat) - n + 1] * kinds + word[n - 1 :]
        else:
            inside = np.ones(len(flat), bool)
        place = np.flatnonzero(inside)
        code, first = _distinct(key[place])
        at = place[first]
        crc = crcs(data, starts[at], ends[at + n - 1] - starts[at])
        buckets.append((crc % BUCKETS).astype(np.int64)[code])
        owners.append(owner[place])
        if n < RUN:
            full = np.zeros(len(key), np.int64)
            full[place] = code
            key = full
    return np.concatenate(buckets), np.concatenate(owners), n_words


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each key among the distinct ones, and a place of every distinct key."""
    code, unique = pd.factorize(keys)
    first = np.empty(len(unique), np.int64)
    first[code[::-1]] = np.arange(len(keys))[::-1]
    return code.astype(np.int64), first


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, int, list[bytes | None]]]:
    """Runs of rows whose texts together have about ``BATCH`` bytes."""
    for batch in batches:
        texts, size, begin = [], 0, 0
        for i, text in enumerate(batch.column(column)):
            texts.append(text.as_buffer().to_pybytes() if text.is_valid else None)
            size += len(texts[-1] or b"")
            if size >= BATCH:
                yield batch, begin, i + 1, texts
                texts, size, begin = [], 0, i + 1
        if texts:
            yield batch, begin, batch.num_rows, texts


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Occurrences of all features of ``texts (text)`` per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, _, _, held in _batches(batches, 0):
            total += np.bincount(features(held)[0], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total)], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(count, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed frequencies, per bucket."""
    s, t = source.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row of ``docs (doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begin, end, texts in _batches(batches, 1):
            bucket, owner, n_words = features(texts)
            n = np.bincount(owner, minlength=len(texts))
            order = np.argsort(owner, kind="stable")
            sums = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(begin, end - begin), pa.array(n_words), pa.array(n.astype(np.int64)),
                 pa.array(sums[ends] - sums[ends - n])], names=["doc_id", "n_words", "n_features", "weight"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int = SEED) -> Column:
    """Thousandths of a standard Gumbel draw fixed by the document's id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the number of their range and their place in it, from 1."""
    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen + 1, seen + n + 1))],
            names=[*batch.schema.names, "part", "place"])
        seen += n


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PCT, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; ``rank`` is null if it is not drawn."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = weigh(docs, gain).withColumn("score", F.col("weight") + gumbel(seed))
    rows = land(rows.withColumn("able", F.col("n_words") >= MIN_WORDS).drop("n_words"), "resample-scores")
    # Ranges in the order of the draw: a range's first rank follows from the sizes of those before it.
    order = [F.desc("able"), F.desc("score"), order_id().asc(), F.asc("n_features"), F.asc("weight"), F.asc("row")]
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    names = ["doc_id", "n_features", "weight", "score", "able"]
    ranged = land(ranged.select(*names).mapInArrow(
        _numbered, "doc_id long, n_features long, weight long, score long, able boolean, part int, place long"), "resample-ranges")
    sizes = ranged.groupBy("part").agg(F.count_if("able").alias("n"))  # one row per range
    sizes = sizes.select("part", "n", F.coalesce(
        F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    place = F.col("before") + F.col("place")
    return ranged.join(F.broadcast(sizes.drop("n")), "part").select(
        "doc_id", "n_features", "weight", "score",
        F.when(F.col("able") & (place <= percent * total // 100), place).cast("long").alias("rank"))
