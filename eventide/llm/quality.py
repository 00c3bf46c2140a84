"""Quality classifier: random Fourier features over document statistics, ridge, isotonic.

``statistics`` describes a text by a few numbers. Their standardised values go
through D random cosines, which approximate a Gaussian kernel; each partition
sums its part of the normal equations, and one ridge solve of D x D gives the
weights. Raw scores are binned, and pool-adjacent-violators over the bins turns
them into probabilities that never fall as the raw score rises.

Only the text enters a score. Labels are learnt from the rows given to ``fit``.

Defined results
- null text: empty. Empty and very long texts are scored like any other.
- several labels of one doc_id: their mean. Null labels and null ids are not learnt from.
- no label at all: every score is 0.5; one class only: every score is that class's rate.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import bloom_filter, maybe_in
from .common import land

SEED = 20
COSINES = 256
RIDGE = 1.0
WIDTH = 5.0  # kernel width in standard deviations of the statistics
BINS = 512
SUMS = 16  # partial sums that meet on the driver

_BYTE_CLASS = np.zeros(256, np.uint8)  # 0 other
for _i, _chars in enumerate((
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t\x0b\x0c",
    b".,;:", b"!?", b"'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~",
), start=1):
    _BYTE_CLASS[list(_chars)] = _i
_BYTE_CLASS[128:192] = 10  # continuation bytes
_BYTE_CLASS[192:] = 11  # first bytes beyond ASCII
_SPACES = re.compile(r"\s+")
NAMES = (
    "log_chars", "lower", "upper", "digit", "space", "breaks", "stops", "shouts", "quotes", "symbols", "beyond_ascii",
    "log_words", "word_length", "long_words", "short_words", "distinct_words", "top_word", "repeated_pairs", "same_next",
    "distinct_lines", "line_words", "words_with_symbol", "capital_words",
)
_SYMBOL = re.compile(r"[#$%&*|<>@{}\[\]^~=_+!]")


def describe(text: str | None) -> np.ndarray:
    """The statistics of one text, in the order of ``NAMES``."""
    out = np.zeros(len(NAMES))
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kind = np.bincount(_BYTE_CLASS[raw], minlength=12)
    n = len(raw) - kind[10]
    out[0] = np.log1p(n)
    out[1:10] = kind[1:10] / n
    out[10] = kind[11] / n
    words = text.split()
    if not words:
        return out
    m = len(words)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int32, m)
    pairs = len(set(zip(words, words[1:])))
    lines = text.split("\n")
    out[11] = np.log1p(m)
    out[12] = lengths.mean()
    out[13] = (lengths > 12).mean()
    out[14] = (lengths < 3).mean()
    out[15] = len(counts) / m
    out[16] = max(counts.values()) / m
    out[17] = 1 - pairs / max(1, m - 1) if m > 1 else 0.0
    out[18] = sum(map(str.__eq__, words, words[1:])) / m
    out[19] = len(set(lines)) / len(lines)
    out[20] = np.log1p(m / len(lines))
    out[21] = sum(c for w, c in counts.items() if _SYMBOL.search(w)) / m
    out[22] = sum(c for w, c in counts.items() if w[0].isupper()) / m
    return out


def _describe_all(texts: pd.Series) -> np.ndarray:
    return np.stack([describe(t) for t in texts]) if len(texts) else np.zeros((0, len(NAMES)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics(text: pd.Series) -> pd.Series:
    return pd.Series(list(_describe_all(text)))


@dataclass
class Model:
    """A fitted scorer: a few arrays whose size depends on the parameters only."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # raw scores at which the calibrated score is given
    levels: np.ndarray

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.cos(z @ self.waves + self.phase) * np.sqrt(2.0 / len(self.phase))

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.weights[:-1] + self.weights[-1]

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.steps, self.levels) if len(stats) else np.zeros(0)


def isotonic(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-falling fit of ``mean``."""
    blocks: list[list[float]] = []
    for w, m in zip(weight, mean):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, n2 = blocks.pop()
            w1, m1, n1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2])
    return np.concatenate([np.full(n, m) for _, m, n in blocks]) if blocks else np.zeros(0)


def _sums(batches, model: Model):
    """One row per partition: its part of Z'Z and Z'y, as bytes."""
    d = len(model.phase) + 1
    zz, zy = np.zeros((d, d)), np.zeros(d)
    for pdf in batches:
        if len(pdf):
            z = np.column_stack([model.cosines(np.stack(pdf["stats"])), np.ones(len(pdf))])
            zz += z.T @ z
            zy += z.T @ pdf["label"].to_numpy(float)
    yield pd.DataFrame({"part": [zz.tobytes() + zy.tobytes()]})


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(x) for x in pdf["part"]], axis=0)
    return pd.DataFrame({"part": [total.tobytes()]})


def fit(docs: DataFrame, labels: DataFrame, cosines: int = COSINES, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """Learn from every row of ``labels (doc_id, label)`` whose document is in ``docs (doc_id, text)``."""
    spark = docs.sparkSession
    labels = labels.filter("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.avg(F.col("label").cast("double")).alias("label"))
    # Only documents that may have a label are described; the join on the id is exact.
    key = F.col("doc_id").cast("string").alias("_key")
    described = maybe_in(docs.select("doc_id", "text", key), bloom_filter(labels.select(key), "_key"), "_key").select(
        "doc_id", statistics("text").alias("stats"))
    rows = land(described.join(labels, "doc_id").select("stats", "label"), "quality")
    width = len(NAMES)
    moments = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate"),
        *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(width)],
        *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(width)]).first()
    rng = np.random.default_rng(seed)
    model = Model(
        np.array([moments[f"m{i}"] or 0.0 for i in range(width)]),
        np.array([max(moments[f"s{i}"] or 0.0, 1e-6) for i in range(width)]),
        rng.normal(size=(width, cosines)) / WIDTH, rng.uniform(0, 2 * np.pi, cosines),
        np.zeros(cosines + 1), np.array([0.0]), np.array([0.5]))
    if not moments["n"]:
        return model
    parts = rows.mapInPandas(lambda it: _sums(it, model), "part binary")
    parts = parts.groupBy(F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(SUMS))).applyInPandas(_add, "part binary")
    total = np.sum([np.frombuffer(r["part"]) for r in parts.collect()], axis=0)
    d = cosines + 1
    zz, zy = total[: d * d].reshape(d, d), total[d * d :]
    model.weights = np.linalg.solve(zz + ridge * np.eye(d), zy)

    @F.pandas_udf(T.DoubleType())
    def raw(stats: pd.Series) -> pd.Series:
        return pd.Series(model.raw(np.stack(stats)) if len(stats) else np.zeros(0))

    low, high = -0.5, 1.5
    at = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((raw("stats") - low) / (high - low) * BINS)))
    bins = rows.select(at.alias("bin"), "label").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate")).orderBy("bin").collect()
    middle = np.array([low + (r["bin"] + 0.5) * (high - low) / BINS for r in bins])
    model.steps = middle
    model.levels = isotonic(np.array([float(r["n"]) for r in bins]), np.array([r["rate"] for r in bins]))
    return model


def scorer(model: Model):
    """A column function: text -> calibrated probability that its label is 1."""

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(_describe_all(text)))

    return score


def quality_labels(labels: DataFrame, held_out: Column | None) -> DataFrame:
    rows = labels.select("doc_id", F.col("quality").alias("label"))
    return rows if held_out is None else rows.filter(~held_out)
