"""Toxicity: a convolutional text classifier over hashed word embeddings.

Words are hashed to a fixed number of embeddings. Filters of several widths slide
over the whole text, each keeps its largest response, and a logistic layer joins
them. Everything is trained here in numpy, on every labelled row: the rows are dealt by
hash of the id into shards of about ``TRAIN_ROWS``, each shard learns from its rows in
a task of its own, and after every pass the shards' models are averaged by their rows.
Up to ``TRAIN_ROWS`` rows are one shard. One row in ``CALIBRATION`` is kept for the
thresholds; many shards count these by their rounded logits. Thresholds are calibrated per language; the language comes from the text
(function words), never from a column. Calibrated scores are shifted so that each
language's threshold becomes 0.5.

Defined results
- null text: empty; its score is that of a text without words.
- a language with too few calibration rows uses the threshold of all rows.
- without any toxic or any clean label every score is the share of toxic labels.
- several labels of one doc_id: toxic if most say so; null labels and ids are not learnt from.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import bloom_filter, maybe_in
from .common import drop, land

SEED = 7
TRAIN_ROWS = 6000  # labelled rows of a shard, which learns in one task
HASHES = 1 << 15
DIM = 8
STEMS = (4, 5)  # letters of the hashed beginnings
PIECES = 1 + len(STEMS)
WIDTHS = (1, 2, 3)
FILTERS = 8  # per width
EPOCHS = 8
PASSES = 3  # least number of passes of many shards; each has more steps than one of a single shard
STEPS = 256  # logits of many shards are rounded to so many a unit
BLOCKS = 16  # parts in which the models of the shards are added up
BATCH = 32
RATE = 0.01
CALIBRATION = 4  # one row in so many is kept for the thresholds
LEAST = 20  # rows of each class that a language's own threshold needs
CACHE = 500_000
CHUNK = 1 << 16  # positions convolved at once

# Common function words of the languages told apart.
FUNCTION_WORDS = {
    "en": ("the", "and", "of", "to", "in", "that", "is", "for", "with", "was", "this", "are", "it", "on", "as"),
    "fr": ("le", "la", "les", "des", "une", "que", "est", "dans", "pour", "qui", "sur", "du", "au", "et", "avec"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "von", "zu", "den", "mit", "auf", "im", "sich", "für"),
    "es": ("el", "los", "las", "que", "una", "para", "con", "por", "del", "se", "es", "en", "y", "no", "un"),
}
_LANGUAGES = (*FUNCTION_WORDS, "other")
_TRIM = " .,;:!?\"'()[]{}<>*_~`|/\\-–—…«»“”„¡¿"


class Words:
    """Words -> three hash ids: of the whole word and of its first four and five letters.

    The beginnings let inflected forms of one stem share what is learnt of it.
    A bounded number of words is remembered.
    """

    def __init__(self, hashes: int = HASHES):
        self.hashes = hashes
        self.marks: dict[int, list[int]] = {}
        self._forget()
        for i, words in enumerate(FUNCTION_WORDS.values()):
            for w in words:
                self.marks.setdefault(self._hash(w), []).append(i)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, PIECES), np.int32)

    def _hash(self, piece: str) -> int:
        return 1 + zlib.crc32(piece.encode("utf-8", "replace")) % (self.hashes - 1)

    def _learn(self, word: str) -> int:
        i = self.known[word] = len(self.known)
        if i == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        plain = word.lower().strip(_TRIM)
        if plain:
            self.rows[i] = [self._hash(plain)] + [
                self._hash(f"{n}:{plain[:n]}") if len(plain) > n else 0 for n in STEMS]
        else:
            self.rows[i] = 0
        return i

    def ids(self, text: str | None) -> np.ndarray:
        """One row of ``PIECES`` hash ids per word; 0 stands for nothing."""
        if len(self.known) > CACHE:
            self._forget()
        known, out = self.known, []
        for w in (text or "").split():
            i = known.get(w)
            out.append(self._learn(w) if i is None else i)
        return self.rows[np.asarray(out, np.int64)]

    def language(self, ids: np.ndarray) -> int:
        """Position in ``_LANGUAGES``; ``other`` when no function word occurs."""
        votes = np.zeros(len(FUNCTION_WORDS))
        values, counts = np.unique(ids[:, 0], return_counts=True)
        for v, c in zip(values.tolist(), counts.tolist()):
            for i in self.marks.get(v, ()):
                votes[i] += c
        return int(votes.argmax()) if votes.any() else len(FUNCTION_WORDS)


@dataclass
class Model:
    """Arrays of a size fixed by the parameters."""

    embed: np.ndarray
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    bias: np.ndarray  # (widths, FILTERS)
    out: np.ndarray
    out_bias: float
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(_LANGUAGES)))  # logit of each threshold
    constant: float | None = None

    def pooled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of every filter over the text, and where it is; in bounded chunks."""
        widest = max(WIDTHS)
        padded = np.concatenate([ids, np.zeros((widest, PIECES), np.int32)])
        best = np.full((len(WIDTHS), FILTERS), -np.inf, np.float32)
        where = np.zeros((len(WIDTHS), FILTERS), np.int64)
        n = max(1, len(ids))
        for at in range(0, n, CHUNK):
            end = min(n, at + CHUNK)
            x = sum(self.embed[padded[at : end + widest - 1, j]] for j in range(PIECES))
            for k, w in enumerate(WIDTHS):
                y = sum(x[j : j + end - at] @ self.filters[k][j] for j in range(w)) + self.bias[k]
                top = y.argmax(0)
                value = y[top, np.arange(FILTERS)]
                better = value > best[k]
                best[k][better] = value[better]
                where[k][better] = at + top[better]
        return np.maximum(best, 0), where

    def logit(self, ids: np.ndarray) -> float:
        return float(self.pooled(ids)[0].ravel() @ self.out + self.out_bias)

    def score(self, ids: np.ndarray, language: int) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.logit(ids) - self.shift[language], -30, 30))))


def _seen(texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """How many clean and toxic texts hold each piece."""
    seen = np.zeros((2, HASHES))
    for ids, label in zip(texts, y):
        seen[int(label), np.unique(ids)] += 1
    return seen


def _weights(seen: np.ndarray, share: float, rng: np.random.Generator) -> Model:
    """Random weights; the first embedding axis starts as the log of how often a piece
    occurs in toxic texts against how often it would if it said nothing."""
    odds = np.log((seen[1] + 1) / (seen.sum(0) * share + 1))
    embed = rng.normal(0, 0.1, (HASHES, DIM)).astype(np.float32)
    embed[:, 0] = np.clip(odds, -3, 3)
    embed[0] = 0
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0] += np.linspace(0.2, 1, FILTERS, dtype=np.float32) / len(f)
    return Model(embed, filters, np.zeros((len(WIDTHS), FILTERS), np.float32),
                 np.full(len(WIDTHS) * FILTERS, 0.05, np.float32), -1.0)


def _initial(texts: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> Model:
    return _weights(_seen(texts, y), y.mean(), rng)


def gradients(m: Model, texts: list[np.ndarray], y: np.ndarray) -> tuple:
    """Gradients of the mean log loss: of the embeddings by piece, filters, filter biases, output weights and output bias."""
    widest = max(WIDTHS)
    pieces, parts = [], []
    g_filters = [np.zeros_like(f) for f in m.filters]
    g_bias, g_out, g_ob = np.zeros_like(m.bias), np.zeros_like(m.out), np.zeros(1, np.float32)
    for text, label in zip(texts, y):
        ids = np.concatenate([text, np.zeros((widest, PIECES), np.int32)])
        h, where = m.pooled(text)
        p = 1 / (1 + np.exp(-np.clip(h.ravel() @ m.out + m.out_bias, -30, 30)))
        d = np.float32((p - label) / len(texts))
        g_out += d * h.ravel()
        g_ob += d
        dh = (d * m.out).reshape(h.shape) * (h > 0)
        g_bias += dh
        for k, w in enumerate(WIDTHS):
            for j in range(w):
                at_words = ids[where[k] + j]  # (FILTERS, PIECES)
                x = m.embed[at_words].sum(1)  # (FILTERS, DIM)
                g_filters[k][j] += x.T * dh[k]
                live = np.flatnonzero(dh[k])
                if len(live):
                    pieces.append(at_words[live].ravel())
                    parts.append(np.repeat(m.filters[k][j].T[live] * dh[k][live, None], PIECES, axis=0))
    g_embed: dict[int, np.ndarray] = {}
    if pieces:
        found, at = np.unique(np.concatenate(pieces), return_inverse=True)
        sums = np.zeros((len(found), DIM), parts[0].dtype)
        np.add.at(sums, at, np.concatenate(parts))
        g_embed = {p: g for p, g in zip(found.tolist(), sums) if p}
    return g_embed, g_filters, g_bias, g_out, g_ob


class Learner:
    """A model in training, with the moments of its steps."""

    def __init__(self, m: Model):
        self.m, self.steps = m, 0
        self.out_bias = np.array([m.out_bias], np.float32)
        self.named = {f"f{k}": f for k, f in enumerate(m.filters)} | {"bias": m.bias, "out": m.out, "out_bias": self.out_bias}
        self.moments = {name: (np.zeros_like(v), np.zeros_like(v)) for name, v in self.named.items()}

    def _step(self, name: str, grad: np.ndarray) -> None:
        value, (a, b) = self.named[name], self.moments[name]
        a += 0.1 * (grad - a)
        b += 0.01 * (grad * grad - b)
        value -= RATE * (a / (1 - 0.9**self.steps)) / (np.sqrt(b / (1 - 0.99**self.steps)) + 1e-6)

    def learn(self, texts: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> None:
        """One pass over the texts."""
        m, order = self.m, rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            self.steps += 1
            chosen = order[at : at + BATCH]
            m.out_bias = float(self.out_bias[0])
            g_embed, g_filters, g_bias, g_out, g_ob = gradients(m, [texts[i] for i in chosen], y[chosen])
            for k in range(len(WIDTHS)):
                self._step(f"f{k}", g_filters[k])
            self._step("bias", g_bias)
            self._step("out", g_out + 1e-5 * m.out)
            self._step("out_bias", g_ob)
            if g_embed:
                words = np.fromiter(g_embed, np.int64)
                m.embed[words] -= 0.5 * np.stack(list(g_embed.values()))
        m.out_bias = float(self.out_bias[0])

    def _arrays(self) -> list[np.ndarray]:
        return [self.m.embed, *self.named.values(), *[x for pair in self.moments.values() for x in pair]]

    def packed(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self._arrays()] + [np.array([self.steps], np.float32)])

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for a in self._arrays():
            a[...] = flat[at : at + a.size].reshape(a.shape)
            at += a.size
        self.steps = round(float(flat[at]))
        self.m.out_bias = float(self.out_bias[0])


def _train(texts: list[np.ndarray], y: np.ndarray, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    learner = Learner(_initial(texts, y, rng))
    for _ in range(EPOCHS):
        learner.learn(texts, y, rng)
    return learner.m


def _threshold(logits: np.ndarray, rows: np.ndarray, toxic: np.ndarray) -> float:
    """The cut with the largest F1, in the middle of its gap; ``rows`` and ``toxic`` count what a logit has."""
    order = np.argsort(-logits, kind="stable")
    s, n, hits = logits[order], np.cumsum(rows[order]), np.cumsum(toxic[order])
    f1 = 2 * hits / (n + toxic.sum())
    cuts = np.flatnonzero(np.append(s[1:] < s[:-1], True))
    best = cuts[f1[cuts].argmax()]
    return float((s[best] + s[best + 1]) / 2) if best + 1 < len(s) else float(s[best] - 1)


# --- shards -----------------------------------------------------------------
@F.pandas_udf(T.BinaryType())
def _encoded(text: pd.Series) -> pd.Series:
    words = Words()
    return pd.Series([words.ids(t).astype(np.uint16).tobytes() for t in text], dtype=object)


_SHARD = "shard long, label binary, length binary, ids binary"


def _shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of a shard, in the order of their hashes, as one row of arrays."""
    pdf = pdf.sort_values(["crc", "doc_id"])
    return pd.DataFrame({
        "shard": [key[0]], "label": [pdf["label"].to_numpy(np.float32).tobytes()],
        "length": [pdf["ids"].str.len().to_numpy(np.int64).tobytes()], "ids": [b"".join(pdf["ids"])]})


def _opened(batches, keep: bool):
    """Number, texts and labels of each shard, and which rows are kept for the thresholds; nothing is copied."""
    for batch in batches:
        for shard, label, length, ids in zip(*(batch.column(c) for c in ("shard", "label", "length", "ids"))):
            ends = np.cumsum(np.frombuffer(length.as_buffer(), np.int64) // (2 * PIECES))[:-1]
            pieces = np.frombuffer(ids.as_buffer(), np.uint16).reshape(-1, PIECES)
            y = np.frombuffer(label.as_buffer(), np.float32)
            yield shard.as_py(), np.split(pieces, ends), y, (np.arange(len(y)) % CALIBRATION == 0) & keep


def _chosen(texts: list[np.ndarray], mask: np.ndarray) -> list[np.ndarray]:
    return [t for t, k in zip(texts, mask) if k]


_PART = "shard long, block long, part binary"


def _blocks(shard: int, values: np.ndarray) -> pa.RecordBatch:
    parts = [p.tobytes() for p in np.array_split(values.astype(np.float64), BLOCKS)]
    return pa.RecordBatch.from_pydict({
        "shard": pa.array([shard] * BLOCKS, pa.int64()), "block": pa.array(range(BLOCKS), pa.int64()), "part": pa.array(parts, pa.binary())})


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = 0.0
    for part in pdf.sort_values("shard")["part"]:
        total = total + np.frombuffer(part)
    return pdf.head(1)[["shard", "block"]].assign(part=[total.tobytes()])


def _added(shards: DataFrame, values) -> np.ndarray:
    """The sum over all shards of ``values(shard, texts, y, kept)``, added up in blocks; one vector reaches the driver."""
    def each(batches):
        for shard, texts, y, kept in _opened(batches, True):
            yield _blocks(shard, values(shard, texts, y, kept))

    parts = shards.mapInArrow(each, _PART).groupBy("block").applyInPandas(_add, _PART).collect()
    return np.concatenate([np.frombuffer(r["part"]) for r in sorted(parts, key=lambda r: r["block"])])


def _train_shards(shards: DataFrame, n: int, toxic: int, keep: bool, passes: int, seed: int) -> Model:
    """Passes over all shards at once; each starts from the average of the models of the last one."""
    learner = Learner(_weights(_added(shards, lambda _, texts, y, kept: _seen(
        _chosen(texts, ~(kept & keep)), y[~(kept & keep)]).ravel()).reshape(2, HASHES), toxic / n, np.random.default_rng(seed)))
    for i in range(passes):
        flat = learner.packed()

        def learnt(shard, texts, y, kept):
            own = Learner(Model(np.zeros((HASHES, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS],
                                np.zeros((len(WIDTHS), FILTERS), np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), 0.0))
            own.unpack(flat)
            use = ~(kept & keep)
            own.learn(_chosen(texts, use), y[use], np.random.default_rng([seed, i, shard]))
            return own.packed() * (use.sum() / n)

        learner.unpack(_added(shards, learnt))
    return learner.m


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, seed: int = SEED) -> Model:
    """Learn from every row of ``labels (doc_id, label)`` whose document is in ``docs``, about ``rows`` in a shard.

    Of texts that share a doc_id the first in order is learnt, of its labels the majority.
    """
    labels = labels.filter("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        (F.avg(F.col("label").cast("double")) >= 0.5).cast("int").alias("label"))
    # Only documents that may have a label are dealt out; the join on the id is exact.
    key = F.col("doc_id").cast("string").alias("_key")
    near = maybe_in(docs.select("doc_id", "text", key), bloom_filter(labels.select(key), "_key"), "_key").select("doc_id", "text")
    found = near.join(labels, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    rows_ = land(found.select(
        "doc_id", "label", F.crc32(F.col("doc_id").cast("string")).alias("crc"), _encoded("text").alias("ids")), "toxicity")
    n, toxic = rows_.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    empty = Model(np.zeros((HASHES, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS],
                  np.zeros((len(WIDTHS), FILTERS), np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), 0.0)
    if toxic in (0, n):
        empty.constant = toxic / n if n else 0.0
        drop(rows_)
        return empty
    count = max(1, -(-n // rows))
    dealt = rows_.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(count)))
    shards = land(dealt.repartition(4 * count if count > 1 else 1, "shard").groupBy("shard").applyInPandas(_shard, _SHARD), "toxicity-shards")
    drop(rows_)
    used, hits = _added(shards, lambda _, texts, y, kept: np.array([(~kept).sum(), y[~kept].sum()] + [0] * BLOCKS))[:2]
    keep = 0 < hits < used
    if not keep:
        used, hits = n, toxic
    if count == 1:
        def whole(_, texts, y, kept):
            m = _train(_chosen(texts, ~(kept & keep)), y[~(kept & keep)], seed)
            return Learner(m).packed()

        learner = Learner(empty)
        learner.unpack(_added(shards, whole))
        model = learner.m
    else:
        model = _train_shards(shards, int(used), int(hits), keep, max(PASSES, -(-EPOCHS * rows // n)), seed)
    if keep:
        _calibrate(model, shards, count > 1)
    drop(shards)
    return model


def _calibrate(model: Model, shards: DataFrame, rounded: bool) -> None:
    """Thresholds from the logits of all kept rows, counted by value."""
    def each(batches):
        words = Words()
        for _, texts, y, kept in _opened(batches, True):
            own = _chosen(texts, kept)
            yield pa.RecordBatch.from_pydict({
                "language": pa.array([words.language(t) for t in own], pa.int32()),
                "logit": pa.array([model.logit(t) for t in own], pa.float64()), "label": pa.array(y[kept].astype(np.int32))})

    value = F.round(F.col("logit") * STEPS) / STEPS if rounded else F.col("logit")
    bins = shards.mapInArrow(each, "language int, logit double, label int").groupBy(
        "language", value.alias("logit")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).orderBy(
        "language", "logit").collect()
    language, logits, n, toxic = (np.array([r[i] for r in bins]) for i in range(4))
    if not 0 < toxic.sum() < n.sum():
        return
    model.shift[:] = _threshold(logits, n, toxic)
    for i in range(len(_LANGUAGES)):
        own = language == i
        if min(toxic[own].sum(), (n - toxic)[own].sum()) >= LEAST:
            model.shift[i] = _threshold(logits[own], n[own], toxic[own])


def scorer(model: Model):
    """A column function: text -> calibrated probability of being toxic."""

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series) -> pd.Series:
        words = Words()
        out = []
        for t in text:
            ids = words.ids(t)
            out.append(model.score(ids, words.language(ids)))
        return pd.Series(out, dtype=float)

    return score
