"""Near-dedup by improved consistent weighted sampling over TF-IDF shingles.

A document is a weighted set of five-word shingles: the weight of a shingle is its
count times the mean inverse document frequency of its words. Word frequencies are
counted over all documents, in a fixed number of hash buckets, so the table that
travels with the job has a fixed size.

Improved consistent weighted sampling draws ``BANDS * ROWS`` samples per document; two
documents agree in a sample with the probability of their weighted Jaccard similarity.
Documents that agree in all samples of a band meet in a bucket. Equal texts are
collapsed before. In a bucket each document is first compared with one leader, and links
found so far are closed into groups; then the documents outside the bucket's largest
group are compared with those of other groups. No pair is a row anywhere: the documents of a
bucket are cut into blocks, and a unit of work compares two blocks (or a leader with a
block) inside one task, first by signatures; only documents with a likely partner are
fetched as texts, and only a spanning forest of the links leaves the task. A pair is
compared in the first band it shares. Every link is verified by the exact weighted Jaccard
similarity of the whole texts.

Defined results
- null text: empty. Texts without words are near no other text; equal ones are one group.
- a text of one to four words is one shingle.
- texts that differ in white space only have similarity 1.
- a null doc_id comes after all ids; rows of one id with different texts are compared
  like any others. ``representative`` is the smallest doc_id of a group (null if none
  has an id) and ``kept`` marks its row: the smallest (doc_id, text hash, source hash).
  Rows that repeat it in all three are marked, too; ``keep_one`` keeps one of them.
- an empty table gives an empty result; extra columns stay untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import split_join
from .common import NO_ID, components, drop, land, order_id

SEED = 29
SIMILARITY = 0.8
WORDS = 5
BANDS = 20
ROWS = 5
BUCKETS = 1 << 16  # document frequency counters
TABLE = 1 << 14  # random draws per sample, addressed by shingle hash
CHUNK = 1 << 15  # shingles sampled at once
BATCH = 1 << 19  # characters of texts shingled at once
SLICE = 1 << 22  # bytes whose words are hashed at once
PARTS = 64
FILTER_BITS = 25  # bit table that selects the texts to be compared: 4 MB
BLOCK = 256  # documents of a block
BLOCK_SHINGLES = 1 << 19  # and their shingles, on average
CELLS = 1 << 22  # entries of a matrix of texts and shingles
FEW = 8  # pairs of a unit that are compared one by one
# Two documents at the similarity wanted agree in that share of all samples, give or
# take 4 %; a pair this far below it is not compared any further.
LEAST_AGREEING = int(BANDS * ROWS * (SIMILARITY - 0.25))

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """Texts -> distinct shingle hashes and weights.

    A word's hash is the sum of one random 64-bit number per byte times the powers of an odd
    number, modulo 2 ** 64: differences of prefix sums, so all words are hashed at once.
    """

    def __init__(self, idf: np.ndarray | None = None):
        self.idf = idf
        rng = np.random.default_rng(SEED)
        self.byte = rng.integers(0, 1 << 64, 256, np.uint64)
        self.base = np.uint64(int(rng.integers(1 << 61, 1 << 62)) * 4 + 3)
        self.back = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            for name, base in (("powers", self.base), ("inverse", self.back)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def _hash(self, data: np.ndarray) -> np.ndarray:
        """Hashes of the words of ``data`` (uint8), which are parted by single blanks."""
        self._grow(len(data))
        gaps = np.flatnonzero(data == 32)
        starts, ends = np.append(0, gaps + 1), np.append(gaps, len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.byte[data] * self.powers[: len(data)])])
        return _mix(_mix((sums[ends] - sums[starts]) * self.inverse[starts]))

    def words(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of all words of the texts, and the number of words of each."""
        plain = [" ".join((t or "").split()) for t in texts]
        counts = np.array([p.count(" ") + 1 if p else 0 for p in plain], np.int64)
        raw = " ".join(p for p in plain if p).encode("utf-8", "replace")
        out, at = [], 0
        while at < len(raw):
            end = raw.find(b" ", at + SLICE)
            end = len(raw) if end < 0 else end
            out.append(self._hash(np.frombuffer(raw[at:end], np.uint8)))
            at = end + 1
        return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingle hashes, ascending inside each text, their weights, and the texts they belong to."""
        h, counts = self.words(texts)
        if not len(h):
            return h, np.zeros(0), np.zeros(0, np.int64)
        idf = self.idf[(h >> np.uint64(48)).astype(np.int64)]
        doc = np.repeat(np.arange(len(texts)), counts)
        m = max(0, len(h) - WORDS + 1)
        inside = doc[:m] == doc[len(h) - m :]
        s, w = np.zeros(m, np.uint64), np.zeros(m)
        for j in range(WORDS if m else 0):
            s = _mix(s * np.uint64(31) + h[j : j + m])
            w += idf[j : j + m]
        s, w, own = s[inside], w[inside] / WORDS, doc[:m][inside]
        ends = np.cumsum(counts)
        for i in np.flatnonzero((counts > 0) & (counts < WORDS)).tolist():  # a short text is one shingle
            key = np.zeros(1, np.uint64)
            for j in range(int(ends[i] - counts[i]), int(ends[i])):
                key = _mix(key * np.uint64(31) + h[j])
            s, own = np.append(s, key), np.append(own, i)
            w = np.append(w, idf[ends[i] - counts[i] : ends[i]].mean())
        order = np.lexsort((s, own))
        s, w, own = s[order], w[order], own[order]
        first = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (own[1:] != own[:-1])))
        return s[first], w[first] * np.diff(np.append(first, len(s))), own[first]

    def sets(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The shingle hashes and weights (count times mean idf) of each text."""
        hashes, weights, own = self.batch(texts)
        cuts = np.searchsorted(own, np.arange(1, len(texts)))
        return list(zip(np.split(hashes, cuts), np.split(weights, cuts)))

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return self.sets([text])[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity; 1 for two empty sets."""
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64))
    if total == 0:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    return both / (total - both)


def similarities(one: list[tuple], two: list[tuple]) -> np.ndarray:
    """Weighted Jaccard similarity of every set of ``one`` with every set of ``two``.

    The smaller of two weights is the sum of the steps between a shingle's weights that
    both reach, so sums of minima are one matrix product over (shingle, step).
    """
    sets = one + two
    hashes = np.concatenate([x[0] for x in sets])
    weights = np.concatenate([x[1] for x in sets]).astype(float)
    own = np.repeat(np.arange(len(sets)), [len(x[0]) for x in sets])
    total = np.bincount(own, weights, len(sets))
    order = np.lexsort((weights, hashes))
    hashes, weights, own = hashes[order], weights[order], own[order]
    fresh = np.append(True, hashes[1:] != hashes[:-1])
    group = np.cumsum(fresh) - 1
    shared = np.bincount(group)[group] > 1
    hashes, weights, own, fresh, group = hashes[shared], weights[shared], own[shared], fresh[shared], group[shared]
    level = np.append(True, (group[1:] != group[:-1]) | (weights[1:] != weights[:-1]))[: len(group)]
    at = np.cumsum(level) - 1  # column of each (shingle, step)
    below = np.where(fresh[level], 0, np.append(0, weights[level][:-1]))
    step = weights[level] - below
    first = np.maximum.accumulate(np.where(fresh, at, 0)) if len(at) else at
    n = at - first + 1  # an entry reaches its own step and all lower ones of its shingle
    cells = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    rows = np.repeat(own, n)
    order = np.argsort(cells, kind="stable")
    rows, cells = rows[order], cells[order]
    both, width = np.zeros((len(one), len(two))), max(1, CELLS // len(sets))
    for low in range(0, len(step), width):  # some columns at a time
        a, b = np.searchsorted(cells, (low, low + width))
        matrix = np.zeros((len(sets), min(width, len(step) - low)))
        matrix[rows[a:b], cells[a:b] - low] = 1
        both += (matrix[: len(one)] * step[low : low + width]) @ matrix[len(one) :].T
    return both / np.maximum(total[: len(one), None] + total[None, len(one) :] - both, 1e-300)


class Sampler:
    """Consistent weighted samples: r, c ~ Gamma(2, 1) and beta ~ U(0, 1) per sample and shingle."""

    def __init__(self, samples: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        shape = (samples, TABLE)
        self.r = rng.gamma(2, 1, shape).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, shape)).astype(np.float32)
        self.beta = rng.random(shape).astype(np.float32)
        self.steps = (rng.integers(1, 1 << 62, samples) * 2 + 1).astype(np.uint64)

    def signatures(self, hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """uint32 (documents, samples) of the documents whose shingles begin at ``starts``."""
        log_w = np.log(weights).astype(np.float32)
        out = np.zeros((len(starts), len(self.steps)), np.uint32)
        lengths = np.diff(np.append(starts, len(hashes)))
        shift = np.uint64(64 - (TABLE.bit_length() - 1))
        for k, step in enumerate(self.steps):
            at = ((hashes * step) >> shift).astype(np.int32)
            r = self.r[k].take(at)
            t = np.floor(log_w / r + self.beta[k].take(at))
            rank = self.log_c[k].take(at) - r * (t - self.beta[k].take(at) + 1)
            least = np.minimum.reduceat(rank, starts)
            hit = np.flatnonzero(rank == np.repeat(least, lengths))
            doc = np.searchsorted(starts, hit, side="right") - 1
            hit = hit[np.append(True, doc[1:] != doc[:-1])]  # ties: the smallest shingle hash
            picked = _mix(hashes[hit] + t[hit].astype(np.int64).astype(np.uint64) * _MIX)
            out[:, k] = (picked >> np.uint64(32)).astype(np.uint32)
        return out


def _text_batches(texts: Iterable[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about ``BATCH`` characters, with the place of their first one."""
    held: list[str | None] = []
    size = begin = 0
    for i, text in enumerate(texts):
        held.append(text)
        size += len(text or "")
        if size >= BATCH or len(held) >= 4096:
            yield begin, held
            held, size, begin = [], 0, i + 1
    if held:
        yield begin, held


def word_frequencies(texts: DataFrame) -> np.ndarray:
    """Number of documents in which a word of each bucket occurs, over all rows of ``texts (text)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, total = Shingles(), np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for _, held in _text_batches(t.as_py() for t in batch.column(0)):
                h, counts = shingles.words(held)
                doc = np.repeat(np.arange(len(held)), counts)
                seen = np.unique(doc * BUCKETS + (h >> np.uint64(48)).astype(np.int64)) % BUCKETS
                total += np.bincount(seen, minlength=BUCKETS + 1)
                total[BUCKETS] += len(held)
        parts = np.array_split(total, PARTS)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(range(PARTS), pa.int32()), "counts": pa.array([p.tobytes() for p in parts], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.int64) for x in pdf["counts"]], axis=0)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "counts": [total.tobytes()]})

    kind = "part int, counts binary"
    parts = texts.select("text").mapInArrow(count, kind)
    # Sums of sums: a part of the counters never meets more than the square root of all tasks at once.
    parts = parts.groupBy("part", (F.spark_partition_id() % PARTS).alias("some")).applyInPandas(add, kind)
    sums = {r["part"]: r["counts"] for r in parts.groupBy("part").applyInPandas(add, kind).collect()}
    if not sums:
        return np.zeros(BUCKETS + 1, np.int64)
    return np.concatenate([np.frombuffer(sums[i], np.int64) for i in range(PARTS)])


def inverse_frequency(counts: np.ndarray) -> np.ndarray:
    """Smoothed idf per bucket, at least 1."""
    return (np.log((1.0 + counts[-1]) / (1.0 + counts[:-1])) + 1).astype(np.float64)


SIGNED = "h1 long, h2 long, sig binary, shingles long"


def _signatures(idf: np.ndarray, sampler: Sampler):
    """Rows (h1, h2, text) -> signature and number of distinct shingles; texts without words give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(idf)
        for batch in batches:
            for begin, held in _text_batches(t.as_py() for t in batch.column(2)):
                hashes, weights, own = shingles.batch(held)
                if not len(hashes):
                    continue
                starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                sizes = np.diff(np.append(starts, len(hashes)))
                sig = np.empty((len(starts), BANDS * ROWS), np.uint32)
                low = 0
                while low < len(starts):  # some texts at a time, at least one
                    high = max(low + 1, int(np.searchsorted(starts, starts[low] + CHUNK)))
                    a, b = starts[low], starts[high] if high < len(starts) else len(hashes)
                    sig[low:high] = sampler.signatures(hashes[a:b], weights[a:b], starts[low:high] - a)
                    low = high
                rows = pa.array(begin + own[starts])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array([r.tobytes() for r in sig], pa.binary()),
                     pa.array(sizes.astype(np.int64))], names=["h1", "h2", "sig", "shingles"])

    return run


def _matrix(sig: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sig), np.uint32).reshape(-1, BANDS * ROWS)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the samples of each band, and of the band."""
    bands = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(_mix(np.arange(1, BANDS + 1).astype(np.uint64) * _MIX), (len(sig), BANDS))
    for k in range(ROWS):
        key = _mix(_mix(key * np.uint64(31) + bands[:, :, k] + _MIX))
    return key


@F.pandas_udf(T.ArrayType(T.LongType()))
def _bands(sig: pd.Series) -> pd.Series:
    return pd.Series(list(band_keys(_matrix(sig)).view(np.int64)), dtype=object)


@F.pandas_udf(T.LongType())
def _filter_bit(h1: pd.Series) -> pd.Series:
    return pd.Series(_mix(h1.to_numpy(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype("int64")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rep, text`` of the texts in ``wanted (rep, h1, h2)``, one row per distinct text.

    A bit table of fixed size spares the other texts the shuffle. Texts that pass it by
    chance do no harm.
    """
    bit = F.col("p") + 1  # the bitmap functions count from 1
    rows = wanted.select(_filter_bit("h1").alias("p")).groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    table = np.zeros((1 << FILTER_BITS) // 8 + 4096, np.uint8)
    for r in rows:  # at most 2 ** FILTER_BITS / 32768 rows of 4 KB
        table[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], np.uint8)

    @F.pandas_udf(T.BooleanType())
    def likely(p: pd.Series) -> pd.Series:
        at = p.to_numpy(np.int64)
        return pd.Series((table[at >> 3] >> (at & 7) & 1).astype(bool))

    found = docs.withColumn("p", _filter_bit("h1")).filter(likely("p")).drop("p")
    return found.join(wanted, ["h1", "h2"]).groupBy("rep").agg(F.any_value("text").alias("text"))


class _Unit:
    """Two blocks of documents whose pairs are compared: rows of side 0 with rows of side 1, or among themselves."""

    def __init__(self, sides: np.ndarray, band: int, rep: np.ndarray, group: np.ndarray, sig: np.ndarray):
        self.left = np.flatnonzero(sides == 0)
        self.right = np.flatnonzero(sides == 1)
        self.alone = not len(self.right)
        if self.alone:
            self.right = self.left
        self.band, self.rep, self.group, self.sig = band, rep, group, sig

    def likely(self) -> np.ndarray:
        """Pairs (places in left, places in right) of different groups that agree often enough and share no earlier band."""
        a, b = self.sig[self.left], self.sig[self.right]
        agree = np.zeros((len(a), len(b)), np.uint8)
        met = np.zeros((len(a), len(b)), bool)
        for k in range(BANDS):
            alike = np.ones((len(a), len(b)), bool)
            for c in range(k * ROWS, (k + 1) * ROWS):
                same = a[:, c][:, None] == b[:, c][None, :]
                agree += same
                alike &= same
            if k < self.band:
                met |= alike
        hit = (agree >= LEAST_AGREEING) & ~met & (self.group[self.left][:, None] != self.group[self.right][None, :])
        if self.alone:
            hit &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
        return hit


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Unit, pa.Table]]:
    """The units of rows sorted by ``u``: (u, side, band, rep, grp, sig, ...)."""
    held: list[pa.RecordBatch] = []

    def close() -> tuple[_Unit, pa.Table]:
        rows = pa.Table.from_batches(held)
        held.clear()
        column = {c: rows.column(c).to_numpy() for c in ("side", "band", "rep", "grp")}
        sig = _matrix(rows.column("sig").to_pylist())
        return _Unit(column["side"], int(column["band"][0]), column["rep"], column["grp"], sig), rows

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        u = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(u)) + 1).tolist(), len(u)]
        for x, y in zip(cuts, cuts[1:]):
            if held and u[x] != last:
                yield close()
            last = u[x]
            held.append(batch.slice(x, y - x))
    if held:
        yield close()


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``u, rep`` of the documents of each unit that have a likely partner in it."""
    for unit, rows in _units(batches):
        hit = unit.likely()
        places = np.union1d(unit.left[hit.any(1)], unit.right[hit.any(0)])
        if len(places):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(places), rows.column("u")[0].as_py())), pa.array(unit.rep[places])], names=["u", "rep"])


def _forest(idf: np.ndarray, similarity: float):
    """Rows of units with texts -> ``a, b``: a spanning forest of the links between groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(idf)
        for unit, rows in _units(batches):
            hit = unit.likely()
            if not hit.any():
                continue
            sets = shingles.sets(rows.column("text").to_pylist())
            one, two = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
            pairs = np.argwhere(hit)
            if len(pairs) > FEW:
                known = similarities([sets[i] for i in unit.left[one]], [sets[i] for i in unit.right[two]])
                value = known[np.searchsorted(one, pairs[:, 0]), np.searchsorted(two, pairs[:, 1])]
                unsure = np.abs(value - similarity) < 1e-9  # sums in another order
                pairs = pairs[(value >= similarity) | unsure]
                unsure = unsure[(value >= similarity) | unsure]
            else:
                unsure = np.ones(len(pairs), bool)
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            links = []
            for (i, j), check in zip(pairs.tolist(), unsure.tolist()):
                x, y = int(unit.left[i]), int(unit.right[j])
                p, q = find(int(unit.group[x])), find(int(unit.group[y]))
                if p != q and (not check or jaccard(sets[x], sets[y]) >= similarity):
                    root[p] = q
                    links.append((unit.rep[x], unit.rep[y]))
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    return run


def _verified(units: DataFrame, signed: DataFrame, docs: DataFrame, idf: np.ndarray, similarity: float, label: str) -> DataFrame:
    """``a, b``: links between the groups of ``units (u, side, band, rep, grp)``.

    Signatures decide which documents of a unit are worth their texts; these come once per
    document and unit, never once per pair.
    """
    order = ["u", "side", "band", "rep", "grp"]
    full = land(units.join(signed.select("rep", "sig"), "rep").select(*order, "sig"), f"{label}-units")
    dealt = full.repartition("u").sortWithinPartitions("u", "side", "rep")
    likely = land(dealt.mapInArrow(_likely, "u long, rep long"), f"{label}-likely")
    wanted = likely.select("rep").distinct().join(signed.select("rep", "h1", "h2"), "rep")
    texts = land(_texts_of(docs, wanted), f"{label}-texts")
    rows = full.join(likely.distinct(), ["u", "rep"]).join(texts, "rep").select(*order, "sig", "text")
    rows = rows.repartition("u").sortWithinPartitions("u", "side", "rep")
    links = land(rows.mapInArrow(_forest(idf, similarity), "a long, b long").distinct(), f"{label}-links")
    drop(full, likely, texts)
    return links


def near_duplicate_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``h1, h2, rep, component``: the group of every distinct text that has words and shares a bucket."""
    h1, h2 = text_hashes()
    texts = docs.select(h1.alias("h1"), h2.alias("h2"), F.coalesce("text", F.lit("")).alias("text"))
    idf = inverse_frequency(word_frequencies(texts))
    # Equal texts have equal signatures and are one row from here on, under a number of their own.
    sampler = Sampler(BANDS * ROWS)
    signed = texts.mapInArrow(_signatures(idf, sampler), SIGNED).groupBy("h1", "h2").agg(
        F.any_value("sig").alias("sig"), F.any_value("shingles").alias("shingles"))
    signed = land(signed.withColumn("rep", F.monotonically_increasing_id()), "icws-signatures")
    member = land(signed.select("rep", F.posexplode(_bands("sig")).alias("band", "bucket")), "icws-buckets")
    leaders = member.groupBy("bucket").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = land(member.join(leaders, "bucket").select("bucket", "band", "rep", "a"), "icws-shared")

    # First every document with the leaders of its buckets, in blocks of a leader's documents.
    landed_stars = land(shared.filter("rep != a").select("a", "rep").distinct().join(
        signed.select("rep", "shingles"), "rep"), "icws-stars")
    blocks = landed_stars.groupBy("a").agg(_blocks("n"))
    stars = landed_stars.join(blocks, "a").withColumn("u", F.xxhash64("a", F.pmod(F.xxhash64("rep"), F.col("n"))))
    first = stars.select("u", F.lit(1).alias("side"), F.lit(0).alias("band"), "rep", F.col("rep").alias("grp")).unionByName(
        stars.select("u", F.lit(0).alias("side"), F.lit(0).alias("band"), F.col("a").alias("rep"), F.col("a").alias("grp")).distinct())
    links = _verified(first, signed, texts, idf, similarity, "icws-first")
    groups = components(links, "icws-first").withColumnRenamed("node", "rep")

    # Then the documents outside a bucket's largest group with those of its other groups.
    split = land(shared.join(groups, "rep", "left").join(signed.select("rep", "shingles"), "rep").select(
        "bucket", "band", "rep", F.coalesce("component", "rep").alias("grp"), "shingles"), "icws-split")
    sizes = split.groupBy("bucket", "grp").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("bucket").agg(
        F.max(F.struct("n", "grp")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))
    # Two documents in two groups are a leader and one compared with it.
    largest = largest.filter("groups > 1 AND n > 2").select("bucket", F.col("top.grp").alias("main"))
    mixed = land(split.join(largest, "bucket").withColumn("outer", F.col("grp") != F.col("main")).drop("main"), "icws-mixed")
    counts = mixed.groupBy("bucket").agg(
        _blocks("no", F.col("outer")), _blocks("nm", ~F.col("outer")))
    placed = split_join(mixed, counts, "bucket", "inner").withColumn("x", F.when(
        F.col("outer"), F.pmod(F.xxhash64("rep"), F.col("no"))).otherwise(F.col("no") + F.pmod(F.xxhash64("rep"), F.col("nm"))))
    others = F.when(F.col("outer"), F.sequence(F.lit(0).cast("long"), F.col("no") + F.col("nm") - 1)).otherwise(
        F.sequence(F.lit(0).cast("long"), F.col("no") - 1))
    units = placed.withColumn("y", F.explode(others)).select(
        F.xxhash64("bucket", F.least("x", "y"), F.greatest("x", "y")).alias("u"),
        F.when(F.col("x") > F.col("y"), 1).otherwise(0).alias("side"), "band", "rep", "grp")
    more = _verified(units, signed, texts, idf, similarity, "icws-second")
    groups = components(links.unionByName(more), "icws-second").withColumnRenamed("node", "rep")
    drop(member, shared, landed_stars, split, mixed, links, more)
    return signed.select("rep", "h1", "h2").join(groups, "rep").select("h1", "h2", "rep", "component")


def _blocks(name: str, which: Column | None = None) -> Column:
    """Blocks of the rows (of those in ``which``), by their number and their shingles."""
    which = F.lit(True) if which is None else which
    rows, shingles = F.count_if(which), F.sum(F.when(which, F.col("shingles")).otherwise(0))
    return F.greatest(F.lit(1), F.ceil(rows / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("long").alias(name)


def text_hashes() -> tuple[Column, Column]:
    """Two 64-bit hashes: texts are equal if both are."""
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def mark(docs: DataFrame, columns: list[str] | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """``row`` (the given columns of a document, or all) with ``representative``, ``kept`` and ``best``.

    ``best`` is the rank of the group's kept row and names the group.
    """
    groups = near_duplicate_groups(docs, similarity)
    extra = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    h1, h2 = text_hashes()
    keyed = docs.select(
        F.struct(*(columns or docs.columns)).alias("row"), h1.alias("h1"), h2.alias("h2"),
        F.struct(order_id().alias("id"), h1.alias("text"), h2.alias("text2"), F.xxhash64(extra).alias("source")).alias("rank"))
    least = keyed.groupBy("h1", "h2").agg(F.min("rank").alias("rank"))
    # A text without near copies is a group of its own.
    least = land(least.join(groups, ["h1", "h2"], "left").select("h1", "h2", "rank", "component"), "icws-ranks")
    grouped, alone = least.filter("component IS NOT NULL"), least.filter("component IS NULL")
    best = grouped.groupBy("component").agg(F.min("rank").alias("best"))
    named = land(split_join(grouped, best, "component", "inner").select("h1", "h2", "best").unionByName(
        alone.select("h1", "h2", F.col("rank").alias("best"))), "icws-named")
    return keyed.join(named, ["h1", "h2"]).select(
        "row", F.when(F.col("best.id") != NO_ID, F.col("best.id")).alias("representative"),
        (F.col("rank") == F.col("best")).alias("kept"), "best")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near duplicates, repeated rows included."""
    left = mark(docs, similarity=similarity).filter("kept").dropDuplicates(["best"])
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
