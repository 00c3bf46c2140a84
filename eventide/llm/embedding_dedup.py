"""Embedding near-dedup with an inverted multi-index.

Unit vectors are cut in halves; each half has its own small codebook (k-means on a
bounded sample), and the product of both is a grid of cells. Every vector lies in the
cell of its two nearest codewords. A vector visits cells in the order of a lower bound
of its distance to anything inside them (multi-sequence traversal of two sorted lists),
until the cells visited hold the target share of its neighbours. With the default
target of 1 it stops where the bound passes the link radius, so no link is lost. Pairs
that meet in a cell are verified by their cosine in double precision.

Only counts and a spanning forest leave a cell, never its pairs. Cells with many
vectors are cut into blocks, and each pair of blocks is a task of its own.

Defined results
- vectors that are null, empty, zero or hold null or non-finite components, and rows
  with a null label or null id, link with nothing and are kept.
- vectors of different length link with nothing. Repeated rows are vectors of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, land

SEED = 5
COSINE = 0.98
SAMPLE_VALUES = 2_000_000  # numbers in the codebooks' sample
SAMPLE_ROWS = 20_000
CELL_ROWS = 4096  # rows of one label that a cell should hold: visits cost more than comparisons
MAX_CODES = 1024
BLOCK = 1024  # rows of a cell that are compared at once
SLACK = 1e-9
CLOSE = 1e-6  # codewords nearer to each other are one


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _squares(x, centres).argmin(1)
        for c in range(len(centres)):
            own = x[near == c]
            if len(own):
                centres[c] = own.mean(0)
    return _apart(np.unique(centres, axis=0))


def _apart(centres: np.ndarray) -> np.ndarray:
    """Without those that lie within ``CLOSE`` of an earlier one: the bound divides by their distance."""
    kept: list[int] = []
    for i, c in enumerate(centres):
        if not kept or ((centres[kept] - c) ** 2).sum(1).min() > CLOSE**2:
            kept.append(i)
    return centres[kept]


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


class Grid:
    """Two codebooks and the traversal of their product."""

    def __init__(self, left: np.ndarray, right: np.ndarray, radius: float):
        self.books, self.radius = (left, right), radius
        # Differences, not products: a small distance must not cancel out.
        self.gaps = [np.stack([np.sqrt(((c - x) ** 2).sum(1)) for x in c]) for c in self.books]

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Home cell of each row, and per half the squared least distance to every codeword's region.

        A point of region u is at least (d_u^2 - d_near^2) / (2 |c_u - c_near|) away: its
        side of the plane midway between both codewords.
        """
        homes, lower = [], []
        cut = self.books[0].shape[1]
        for half, book, gap in zip((x[:, :cut], x[:, cut:]), self.books, self.gaps):
            d = _squares(half, book)
            near = d.argmin(1)
            away = (d - d[np.arange(len(x)), near][:, None]) / np.maximum(2 * gap[near], 1e-12)
            away[np.arange(len(x)), near] = 0
            homes.append(near)
            lower.append(np.maximum(away, 0) ** 2)
        return homes[0] * len(self.books[1]) + homes[1], lower

    def visits(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[float, int]]:
        """(bound, cell) in rising order of the bound, up to the radius."""
        a, b = left.argsort(), right.argsort()
        heap, width = [(left[a[0]] + right[b[0]], 0, 0)], len(right)
        while heap:
            bound, i, j = heapq.heappop(heap)
            if bound > self.radius:
                return
            yield bound, int(a[i]) * width + int(b[j])
            if j + 1 < len(b):
                heapq.heappush(heap, (left[a[i]] + right[b[j + 1]], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (left[a[i + 1]] + right[b[0]], i + 1, 0))


def unit(values: list, dim: int) -> np.ndarray:
    out = np.zeros((len(values), dim))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    top = np.abs(out).max(1, keepdims=True)
    out /= np.where(top > 0, top, 1)  # very large and very small numbers keep their direction
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def fit(reps: DataFrame, dim: int, n: int, cosine: float, target_recall: float, seed: int = SEED) -> Grid:
    """Codebooks from a bounded sample drawn by hash; the number of codewords follows the row count ``n`` of the largest label.

    A vector visits the more cells the finer they are, and a visit costs a copy in a shuffle,
    a comparison only part of a matrix product; hence few, large cells.
    """
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // max(1, dim)))
    drawn = reps.select("embedding").orderBy(F.xxhash64(F.lit(seed), "embedding")).limit(rows).collect()
    x = unit([r["embedding"] for r in drawn], dim)
    k = int(min(MAX_CODES, max(2, np.ceil(np.sqrt(n / CELL_ROWS)))))
    rng = np.random.default_rng(seed)
    cut = max(1, dim // 2)
    right = x[:, cut:] if dim > 1 else np.zeros((len(x), 1))
    radius = 2 - 2 * cosine + SLACK
    grid = Grid(_kmeans(x[:, :cut], k, rng), _kmeans(right, k, rng), radius)
    if target_recall < 1:
        x = x if dim > 1 else np.column_stack([x, np.zeros(len(x))])
        home, lower = grid.bounds(x)
        found = []
        for at in range(0, len(x), BLOCK):
            for i, j in zip(*np.nonzero(x[at : at + BLOCK] @ x.T >= cosine)):
                if at + i != j:
                    u, v = divmod(int(home[j]), len(grid.books[1]))
                    found.append(lower[0][at + i, u] + lower[1][at + i, v])
        if found:
            grid.radius = float(np.quantile(found, target_recall)) + SLACK
    return grid


def _spread(batches, grid: Grid, dim: int):
    """Each vector once in its home cell and once in every later cell it visits."""
    for pdf in batches:
        if not len(pdf):
            continue
        x = unit(list(pdf["embedding"]), dim)
        if dim == 1:
            x = np.column_stack([x, np.zeros(len(x))])
        home, lower = grid.bounds(x)
        rows, cells, at_home = [], [], []
        for i in range(len(x)):
            own = int(home[i])
            rows.append(i)
            cells.append(own)
            at_home.append(True)
            for _, cell in grid.visits(lower[0][i], lower[1][i]):
                if cell > own:
                    rows.append(i)
                    cells.append(cell)
                    at_home.append(False)
        packed = [v.tobytes() for v in x]
        yield pd.DataFrame({
            "kind": pdf["kind"].to_numpy()[rows], "cell": cells, "rep": pdf["rep"].to_numpy()[rows],
            "copies": pdf["copies"].to_numpy()[rows], "home": at_home, "vec": [packed[i] for i in rows]})


def _verify(cosine: float):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """Link counts and a spanning forest of one pair of blocks."""
        i, j = key[2], key[3]
        x = np.frombuffer(b"".join(pdf["vec"])).reshape(len(pdf), -1)
        first = (pdf["block"] == i).to_numpy()
        a = np.flatnonzero(first)
        b = a if i == j else np.flatnonzero(~first)
        copies, ids = pdf["copies"].to_numpy(), pdf["rep"].to_numpy()
        links, root = np.zeros(len(pdf), np.int64), np.arange(len(pdf))

        def find(p: int) -> int:
            while root[p] != p:
                root[p] = root[root[p]]
                p = root[p]
            return p

        for at in range(0, len(a), BLOCK):
            rows = a[at : at + BLOCK]
            near = x[rows] @ x[b].T >= cosine
            if i == j:
                near[np.arange(len(rows)), at + np.arange(len(rows))] = False
            links[rows] += near @ copies[b]
            if i != j:
                links[b] += near.T @ copies[rows]
            for r in np.flatnonzero(near.any(1)):
                for c in b[near[r]]:
                    p, q = find(rows[r]), find(c)
                    if p != q:
                        root[max(p, q, key=lambda k: ids[k])] = min(p, q, key=lambda k: ids[k])
        hit = np.flatnonzero(links)
        return pd.DataFrame({"rep": ids[hit], "links": links[hit], "root": [ids[find(p)] for p in hit]},
                            columns=["rep", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, target_recall: float = 1.0) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors (vec_id, embedding, label)``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite
        & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    good = rows.filter("usable").select(
        "vec_id", "embedding", F.xxhash64("label", F.size("embedding")).alias("kind"),
        F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    # Exact copies collapse to one counted row; the smallest id stands for them.
    # Copies of a vector under other labels have other representatives, numbered as they are written.
    reps = land(good.groupBy("kind", "h1", "h2").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"),
        F.any_value("embedding").alias("embedding")).withColumn("rep", F.monotonically_increasing_id()), "imi-reps")
    size = reps.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    if not size["n"]:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    dim = size["dim"]
    largest = reps.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    grid = fit(reps, dim, largest, cosine, target_recall)
    spread = land(reps.select("kind", "rep", "copies", "embedding").mapInPandas(
        lambda it: _spread(it, grid, dim), "kind long, cell int, rep long, copies long, home boolean, vec binary"), "imi-cells")
    # How many blocks of homes and of visitors each cell has.
    counts = spread.groupBy("kind", "cell").agg(
        F.ceil(F.count_if("home") / BLOCK).cast("int").alias("nh"),
        F.ceil(F.count_if(~F.col("home")) / BLOCK).cast("int").alias("nv")).filter("nh > 0")
    counts = land(counts, "imi-counts")
    placed = spread.join(counts, ["kind", "cell"]).withColumn("block", F.when(
        F.col("home"), F.pmod("rep", F.col("nh"))).otherwise(F.col("nh") + F.pmod("rep", F.greatest("nv", F.lit(1)))).cast("int"))
    others = F.when(F.col("home"), F.sequence(F.lit(0), F.col("nh") + F.col("nv") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("nh") - 1))
    units = placed.withColumn("other", F.explode(others)).select(
        "kind", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "rep", "copies", "vec")
    found = land(units.groupBy("kind", "cell", "i", "j").applyInPandas(
        _verify(cosine), "rep long, links long, root long"), "imi-links")
    tree = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "imi")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # The smallest vector id of each component, over its representatives.
    named = land(
        reps.select("rep", "kind", "h1", "h2", "first", "copies").join(links, "rep", "left")
        .join(tree.withColumnRenamed("node", "rep"), "rep", "left")
        .select("kind", "h1", "h2", "first", F.coalesce("component", "rep").alias("component"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "imi-named")
    smallest = land(named.groupBy("component").agg(F.min("first").alias("component_id")), "imi-smallest")
    result = land(named.join(smallest, "component").select("kind", "h1", "h2", "n_links", "component_id"), "imi-result")
    out = good.drop("embedding").join(result, ["kind", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
