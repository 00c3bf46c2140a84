from __future__ import annotations

import math

import numpy as np
import pytest

from eventide.llm import embedding_dedup as E
from eventide.llm.queries import op2_embedding_dedup

SF = "/root/testdata/sf0.01"
LAYOUT = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=E.COSINE):
    """{(row position): (n_links, component)} by comparing all rows with each other."""
    def usable(i, v, label):
        return i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = [k for k, r in enumerate(rows) if usable(*r)]
    root = {k: k for k in good}
    links = dict.fromkeys(range(len(rows)), 0)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (a, b))
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    root[find(b)] = find(a)
    least = {}
    for k in good:
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    return [(r[0], links[k], least[find(k)] if k in root else r[0]) for k, r in enumerate(rows)]


def got(df):
    return [(r["vec_id"], r["n_links"], r["component_id"]) for r in df.collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_query_against_all_pairs(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    out = op2_embedding_dedup(spark, SF)
    assert order(got(out)) == order(brute(rows))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out.collect())


def test_groups_of_near_copies_and_a_chain(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    monkeypatch.setattr(E, "CELL_ROWS", 8)
    rng = np.random.default_rng(4)
    rows, base = [], rng.normal(size=(4, 16))
    for i in range(120):
        rows.append((i, (base[i % 3] + rng.normal(size=16) * 0.03).astype(np.float32).tolist(), i % 2))
    rows += [(200 + i, base[3].astype(np.float32).tolist(), 0) for i in range(30)]
    rows += [(300 + i, [math.cos(i * 0.15), math.sin(i * 0.15)], 1) for i in range(20)]  # neighbours only
    assert order(got(E.near_duplicates(spark.createDataFrame(rows, LAYOUT)))) == order(brute(rows))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1),
            (8, [1.0, None], 1), (9, [inf, 1.0], 1), (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (10, [1.0, 0.0], 2), (11, [1.0, 0.0, 0.0], 1),
            (12, [1e30, 0.0], 1), (13, [-1.0, 0.0], 1), (14, [3.0], 1), (15, [4.0], 1), (-3, [0.99, 0.01], 1)]
    df = spark.createDataFrame(rows, LAYOUT).selectExpr("*", "1 AS rep", "2 AS cell", "3 AS kind")
    assert order(got(E.near_duplicates(df))) == order(brute(rows))
    assert E.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 3, 12])
def test_traversal_finds_every_neighbour_in_bound_order(k):
    rng = np.random.default_rng(k)
    x = E.unit(list(np.concatenate([c + rng.normal(size=(30, 8)) * 0.05 for c in rng.normal(size=(8, 8))])), 8)
    grid = E.Grid(E._kmeans(x[:, :4], k, rng), E._kmeans(x[:, 4:], k, rng), 2 - 2 * E.COSINE + E.SLACK)
    home, lower = grid.bounds(x)
    for i in range(len(x)):
        seen = list(grid.visits(lower[0][i], lower[1][i]))
        assert [b for b, _ in seen] == sorted(b for b, _ in seen)
        cells = {c for _, c in seen}
        assert len(cells) == len(seen)
        assert all(int(home[j]) in cells for j in np.flatnonzero(x @ x[i] >= E.COSINE))


def test_a_lower_target_recall_still_reaches_it(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    links = sum(r[1] for r in got(E.near_duplicates(spark.createDataFrame(rows, LAYOUT), target_recall=0.9)))
    assert links >= 0.9 * sum(r[1] for r in brute(rows))


def test_bounds_hold_for_codewords_that_nearly_meet():
    """The bound of a region never exceeds the distance to a point of it."""
    rng = np.random.default_rng(11)
    for trial in range(60):
        base = rng.normal(size=(4, 3))
        close = base + rng.normal(size=(4, 3)) * 10.0 ** rng.integers(-9, -3)
        book = E._apart(np.unique(np.concatenate([base, close]), axis=0))
        gaps = np.sqrt(((book[:, None] - book[None]) ** 2).sum(2))
        assert gaps[~np.eye(len(book), dtype=bool)].min() > E.CLOSE
        grid = E.Grid(book, rng.normal(size=(2, 3)), 0.04)
        x = np.concatenate([book[rng.integers(len(book), size=(300,))] + rng.normal(0, 0.05, (300, 3)), rng.normal(size=(300, 3))], axis=1)
        _, lower = grid.bounds(x)
        near = E._squares(x[:, :3], book).argmin(1)
        true = ((x[:, None, :3] - x[None, :, :3]) ** 2).sum(2)  # to the points of each region
        assert (lower[0][:, near] <= true + 1e-9).all(), trial
