from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from eventide.llm import mixing as M
from eventide.llm.queries import op9_mixing

SF = "/root/testdata/sf0.01"


def check_schedule(sizes, weights, segment):
    fluid = M.Fluid(np.array(sizes), np.array(weights, float))
    total = int(sum(sizes))
    rows = [r for at in range(0, total, segment) for r in M.schedule(fluid, at, min(total, at + segment))]
    assert sorted((s, b) for s, b, *_ in rows) == [(s, b) for s, n in enumerate(sizes) for b in range(1, n + 1)]
    assert [r[2] for r in rows] == list(range(total))
    done = np.zeros(len(sizes))
    for s, block, slot, release, deadline in rows:
        assert done[s] == block - 1 and release <= slot < deadline
        done[s] += 1
        assert np.abs(done - fluid.delivered(slot + 1)).max() < 1


@pytest.mark.parametrize("segment", [7, 64, 10_000])
@pytest.mark.parametrize("sizes,weights", [
    ([5], [1]), ([1, 1, 1], [1, 1, 1]), ([100, 50, 25], [4, 2, 1]), ([300, 10, 10, 5], [1, 1, 1, 1]), ([40, 40, 40], [0.5, 0.3, 0.2]),
    ([200, 3, 77, 15, 60, 1], [0.17, 0.29, 0.31, 0.05, 0.11, 0.07]), ([20, 30], [1, 0]), ([10, 10], [0, 0]),
])
def test_every_block_keeps_its_window(sizes, weights, segment):
    check_schedule(sizes, weights, segment)


def exact_windows(sizes, weights):
    """(release, deadline) of every block in exact arithmetic: the fluid is followed from one source's end to the next."""
    left, time, times = [Fraction(n) for n in sizes], Fraction(0), [[] for _ in sizes]
    out = [Fraction(0)] * len(sizes)
    while any(left):
        rate = {s: Fraction(weights[s]) / sum(Fraction(weights[k]) for k in range(len(sizes)) if left[k]) for s in range(len(sizes)) if left[s]}
        span = min(left[s] / r for s, r in rate.items())
        for s, r in rate.items():
            for block in range(int(out[s]) + 1, int(out[s] + r * span) + 1):
                times[s].append(time + (block - out[s]) / r)
            out[s] += r * span
            left[s] -= r * span
        time += span
    return [[(math.floor(a), math.ceil(b)) for a, b in zip([Fraction(0), *t], t)] for t in times]


@pytest.mark.parametrize("seed", range(12))
def test_a_second_scheduler_agrees(seed):
    """Earliest deadline first, slot by slot over all sources, from windows in exact arithmetic."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 9))
    sizes, weights = rng.integers(1, 40, n).tolist(), rng.integers(1, 12, n).tolist()
    windows, done, want = exact_windows(sizes, weights), [0] * n, []
    for slot in range(sum(sizes)):
        ready = [(windows[s][done[s]][1], s) for s in range(n) if done[s] < sizes[s] and windows[s][done[s]][0] <= slot]
        deadline, s = min(ready)
        assert slot < deadline
        done[s] += 1
        want.append((s, done[s], slot, *windows[s][done[s] - 1]))
    assert M.schedule(M.Fluid(np.array(sizes), np.array(weights, float)), 0, sum(sizes)) == want


def test_random_mixes():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(1, 25))
        check_schedule(rng.integers(1, 120, n).tolist(), (rng.random(n) + 0.01).tolist(), int(rng.integers(5, 200)))


@pytest.mark.parametrize("n,seed", [(1500, 0), (3000, 1), (3000, 2)])
def test_thousands_of_sources_keep_their_windows(n, seed):
    rng = np.random.default_rng(seed)
    check_schedule(rng.integers(1, 4, n).tolist(), (rng.random(n) ** 3 + 0.001).tolist(), 700)


def test_slots_taken_long_before_a_segment_count():
    # 1,000 blocks released at slot 4,000 are out at 6,000; so but 1,000 of 1,200 others released since then may be.
    kinds = [(1000, 2000, 10), (1200, 4020, 5), (8000, 40_000, 3)]  # sources, slots a block, blocks
    weights = np.concatenate([np.full(n, 1 / slots) for n, slots, _ in kinds])
    fluid = M.Fluid(np.concatenate([np.full(n, size) for n, _, size in kinds]), weights)
    at = int(np.ceil(2000 * weights.sum()))
    start, end = 2 * at - 5, fluid.window(0, 3)[1]
    assert all(release <= slot < deadline for *_, slot, release, deadline in M.schedule(fluid, start, end))


def test_free_slots_are_counted_by_chunks(monkeypatch):
    rng = np.random.default_rng(4)
    fluid = M.Fluid(rng.integers(1, 9, 300), rng.random(300) + 0.01)
    want = [fluid.before(t).tolist() for t in range(0, 900, 50)]
    monkeypatch.setattr(M, "CHUNK", 7)
    assert [fluid.before(t).tolist() for t in range(0, 900, 50)] == want


def test_query_places_every_document_once(spark):
    docs = {(r["doc_id"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op9_mixing(spark, SF).toPandas()
    assert set(zip(rows["doc_id"], rows["source"])) == docs and len(rows) == len(docs)
    assert not rows.duplicated(["slot", "in_block"]).any()
    assert ((rows["release"] <= rows["slot"]) & (rows["slot"] < rows["deadline"])).all()
    sizes = rows.groupby(["source", "block"]).size().reset_index(name="n")
    last = sizes.groupby("source")["block"].transform("max") == sizes["block"]
    assert (sizes.loc[~last, "n"] == M.BLOCK).all() and sizes["n"].max() <= M.BLOCK
    blocks = rows.drop_duplicates(["source", "block"])
    assert (blocks.sort_values("slot").groupby("source")["block"].diff().dropna() == 1).all()


def test_weights_steer_the_mix(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS source")
    rows = M.place(docs, {"a": 3.0, "b": 1.0}, block=10).select("slot", "source_key").distinct().toPandas().sort_values("slot")
    assert abs((rows["source_key"][:40] == "a").sum() - 30) <= 1


def test_odd_rows(spark):
    rows = [(1, None, "t"), (1, None, "t"), (None, "s", None), (2, "s", ""), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS slot", "2 AS block", "3 AS bucket", "4 AS rank")
    placed = M.place(docs, block=2)
    assert placed.count() == 5 and placed.select("slot", "in_block").distinct().count() == 5
    out = M.in_order(placed, docs.columns)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert M.place(docs.limit(0)).count() == 0


def test_repeated_rows_and_ids_have_places_of_their_own(spark, tmp_path):
    """A third of all rows are copies of one row, another third has no id; both from files and from a plan."""
    rows = [(7, "s", "same") if i % 3 == 0 else (None, "s", f"t{i % 50}") if i % 3 == 1 else (i, "q", f"u{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    docs.write.parquet(f"{tmp_path}/docs")
    for df in (docs, spark.read.parquet(f"{tmp_path}/docs")):
        placed = M.place(df, block=10).select("row.*", "slot", "in_block", "block", "source_key").toPandas()
        assert len(placed) == 3000 and not placed.duplicated(["slot", "in_block"]).any()
        assert sorted(placed["text"]) == sorted(r[2] for r in rows)
        assert (placed.groupby(["source_key", "block"]).size() == 10).all()


def test_any_number_of_sources(spark):
    """More sources than were once allowed: every document has a place, and every block its slot."""
    n = 120_000
    docs = spark.range(0, n, 1, 8).selectExpr("id AS doc_id", "concat('s', id % 110000) AS source")
    placed = M.place(docs, block=1).select("source_key", "block", "in_block", "slot", "release", "deadline")
    checks = placed.selectExpr(
        "count(*) AS n", "count(DISTINCT slot) AS slots", "min(slot) AS low", "max(slot) AS high",
        "count_if(release <= slot AND slot < deadline) AS inside", "count(DISTINCT source_key, block) AS blocks").first()
    assert tuple(checks) == (n, n, 0, n - 1, n, n)
