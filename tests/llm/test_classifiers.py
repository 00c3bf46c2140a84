from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import quality as Q
from eventide.llm import toxicity as X
from eventide.llm.queries import op7_toxicity, op10_quality

SF = "/root/testdata/sf0.1"


def auc(y, score):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def scored(spark, query, column, parts, left_out):
    rows = query(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = rows.toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    for r in got.itertuples():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == left_out)
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    return got.merge(labels, on="doc_id").query("held_out")


def test_quality_on_the_held_out_fold(spark):
    r = scored(spark, op10_quality, "quality", 4, 2)
    assert auc(r["quality"].to_numpy(), r["score"].to_numpy()) > 0.98
    assert (r["predicted"] == r["quality"]).mean() > 0.97 and (r["predicted"] == (r["score"] >= 0.7)).all()


def test_toxicity_on_the_held_out_fold(spark):
    r = scored(spark, op7_toxicity, "toxic", 5, 0)
    assert auc(r["toxic"].to_numpy(), r["score"].to_numpy()) > 0.93
    assert (r["predicted"] == r["toxic"]).mean() > 0.97 and (r["predicted"] == (r["score"] >= 0.5)).all()


def test_normal_equations_and_isotonic_match_brute_force(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["alpha", "BETA", "g4mma", "!!"], int(rng.integers(1, 60)))) for _ in range(300)]
    y = [int("BETA" in t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, label int")
    model = Q.fit(docs, labels, cosines=16)
    stats = np.stack([Q.describe(t) for t in texts])
    assert np.allclose(model.mean, stats.mean(0)) and np.allclose(model.scale, np.maximum(stats.std(0), 1e-6))
    z = np.column_stack([model.cosines(stats), np.ones(len(texts))])
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + Q.RIDGE * np.eye(17), z.T @ np.array(y)))
    assert (np.diff(model.levels) >= 0).all()


def test_pool_adjacent_violators():
    assert np.allclose(Q.isotonic(np.array([1, 1, 2, 1.0]), np.array([0.2, 0.8, 0.5, 0.9])), [0.2, 0.6, 0.6, 0.9])
    assert np.allclose(Q.isotonic(np.ones(3), np.array([3.0, 2, 1])), [2, 2, 2]) and len(Q.isotonic(np.zeros(0), np.zeros(0))) == 0


ODD = [(1, None), (2, ""), (3, "word " * 100_000), (4, "\x00\x1f"), (4, "repeated id"), (None, "no id"), (5, "é😀\n\n")]


@pytest.mark.parametrize("module", [Q, X])
@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, 0), (3, 1), (3, 0), (4, None), (None, 1), (99, 1)]])
def test_odd_rows_and_labels(spark, module, labels):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "1 AS stats", "2 AS label", "3 AS score")
    score = module.scorer(module.fit(docs, spark.createDataFrame(labels, "doc_id long, label int")))
    got = [r[0] for r in docs.select(score("text")).collect()]
    assert len(got) == len(ODD) and all(0 <= s <= 1 for s in got)
    assert docs.limit(0).select(score("text")).count() == 0


def test_inputs_are_the_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = X.fit(docs, labels, rows=200)
    words = X.Words()
    ids = words.ids("the cat and the dog of this house")
    assert X._LANGUAGES[words.language(ids)] == "en" and X._LANGUAGES[words.language(words.ids("der Hund und die Katze"))] == "de"
    assert X._LANGUAGES[words.language(words.ids("xyzzy"))] == "other"
    assert 0 <= model.score(ids, words.language(ids)) <= 1


def test_chunks_do_not_change_a_score(monkeypatch):
    rng = np.random.default_rng(5)
    m = X._initial([np.zeros((1, X.PIECES), np.int32)], np.array([1.0]), rng)
    ids = rng.integers(0, X.HASHES, (5000, X.PIECES)).astype(np.int32)
    whole = m.pooled(ids)
    monkeypatch.setattr(X, "CHUNK", 37)
    parts = m.pooled(ids)
    assert np.allclose(whole[0], parts[0]) and (whole[1][whole[0] > 0] == parts[1][parts[0] > 0]).all()


def random_model(rng, scale=0.5):
    return X.Model(rng.normal(0, scale, (50, X.DIM)), [rng.normal(0, scale, (w, X.DIM, X.FILTERS)) for w in X.WIDTHS],
                   rng.normal(0, scale, (len(X.WIDTHS), X.FILTERS)), rng.normal(0, scale, len(X.WIDTHS) * X.FILTERS), 0.3)


def random_texts(rng, n):
    out = [rng.integers(0, 50, (int(rng.integers(0, 9)), X.PIECES)).astype(np.int32) for _ in range(n)]
    for ids in out:
        ids[rng.random(ids.shape) < 0.2] = 0
    return out


def test_pooling_matches_plain_loops():
    rng = np.random.default_rng(3)
    m = random_model(rng)
    m.embed[0] = 0
    for ids in random_texts(rng, 20):
        value, _ = m.pooled(ids)
        words = [sum(m.embed[p] for p in row) for row in ids] + [np.zeros(X.DIM)] * max(X.WIDTHS)
        for k, w in enumerate(X.WIDTHS):
            for f in range(X.FILTERS):
                best = max(sum(float(words[i + j] @ m.filters[k][j][:, f]) for j in range(w)) + m.bias[k, f] for i in range(max(1, len(ids))))
                assert value[k, f] == pytest.approx(max(0.0, best), abs=1e-5)


def test_gradients_match_differences():
    rng = np.random.default_rng(4)
    m = random_model(rng)
    m.embed[0] = 0
    texts, y = random_texts(rng, 6), np.array([0, 1, 1, 0, 1, 0], float)
    g_embed, g_filters, g_bias, g_out, g_ob = X.gradients(m, texts, y)

    def loss():
        z = np.array([m.logit(t) for t in texts])
        return float(np.mean(np.logaddexp(0, z) - y * z))

    def slope(array, at, step=1e-4):
        held = array[at]
        array[at] = held + step
        up = loss()
        array[at] = held - step
        down = loss()
        array[at] = held
        return (up - down) / (2 * step)

    for piece in sorted(g_embed)[:12]:
        for c in range(0, X.DIM, 3):
            assert slope(m.embed, (piece, c)) == pytest.approx(g_embed[piece][c], abs=2e-3)
    for k, g in enumerate(g_filters):
        for at in ((0, 1, 2), (len(g) - 1, 4, 7)):
            assert slope(m.filters[k], at) == pytest.approx(g[at], abs=2e-3)
    assert slope(m.bias, (1, 3)) == pytest.approx(g_bias[1, 3], abs=2e-3) and slope(m.out, 5) == pytest.approx(g_out[5], abs=2e-3)
    m.out_bias += 1e-4
    up = loss()
    m.out_bias -= 2e-4
    assert (up - loss()) / 2e-4 == pytest.approx(float(g_ob[0]), abs=2e-3)


def test_the_first_of_texts_with_one_id_is_learnt(spark):
    a = [(i, "bad words here" if i % 2 else "fine words there") for i in range(40)]
    docs = spark.createDataFrame(a + [(i, "zzz later text") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, label int")
    one, two = X.fit(docs.repartition(5), labels), X.fit(spark.createDataFrame(a, "doc_id long, text string"), labels)
    assert (one.embed == two.embed).all() and (one.out == two.out).all()


def test_every_labelled_row_is_learnt(spark):
    """A word that tells a label only in rows beyond the first shard is learnt as well."""
    rng = np.random.default_rng(8)
    texts, y = [], []
    for i in range(900):
        toxic = int(i % 3 == 0)
        texts.append(" ".join([*rng.choice(["one", "two", "three"], 5), f"{'vile' if toxic else 'kind'}{i % 15:02d}x"]))
        y.append(toxic)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, label int")
    seen = []
    held = X._weights
    try:
        X._weights = lambda counts, share, rng: (seen.append((counts.copy(), share)), held(counts, share, rng))[1]
        model = X.fit(docs, labels, rows=100)
    finally:
        X._weights = held
    # The starting weights of the shards count each row but those kept for the thresholds, which are about a quarter.
    words = X.Words()
    counts, share = seen[0]
    least = sum(counts[:, words.ids(f"{w}{i:02d}x")[0, 0]].sum() for w, i in [("vile", k) for k in range(0, 15, 3)] + [("kind", k) for k in range(15) if k % 3])
    assert 900 * 0.7 <= least <= 900 * 0.75 and share == pytest.approx(1 / 3, abs=0.05)
    got = docs.select("doc_id", X.scorer(model)("text").alias("s")).toPandas().sort_values("doc_id")
    assert ((got["s"] >= 0.5).astype(int).to_numpy() == np.array(y)).mean() > 0.99
