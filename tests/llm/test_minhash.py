from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import minhash_dedup as M
from eventide.llm.queries import op5_minhash_dedup

SF = "/root/testdata/sf0.01"


def brute(docs, idf):
    """{doc_id: smallest id of its group} by comparing all texts that share a shingle."""
    shingles = M.Shingles(idf)
    sets = [shingles.of(t) for _, t in docs]
    root, holders = list(range(len(docs))), {}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    pairs = set()
    for k, (hashes, _) in enumerate(sets):
        for h in hashes.tolist():
            pairs.update((j, k) for j in holders.setdefault(h, []))
            holders[h].append(k)
    texts = {}
    for k, (_, t) in enumerate(docs):
        pairs.add((texts.setdefault(t or "", k), k))
    for a, b in pairs:
        if a != b and ((docs[a][1] or "") == (docs[b][1] or "") or len(sets[a][0]) and M.jaccard(sets[a], sets[b]) >= M.SIMILARITY):
            root[find(b)] = find(a)
    least = {}
    for k, (d, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), M.NO_ID), M.NO_ID if d is None else d)
    return [(d, None if least[find(k)] == M.NO_ID else least[find(k)]) for k, (d, _) in enumerate(docs)]


def test_query_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in table.collect()]
    idf = M.inverse_frequency(M.word_frequencies(table.select("text")))
    got = {r["doc_id"]: r["representative"] for r in op5_minhash_dedup(spark, SF).collect()}
    assert got == dict(brute(docs, idf))


def edits(rng, words, n, changes):
    for _ in range(n):
        copy = list(words)
        for at in rng.choice(len(copy), changes, replace=False):
            copy[at] = f"new{rng.integers(1 << 30)}"
        yield " ".join(copy)


def test_groups_chains_and_odd_rows(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    texts = list(edits(rng, words, 60, 3)) + list(edits(rng, words, 30, 12)) + [" ".join(words)] * 10
    texts += ["one two", "one two", "one  two", "", "", None, "x", " ", "long " * 30_000, " ".join(f"p{i}" for i in range(30_000))]
    texts += [f"shared passage of words that many hold and more of the same {i} tail {i * 7} of {i * 13} its own {i * 17} kind" for i in range(40)]
    rows = [(i if i % 17 else None, t, f"s{i % 3}", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rep int").withColumn("sig", F.lit("clash"))
    idf = M.inverse_frequency(M.word_frequencies(docs.select("text")))
    want = brute([(r[0], r[1]) for r in rows], idf)
    marked = M.mark(docs)
    got = [(r["row"]["doc_id"], r["representative"]) for r in marked.select("row", "representative").collect()]
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order)
    kept = M.keep_one(docs)
    groups = marked.select("best").distinct().count()
    assert kept.columns == docs.columns and kept.count() == groups


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "same words here", "s")] * 5 + [(None, "same words here", "s")] * 3 + [(None, None, None)] * 2,
                                 "doc_id long, text string, source string")
    assert sorted(map(str, M.keep_one(docs).collect())) == sorted(map(str, [
        docs.filter("doc_id = 1").first(), docs.filter("text IS NULL").first()]))
    assert M.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85])
def test_samples_agree_as_often_as_the_similarity(share):
    rng = np.random.default_rng(1)
    sampler, agree, true = M.Sampler(400), [], []
    for _ in range(20):
        n = 600
        h = np.sort(rng.integers(0, 1 << 63, 2 * n).astype(np.uint64))
        w = rng.gamma(3, 1, 2 * n).astype(np.float32) + 0.1
        both = rng.random(2 * n) < share
        a, b = both | (rng.random(2 * n) < 0.5), None
        b = both | ~a
        one, two = (h[a], w[a]), (h[b], w[b] * np.float32(1.2))
        true.append(M.jaccard(one, two))
        s = [sampler.signatures(*x, np.array([0]))[0] for x in (one, two)]
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - np.mean(true)) < 0.03


def test_jaccard_of_small_sets():
    a = (np.array([1, 2, 3], np.uint64), np.array([1, 2, 1], np.float32))
    b = (np.array([2, 3, 4], np.uint64), np.array([1, 1, 1], np.float32))
    none = (np.zeros(0, np.uint64), np.zeros(0, np.float32))
    assert M.jaccard(a, b) == pytest.approx(2 / 5) and M.jaccard(none, none) == 1.0 and M.jaccard(a, none) == 0.0


@pytest.mark.parametrize("cells", [1, 100, M.CELLS])
def test_matrix_of_similarities_equals_single_ones(cells, monkeypatch):
    monkeypatch.setattr(M, "CELLS", cells)
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(30):
        h = np.sort(rng.choice(60, rng.integers(0, 40), replace=False)).astype(np.uint64)
        sets.append((h, rng.choice([0.5, 1.0, 1.5, 4.0], len(h))))
    sets[3] = sets[4] = (np.zeros(0, np.uint64), np.zeros(0))
    got = M.similarities(sets[:11], sets[11:])
    for i, a in enumerate(sets[:11]):
        for j, b in enumerate(sets[11:]):
            want = M.jaccard(a, b) if len(a[0]) or len(b[0]) else 0
            assert got[i, j] == pytest.approx(want, abs=1e-12)


def test_batches_equal_single_texts_and_plain_shingles():
    idf = np.linspace(1, 9, M.BUCKETS)
    texts = ["", None, "one", "a b c d", "a b c d e", "x y " * 50, "été  日本　語\x1cz q w e r t", "w" * 9000 + " b c d e f"]
    one = M.Shingles(idf)
    for got, text in zip(one.sets(texts), texts):
        alone = M.Shingles(idf).of(text)
        assert (got[0] == alone[0]).all() and (got[1] == alone[1]).all()
        words = (text or "").split()
        n = min(5, len(words))
        distinct = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
        assert len(got[0]) == len(distinct)
    M.SLICE, old = 16, M.SLICE
    try:
        assert all((a[0] == b[0]).all() for a, b in zip(M.Shingles(idf).sets(texts), one.sets(texts)))
    finally:
        M.SLICE = old


def test_hashes_have_64_bits():
    """Neither the words nor the bands of equal length collide, nor do their halves follow from each other."""
    words = [f"{i:07d}" for i in range(200_000)]
    h, _ = M.Shingles().words([" ".join(words)])
    rng = np.random.default_rng(2)
    keys = M.band_keys(rng.integers(0, 1 << 32, (4000, M.BANDS * M.ROWS), np.uint64).astype(np.uint32)).reshape(-1)
    for x in (h, keys):
        low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
        assert len(np.unique(x)) == len(x) and len(np.unique(low ^ high)) > 0.99 * len(x)
        for half in (low, high):  # about n * n / 2 ** 33 chance collisions
            assert len(x) - len(np.unique(half)) < 3 * len(x) ** 2 / 2**33 + 10
    same = np.zeros((1, M.BANDS * M.ROWS), np.uint32)
    assert len(np.unique(M.band_keys(same))) == M.BANDS


def test_samples_of_long_texts_agree_as_often_as_the_similarity():
    """More shingles than random draws: 20,000 and a third more."""
    rng = np.random.default_rng(6)
    sampler, agree, true = M.Sampler(200), [], []
    for _ in range(6):
        h = np.sort(rng.integers(0, 1 << 63, 26_000).astype(np.uint64))
        w = rng.gamma(3, 1, len(h)) + 0.1
        a, b = np.arange(len(h)) < 23_400, np.arange(len(h)) >= 2_600
        mixed = rng.permutation(len(h))
        one, two = (np.sort(mixed[x]) for x in (a, b))
        true.append(M.jaccard((h[one], w[one]), (h[two], w[two])))
        sig = [sampler.signatures(h[x], w[x], np.array([0]))[0] for x in (one, two)]
        agree.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(true) - 0.8) < 0.01 and abs(np.mean(agree) - np.mean(true)) < 0.03


def test_templated_texts_make_linear_rows(spark, monkeypatch):
    """2,000 texts at about 0.7 to each other and one group of copies: no unit lists pairs, and groups are exact."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(300)]
    texts = list(edits(rng, base, 2000, 10))  # shares 250 of 296 shingles with the template
    near = [f"n{i}" for i in range(300)]
    texts += list(edits(rng, near, 60, 2))
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    sizes, land = {}, M.land

    def counted(df, label):
        out = land(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(M, "land", counted)
    got = {r["doc_id"]: r["representative"] for r in M.mark(docs, ["doc_id"]).select("row.doc_id", "representative").collect()}
    idf = M.inverse_frequency(M.word_frequencies(docs.select("text")))
    sets = M.Shingles(idf).sets(texts)
    alike = M.similarities(sets, sets) >= M.SIMILARITY
    label = np.arange(len(texts))
    while True:
        least = np.array([label[row].min() for row in alike])
        if (least == label).all():
            break
        label = least
    assert got == dict(enumerate(label.tolist()))
    in_buckets = sizes["icws-mixed"]
    assert sizes["icws-second-units"] <= 3 * (M.BANDS * len(texts)) and sizes["icws-second-units"] <= 12 * in_buckets
    assert sizes["icws-second-links"] <= len(texts)
