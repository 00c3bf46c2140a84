from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from eventide.llm import importance as im
from eventide.llm.queries import op13_importance

SF = "/root/testdata/sf0.001"


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def buckets_of(text):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target):
    """doc_id -> (n_features, weight, score, rank), feature by feature."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets_of(text))
    for text in target:
        t.update(buckets_of(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    rows = []
    for doc, text in docs:
        found = buckets_of(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc, len(found), weight, score, len(words_of(text)) >= 20))
    able = sorted((-r[3], r[0] is None, r[0] or 0, r[1], r[2]) for r in rows if r[4])
    drawn = able[: 5 * len(able) // 100]
    out, left = [], {}
    for rank, key in enumerate(drawn, 1):
        left.setdefault(key, []).append(rank)
    for doc, n, weight, score, ok in rows:
        ranks = left.get((-score, doc is None, doc or 0, n, weight), []) if ok else []
        out.append((doc, n, weight, score, ranks.pop(0) if ranks else None))
    return sorted(out, key=str)


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in op13_importance(spark, SF).collect()), key=str)
    assert got == brute(docs, target)
    assert any(r[4] is not None for r in got)


def test_many_partitions_ties_and_odd_rows(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["un", "DEUX", "trois4", "été", "x-y", "日本"]) for _ in range(rng.choice([0, 5, 19, 20, 60])))
             for _ in range(40)]
    texts += [None, "", "--- ---", "z" * 3000 + " " + "y" * 1200]
    docs = [(rng.choice([None, *range(150)]), rng.choice(texts)) for _ in range(500)]
    docs += [(7, "same words " * 15)] * 150
    df = spark.createDataFrame([(*d, 1, "r") for d in docs], "doc_id long, text string, score int, row string").repartition(6)
    target = [None, "", "un deux trois4", "été"]
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = sorted((tuple(r) for r in im.resample(df, goal).collect()), key=str)
    assert got == brute(docs, target)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert im.resample(none, some.select("text")).collect() == []
    got = [tuple(r) for r in im.resample(some, none.select("text")).collect()]
    assert got == brute([(1, "a b c")], [])


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9 é-日\n", max_size=60)), max_size=8))
@settings(deadline=None)
def test_features_of_any_texts(texts):
    bucket, owner, n_words = im.features([None if t is None else t.encode() for t in texts])
    got = sorted(zip(owner.tolist(), bucket.tolist()))
    assert got == sorted((i, b) for i, t in enumerate(texts) for b in buckets_of(t))
    assert n_words.tolist() == [len(words_of(t)) for t in texts]


def test_long_features_fold_their_rows():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 300_000).astype(np.uint8)
    lengths = np.array([0, 1, 511, 512, 513, 1023, 1024, 1025, 99_999, 99_999, 200_000, 4096])
    starts = np.array([5, 9, 0, 3, 8, 77, 1, 2, 0, 150_000, 17, 40])
    want = [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(starts, lengths)]
    assert im.crcs(data, starts, lengths).tolist() == want
    wide = im.CELLS
    im.CELLS = 1 << 12
    try:
        assert im.crcs(data, starts, lengths).tolist() == want
    finally:
        im.CELLS = wide
