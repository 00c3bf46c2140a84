from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
from compare import compare, duck
from hypothesis import given
from hypothesis import strategies as st

from eventide.llm import filter_audit as fa
from eventide.llm.oracle import ORACLE
from eventide.llm.queries import op12_filter_audit

SF = "/root/testdata/sf0.001"


def test_query_matches_sql(spark):
    assert compare(spark, duck(SF), "op12", op12_filter_audit, ORACLE["op12_filter_audit"], SF)[0] == ""


def brute(docs, labels):
    """Every order walked document by document."""
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    least = {}
    for doc, text, _ in docs:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    fails = []
    for doc, text, part in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        first = least.get(t)
        fails.append((part or "", doc, "".join(f for f, bad in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words),
            100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search(r"[#$%&*|]", t) is not None,
            first is not None and (doc is None or doc > first))) if bad)))
    out = {}
    for part in {p for p, _, _ in fails}:
        own = [(d, f) for p, d, f in fails if p == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d, b in left if f in b]
                n_fail = sum(f in b for _, b in own)
                left = [(d, b) for d, b in left if f not in b]
                shapley[f] += len(gone)
                out[part, order, step] = (len(left), len(gone), n_fail - len(gone), sum(b == f for _, b in own),
                                          sum(d in good for d in gone), sum(d in toxic for d in gone))
        for (p, order, step), row in list(out.items()):
            if p == part:
                out[p, order, step] = (*row, shapley[order[step - 1]])
    return out


def as_map(df):
    return {(r["part"], r["filter_order"], r["step"]): (
        r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"])
        for r in df.collect()}


def random_docs(n, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["Alpha", "beta", "GAMMA", "a#b", "x|", "été"] + [f"w{i}" for i in range(rng.choice([5, 400]))])
                      for _ in range(rng.choice([0, 3, 99, 100, 150]))) for _ in range(n // 2)] + [None, "", "\x0b\x0c \t"]
    return [(rng.choice([None, *range(n)]), rng.choice(texts), rng.choice(["en", "en", "de", None, ""])) for _ in range(n)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fa, "RANGE", 3)
    docs = random_docs(160, 5)
    rng = random.Random(6)
    labels = [(rng.choice([None, *range(160)]), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(120)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, lang string, id string").repartition(5)
    lab = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, good int")
    assert as_map(fa.audit(df, lab)) == brute(docs, labels)


def test_chunks_of_a_part_add_up(spark, monkeypatch):
    monkeypatch.setattr(fa, "CHUNK", 7)
    docs = random_docs(60, 8)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert as_map(fa.audit(df, lab)) == brute(docs, [])


def test_odd_tables(spark):
    lab = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert fa.audit(empty, lab).collect() == []
    same = [(1, "word " * 200, "en")] * 4 + [(None, "word " * 200, "en")] * 2 + [(2, None, None)]
    df = spark.createDataFrame(same, "doc_id long, text string, lang string")
    assert as_map(fa.audit(df, lab)) == brute(same, [(1, 1, 1)])


@given(st.lists(st.lists(st.integers(0, 300), max_size=60), min_size=1, max_size=5), st.integers(1, 7))
def test_galloping_sets(lists, width):
    arrays = [np.unique(np.array(x, np.int64)) for x in lists]
    cuts = list(fa.ranges(arrays, width))
    for i, x in enumerate(arrays):
        assert np.concatenate([c[i] for c in cuts] or [x]).tolist() == x.tolist()
    tops = [max((int(c[-1]) for c in cut if len(c)), default=-1) for cut in cuts]
    assert all(int(c[0]) > top for top, cut in zip(tops, cuts[1:]) for c in cut if len(c))
    assert fa.merge(arrays).tolist() == sorted(set().union(*lists))
    assert fa.minus(arrays[0], fa.merge(arrays[1:])).tolist() == sorted(set(lists[0]) - set().union(*lists[1:]))
    for x in arrays:
        for v in (0, 17, 300, 999):
            assert fa.gallop(x, 0, v) == np.searchsorted(x, v)
