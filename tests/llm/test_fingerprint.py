from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from eventide.llm import fingerprint as P
from eventide.llm.queries import op6_fingerprints

SF = "/root/testdata/sf0.001"


def expected_edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        out.append((doc, len(text), text[: len(text) - half] + after[:half], after))
    return out


def shingles(text):
    w = text.split()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in op6_fingerprints(spark, SF).collect()}
    assert len(got) == len(docs)
    texts, gap = dict(docs), []
    for doc, n, edited, after in expected_edits(docs):
        r = got[doc]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        gap += [abs(r["near_edited"] - jaccard(texts[doc], edited)), abs(r["near_next"] - jaccard(texts[doc], after))]
    assert sum(gap) / len(gap) < 0.02 and max(gap) < 0.2
    by_text = {}
    for doc, text in docs:
        assert by_text.setdefault(text, got[doc]["fingerprint"]) == got[doc]["fingerprint"]


@pytest.mark.parametrize("rows", [
    [(1, "only one")], [(1, None), (2, ""), (3, "a b c d e f")], [(1, "x y"), (1, "x y"), (None, "null id"), (None, None)],
    [(i, "w" * i + " é ü") for i in range(40)],
])
def test_edits_of_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _b", "2 AS c0", "3 AS n_chars")
    got = P.edited_fingerprints(docs).select("doc_id", "n_chars", "edited").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, got), key=key) == sorted([r[:3] for r in expected_edits(rows)], key=key)


def test_empty_table(spark):
    assert P.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_merge_and_estimate(spark):
    words = [f"w{i}" for i in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    df = spark.createDataFrame([("k", a), ("k", b), ("z", ""), ("n", None)], "key string, text string").withColumn("s", P.sketch(F.col("text")))
    one, two = [r["s"] for r in df.filter("key = 'k'").collect()]
    merged = P.merge_by(df, ["key"], "s").filter("key = 'k'").first()["s"]
    assert merged == sorted(set(one) | set(two))[: P.SIZE] and one == sorted(one) and len(one) == P.SIZE
    pair = spark.createDataFrame([(one, two, merged)], "a array<long>, b array<long>, m array<long>").select(
        P.resemblance(F.col("a"), F.col("b")).alias("r"), P.containment(F.col("a"), F.col("b")).alias("c"),
        P.distinct_count(F.col("m")).alias("n")).first()
    assert abs(pair["r"] - 1 / 3) < 0.15 and abs(pair["c"] - 0.5) < 0.2 and abs(pair["n"] - 3000) < 900
    assert [r["s"] for r in df.filter("key IN ('z', 'n')").collect()] == [[], []]
    empty = df.filter("key = 'z'").select(P.resemblance(F.col("s"), F.col("s")).alias("r"), P.as_text(F.col("s")).alias("t")).first()
    assert (empty["r"], empty["t"]) == (1.0, "")
