from __future__ import annotations

import string

import pytest

from compare import compare, duck
from eventide.llm import line_dedup as L
from eventide.llm.oracle import ORACLE
from eventide.llm.queries import op3_line_dedup

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_query_matches_sql(spark):
    problem, rows = compare(spark, duck(SF), "op3_line_dedup", op3_line_dedup, ORACLE["op3_line_dedup"], SF)
    assert problem == "" and rows > 0


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def brute(rows):
    rank = lambda d: (d is None, d or 0)
    owners = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                owners[key(line)] = min(owners.get(key(line), rank(d)), rank(d))
    return sorted(
        "\n".join(x for x in (text or "").split("\n") if len(key(x)) < 10 or owners[key(x)] == rank(d)) for d, text in rows)


LINE = "a line that repeats"
CASES = [
    [(1, None), (2, ""), (3, "\n"), (4, "\n\n")],
    [(1, LINE), (2, f"x\n\t{LINE.upper()}\r\nend of it all\n"), (3, f"{LINE}\x0b\n{LINE}")],
    [(2, LINE), (2, LINE), (2, f"{LINE}\nmore than ten"), (5, LINE)],
    [(None, LINE), (None, f"{LINE}\nown words here"), (7, LINE)],
    [(-5, "ÉÉÉÉÉÉÉÉÉÉ"), (1, "éééééééééé"), (2, "ÉÉÉÉÉÉÉÉÉÉ "), (3, "123456789"), (4, "123456789")],
    [(i, "\n".join([LINE] * 3 + [f"unique line number {i}"])) for i in range(200)],
    [(1, "word " * 50_000), (2, "word " * 50_000 + "\nnext line is here")],
]


@pytest.mark.parametrize("rows", CASES)
def test_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS).selectExpr("*", "1 AS _id", "2 AS line", "3 AS row")
    out = L.apply_bitmaps(docs, L.keep_bitmaps(docs))
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted(r["text"] or "" for r in got) == brute(rows)
    assert all(r["n_chars"] == len(r["text"] or "") for r in got)


def test_bitmaps_read_back(spark):
    docs = spark.createDataFrame([(1, f"{LINE}\nb"), (2, f"a\n{LINE}\nc")], "doc_id long, text string")
    got = {r["_id"]: r for r in L.keep_bitmaps(docs).collect()}
    assert L.read_bitmap(got[1]["keep_bitmap"], got[1]["n_lines"]).tolist() == [True, True]
    assert L.read_bitmap(got[2]["keep_bitmap"], got[2]["n_lines"]).tolist() == [True, False, True]
    assert got[2]["n_dropped"] == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert L.apply_bitmaps(docs, L.keep_bitmaps(docs)).count() == 0


def test_a_hash_that_spans_ranges_has_one_owner():
    import pyarrow as pa

    def batch(rows):
        return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(("h1", "h2", "_id", "_th", "pos"))})

    rows = [(5, 5, d, d, 0) for d in range(1, 7)] + [(9, 9, 3, 3, 1), (9, 9, 4, 4, 1)]
    whole = [list(L._first_documents(iter([batch(rows[:2]), batch(rows[2:])])))]
    parts = [list(L._first_documents(iter([batch(p)]))) for p in (rows[:3], rows[3:])]
    for ranges in (whole, parts):
        found = [r for part in ranges for b in part for r in zip(*[c.to_pylist() for c in b.columns])]
        owners = {}
        for kind, h1, h2, i, *_ in found:
            if kind == 2:
                owners[h1] = min(owners.get(h1, i), i)
        gone = {(r[3], r[5]) for r in found if r[0] == 0} | {(r[3], r[5]) for r in found if r[0] == 1 and owners[r[1]] != r[3]}
        assert gone == {(d, 0) for d in range(2, 7)} | {(4, 1)}
