from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import compare, duck
from eventide.llm import chat
from eventide.llm.oracle import ORACLE
from eventide.llm.queries import op4_chat_format

SF = "/root/testdata/sf0.001"
LAYOUT = "conv_id long, turn long, role string, text string"


def test_query_matches_sql(spark):
    problem, rows = compare(spark, duck(SF), "op4_chat_format", op4_chat_format, ORACLE["op4_chat_format"], SF)
    assert problem == "" and rows > 0


def formatted(spark, rows):
    out = chat.format_conversations(spark.createDataFrame(rows, LAYOUT))
    return {r["conv_id"]: r for r in out.withColumns({
        "back": chat.read_turns(F.col("formatted")), "loss": chat.loss_text(F.col("segments"))}).collect()}


NASTY = ["", "\\", "\\b\\h\\l", "### user: </turn>\n", "</turn>\n### assistant: x", "a\n\nb", "#<\\#<", "é😀", "x" * 100_000, " ", "\n"]


def test_round_trip_of_control_strings(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)]
    r = formatted(spark, rows)[1]
    assert [(b["role"], b["text"]) for b in r["back"]] == [(role, t) for _, _, role, t in rows]
    assert r["loss"] == "".join(t for _, _, role, t in rows if role == "assistant")
    assert r["formatted"].count(chat.DEFAULT.close) == len(rows)
    assert "".join(s["text"] for s in r["segments"]) == r["formatted"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys: #<\\", "tool"]), st.text(max_size=40)), min_size=1, max_size=6))
def test_round_trip_of_any_text(spark, turns):
    turns = [(role, "".join(c for c in t if not 0xD800 <= ord(c) < 0xE000)) for role, t in turns]
    r = formatted(spark, [(1, i, role, t) for i, (role, t) in enumerate(turns)])[1]
    assert [(b["role"], b["text"]) for b in r["back"]] == turns


@pytest.mark.parametrize("roles,valid,bad", [
    ("user assistant", True, None), ("system user assistant user assistant", True, None), ("user", False, 1),
    ("assistant user", False, 0), ("user user assistant", False, 1), ("user system", False, 1), ("system", False, 1),
    ("user assistant robot", False, 2),
])
def test_state_machine(spark, roles, valid, bad):
    r = formatted(spark, [(1, i, role, "t") for i, role in enumerate(roles.split())])[1]
    assert (r["valid"], r["bad_turn"]) == (valid, bad)


def test_nulls_ties_and_empty_table(spark):
    rows = [(1, 0, None, None), (1, None, "user", "first"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "x")]
    got = formatted(spark, rows)
    assert [(b["role"], b["text"]) for b in got[1]["back"]] == [("user", "first"), ("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[None]["n_turns"] == 1
    empty = spark.createDataFrame([], LAYOUT)
    assert chat.format_conversations(empty).count() == 0
    clash = spark.createDataFrame(rows, LAYOUT).selectExpr("*", "1 AS turns", "2 AS segments", "3 AS end")
    assert chat.format_conversations(clash).count() == 2


def test_templates_that_cannot_be_read_back_are_refused():
    with pytest.raises(ValueError):
        chat.Template(open="@@ ")


def test_another_template(spark):
    t = chat.Template(open="<|", after_role="|>", close="<|end|>", codes=(("\\", "\\b"), ("<", "\\l")), role_codes=(("|", "\\p"),),
                      loss_roles=("assistant", "tool"))
    rows = [(1, 0, "user", "<|end|>"), (1, 1, "tool", "|>x"), (1, 2, "assistant", "y")]
    r = chat.format_conversations(spark.createDataFrame(rows, LAYOUT), t).select(
        chat.read_turns(F.col("formatted"), t).alias("b"), chat.loss_text(F.col("segments"), t).alias("loss")).first()
    assert [(x["role"], x["text"]) for x in r["b"]] == [r[2:] for r in rows] and r["loss"] == "|>xy"


def test_digest_of_the_planted_conversation(spark):
    r = op4_chat_format(spark, SF).filter("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["loss_chars"] == len(text) and r["valid"]
