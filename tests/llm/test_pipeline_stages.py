from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline as C
from eventide.llm import minhash_dedup, mixing, packing, quality
from eventide.llm.common import land
from eventide.llm.queries import QUALITY_CUT, quality_model

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in C.STAGES:
        docs = land(stage(spark, docs, SF), f"test-{name}")
        out[name] = docs
    return out


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_stage_order_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    for name in ("quality", "line_dedup", "near_dedup", "mixing"):
        assert stages[name].columns == stages["documents"].columns


def test_quality_keeps_the_good(spark, stages):
    model = quality_model(spark, stages["documents"], SF)
    before, after = rows(stages["documents"]), rows(stages["quality"])
    assert set(after) == {d for d, r in before.items() if model.score(quality.describe(r["text"])[None])[0] >= QUALITY_CUT}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in after for d in good) >= 0.97 * len(good)
    assert sum(d in after for d, q in labels.items() if q == 0) <= 0.1 * sum(q == 0 for q in labels.values())


def test_line_dedup_by_brute_force(stages):
    before, after = rows(stages["quality"]), rows(stages["line_dedup"])
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    owner = {}
    for d in sorted(before):
        for line in (before[d]["text"] or "").split("\n"):
            owner.setdefault(key(line), d)
    for d, r in before.items():
        kept = "\n".join(x for x in (r["text"] or "").split("\n") if len(key(x)) < 10 or owner[key(x)] == d)
        assert (after[d]["text"] or "") == kept and after[d]["n_chars"] == len(kept)
    assert set(before) == set(after)


def test_near_dedup_keeps_one_of_each_group(spark, stages):
    from test_minhash import brute

    before = [(r["doc_id"], r["text"]) for r in stages["line_dedup"].collect()]
    idf = minhash_dedup.inverse_frequency(minhash_dedup.word_frequencies(stages["line_dedup"].select("text")))
    assert set(rows(stages["near_dedup"])) == {rep for _, rep in brute(before, idf)}


def test_mixing_keeps_every_row(stages):
    assert rows(stages["mixing"]) == rows(stages["near_dedup"])


def test_packing_holds_every_token(stages):
    from test_packing import check, public_tokenizers, Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    pieces = stages["packing"].toPandas()
    check(pieces, {d: r["text"] for d, r in rows(stages["mixing"]).items()}, tokenizer)
    assert packing.padding(pieces) == 0.0


LAYOUT = "doc_id long, text string, lang string, source string, n_chars long, line string, rank long, slot long, sig binary"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "word " * 60_000, "en", "a", 300_000), (None, "a text of several words here", "en", None, 28),
       (4, "a text of several words here", "en", "b", 28), (4, "a text of several words here", "en", "b", 28), (5, "\n\n", "fr", "b", 2)]


@pytest.mark.parametrize("name,stage", C.STAGES)
@pytest.mark.parametrize("data", [[], ODD])
def test_stages_take_odd_tables(spark, name, stage, data):
    docs = spark.createDataFrame([(*r, "clash", 1, 2, None) for r in data], LAYOUT)
    out = stage(spark, docs, SF)
    n = out.count()
    assert (n == 0) == (not data) or name == "quality"
    if name != "packing":
        assert out.columns == docs.columns and n <= len(data)


def test_sequences_follow_the_mix(spark):
    rng = np.random.default_rng(5)
    sizes = {"a": 2400, "b": 900, "c": 300}
    data = [(f"{s} " + "word " * int(rng.integers(1, 90)), s) for s, n in sizes.items() for _ in range(n)]
    docs = spark.createDataFrame([(i, text, "en", s, len(text)) for i, (text, s) in enumerate(data)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    settings = {"spark.sql.shuffle.partitions": "12", "spark.sql.files.openCostInBytes": "1",
                "spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        mixed = land(C.mix_sources(spark, docs, SF), "test-order")
        assert len(mixed.inputFiles()) > 4
        pieces = land(C.pack_windows(spark, mixed, SF), "test-order-packed").toPandas()
        slots = mixing.place(docs).select("row.doc_id", "slot", "in_block", "source_key").toPandas().set_index("doc_id")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    pieces["task"] = pieces["sequence_id"] // 2**32
    task = pieces.groupby("doc_id")["task"].agg(["min", "max"])
    assert (task["min"] == task["max"]).all() and task["min"].nunique() > 4 and len(task) == len(data)
    order = slots.sort_values(["slot", "in_block"])
    assert task.loc[order.index, "min"].is_monotonic_increasing
    # While all sources last, each task's sequences hold the target shares but for a block on either side.
    target = {s: n**0.5 / sum(m**0.5 for m in sizes.values()) for s, n in sizes.items()}
    ends = order[order["source_key"] == "c"]["slot"].max()
    order["task"] = task["min"]
    for _, part in order.groupby("task"):
        if part["slot"].max() < ends:
            for s, share in target.items():
                assert abs((part["source_key"] == s).sum() - share * len(part)) <= 2 * mixing.BLOCK
