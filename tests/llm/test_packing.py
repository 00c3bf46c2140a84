from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from eventide.llm import packing
from eventide.llm.queries import op8_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


def check(pieces, texts, tokenizer, window=packing.WINDOW):
    """Every id in exactly one piece, pieces gapless in their sequence, digests right."""
    by_doc = {}
    for doc, group in pieces.groupby("doc_id", dropna=False):
        by_doc[doc] = group.sort_values("start")
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids, at = np.array(ids_of(tokenizer, text), "<u4"), 0
        for p in by_doc[doc].itertuples():
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for _, group in pieces.sort_values("offset").groupby("sequence_id"):
        assert list(group["offset"]) == [0, *group["length"].cumsum()[:-1]]
        assert group["length"].sum() <= window


def test_query_against_whole_text_encoding(spark, tokenizer):
    pieces = op8_packing(spark, SF).toPandas()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(pieces, texts, tokenizer)
    assert packing.padding(pieces) == 0.0


def test_words_apart_encode_like_the_whole_text(tokenizer):
    encode = packing.encoder()
    for text in ("", " ", "a  b\n\n c\t", "l'été d'Été 3x <|endoftext|>", "\x1ca\x85b", "日本語テキスト、です", "😀 ok", "x" * 5000,
                 " it's we'll thin  nbsp", "\r\n\r\n x", "é combining"):
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_edge_rows(spark, tokenizer):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, "word " * 9000), (4, "same"), (5, "same")], "doc_id long, text string")
    pieces = packing.pack(docs).toPandas()
    check(pieces, {1: None, 2: "", 3: "word " * 9000, 4: "same", 5: "same"}, tokenizer)
    assert packing.pack(docs.limit(0)).count() == 0
    twice = packing.pack(docs.filter("doc_id = 4").union(docs.filter("doc_id = 4"))).toPandas()
    assert len(twice) == 2 and twice["start"].tolist() == [0, 0]
    extra = docs.selectExpr("*", "1 AS start", "2 AS sequence_id")
    assert packing.pack(extra).count() == len(pieces)


def test_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(1)
    packer = packing.Packer(window=16)
    for _ in range(300):
        size = int(rng.integers(1, 16))
        costs = {}
        for level in range(16 - size + 1):
            if level == 0 or packer.count[level]:
                n = packer.count.copy()
                n[level] -= level > 0
                if level + size < 16:
                    n[level + size] += 1
                costs[level] = int((n[1:16] ** 2).sum())
        assert costs[packer.level(size)] == min(costs.values())
        packer.add(0, np.zeros(size, "<u4"))


def test_settling_early_keeps_everything():
    rng = np.random.default_rng(2)
    packer = packing.Packer(window=64, max_open=3)
    total = 0
    for doc in range(500):
        ids = rng.integers(0, 99, int(rng.integers(1, 200))).astype("<u4")
        total += len(ids)
        packer.add(doc, ids)
        assert packer.n_open <= 3
    packer.settle()
    assert sum(p[2] for p in packer.take()) == total


def test_files_give_the_order_of_sequences(spark, tokenizer, tmp_path):
    """Files of a sorted write, read back in parts: each token once, sequences in the order of the rows."""
    n = 900
    docs = spark.range(n).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), int(id % 97) * 3) AS text", "'x' AS file", "1 AS begin")
    docs.repartitionByRange(11, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/docs")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        pieces = packing.pack_files(spark.read.parquet(f"{tmp_path}/docs")).toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    check(pieces, {r["doc_id"]: r["text"] for r in docs.collect()}, tokenizer)
    assert packing.padding(pieces) == 0.0
    parts = (pieces["sequence_id"] // 2**32).groupby(pieces["doc_id"]).agg(["min", "max"]).sort_index()
    assert (parts["min"] == parts["max"]).all() and parts["min"].is_monotonic_increasing and parts["min"].nunique() >= 11
    docs.limit(0).write.parquet(f"{tmp_path}/none")
    assert packing.pack_files(spark.read.parquet(f"{tmp_path}/none")).count() == 0
