from __future__ import annotations

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from eventide.llm import token_counts as tc
from eventide.llm.queries import op11_token_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tc.MODEL))


@pytest.fixture(scope="module")
def merges():
    return tc.Merges()


def test_query_against_the_library(spark, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in op11_token_counts(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in rows:
        text = r["text"] or ""
        n = len(library.encode(text))
        want[r["doc_id"]] = (len(text.encode()), n, n > tc.LIMIT)
    assert got == want and len(rows) == len(got)


ALPHABETS = st.sampled_from([
    "ab▁ ", "aeinrst ", " \n\t", "日本語の人中 ", "=-_*#/ ", "0123 x", "éüñ́ ß", "😀🎉a ",
    "".join(map(chr, range(32, 127)))])


@given(st.lists(ALPHABETS.flatmap(lambda a: st.text(alphabet=a, max_size=40)), max_size=6))
@settings(max_examples=400, deadline=None)
def test_any_text(library, merges, parts):
    text = "".join(parts)
    assert tc.Counter(merges).of([text]) == [len(library.encode(text))]


@given(st.text(max_size=80))
@settings(max_examples=400, deadline=None)
def test_any_characters(library, merges, text):
    assert tc.Counter(merges).of([text]) == [len(library.encode(text))]


@pytest.mark.parametrize("text", [
    "a" * 50_000, " " * 50_000, "ab" * 30_000, "aab" * 9_000, "the" * 20_000, "=-" * 3000 + "=" * 9001, "\x00\n" * 5000,
    "<s></s><unk><0x0A>", "▁▁ ▁", "word " * 20_000, "xyzzy" * 4_000 + "qwerty" * 4_000])
def test_long_and_odd_texts(library, merges, text):
    assert tc.Counter(merges).of([text]) == [len(library.encode(text))]


def test_memory_is_cleared_and_long_words_are_not_kept(library, merges, monkeypatch):
    monkeypatch.setattr(tc, "CACHE", 20)
    counter = tc.Counter(merges)
    texts = [f"w{i} v{i * 7} " + "z" * 100 for i in range(60)]
    for i in range(0, 60, 5):
        assert counter.of(texts[i : i + 5]) == [len(x) for x in library.encode(texts[i : i + 5])]
        assert not any(len(w) > tc.KEPT_CHARS for w in counter.known)


def test_odd_rows(spark):
    schema = "doc_id long, text string, n_tokens string, source string"
    docs = spark.createDataFrame(
        [(1, None, "x", None), (None, "", "x", "s"), (2, "a b", None, "s"), (2, "a b", None, "s")], schema)
    got = sorted((tuple(r) for r in tc.token_counts(docs, limit=1).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (None, 0, 0, False), (2, 3, 2, True), (2, 3, 2, True)], key=str)
    assert tc.token_counts(docs.limit(0)).collect() == []
