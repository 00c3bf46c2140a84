"""Sum-of-squares packing of tokenised documents into fixed windows.

Each partition packs its rows on their own, in one stream. A document first fills
whole windows; what is left goes into the open window (or a new one) whose choice
makes the sum over fill levels of the squared number of open windows smallest. A
level array counts the open windows of each fill. When a partition ends, its
emptiest open windows are cut up to fill the fullest ones, and the last one
becomes sequences whose lengths are powers of two, so no padding remains.

A task holds at most ``MAX_OPEN`` open windows; beyond that it settles them early
in the same way: cut windows make up to one piece more each. Sequence ids are (partition number << 32) + running number: a
task that runs again over the same rows gives the same ids. Over range-partitioned
rows the ids follow the ranges; inside a task a document may come later by the time
its window stays open.

Defined results
- null text: empty, that is the end token alone. Every row is packed, repeated
  rows included; null ids stay null.
- texts are ordinary text throughout: a special token's string is not special.
"""

from __future__ import annotations

import base64
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import land, per_worker

WINDOW = 2048
END = 1
MAX_OPEN = 4096
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"  # the same vocabulary
CACHE = 500_000  # words whose ids a task remembers

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

# Plain characters: those that the tokenizer's word pattern and Python class alike, with
# no white space but the blank and the line end. Other texts are encoded whole.
_ODD = re.compile("[^\\n\\x20-\\x7e\\xa1-\\u167f\\u2010-\\u2027\\u3041-\\u30ff\\u4e00-\\u9fa5\\uac00-\\ud7a3]")


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Known(dict):
    """Ids of words after ``lead``, found when first asked for. No word may be empty."""

    def __init__(self, lead: str, encode: Callable[[str], list[int]]):
        self.lead, self.encode = lead, encode

    def __missing__(self, word: str) -> bytes:
        if not word:
            raise KeyError(word)
        if len(self) > CACHE:
            self.clear()
        ids = self[word] = _packed(self.encode(self.lead + word))
        return ids


def encoder(path: str | None = None) -> Callable[[str], bytes]:
    """Text -> token ids of the tokenizer at ``path`` (by default the 50k byte-level BPE),
    as little-endian 32-bit numbers.

    The default tokenizer splits a text into words by a pattern and encodes each word on
    its own. A single blank between two visible characters always begins a word, and a
    single line end is one, so such pieces are encoded apart and remembered; their ids come
    from the same vocabulary as a rank table. Texts with other white space go through the
    tokenizer as a whole.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
    tokenizer.encode_special_tokens = True

    def whole(text: str) -> bytes:
        return _packed(tokenizer.encode(text, add_special_tokens=False).ids)

    if path:
        return whole
    import tiktoken

    with open(public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    words = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    piece = words._core_bpe.encode_ordinary  # without the wrapper's handling of lone surrogates, which texts cannot hold
    first, later = _Known("", piece), _Known(" ", piece)
    line_end = _packed(piece("\n"))

    def encode(text: str) -> bytes:
        if _ODD.search(text):
            return whole(text)
        out: list[bytes] = []
        try:
            for i, line in enumerate(text.split("\n")):
                if i:
                    out.append(line_end)
                words = line.split(" ")
                out.append(first[words[0]])
                if len(words) > 1:
                    del words[0]
                    out += map(later.__getitem__, words)
        except KeyError:  # neighbouring, leading or trailing white space
            return whole(text) if text else b""
        return b"".join(out)

    return encode


class Packer:
    """Packs id arrays one after the other; ``take`` hands over finished sequences."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN, first_id: int = 0):
        self.window, self.max_open, self.next_id = window, max_open, first_id
        self.count = np.zeros(window + 1, np.int64)  # open windows of each fill level
        self.open: list[list[list]] = [[] for _ in range(window)]  # the windows themselves
        self.n_open = 0
        self.done: list[tuple] = []

    def _close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def level(self, size: int) -> int:
        """The fill level to add ``size`` to: least sum of squared level counts."""
        n, top = self.count, self.window - size
        change = 2 * n[size : self.window + 1].copy() + 1
        change[top] = 0  # a full window leaves the levels
        change[1 : top + 1] -= 2 * n[1 : top + 1] - 1
        usable = n[: top + 1] > 0
        usable[0] = True
        return int(np.argmin(np.where(usable, change, np.iinfo(np.int64).max)))

    def add(self, doc, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.window:
            self._close([(doc, start, ids[start : start + self.window], total)])
            start += self.window
        size = total - start
        if not size:
            return
        level = self.level(size)
        if level:
            pieces = self.open[level].pop()
            self.count[level] -= 1
        else:
            pieces = []
            self.n_open += 1
        pieces.append((doc, start, ids[start:], total))
        if level + size == self.window:
            self._close(pieces)
            self.n_open -= 1
        else:
            self.open[level + size].append(pieces)
            self.count[level + size] += 1
        if self.n_open > self.max_open:
            self.settle()

    def settle(self) -> None:
        """Fill the fullest open windows by cutting up the emptiest."""
        rest = [(level, pieces) for level in range(1, self.window) for pieces in self.open[level]]
        self.open = [[] for _ in range(self.window)]
        self.count[:] = 0
        self.n_open = 0
        low, high = 0, len(rest) - 1
        while low < high:
            fill, pieces = rest[high]
            while fill < self.window and low < high:
                size, source = rest[low]
                room = self.window - fill
                doc, start, ids, total = source.pop()
                if len(ids) > room:
                    source.append((doc, start, ids[:-room], total))
                    doc, start, ids = doc, start + len(ids) - room, ids[-room:]
                pieces.append((doc, start, ids, total))
                fill += len(ids)
                rest[low] = (size - len(ids), source)
                if not source:
                    low += 1
            rest[high] = (fill, pieces)
            if fill == self.window:
                self._close(pieces)
                high -= 1
        if low == high:
            self._powers(rest[low][1])

    def _powers(self, pieces: list) -> None:
        """Cut one open window into sequences whose lengths are powers of two."""
        left = sum(len(p[2]) for p in pieces)
        pieces = pieces[::-1]
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            taken = []
            while room:
                doc, start, ids, total = pieces.pop()
                if len(ids) > room:
                    pieces.append((doc, start + room, ids[room:], total))
                    ids = ids[:room]
                taken.append((doc, start, ids, total))
                room -= len(ids)
            self._close(taken)

    def take(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


_LAST = _packed([END])


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of ``docs (doc_id, text)``; each token lies in exactly one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, first_id=TaskContext.get().partitionId() << 32)
        encode = per_worker(("packing", path), lambda: encoder(path))
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc, np.frombuffer(encode(text.as_py() or "") + _LAST, "<u4"))
                if len(packer.done) >= 20_000:
                    yield _batch(packer.take())
        packer.settle()
        yield _batch(packer.take())

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def pack_files(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Like ``pack`` for rows read from files, with sequences numbered in the order of the files.

    Spark gives a task parts of several files, in no order. Each part is packed on its own
    under a number within it; the parts are numbered afterwards, by file and place in it, in a
    table with a row per part. So rows that were written in an order keep it without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = per_worker(("packing", path), lambda: encoder(path))
        packer, part = Packer(window), None

        def close() -> pa.RecordBatch:
            rows = _batch(packer.take())
            held = [pa.array([part[i]] * rows.num_rows, kind) for i, kind in ((0, pa.string()), (1, pa.int64()))]
            return pa.RecordBatch.from_arrays([*rows.columns, *held], names=[*rows.schema.names, "file", "begin"])

        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), batch.column(1))
            for doc, file, begin, text in rows:
                if (file, begin) != part:
                    if part is not None:
                        packer.settle()
                        yield close()
                    packer, part = Packer(window), (file, begin)
                packer.add(doc, np.frombuffer(encode(text.as_py() or "") + _LAST, "<u4"))
                if len(packer.done) >= 20_000:
                    yield close()
        if part is not None:
            packer.settle()
            yield close()

    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), "text", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("begin"))
    pieces = land(rows.mapInArrow(run, f"{SCHEMA}, file string, begin long"), "packing-pieces")
    number = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("long")  # how Spark names the files of a write
    parts = pieces.select("file", "begin").distinct()  # one row per part of a file
    parts = parts.withColumn("part", F.row_number().over(W.orderBy(number, "file", "begin")) - 1)
    return pieces.join(F.broadcast(parts), ["file", "begin"]).withColumn(
        "sequence_id", F.shiftleft(F.col("part").cast("long"), 32) + F.col("sequence_id")).select(*_ARROW.names)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], schema=_ARROW)


def padding(pieces: pd.DataFrame, window: int = WINDOW) -> float:
    """Share of padding: a sequence is padded to the window unless its length is a power of two."""
    fill = pieces.groupby("sequence_id")["length"].sum().to_numpy()
    padded = np.where(fill & (fill - 1) == 0, fill, window)
    return float((padded - fill).sum() / padded.sum()) if len(fill) else 0.0
