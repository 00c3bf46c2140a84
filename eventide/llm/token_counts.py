"""Token counts of a sentencepiece BPE model by rank-synchronous array merging.

The model writes a text as U+2581 and the text with U+2581 for every blank. No piece holds
U+2581 after another character, so a text falls into pre-tokens that never merge with
each other: a run of U+2581 and what follows it. Characters that no longer piece holds
stand alone. Pre-tokens that a task meets for the first time are laid end to end into
ragged numpy arrays and merged together. In each round every sequence applies the pair of
its best rank; what counts at the end are the surviving symbols, a character outside the
vocabulary with its UTF-8 bytes. Counts of short pre-tokens are remembered by the task.

All occurrences of a sequence's best rank are merged at once, up to the first one that
forms a pair of the same or a better rank: that pair comes before the occurrences right of
it, so the rest of the round goes through them one by one. A pair that is formed so holds
the symbol just merged, and a symbol is no longer than the longest piece. The order of
merges is the library's.

Defined results
- null text: empty, with no tokens. Every row is counted, repeated rows and null ids, too.
- the strings of control pieces are ordinary text, as the library has it.
- an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_worker

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
MARK = "▁"  # fixed value: how the model writes a blank
CACHE = 500_000  # pre-tokens whose counts a task remembers
KEPT_CHARS = 64  # longer pre-tokens are counted anew each time
CHUNK = 1 << 20  # characters of texts looked at together
NONE = np.int32(np.iinfo(np.int32).max)


class Merges:
    """The model's vocabulary as arrays: symbols, mergeable pairs and their ranks."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
        if sp.normalize(f" ﬁ  a{MARK}　 ") != f"{MARK}{MARK}ﬁ{MARK}{MARK}a{MARK}　{MARK}":
            raise ValueError("the model rewrites texts by other rules than a leading blank")
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(sp.is_unused(i) for i in ids):
            raise ValueError("the model has unused pieces")
        score = {sp.id_to_piece(i): sp.get_score(i) for i in ids}
        if any(MARK in p.lstrip(MARK) for p in score):
            raise ValueError("the model has pieces that span words")
        long = [p for p in score if len(p) > 1]
        chars = sorted(set("".join(long)) | {p for p in score if len(p) == 1})
        self.symbols = {s: i for i, s in enumerate([*chars, *long])}
        # Tokens of a symbol that survives: one, or the bytes of a character without a piece.
        self.tokens = np.array([1 if s in score else len(s.encode()) for s in self.symbols] + [0], np.int64)
        points = np.array([ord(c) for c in chars], np.int64)
        self.by_point = np.full(0x110000, len(self.symbols), np.int32)
        self.by_point[points] = np.arange(len(points))
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = {}
        for p in long:
            for cut in range(1, len(p)):
                a, b = self.symbols.get(p[:cut]), self.symbols.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (order[score[p]], self.symbols[p])
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        self.inner = np.unique([ord(p[i]) << 32 | ord(p[i + 1]) for p in long for i in range(len(p) - 1)])
        inside = set("".join(long))
        alone = "".join(chr(c) for c in range(128) if chr(c) not in inside and chr(c) != " ")
        lone = re.escape(alone)
        self.pretoken = re.compile(f"[{lone}]|{MARK}*[^{lone}{MARK}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")

    def rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; ``NONE`` if it does not merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), self.merged[at]

    def pretokens(self, text: str) -> list[str]:
        return self.pretoken.findall(MARK + text.replace(" ", MARK)) if text else []

    def count(self, words: list[str]) -> np.ndarray:
        """Number of tokens of each pre-token."""
        lengths = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        symbol = self.by_point[points]
        unknown = symbol == len(self.symbols)
        size = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        total = np.bincount(owner[unknown], size[unknown], len(words)).astype(np.int64)
        # Neighbours that no piece holds side by side never meet: cut there.
        start = np.ones(len(points), bool)
        if len(self.inner):
            both = points[:-1] << 32 | points[1:]
            at = np.minimum(np.searchsorted(self.inner, both), len(self.inner) - 1)
            start[1:] = (owner[1:] != owner[:-1]) | (self.inner[at] != both)
        survivors, where = self._merge(symbol, np.cumsum(start) - 1, owner)
        return total + np.bincount(where, self.tokens[survivors], len(words)).astype(np.int64)

    def _merge(self, symbol: np.ndarray, seq: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols and the words they belong to; ``seq`` numbers the sequences in order."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        alive, rank, into = np.ones(0, bool), None, None
        while len(symbol):
            if rank is None:  # lay out the sequences that still have a pair to merge
                n = len(symbol)
                after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
                rank, into = np.full(n + 1, NONE), np.zeros(n + 1, np.int32)
                near = seq[1:] == seq[:-1]
                r, m = self.rank(symbol[:-1], symbol[1:])
                rank[: n - 1][near], into[: n - 1][near] = r[near], m[near]
                starts = np.flatnonzero(np.append(True, ~near))
                number = np.cumsum(np.append(True, ~near)) - 1
                alive = np.ones(n, bool)
            best = np.minimum.reduceat(rank[:-1], starts)
            open_ = best < NONE
            if open_.sum() * 2 < len(starts) or alive.sum() * 2 < len(alive):
                done = alive & ~open_[number]
                out.append((symbol[done], owner[done]))
                left = alive & open_[number]
                symbol, seq, owner, rank = symbol[left], seq[left], owner[left], None
                continue
            hit = np.flatnonzero((rank[:-1] == best[number]) & open_[number])
            every = hit
            # Overlapping pairs: every second one of a run, from the left.
            apart = np.append(True, after[hit[:-1]] != hit[1:])
            at = np.arange(len(hit))
            hit = hit[(at - np.maximum.accumulate(np.where(apart, at, 0))) % 2 == 0]
            new, level, right = into[hit], rank[hit], after[hit]
            # The pairs that each merge forms with its neighbours at that moment.
            beyond, prior = after[right], before[hit]
            tail = (beyond < len(symbol)) & (number[np.minimum(beyond, len(symbol) - 1)] == number[hit])
            head = (prior >= 0) & (number[prior] == number[hit])
            ahead = symbol[prior].copy()
            touching = np.append(False, right[:-1] == prior[1:]) & head
            ahead[1:][touching[1:]] = new[:-1][touching[1:]]
            r_tail, _ = self.rank(new, symbol[np.minimum(beyond, len(symbol) - 1)])
            r_head, _ = self.rank(ahead, new)
            sooner = (tail & (r_tail <= level)) | (head & (r_head <= level))
            seen = np.cumsum(sooner) - sooner
            first = np.append(True, number[hit[1:]] != number[hit[:-1]])
            base = seen[np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))]
            go = seen == base
            stuck = np.unique(number[hit[~go]])
            hit, new, right, beyond = hit[go], new[go], right[go], beyond[go]
            symbol[hit] = new
            alive[right] = False
            rank[right] = NONE
            after[hit] = beyond
            inside = beyond < len(symbol)
            before[beyond[inside]] = hit[inside]
            if len(stuck):
                last = hit[np.searchsorted(number[hit], stuck, side="right") - 1]
                low, high = np.searchsorted(number[every], stuck), np.searchsorted(number[every], stuck, side="right")
                ends = np.append(starts, len(symbol))
                grown = [self._one_by_one(symbol, after, before, alive, rank, int(i), every[a:b], int(ends[s]), int(ends[s + 1]))
                         for i, a, b, s in zip(last, low, high, stuck)]
                hit = np.concatenate([hit, *grown])
                hit = hit[alive[hit]]
            # Fresh ranks of the pairs that begin or end at a merged symbol.
            prior = before[hit]
            touched = np.concatenate([hit, prior[prior >= 0]])
            follow = after[touched]
            ok = follow < len(symbol)
            ok[ok] = number[follow[ok]] == number[touched[ok]]
            r, m = self.rank(symbol[touched], symbol[np.where(ok, follow, 0)])
            rank[touched], into[touched] = np.where(ok, r, NONE), m
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([s for s, _ in out]), np.concatenate([o for _, o in out])


    def _one_by_one(self, symbol, after, before, alive, rank, start: int, hits: np.ndarray, low: int, high: int) -> list[int]:
        """Merges of one rank in the sequence ``low`` to ``high`` from ``start``, the last merge made, to the right."""
        pairs, never, level, grown = self.pairs, (NONE, 0), None, []

        def pair(i: int, j: int) -> tuple[int, int]:
            return pairs.get(int(symbol[i]) << 32 | int(symbol[j]), never) if low <= i and j < high else never

        def merge(i: int, j: int, new: int) -> None:
            symbol[i], alive[j], rank[j], after[i] = new, False, NONE, after[j]
            if after[j] < len(symbol):
                before[after[j]] = i

        def grow(i: int) -> None:
            while True:
                p, q = int(before[i]), int(after[i])
                left, right = pair(p, i), pair(i, q)
                if min(left[0], right[0]) > level:
                    grown.append(i)
                    return
                if left[0] <= right[0]:
                    merge(p, i, left[1])
                    i = p
                else:
                    merge(i, q, right[1])

        hits = hits[hits > start].tolist()
        level = int(rank[hits[-1]])
        grow(start)
        for i in hits:
            if alive[i]:
                j = int(after[i])
                found = pair(i, j)
                if found[0] == level:
                    merge(i, j, found[1])
                    grow(i)
        return grown


class Counter:
    """Texts -> numbers of tokens; remembers the counts of short pre-tokens."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.known: dict[str, int] = {}

    def of(self, texts: list[str]) -> list[int]:
        words = [self.merges.pretokens(t) for t in texts]
        fresh = list(set().union(*words) - self.known.keys())
        if len(self.known) + len(fresh) > CACHE:
            self.known.clear()
            fresh = list(set().union(*words))
        once = {}
        if fresh:
            found = dict(zip(fresh, self.merges.count(fresh).tolist()))
            once = {w: n for w, n in found.items() if len(w) > KEPT_CHARS}
            self.known.update(found)
        counts = [sum(map(self.known.__getitem__, w)) for w in words]
        for w in once:
            del self.known[w]
        return counts


def _counts(path: str | None):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = per_worker(("token_counts", path), lambda: Counter(Merges(path)))
        for column in batches:
            out: list[int] = []
            texts: list[str] = []
            size = 0
            for text in column:
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= CHUNK:
                    out += counter.of(texts)
                    texts, size = [], 0
            yield pa.array(out + counter.of(texts), pa.int64())

    return run


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs (doc_id, text)``."""
    n_tokens = F.arrow_udf(_counts(path), "long")
    return docs.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        n_tokens("text").alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
