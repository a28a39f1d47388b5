"""Token counts by rank-synchronous merging of ragged arrays of symbols."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftjobs.llm.common import fine_text, sized_batches, tidy
from driftjobs.llm.pieces import MARK, PieceModel, marked_words, model_bytes

NEVER = np.int64(1) << 40
#: Distinct words whose counts a task remembers; beyond it the memory starts anew, and results stay the same.
REMEMBERED = 400_000


class MergeTable:
    """Which neighbouring symbols merge into which, at which rank (0 merges first; equal scores, equal ranks)."""

    def __init__(self, model: PieceModel):
        strings = dict(model.ids)
        for c in sorted({c for p in model.ids for c in p} - strings.keys()):
            strings[c] = len(model.pieces) + len(strings)  # occurs in pieces only
        self.pieces = len(model.pieces)
        self.width = np.int64(max(strings.values()) + 1)
        score_of = {i: model.scores[i] for i in model.ids.values()}
        order = {s: r for r, s in enumerate(sorted(set(score_of.values()), reverse=True))}
        found = {}
        for piece, merged in model.ids.items():
            for cut in range(1, len(piece)):
                left, right = strings.get(piece[:cut]), strings.get(piece[cut:])
                if left is not None and right is not None:
                    found[left * int(self.width) + right] = (order[score_of[merged]], merged)
        self.keys = np.array(sorted(found), dtype=np.int64)
        self.ranks = np.array([found[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.merged = np.array([found[k][1] for k in self.keys.tolist()], dtype=np.int64)
        owners = np.bincount(list(order[s] for s in score_of.values()), minlength=len(order))
        self.shared = owners > 1
        self.chars = np.full(0x110000, -1, dtype=np.int64)
        for s, i in strings.items():
            if len(s) == 1:
                self.chars[ord(s)] = i
        self.chars[ord(" ")] = self.chars[ord(MARK)]
        self.size = np.full(0x110000, 4, dtype=np.int64)
        self.size[:0x10000], self.size[:0x800], self.size[:0x80] = 3, 2, 1
        self.size[ord(" ")] = 3

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged symbols of pairs; rank NEVER for what doesn't merge (unknown symbols are negative)."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NEVER), np.where(hit, self.merged[at], -1)


def count_tokens(words: list[str], table: MergeTable) -> np.ndarray:
    """Tokens of each marked word: surviving symbols, and for unknown characters their bytes."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    sym, cost = table.chars[flat], table.size[flat]
    cost = np.where((sym >= 0) & (sym < table.pieces), 1, cost)
    row = np.repeat(np.arange(len(words)), lengths)
    total = np.zeros(len(words), dtype=np.int64)
    rank, into = _pairs(sym, row, table)
    while len(sym):
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.r_[starts, len(row)])
        done = least == NEVER
        if done.any():  # rows without a pair that merges leave
            gone = np.repeat(done, sizes)
            np.add.at(total, row[gone], cost[gone])
            sym, cost, row, rank, into = (x[~gone] for x in (sym, cost, row, rank, into))
            continue
        low = np.repeat(least, sizes)
        take = rank == low
        first = np.r_[True, ~take[:-1]]  # of overlapping occurrences, every second from the left
        index = np.arange(len(take))
        take &= (index - np.maximum.accumulate(np.where(first, index, 0))) % 2 == 0
        at = np.flatnonzero(take)
        several = np.bincount(row[at], minlength=len(words))[row[at]] > 1
        odd = np.zeros(len(at), dtype=bool)
        if several.any():
            odd[several] = _order_matters(at[several], take, sym, row, rank, into, table)
        if odd.any():
            slow = np.unique(row[at[odd]])
            gone = np.isin(row, slow)
            for r, a, b in zip(slow.tolist(), np.searchsorted(row, slow), np.searchsorted(row, slow, "right"), strict=True):
                total[r] = _one_by_one(sym[a:b].tolist(), cost[a:b].tolist(), table)
            sym, cost, row, rank, into = (x[~gone] for x in (sym, cost, row, rank, into))
            continue
        sym[at], cost[at] = into[at], 1
        keep = np.ones(len(sym), dtype=bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        sym, cost, row, rank, into = (x[keep] for x in (sym, cost, row, rank, into))
        at = place[at]
        renew = np.zeros(len(sym), dtype=bool)
        renew[at] = renew[np.maximum(at - 1, 0)] = True
        renew = np.flatnonzero(renew)
        rank[renew], into[renew] = _pairs_at(sym, row, renew, table)
    return total


def _order_matters(at, take, sym, row, rank, into, table) -> np.ndarray:
    """Whether merging at ``at`` makes a pair that would merge before the row's other occurrences, or several pieces share the rank."""
    before, after, twin = np.maximum(at - 1, 0), np.minimum(at + 2, len(sym) - 1), np.maximum(at - 2, 0)

    def made(left: np.ndarray, right: np.ndarray, exists: np.ndarray) -> np.ndarray:
        return np.where(exists, table.look_up(left, right)[0], NEVER)

    new = np.minimum(made(sym[before], into[at], (row[before] == row[at]) & (before != at)), made(into[at], sym[after], (row[after] == row[at]) & (after != at)))
    new = np.minimum(new, made(into[twin], into[at], (row[twin] == row[at]) & (twin != at) & take[twin]))
    return (new <= rank[at]) | table.shared[rank[at]]


def _pairs(sym: np.ndarray, row: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    return _pairs_at(sym, row, np.arange(len(sym)), table)


def _pairs_at(sym, row, at, table):
    right = np.minimum(at + 1, len(sym) - 1)
    rank, into = table.look_up(sym[at], sym[right])
    apart = (right == at) | (row[at] != row[right])
    return np.where(apart, NEVER, rank), into


def _one_by_one(sym: list[int], cost: list[int], table: MergeTable) -> int:
    """The same merges with a queue: best rank first, leftmost first among equals."""
    n = len(sym)
    following, preceding = [*range(1, n), -1], [-1, *range(n - 1)]
    version, queue = [0] * n, []

    def offer(lefts: list[int]) -> None:
        lefts = [i for i in lefts if i >= 0 and following[i] >= 0]
        if lefts:
            ranks, into = table.look_up(np.array([sym[i] for i in lefts]), np.array([sym[following[i]] for i in lefts]))
            for i, r, m in zip(lefts, ranks.tolist(), into.tolist(), strict=True):
                if r != NEVER:
                    heapq.heappush(queue, (r, i, m, version[i], version[following[i]], following[i]))

    offer(list(range(n)))
    alive = [True] * n
    while queue:
        _, i, merged, vi, vj, j = heapq.heappop(queue)
        if not (alive[i] and alive[j] and following[i] == j and version[i] == vi and version[j] == vj):
            continue
        sym[i], cost[i], alive[j] = merged, 1, False
        version[i] += 1
        following[i] = following[j]
        if following[j] >= 0:
            preceding[following[j]] = i
        offer([preceding[i], i])
    return sum(c for c, a in zip(cost, alive, strict=True) if a)


def token_count(docs: DataFrame, text_col: str, model_path: str) -> F.Column:
    """A long column: the tokens of ``text_col`` as the SentencePiece BPE model at ``model_path`` gives them.

    Nulls and empty texts have 0 tokens. Whole texts count: nothing is cut or padded, and control strings
    inside a text are ordinary text, as in the library. Within a task each distinct word is merged once.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, known = MergeTable(PieceModel(model.value)), {}
        for texts in batches:
            if len(known) > REMEMBERED:
                known.clear()
            out = np.zeros(len(texts), dtype=np.int64)
            for k, text in enumerate(texts):
                words = marked_words(text) if text else []
                known.update((w, None) for w in set(words) if w not in known)
                out[k] = -1 if words else 0
            todo = [w for w, n in known.items() if n is None]
            for at in range(0, len(todo), 50_000):
                part = todo[at : at + 50_000]
                known.update(zip(part, count_tokens(part, table).tolist(), strict=True))
            for k, text in enumerate(texts):
                if out[k] < 0:
                    out[k] = sum(map(known.__getitem__, marked_words(text)))
            yield pd.Series(out)
        known.clear()
        tidy()

    return count(fine_text(text_col))


def token_counts(docs: DataFrame, model_path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``, which replace columns of those names.

    One row for each row, repeated rows included; an empty table stays empty. Bytes that aren't UTF-8 are counted
    as tokens of U+FFFD (``fine_text``); ``n_bytes`` is of the bytes as they are.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    counted = sized_batches(docs).withColumns({"n_bytes": size, "n_tokens": token_count(docs, text_col, model_path)})
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
