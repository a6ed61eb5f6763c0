"""Merge replay: byte-pair merges of many words at once, through an inverted index.

All words lie in one symbol array, each followed by a separator. The index leads
from a pair's rank to the positions where the pair begins. Ranks are taken in
order, the lowest that occurs anywhere first; all its occurrences merge at once,
from the left where they overlap, and only the pairs with the left and the right
neighbour are looked up again. For each word this is the order that merging its
lowest-ranked pair again and again gives, as words don't touch one another.
"""

from __future__ import annotations

import heapq

import numpy as np

from curata.llm import common as c

NONE = np.int32(2**31 - 1)
_BITS = 20


class PairTable:
    """(left, right) -> (rank, merged id), looked up for whole arrays."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array(list(pairs), np.int64).reshape(-1, 2)
        self.codes = np.concatenate([(keys[:, 0] << 32) | keys[:, 1], [-1]])
        values = np.array(list(pairs.values()), np.int64).reshape(-1, 2)
        self.rank = np.concatenate([values[:, 0].astype(np.int32), [NONE]])
        self.merged = dict(zip(values[:, 0].tolist(), values[:, 1].tolist(), strict=True))
        self.levels: list[np.ndarray] = []
        left = np.arange(len(keys))
        while len(left):
            level = np.full(1 << _BITS, len(keys), np.int32)
            slot = self._slot(self.codes[left], len(self.levels))
            level[slot] = left
            self.levels.append(level)
            left = left[level[slot] != left]

    @staticmethod
    def _slot(codes: np.ndarray, level: int) -> np.ndarray:
        return (c.mix(codes.astype(c.U64) + c.U64(level * 0x9E3779B9)) >> c.U64(64 - _BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where there is no merge; negative symbols never merge."""
        codes = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(len(codes), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        for k, level in enumerate(self.levels):
            if not len(todo):
                break
            at = level[self._slot(codes[todo], k)]
            hit = self.codes[at] == codes[todo]
            out[todo[hit]] = self.rank[at[hit]]
            todo = todo[~hit]
        return out


def replay(symbols: np.ndarray, sizes: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge the words of ``sizes`` symbols that follow one another; returns ids and sizes."""
    words, total = len(sizes), int(sizes.sum())
    if not total:
        return np.zeros(0, np.int32), np.zeros(words, np.int64)
    where = np.arange(total) + np.repeat(np.arange(words), sizes) + 1
    n = total + words + 1
    sym = np.full(n, -1, np.int32)
    sym[where] = symbols
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    rank_at = np.full(n, NONE, np.int32)
    rank_at[:-1] = table.ranks(sym[:-1], sym[1:])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def put(at: np.ndarray) -> None:
        ranks = rank_at[at]
        some = ranks != NONE
        at, ranks = at[some], ranks[some]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
            if rank in index:
                index[rank].append(part)
            else:
                index[rank] = [part]
                heapq.heappush(heap, rank)

    put(np.arange(n, dtype=np.int32))
    while heap:
        rank = heapq.heappop(heap)
        parts = index.pop(rank)
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        at = at[rank_at[at] == rank]
        if not len(at):
            continue
        if len(at) > 1 and (overlap := after[at[:-1]] == at[1:]).any():
            fresh = np.concatenate([[True], ~overlap])
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
        gone = after[at]
        sym[at] = table.merged[rank]
        sym[gone] = -2
        rank_at[gone] = NONE
        follow = after[gone]
        after[at] = follow
        before[follow] = at
        left = before[at]
        rank_at[at] = table.ranks(sym[at], sym[after[at]])
        rank_at[left] = table.ranks(sym[left], sym[at])
        put(np.unique(np.concatenate([at, left])))
    out = sym[where]
    kept = out >= 0
    word = np.repeat(np.arange(words), sizes)[kept]
    return out[kept], np.bincount(word, minlength=words).astype(np.int64)
