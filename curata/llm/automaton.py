"""Byte-pair merges compiled to a deterministic transducer.

The automaton reads symbols. Its states are the prefixes of tokens, its transitions
lead to the longest token prefix that ends at the symbol read. A prefix of a word has one
encoding, whose last token is one of the tokens that end there: the one that stands
beside the last token of what precedes it, which holds for exactly one of them. So a
transition also emits: the tokens of the prefix number one more than those of what
precedes its last token. Which tokens stand side by side is compiled from the merges:
two do, unless a merge across their border comes before one that formed them.

Words are chunks: many are read side by side, a symbol each a step, all from the begin
state. A word of more than ``PIECE`` symbols is cut, and each cut part is read from the
begin state ``WARM`` symbols early. Where it has come to the same last tokens as the part
before it, over a token's length, its map of states is constant and only counts are left to
add, in a prefix sum. A word with a part that has not is left to the caller.
"""

from __future__ import annotations

import numpy as np

from curata.llm.replay import NONE, PairTable

PIECE, WARM = 512, 128


class Automaton:
    """Compiled from ``pairs``, (left, right) to (rank, merged), over the tokens ``symbols`` that no merge gives.

    ``longest`` is the most symbols of a token.
    """

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], symbols: np.ndarray):
        self.table = PairTable(pairs)
        size = 1 + max([*symbols.tolist(), *(m for _, m in pairs.values())])
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        spell: list[tuple[int, ...]] = [()] * size
        for k in symbols.tolist():
            spell[k] = (k,)
        for (a, b), (rank, merged) in sorted(pairs.items(), key=lambda x: x[1][0]):
            if self.rank[merged] < 0:  # the first merge that gives a token is the one that its encoding uses
                self.rank[merged], self.left[merged], self.right[merged] = rank, a, b
                spell[merged] = spell[a] + spell[b]
        self.length = np.array([len(s) for s in spell], np.int64)
        self.longest = int(self.length.max())
        # Prefix states, numbered breadth first so that failures come before what needs them.
        child: dict[tuple[int, int], int] = {}
        token_at, depth = [-1], [0]
        for token in np.argsort(self.length, kind="stable").tolist():
            state = 0
            for s in spell[token]:
                following = child.get((state, s))
                if following is None:
                    following = child[state, s] = len(token_at)
                    token_at.append(-1)
                    depth.append(depth[state] + 1)
                state = following
            if spell[token]:
                token_at[state] = token
        fail = [0] * len(token_at)
        for (state, s), following in sorted(child.items(), key=lambda x: depth[x[1]]):
            if state:
                back = fail[state]
                while back and (back, s) not in child:
                    back = fail[back]
                fail[following] = child.get((back, s), 0)
        #: The longest token that ends at a state, and for a token the next shorter one that ends with it.
        ends = [-1] * len(token_at)
        self.shorter = np.full(size, -1, np.int64)
        for state in np.argsort(depth, kind="stable").tolist():
            token = token_at[state]
            ends[state] = token if token >= 0 else ends[fail[state]] if state else -1
            if token >= 0 and state:
                self.shorter[token] = ends[fail[state]]
        self.fail, self.ends = np.array(fail, np.int64), np.array(ends, np.int64)
        self.step = PairTable({k: (v, v) for k, v in child.items()})

    def follow(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        out = np.zeros(len(states), np.int64)
        todo, now = np.arange(len(states)), states
        while len(todo):
            found = self.step.ranks(now, symbols[todo])
            hit = found != NONE
            out[todo[hit]] = found[hit]
            rest = ~hit & (now > 0)
            todo, now = todo[rest], self.fail[now[rest]]
        return out

    def adjacent(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens ``a`` and ``b`` stay apart when side by side.

        The border is followed through the merges that formed them, latest first; a merge across
        it that comes before the last one undone would have been made in its place. Of equal ranks
        the left occurrence merges first.
        """
        out = np.ones(len(a), bool)
        todo, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), 2 * int(NONE), np.int64)
        while len(todo):
            across = 2 * self.table.ranks(a, b).astype(np.int64)
            made = across < limit
            out[todo[made]] = False
            ra, rb = self.rank[a], self.rank[b]
            rest = ~made & ((ra >= 0) | (rb >= 0))
            todo, a, b, ra, rb = todo[rest], a[rest], b[rest], ra[rest], rb[rest]
            split_a = ra >= rb
            # A merge across at the left token's own rank would be to its right, so later.
            limit = np.minimum(limit[rest], np.where(split_a, 2 * ra, 2 * rb + 1))
            a = np.where(split_a, self.right[a], a)
            b = np.where(split_a, b, self.left[b])
        return out

    def _read(self, symbols: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Last token and number of tokens of every prefix of every word; word ``k``'s prefix of ``i`` symbols is at ``base[k] + i``."""
        base = np.cumsum(sizes + 1) - (sizes + 1)
        last = np.full(int((sizes + 1).sum()), -1, np.int64)
        count = np.zeros(len(last), np.int64)
        order = np.argsort(-sizes, kind="stable")
        falling = -sizes[order]
        state = np.zeros(len(sizes), np.int64)
        for i in range(int(sizes.max(initial=0))):
            live = order[: int(np.searchsorted(falling, -i, "left"))]
            state[live] = s = self.follow(state[live], symbols[begin[live] + i])
            token = self.ends[s]
            todo = np.flatnonzero(token >= 0)
            at = base[live] + i + 1
            while len(todo):
                t = token[todo]
                before = at[todo] - self.length[t]
                first = before == base[live[todo]]
                ok = first.copy()
                inner = np.flatnonzero(~first)
                ok[inner] = (last[before[inner]] >= 0) & self.adjacent(last[before[inner]], t[inner])
                last[at[todo[ok]]] = t[ok]
                count[at[todo[ok]]] = count[before[ok]] + 1
                todo = todo[~ok]
                token[todo] = self.shorter[token[todo]]
                todo = todo[token[todo] >= 0]
        return base, last, count

    def counts(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of tokens of each word, and which words' parts did not come together (their numbers are void)."""
        begin, piece, early = np.cumsum(sizes) - sizes, max(PIECE, 4 * self.longest), max(WARM, 2 * self.longest)
        parts = np.maximum(1, -(-sizes // piece))
        word = np.repeat(np.arange(len(sizes)), parts)
        number = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, stop = number * piece, np.minimum((number + 1) * piece, sizes[word])
        warm = np.where(number > 0, early, 0)
        base, last, count = self._read(symbols, begin[word] + start - warm, stop - start + warm)
        total = count[base + stop - start + warm] - count[base + warm]
        bad = np.zeros(len(sizes), bool)
        bad[word[(last[base + stop - start + warm] < 0) & (sizes[word] > 0)]] = True
        later = np.flatnonzero(number > 0)
        if len(later):
            window = np.arange(self.longest + 1)
            mine = last[(base + warm)[later][:, None] - window]
            before = last[(base + stop - start + warm)[later - 1][:, None] - window]
            bad[word[later[(mine != before).any(1)]]] = True
        return np.bincount(word, weights=total, minlength=len(sizes)).astype(np.int64), bad
