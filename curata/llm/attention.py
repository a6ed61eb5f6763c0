"""A small causal self-attention language model in numpy.

Ids of a public byte-level vocabulary fall into ``GROUPS * MEMBERS`` output classes:
the commonest ids alone, the end of a text, and the others in classes by leading
space and frequency. The model predicts a class from the classes before it in a
window, as its group and then its member of the group, each by a softmax; an id's
share of its class is counted. Windows of ``WINDOW`` positions start every
``STRIDE``: the first positions of all but a text's first window are context only,
so each token is scored once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

GROUPS, MEMBERS, WINDOW, STRIDE, WIDTH = 32, 32, 16, 12, 24
#: Class numbers: the end of a text, single ids, then the last group's shared classes; the begin is an input only.
CLASSES = GROUPS * MEMBERS
END, SINGLE, BEGIN = 0, CLASSES - MEMBERS - 1, CLASSES
_MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
_CAUSAL = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_ONES = np.ones(max(WINDOW, GROUPS, MEMBERS), np.float32)


@dataclass
class Model:
    class_of: np.ndarray  # of each id
    share: np.ndarray  # log10 of each id's share of its class
    embed: np.ndarray
    place: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    hidden: np.ndarray
    group: np.ndarray
    group_bias: np.ndarray
    member: np.ndarray  # of each group
    member_bias: np.ndarray

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """What predicts the class after each position of windows of input classes, and what training needs.

        Keys are folded into the queries, and values are mixed before their product.
        """
        e = self._inputs(x)
        f = _times(e, self.fold())
        a, total = _weights(f, e)
        a /= total.reshape(len(x), WINDOW, 1)
        c = a @ e
        mixed = _times(c, self.value)
        mixed += e
        h = _times(mixed, self.hidden)
        np.tanh(h, out=h)
        return mixed + h, e, f, a, c, mixed, h

    def fold(self) -> np.ndarray:
        """Queries times keys, scaled: what stands between two positions in their score."""
        return self.query @ self.key.T * np.float32(WIDTH**-0.5)

    def tops(self, x: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """The ``top`` rows of ``forward`` at the scored positions, without what training needs."""
        e, kept = self._inputs(x), np.flatnonzero(scored)
        a, total = _weights(_times(e, self.fold()), e)
        mixed = (a @ e).reshape(-1, WIDTH).take(kept, axis=0)
        mixed /= total.take(kept)[:, None]
        mixed = mixed @ self.value
        mixed += e.reshape(-1, WIDTH).take(kept, axis=0)
        h = mixed @ self.hidden
        np.tanh(h, out=h)
        h += mixed
        return h

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        e = self.embed.take(x, axis=0)
        e += self.place
        return e

    def log_prob(self, top: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probability of class ``y`` for each row of ``top``."""
        g = (y // MEMBERS).astype(np.uint8)
        order = np.argsort(g, kind="stable")
        top, g, k = _with_ones(top, order), g[order], (y % MEMBERS)[order]
        group, member = self.outputs()
        sorted_out = np.empty(len(y), np.float32)
        for at in range(0, len(y), 1024):
            at = slice(at, at + 1024)
            sorted_out[at] = _log_softmax(top[at] @ group, g[at])
        cuts = np.searchsorted(g, np.arange(GROUPS + 1))
        for n in np.flatnonzero(np.diff(cuts)):
            for at in range(cuts[n], cuts[n + 1], 1024):
                at = slice(at, min(at + 1024, cuts[n + 1]))
                sorted_out[at] += _log_softmax(top[at] @ member[n], k[at])
        out = np.empty_like(sorted_out)
        out[order] = sorted_out
        return out

    def outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """The output weights of groups and of each group's members, above their biases."""
        return np.concatenate([self.group, self.group_bias[None]]), np.concatenate([self.member, self.member_bias[:, None]], 1)


def _with_ones(top: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The ``rows`` of ``top``, with a column of ones for the biases."""
    out = np.ones((len(rows), WIDTH + 1), np.float32)
    out[:, :WIDTH] = top.take(rows, axis=0)
    return out


def _plain(x: np.ndarray) -> bool:
    """Whether the exponentials of ``x`` and their sums are far from the bounds of single precision, so no maxima need be taken off."""
    return bool(x.size) and x.max() < 60 and x.min() > -60


def _weights(f: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights of each position's past before they are divided by their sums, and the sums of all positions in a row."""
    a = f @ e.transpose(0, 2, 1)
    if _plain(a):
        np.exp(a, out=a)
        a *= _CAUSAL
    else:
        a += _MASK
        a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
    return a, a.reshape(-1, WINDOW) @ _ONES[:WINDOW]


def _log_softmax(logits: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of ``logits``, at its column ``y``."""
    if not _plain(logits):
        logits -= logits.max(-1, keepdims=True)
    chosen = logits[np.arange(len(y)), y]
    np.exp(logits, out=logits)
    return chosen - np.log(logits @ _ONES[: logits.shape[1]])


NAMES = ("embed", "place", "query", "key", "value", "hidden", "group", "group_bias", "member", "member_bias")


def classes(counts: np.ndarray, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id's class and log10 share; unseen ids share their group's half counts."""
    order = np.argsort(-counts, kind="stable")
    class_of = np.empty(len(counts), np.int16)
    class_of[order[:SINGLE]] = 1 + np.arange(min(SINGLE, len(order)))
    rest = order[SINGLE:]
    smooth = counts + 0.1
    for side in (0, 1):
        ids = rest[spaced[rest] == side]
        mass = np.cumsum(smooth[ids]) / max(1e-9, smooth[ids].sum())
        class_of[ids] = 1 + SINGLE + side * (MEMBERS // 2) + np.minimum((mass * (MEMBERS // 2)).astype(int), MEMBERS // 2 - 1)
    total = np.bincount(class_of, weights=smooth, minlength=CLASSES)
    return class_of, np.log10(smooth / total[class_of])


def window_counts(sizes: np.ndarray) -> np.ndarray:
    """How many windows texts of ``sizes`` classes, ends included, have."""
    return 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE))


def windows(seq: np.ndarray, sizes: np.ndarray, pick: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets, rows and the scored positions of windows over texts of target classes in a row.

    ``seq`` holds each text's classes and its end; inputs are shifted by one, after a begin.
    ``pick``: the numbers of the windows to return, in their order (all, if None).
    """
    ends = np.cumsum(sizes)
    inputs = np.concatenate([np.full(1, BEGIN, seq.dtype), seq[:-1]]) if len(seq) else seq
    inputs[(ends - sizes)[sizes > 0]] = BEGIN
    count = window_counts(sizes)
    row = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    if pick is not None:
        row, number = row[pick], number[pick]
    at = (ends - sizes)[row] + number * STRIDE
    place = at[:, None] + np.arange(WINDOW)
    inside = place < ends[row][:, None]
    place = np.where(inside, place, at[:, None])
    scored = inside & ((np.arange(WINDOW) >= WINDOW - STRIDE) | (number == 0)[:, None])
    return inputs[place], seq[place], row, scored


def _times(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``x @ weights`` as one product over the rows of all windows."""
    return (x.reshape(-1, x.shape[-1]) @ weights).reshape(*x.shape[:-1], -1)


def _softmax_columns(x: np.ndarray) -> np.ndarray:
    """The softmax over the columns of each row, in place."""
    if not _plain(x):
        x -= x.max(-1, keepdims=True)
    np.exp(x, out=x)
    x /= (x @ _ONES[: x.shape[1]])[:, None]
    return x


def begin(counts: np.ndarray, spaced: np.ndarray) -> Model:
    """A model with its classes, and random parameters."""
    r = np.random.default_rng(8)
    class_of, share = classes(counts, spaced)
    f = lambda *s: (r.normal(0, 1, s) * s[0] ** -0.5).astype(np.float32)
    return Model(class_of, share, f(CLASSES + 1, WIDTH) * 4, f(WINDOW, WIDTH), f(WIDTH, WIDTH), f(WIDTH, WIDTH), f(WIDTH, WIDTH), f(WIDTH, WIDTH), f(WIDTH, GROUPS), np.zeros(GROUPS, np.float32), f(WIDTH, GROUPS * MEMBERS).reshape(WIDTH, GROUPS, MEMBERS).transpose(1, 0, 2).copy(), np.zeros((GROUPS, MEMBERS), np.float32))


def state_of(m: Model) -> np.ndarray:
    """The parameters in a row, above zeros for the two moments that ``advance`` keeps of each."""
    flat = np.concatenate([getattr(m, k).ravel() for k in NAMES])
    return np.stack([flat, np.zeros_like(flat), np.zeros_like(flat)])


def with_state(m: Model, state: np.ndarray) -> Model:
    """``m`` with the parameters of ``state``, as views of it."""
    sizes = [getattr(m, k).size for k in NAMES]
    parts = np.split(state[0], np.cumsum(sizes)[:-1])
    return replace(m, **{k: x.reshape(getattr(m, k).shape) for k, x in zip(NAMES, parts, strict=True)})


def advance(m: Model, state: np.ndarray, seq: np.ndarray, sizes: np.ndarray, done: int, steps: int, last: int, seed: int = 8, batch: int = 192) -> np.ndarray:
    """The state after steps ``done + 1`` to ``done + steps`` of ``last``: Adam on the cross-entropy of windows.

    Windows come in a random order that ``seed`` fixes, so calls that go on from each other take all of them in turn.
    ``seq`` and ``sizes`` are texts of classes, as ``windows`` takes them.
    """
    state = state.copy()
    m = with_state(m, state)
    own, first, second = state
    n_windows = int(window_counts(sizes).sum())
    pick = np.random.default_rng(seed).permutation(n_windows)[np.arange(done * batch, (done + steps) * batch) % n_windows]
    x_all, y_all, _, scored = windows(seq, sizes, pick)
    # Only scored positions have a loss. They come step by step, and by group in each.
    kept_all = np.flatnonzero(scored)
    target_all = y_all.reshape(-1)[kept_all].astype(np.intp)
    turn = kept_all // (batch * WINDOW)
    key = turn * GROUPS + target_all // MEMBERS
    order = np.argsort(key.astype(np.uint16) if steps * GROUPS < 1 << 16 else key, kind="stable")
    kept_all, target_all = kept_all[order] - turn * (batch * WINDOW), target_all[order]
    cuts_all = np.searchsorted(key[order], np.arange(steps * GROUPS + 1)).tolist()
    flat = lambda z: z.reshape(-1, z.shape[-1])
    scale, entry = np.float32(WIDTH**-0.5), np.arange(m.embed.size).reshape(m.embed.shape)
    grad, room = np.empty_like(own), np.empty_like(own)
    d = with_state(m, grad[None])
    d_member = np.empty((GROUPS, WIDTH + 1, MEMBERS), np.float32)
    for step in range(done + 1, done + steps + 1):
        turn = step - 1 - done
        x = x_all[turn * batch : (turn + 1) * batch]
        top, e, f, a, c, mixed, h = m.forward(x)
        cuts = cuts_all[turn * GROUPS : (turn + 1) * GROUPS + 1]
        kept, target = kept_all[cuts[0] : cuts[-1]], target_all[cuts[0] : cuts[-1]]
        held = [(k, slice(cuts[k] - cuts[0], cuts[k + 1] - cuts[0])) for k in range(GROUPS) if cuts[k] < cuts[k + 1]]
        t, weight, row = _with_ones(flat(top), kept), np.float32(1 / len(kept)), np.arange(len(kept))
        group, member = m.outputs()
        g = _softmax_columns(t @ group)
        g.reshape(-1)[row * GROUPS + target // MEMBERS] -= 1
        n = np.empty((len(kept), MEMBERS), np.float32)
        for k, at in held:
            np.dot(t[at], member[k], out=n[at])
        n = _softmax_columns(n)
        n.reshape(-1)[row * MEMBERS + target % MEMBERS] -= 1
        g *= weight
        n *= weight
        d_group = t.T @ g
        d_kept, d_more = g @ m.group.T, np.empty((len(kept), WIDTH), np.float32)
        d_member[:] = 0
        for k, at in held:
            np.dot(n[at], m.member[k].T, out=d_more[at])
            np.dot(t[at].T, n[at], out=d_member[k])
        d_kept += d_more
        d_mixed = np.zeros((x.size, WIDTH), np.float32)
        d_mixed[kept] = d_kept
        d_pre = np.square(flat(h))
        np.subtract(1, d_pre, out=d_pre)
        d_pre *= d_mixed
        d_mixed += d_pre @ m.hidden.T
        d_c = (d_mixed @ m.value.T).reshape(e.shape)
        d_s = d_c @ e.transpose(0, 2, 1)
        d_s *= a
        d_s -= a * (flat(d_s) @ _ONES[:WINDOW]).reshape(len(x), WINDOW, 1)
        d_f = d_s @ e
        d_e = a.transpose(0, 2, 1) @ d_c
        d_e += d_s.transpose(0, 2, 1) @ f
        d_e += d_mixed.reshape(e.shape)
        d_e += _times(d_f, m.fold().T)
        d_fold = flat(e).T @ flat(d_f)
        d_fold *= scale
        grad[: m.embed.size] = 0
        np.add.at(grad[: m.embed.size], entry.take(x, axis=0).ravel(), d_e.ravel())
        np.add.reduce(d_e, 0, out=d.place)
        np.matmul(d_fold, m.key, out=d.query)
        np.matmul(d_fold.T, m.query, out=d.key)
        np.matmul(flat(c).T, d_mixed, out=d.value)
        np.matmul(flat(mixed).T, d_pre, out=d.hidden)
        d.group[:], d.group_bias[:] = d_group[:WIDTH], d_group[WIDTH]
        d.member[:], d.member_bias[:] = d_member[:, :WIDTH], d_member[:, WIDTH]
        rate = 0.01 * min(1, step / 50) * (1 - 0.9 * step / last)
        first *= np.float32(0.9)
        first += np.multiply(grad, np.float32(0.1), out=room)
        second *= np.float32(0.99)
        grad *= grad
        grad *= np.float32(0.01)
        second += grad
        np.sqrt(np.multiply(second, np.float32(1 / (1 - 0.99**step)), out=room), out=room)
        room += np.float32(1e-8)
        np.divide(first, room, out=room)
        room *= np.float32(rate / (1 - 0.9**step))
        own -= room
    return state


def sequence(m: Model, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes of texts in a row, each with its end, and their lengths."""
    ends = np.cumsum(sizes + 1)
    seq = np.full(ends[-1] if len(ends) else 0, END, np.int16)
    real = np.ones(len(seq), bool)
    real[ends - 1] = False
    seq[real] = m.class_of[ids]
    return seq, sizes + 1


def score(m: Model, ids: np.ndarray, sizes: np.ndarray, batch: int = 128, together: int = 32) -> np.ndarray:
    """log10 probability of each text, its end included; ``ids`` of all texts in a row."""
    seq, lengths = sequence(m, ids, sizes)
    out = np.zeros(len(sizes))
    own = np.concatenate([[0.0], np.cumsum(m.share[ids])])
    stop = np.cumsum(sizes)
    out += own[stop] - own[stop - sizes]
    x, y, row, scored = windows(seq, lengths)
    for at in range(0, len(x), batch * together):
        stop = min(len(x), at + batch * together)
        use = scored[at:stop]
        tops = [m.tops(x[k : min(stop, k + batch)], scored[k : min(stop, k + batch)]) for k in range(at, stop, batch)]
        logp = m.log_prob(np.concatenate(tops), y[at:stop][use])
        out += np.bincount(np.repeat(row[at:stop], use.sum(1)), weights=logp, minlength=len(sizes)) / np.log(10)
    return out
