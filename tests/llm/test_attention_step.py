"""A training step: its gradient by differences, and what it is taken over."""

import numpy as np
from curata.llm import attention


def test_a_step_takes_the_gradient_of_scored_positions_only():
    r = np.random.default_rng(5)
    m = attention.begin(r.integers(0, 9, 3000).astype(float), r.integers(0, 2, 3000))
    sizes = np.array([0, 3, 40, 17])
    seq, lengths = attention.sequence(m, r.integers(0, 3000, sizes.sum()), sizes)
    state = attention.state_of(m).astype(np.float32)
    x, y, _, scored = attention.windows(seq, lengths)

    def loss(flat):
        own = attention.with_state(m, flat[None])
        return -own.log_prob(own.tops(x, scored), y[scored]).astype(float).mean()

    first = attention.advance(m, state, seq, lengths, 0, 1, 10, 8, len(x))[1].astype(float) * 10  # the gradient of all windows
    for direction in (first, np.where(r.random(len(first)) < 0.5, first, 0)):
        size = 1e-2 / np.sqrt((direction**2).sum())
        slope = (loss((state[0] + size * direction).astype(np.float32)) - loss((state[0] - size * direction).astype(np.float32))) / (2 * size)
        assert abs(slope - (first * direction).sum()) < 0.02 * (first * direction).sum()
    wide = max(sum(np.size(z) for z in c) for c in _columns(m, state, seq, lengths, len(x)))
    assert wide == scored.sum() * attention.GROUPS  # it was all positions of all windows


def _columns(m, state, seq, lengths, batch):
    """The shapes of the softmax inputs of a step."""
    seen, own = [], attention._softmax_columns
    try:
        attention._softmax_columns = lambda z: (seen.append([z.copy()]), own(z))[1]
        attention.advance(m, state, seq, lengths, 0, 1, 10, 8, batch)
    finally:
        attention._softmax_columns = own
    return seen


def test_a_call_builds_the_windows_of_its_own_steps_only(monkeypatch):
    r = np.random.default_rng(6)
    m = attention.begin(r.integers(0, 9, 3000).astype(float), r.integers(0, 2, 3000))
    sizes = np.array([2000, 0, 700])
    seq, lengths = attention.sequence(m, r.integers(0, 3000, sizes.sum()), sizes)
    every, built, own = attention.windows(seq, lengths), [], attention.windows
    monkeypatch.setattr(attention, "windows", lambda *a: built.append(own(*a)) or built[-1])
    state = attention.state_of(m)
    for done in range(0, 12, 3):
        state = attention.advance(m, state, seq, lengths, done, 3, 12, 8, 20)
    assert [len(x) for x, *_ in built] == [60] * 4  # it was all 227 windows each time
    taken = np.concatenate([np.concatenate([x, y, s], 1) for x, y, _, s in built])
    want = np.concatenate([every[0], every[1], every[3]], 1)
    assert {w.tobytes() for w in taken} == {w.tobytes() for w in want}


def test_scores_far_apart_are_weighed_as_they_are():
    r = np.random.default_rng(7)
    m = attention.begin(r.integers(0, 9, 3000).astype(float), r.integers(0, 2, 3000))
    m.query *= 1000
    sizes = np.array([60, 5])
    x, _, _, scored = attention.windows(*attention.sequence(m, r.integers(0, 3000, sizes.sum()), sizes))
    e = (m.embed[x] + m.place).astype(float)
    a = (e @ m.query) @ (e @ m.key).transpose(0, 2, 1) / np.sqrt(attention.WIDTH)
    assert abs(a).max() > 200  # they were held within 60 of zero
    a = np.where(np.tri(attention.WINDOW, dtype=bool), a, -np.inf)
    a = np.exp(a - a.max(-1, keepdims=True))
    mixed = e + a / a.sum(-1, keepdims=True) @ (e @ m.value)
    want = mixed + np.tanh(mixed @ m.hidden)
    assert np.allclose(m.forward(x)[0], want, atol=0.02) and np.allclose(m.tops(x, scored), want[scored], atol=0.02)
