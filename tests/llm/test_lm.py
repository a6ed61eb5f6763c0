import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from curata.llm import attention, lm

LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def rows():
    r = random.Random(8)
    syllables = ["the", "tion", "ing", "er", "re", "on", "and"]
    words = ["".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(300)]
    docs = [(i, " ".join(r.choices(words, k=r.randint(1, 200))).capitalize(), 1) for i in range(240)]
    return docs + [(900, None, 1), (901, "", 1), (None, "the null", 1), (3, docs[3][1], 1), (902, "unique" + "x" * 50_000, 1)]


@pytest.fixture(scope="module")
def scored(spark):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lm, "UNIT_BYTES", 40_000)
        yield from _scored(spark)


def _scored(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, score int").repartition(4)
    yield lm.score(df, lm.fit(df)).collect()


def test_base_score_against_brute_force(scored):
    docs = rows()
    counts = Counter(t for i, x, _ in docs if not held(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), n, round(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x)), 6)) for i, x, _ in docs)
    assert sorted((str(r[0]), *r[1:5], round(r.base_score, 6)) for r in scored) == want


def test_every_text_has_a_score(scored):
    assert all(r.score < 0 for r in scored)


def test_scores_are_the_models_forward_pass():
    r = np.random.default_rng(1)
    counts = r.integers(0, 50, 3000).astype(float)
    m = attention.begin(counts, r.integers(0, 2, 3000))
    sizes = np.array([3, 0, 40, 15])
    ids = r.integers(0, 3000, sizes.sum())
    state = attention.advance(m, attention.state_of(m), *attention.sequence(m, ids, sizes), 0, 20, 20)
    m = attention.with_state(m, state)
    seq, lengths = attention.sequence(m, ids, sizes)
    x, y, row, scored = attention.windows(seq, lengths)
    top = m.forward(x)[0]
    want = np.zeros(len(sizes))
    for w, k in zip(*np.nonzero(scored), strict=True):
        g, n = divmod(y[w, k], attention.MEMBERS)
        for logits, at in ((top[w, k] @ m.group + m.group_bias, g), (top[w, k] @ m.member[g] + m.member_bias[g], n)):
            want[row[w]] += (logits[at] - np.log(np.exp(logits).sum())) / np.log(10)
    ends = np.cumsum(sizes)
    want += [m.share[ids[a:b]].sum() for a, b in zip(ends - sizes, ends, strict=True)]
    assert np.allclose(attention.score(m, ids, sizes), want, rtol=1e-4, atol=1e-3)


def test_windows_score_each_token_once():
    sizes = np.array([1, 5, 16, 17, 40, 29])
    seq = np.arange(sizes.sum())
    x, y, row, scored = attention.windows(seq, sizes)
    assert sorted(y[scored].tolist()) == seq.tolist()
    assert (np.bincount(row, weights=scored.sum(1)) == sizes).all()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(df, lm.fit(df)).count() == 0
