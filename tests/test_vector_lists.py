"""Vector lists against exact search: full recall when exact, measured recall when not."""

import math
import random

import numpy as np
import pytest
from curata.operators import vector_lists as v


def exact(rows, queries, k):
    ints = {i: [math.floor(1024 * x) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for q in sorted(set(queries) & set(ints)):
        near = sorted((sum((a - b) ** 2 for a, b in zip(ints[q], e)), i) for i, e in ints.items() if i != q)[:k]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return out


def test_exact_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(v, "LIST_ROWS", 40)
    monkeypatch.setattr(v, "BLOCK_QUERIES", 7)
    r = random.Random(2)
    rows = [(i, [r.gauss(i % 5, 0.4) for _ in range(6)]) for i in range(300)] + [(i, [0.5] * 6) for i in range(300, 450)]
    rows += [(None, [0.1] * 6), (500, None), (520, [None] * 6), (540, [float("nan")] * 6)]
    df = spark.createDataFrame([(*x, "z") for x in rows], "vec_id long, embedding array<float>, list string")
    index = v.build(df, "vec_id", "embedding", 8)
    got = v.search(index, df.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, 2, exact=True)
    single = [(i, None if e is None else [None if x is None else float(__import__("numpy").float32(x)) for x in e]) for i, e in rows]
    assert sorted(map(tuple, got.collect())) == exact(single, range(0, 560, 20), 10)
    assert v.build(df.where("vec_id >= 500"), "vec_id", "embedding", 8) is None
    assert v.search(index, df.limit(0), "vec_id", "embedding", 10, 2, exact=True).count() == 0


@pytest.mark.parametrize("exactly", [True, False])
def test_recall(spark, exactly):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index = v.build(df, "vec_id", "embedding", 16)
    found = v.search(index, df.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, 16 if exactly else 12)
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    truth = spark.createDataFrame([(q, i) for q, _, i, _ in exact(rows, [i for i, _ in rows if i % 20 == 0], 10)], "query_id long, id long")
    share = v.recall(found, truth)
    assert share == 1.0 if exactly else 0.9 <= share < 1.0


def test_distances_held_at_a_time_are_bounded(monkeypatch):
    r = np.random.default_rng(5)
    x, q = r.integers(-9, 9, (700, 4)), r.integers(-9, 9, (90, 4))
    ids, asked, held, squared = np.arange(700), np.arange(650, 740), [], v._squared
    monkeypatch.setattr(v, "_squared", lambda a, b: held.append(squared(a, b)) or held[-1])
    want = [y.tolist() for y in v._best_pairs(x, ids, q, asked, 5)]
    held.clear()
    monkeypatch.setattr(v, "PAIRS", 2000)
    assert [y.tolist() for y in v._best_pairs(x, ids, q, asked, 5)] == want
    assert max(d.size for d in held) <= 2000 and sum(d.size for d in held) == 700 * 90
