import math
import random

import numpy as np
from curata.llm import whitening as w

SCHEMA = "vec_id long, embedding array<double>, deviation int, id string"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(parts)


def op12(spark, rows, tmp_path, name):
    frame(spark, rows).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    return w.op12_whitening(spark, f"{tmp_path}/{name}").collect()


def brute(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(len(v) for _, v in kept)
    x = [[math.floor(64 * c) + 1000000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in kept]
    n, s = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    centred = np.array([[(n * a - b) / n for a, b in zip(r, s)] for r in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in kept], n, deviation, centred, values[::-1], vectors[:, ::-1].T


def test_against_eigenvectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(w, "FAN", 2)
    r = random.Random(3)
    rows = [(i, [r.gauss(k, 1 + k / 3) for k in range(40)]) for i in range(400)]
    rows += [(None, [0.5] * 40), (7, rows[7][1]), (900, [2.0] * 39), (901, []), (902, None), (903, [None] * 40), (904, [math.nan] * 40), (905, [math.inf] * 40)]
    got = op12(spark, rows, tmp_path, "a")
    ids, n, deviation, centred, values, vectors = brute(rows)
    assert len(got) == 32 * len(ids) and {g["n"] for g in got} == {n}
    assert {g["component"] for g in got} == set(range(1, 33))
    assert sorted({(g["vec_id"], g["deviation"]) for g in got}, key=str) == sorted(set(zip(ids, deviation)), key=str)
    for k in range(32):
        own = sorted(((g["deviation"], g["whitened"]) for g in got if g["component"] == k + 1), key=lambda x: x[0])
        want = [x for _, x in sorted(zip(deviation, centred @ vectors[k] / math.sqrt(values[k])), key=lambda x: x[0])]
        mine = np.array([x for _, x in own])
        assert np.allclose(mine, want, atol=1e-8) or np.allclose(-mine, want, atol=1e-8)
        share = {g["explained"] for g in got if g["component"] == k + 1}
        assert len(share) == 1 and math.isclose(share.pop(), values[k] / values.sum(), rel_tol=1e-9)
    error = {g["identity_error"] for g in got}
    assert len(error) == 1 and error.pop() < 1e-9


def test_equal_rows_and_small_tables(spark, tmp_path):
    got = op12(spark, [(1, [0.25, 3.0])] * 3, tmp_path, "equal")
    assert [(g["component"], g["n"], g["deviation"], g["whitened"], g["explained"], g["identity_error"]) for g in sorted(got, key=lambda g: g["component"])] == [(1, 3, 0, None, None, None)] * 3 + [(2, 3, 0, None, None, None)] * 3
    got = op12(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0])], tmp_path, "two")
    assert sorted((g["vec_id"], g["component"], g["deviation"], g["explained"]) for g in got) == [(1, 1, 4096, 1.0), (1, 2, 4096, 0.0), (2, 1, 4096, 1.0), (2, 2, 4096, 0.0)]
    assert sorted(abs(g["whitened"]) for g in got if g["component"] == 1) == [1.0, 1.0]
    assert op12(spark, [(1, None)], tmp_path, "none") == []
    assert op12(spark, [], tmp_path, "empty") == []


def test_large_entries_are_exact(spark, tmp_path):
    rows = [(1, [1e140, 0.0]), (2, [-1e140, 5.0]), (3, [0.0, 0.25])]
    got = op12(spark, rows, tmp_path, "large")
    assert {g["deviation"] for g in got if g["vec_id"] == 1} == {None}
    n, sums = w.totals(w.usable(frame(spark, rows)))
    assert (n, sums) == (3, [3000000, 3000000 + 320 + 16])
    rows = [(i, [1e12 + i, float(i)]) for i in range(4)]
    deviation = brute(rows)[2]
    assert {g["vec_id"]: g["deviation"] for g in op12(spark, rows, tmp_path, "shifted")} == dict(enumerate(deviation))
