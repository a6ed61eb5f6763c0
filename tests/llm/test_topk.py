import math
import random

from curata.llm import topk


def brute(rows, queries, k):
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in [r for r in ints if queries(r[0])]:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(260)] + [(i, [0.5] * 8) for i in range(300, 430)]
    rows += [(500, None), (600, [None] * 8), (700, [float("nan")] * 8), (None, [0.5] * 8), (800, [0.25] * 3), (801, [0.25] * 3), (0, rows[0][1])]
    monkeypatch.setattr(topk, "QUERY_BYTES", 32)
    monkeypatch.setattr(topk, "TILE_ROWS", 50)
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    got = topk.search(df, df.where("vec_id % 100 = 0"), 10).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i % 100 == 0, 10)
    assert topk.search(df.limit(0), df.limit(0), 10).count() == 0
