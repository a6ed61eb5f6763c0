import math
import random
import re
from collections import Counter

import duckdb
from curata.llm import lexical as x

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


def terms(t):
    return [w.translate(LOWER) for w in TERM.findall(t or "")]


def brute(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(sum(w.values()) for _, w in held)
    df = Counter(t for _, w in held for t in w)
    out = []
    for item, text in items:
        scored = []
        for i, w in held:
            m = 100 - 25 + ((25 * sum(w.values()) * n) // total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * w[t]) // (1000 * w[t] + 12 * m)) for t in terms(text) if w[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank + 1, None if u else i, -s) for rank, (s, u, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def got(spark, docs, items, k=20, parts=3):
    df = spark.createDataFrame([(*d, 1.5, "t") for d in docs], "doc_id long, text string, score double, terms string").repartition(parts)
    q = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, rank int")
    return sorted(map(tuple, x.search(x.index(df), q, k).collect()), key=str)


def sample(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{int(r.paretovariate(0.7)) % 400}" for _ in range(3000)]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 60)))) for i in range(n)]
    docs += [(n + 1, None), (n + 2, ""), (n + 3, " .,- "), (None, docs[0][1]), (3, docs[3][1]), (n + 4, "Éa W1 w2_w3 " * 4000), (n + 5, docs[5][1].upper())]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 25)))) for i in range(30)]
    return docs, items + [(30, None), (31, ""), (32, "absent word"), (33, "w1 W1 w1"), (None, "éa w1 Éa"), (5, "w2"), (5, "w2")]


def test_against_brute_force(spark, monkeypatch):
    docs, items = sample(1, 300)
    assert got(spark, docs, items) == brute(docs, items)
    monkeypatch.setattr(x, "SHARD_BYTES", 3000)
    monkeypatch.setattr(x, "QUERY_BYTES", 700)
    assert got(spark, docs, items, 3) == brute(docs, items, 3)
    assert got(spark, docs, []) == got(spark, [], items) == got(spark, [(1, None)], items) == []


def test_non_essential_lists_are_only_probed(monkeypatch):
    import numpy as np
    import pyarrow as pa

    docs = [(i, "rare " * (i < 30) + "common " * (1 + i % 3) + "filler " * (i % 7)) for i in range(4000)]
    row = x._shard(pa.array([i for i, _ in docs]), pa.array([t for _, t in docs]))
    block = x._block(pa.array([0]), pa.array(["rare common"]))
    df = {"rare": 30, "common": 4000}
    block.weight = np.array([math.floor(1000 * math.log((2 * 4000 + 2) / (2 * df[block.words[int(t)].as_py()] + 1))) + 1 for t in block.number])
    best = x.Best(1, 20)
    total = int(np.asarray(row.column("lengths").flatten()).sum())
    assert x.search_shard(row, block, 4000, total, best) < 100
    assert best.of[0][1].max() < 30 and len(best.of[0][0]) == 20


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    assert sorted(map(tuple, x.op11_lexical_search(spark, d).collect())) == sorted(con.execute(x.ORACLE).fetchall())
