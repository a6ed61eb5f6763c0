import random
import re

from curata.llm import jaccard as j
from curata.llm.graph import components

LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 10 * min(len(x), len(y)) >= 9 * max(len(x), len(y)) and 100 * len(x & y) >= 90 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def corpus(seed, families, copies):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(900)]
    docs = []
    for _ in range(families):
        base = [r.choice(vocabulary) for _ in range(r.choice([9, 11, 12, 13, 20, 40, 80, 160, 400]))]
        for _ in range(r.randint(1, copies)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                p = r.randrange(len(w))
                w[p : p + 1] = r.choice([[], [r.choice(vocabulary)], [w[p], r.choice(vocabulary)]])
            docs.append(" ".join(w).upper() if r.random() < 0.2 else "  ".join(w))
    r.shuffle(docs)
    return list(enumerate(docs))


def test_against_brute_force(spark, monkeypatch):
    docs = corpus(1, 70, 14) + [(5000, None), (5001, ""), (5002, " \n"), (5003, "one two"), (5004, "ONE\ttwo"), (5005, "one"), (5006, "very " * 9000 + "long"), (5007, "very " * 8000 + "long")]
    frame = lambda rows: spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, n long, h long").repartition(5)
    want = brute(docs)
    assert sorted(map(tuple, j.near_duplicates(frame(docs)).collect())) == want
    assert len({x[2] for x in want}) < len(want) - 100
    monkeypatch.setattr(j, "TILE", 3)
    assert sorted(map(tuple, j.near_duplicates(frame(docs)).collect())) == want
    extra = frame([(None, docs[0][1]), docs[0]])
    got = [tuple(r) for r in j.near_duplicates(extra).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, len(shingles(docs[0][1])), None), (0, len(shingles(docs[0][1])), 0)]))
    assert j.near_duplicates(frame(docs).limit(0)).count() == 0


def test_keys_reach_every_linked_pair():
    import pyarrow as pa

    docs = corpus(7, 150, 9)
    h, sizes, begin = j.shingle_sets(pa.array([t for _, t in docs]))
    key, count = j.segment_keys(h, sizes)
    ends = count.cumsum()
    keys = [set(key[e - n : e].tolist()) for e, n in zip(ends, count)]
    sets = [h[b : b + n] for b, n in zip(begin, sizes)]
    for a in range(len(docs)):
        for b in range(a):
            if sizes[a] and abs(int(sizes[a]) - int(sizes[b])) * 9 <= sizes[a] and j.linked(sets[a], sets[b]):
                assert keys[a] & keys[b] or set(sets[a].tolist()) == set(sets[b].tolist())


def test_components(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 40)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(200)] + [(9, 9), (0, 1)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in list(root))
