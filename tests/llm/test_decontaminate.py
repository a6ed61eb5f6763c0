import hashlib
import re

from curata.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items):
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for item, x in items:
            v = words(x)
            m = min(10, len(v))
            for k in range(len(v) - m + 1 if item is not None and v else 0):
                for s in range(len(w) - m + 1):
                    if w[s : s + m] == v[k : k + m]:
                        hit |= set(range(s, s + m))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(spark, docs, items):
    df = spark.createDataFrame(docs, "doc_id long, text string, n_words int, _x int") if docs and len(docs[0]) == 4 else spark.createDataFrame(docs, "doc_id long, text string")
    res = d.hit_counts(d.occurrences(df, spark.createDataFrame(items, "item_id long, text string"), keep=["doc_id"]))
    return sorted([tuple(r) for r in res.collect()], key=str)


A = "Zero one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, A), (2, "Short item here"), (3, "x"), (4, ""), (5, None), (None, "orphan words"), (12, "ÀÉ über straße nine"), (1, A), (7, " ".join("ab" * 20))]


def test_against_brute_force(spark, monkeypatch):
    docs = [
        (0, "before " + A.upper() + " after"),
        (1, "short ITEM, here; short-item-here"),
        (2, None),
        (3, ""),
        (4, "X"),
        (5, "orphan words"),
        (6, "ÀÉ über straße nine ÀÉ Über straße nine"),
        (7, ("pad " * 500) + A + (" tail" * 700) + " " + A[5:]),
        (8, " ".join("ab" * 40)),
        (None, A),
        (0, "before " + A.upper() + " after"),
    ]
    assert got(spark, docs, ITEMS) == brute(docs, ITEMS)
    assert got(spark, docs, []) == brute(docs, [])
    assert got(spark, [], ITEMS) == []
    assert [r[:4] for r in got(spark, [(1, A, 9, 9)], ITEMS)] == [(1, 13, 13, 1)]
    monkeypatch.setattr(d, "BLOCK_BYTES", 40)
    assert got(spark, docs, ITEMS) == brute(docs, ITEMS)
