import re
from functools import partial

import corpus_pipeline as p
import pyarrow as pa
import pytest
from curata.llm import common
from curata.llm import jaccard as j
from test_jaccard import LOWER, corpus

DIR = "/root/testdata/sf0.001"


def shingles(t, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(docs, words, percent):
    sets = {i: shingles(t, words) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                q, r = sorted((find(a), find(b)))
                root[r] = q
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def test_stage_takes_five_words_and_four_fifths(spark):
    docs = common.table(spark, DIR, "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(r.doc_id for r in dict(p.STAGES)["near_duplicates"](spark, docs, DIR).collect())
    assert got == sorted({c for _, _, c in brute(texts, 5, 80)})
    assert got != sorted({c for _, _, c in brute(texts, 3, 90)})


def test_parameters_against_brute_force(spark, monkeypatch):
    docs = corpus(5, 50, 12) + [(5000, "a b c d e f g h i"), (5001, "a b c d e f g h")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, j.near_duplicates(frame, words=5, percent=80).collect())) == brute(docs, 5, 80)
    monkeypatch.setattr(j, "TILE", 3)
    assert sorted(map(tuple, j.near_duplicates(frame, words=2, percent=60).collect())) == brute(docs, 2, 60)


@pytest.mark.parametrize("words, percent", [(5, 80), (2, 60), (4, 95)])
def test_keys_reach_every_linked_pair(words, percent):
    docs = corpus(11, 120, 9)
    h, sizes, begin = j.shingle_sets(pa.array([t for _, t in docs]), words)
    key, count = j.segment_keys(h, sizes, percent)
    keys = [set(key[e - n : e].tolist()) for e, n in zip(count.cumsum(), count)]
    sets = [h[b : b + n] for b, n in zip(begin, sizes)]
    same = partial(j.linked, percent=percent)
    for a in range(len(docs)):
        for b in range(a):
            if same(sets[a], sets[b]):
                assert keys[a] & keys[b] or set(sets[a].tolist()) == set(sets[b].tolist())


def test_rows_of_one_id_go_by_their_own_texts(spark):
    a, b = (" ".join(f"{k}{n}" for n in range(60)) for k in "ab")
    rows = [(0, a + " y"), (1, a), (1, b), (5, a + " z"), (6, b + " z"), (6, b + " z"), (7, None)]
    got = j.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=90).collect()
    assert sorted((r[0], r[2]) for r in got) == [(0, 0), (1, 0), (1, 1), (5, 0), (6, 1), (6, 1), (7, 7)]


def test_bitmaps_let_every_linked_pair_pass():
    docs = corpus(13, 60, 9)
    h, sizes, begin = j.shingle_sets(pa.array([t for _, t in docs]), 2)
    bits, width = j.bitmaps(h, sizes)
    ends = (width // 8).cumsum()
    maps = [bits[e - n : e].tobytes() for e, n in zip(ends, width // 8)]
    part = j.possible(sizes, maps, 60)
    sets = [h[b : b + n] for b, n in zip(begin, sizes)]
    pairs = [(a, b) for a in range(len(docs)) for b in range(a) if j.linked(sets[a], sets[b], 60)]
    assert all(part[a] == part[b] for a, b in pairs)
    assert len(set(part.tolist())) > 20


def test_small_steps_give_the_same(spark, monkeypatch):
    docs = corpus(17, 40, 12)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs, 5, 80)
    for name, value in (("SKETCH_TILE", 4), ("FLUSH_KEYS", 50), ("TILE", 2)):
        monkeypatch.setattr(j, name, value)
        assert sorted(map(tuple, j.near_duplicates(frame, words=5, percent=80).collect())) == want
