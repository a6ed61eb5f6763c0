import random
import re

import numpy as np
import pyarrow as pa
import pytest
from curata.llm import licenses as x

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def base(t):
    w = words(t)
    return sorted((i, i + len(p.split()), label) for p, label in x.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def longest_runs(w, templates):
    """The longest run of some template that ends at each word, by comparing slices."""
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    return [max(n for n in range(i + 2) if n == 0 or tuple(w[i + 1 - n : i + 1]) in runs) for i in range(len(w))]


@pytest.mark.parametrize("lane", [3, 512])
def test_statistics_and_phrases_against_brute_force(monkeypatch, lane):
    monkeypatch.setattr(x, "LANE", lane)
    r = random.Random(lane)
    for _ in range(60):
        given = [[r.choice("abc") for _ in range(r.randint(1, 9))] for _ in range(r.randint(1, 4))]
        phrases = {" ".join(r.choice("abcd") for _ in range(r.randint(1, 3))): "p" for _ in range(2)}
        m = x.Machine([("t", " ".join(t)) for t in given], phrases)
        texts = [[r.choice("abcdx") for _ in range(r.randint(0, 30))] for _ in range(4)]
        fresh = np.concatenate([np.arange(len(t)) == 0 for t in texts]).astype(bool)
        known = m.vocabulary.to_pylist()
        flat = [w for t in texts for w in t]
        state, length = m.statistics(np.array([known.index(w) if w in known else -1 for w in flat], np.int32), fresh)
        want = [n for t in texts for n in longest_runs(t, given + [p.split() for p in phrases])]
        assert length.tolist() == want
        found = x.scan(pa.array([" ".join(t) for t in texts]), m)
        for t, (n, places, _, _) in zip(texts, found):
            assert n == len(t)
            assert [p[:2] for p in places] == sorted((i, i + len(p.split())) for p in phrases for i in range(len(t)) if t[i : i + len(p.split())] == p.split())


MIT, APACHE = x.TEMPLATES[4][1], x.TEMPLATES[1][1]


def test_labels_spans_and_scores(spark, tmp_path):
    pad = " ".join(f"pad{i}" for i in range(50))
    w = words(MIT)
    edited = " ".join([*w[:30], "gadget", *w[31:60], "extra", "words", *w[60:]])
    texts = [
        (0, f"{pad} {MIT.upper()} {pad}", "mit", ""),
        (1, f"{edited}", "mit", ""),
        (2, " ".join(w[:20]), "", ""),
        (3, f"{pad} Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc", "cc-by"),
        (4, "GNU General-Public, License; all rights reserved. All Rights Reserved", "gpl,reserved", "gpl,reserved"),
        (5, f"{APACHE}\n{MIT}", "apache,mit", ""),
        (6, None, "", ""),
        (7, "", "", ""),
        (8, "all rights. are reserved, of this software and the license", "", ""),
        (9, "the of and " * 30000 + "Released under the MIT License", "mit", ""),
        (None, "all rights reserved", "reserved", "reserved"),
        (4, "cc by", "cc-by", "cc-by"),
        (10, ("Licensed under the Apache License, Version 2.0. " + "between " * 30) * 3000, "apache", ""),
    ]
    rows = [(i, t, 2, "z") for i, t, _, _ in texts]
    spark.createDataFrame(rows, "doc_id long, text string, n_words int, licenses string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["n_words"]): r for r in x.op13_license_scan(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t, labels, base_labels in texts:
        r, b = got[i, len(words(t))], base(t)
        assert (r["labels"], r["base_labels"]) == (labels, base_labels), i
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(b), min((p[0] for p in b), default=None), max((p[0] for p in b), default=None))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (labels != "")
    df = spark.createDataFrame([(0, texts[0][1])], "doc_id long, text string")
    assert [tuple(s) for s in x.find(df).first()["licenses"]["spans"]] == [(50, 50 + len(w), "mit", 4, len(w))]
    assert x.find(df.limit(0)).count() == 0
    assert got[0, 100 + len(w)]["score"] == 1.0 > got[1, len(w) + 2]["score"] > 0.9
