"""Bundles within a budget against a plain loop."""

import hashlib
import random
import re

from curata.operators import bundles as b


def score(t):
    low = t.lower()
    return sum(n for w, n in b.WORDS.items() if w in low) + sum(w in low for w in b.STATISTICS) + min(len(re.findall(r"\d+\.?\d*", t)) * 0.5, 3)


def plain(chunks, most):
    papers = {}
    for key, section, place, text in chunks:
        if section in b.SECTIONS and text is not None:
            papers.setdefault(key, {}).setdefault(section, []).append((place, text))
    out = []
    for key, sections in papers.items():
        used, kept = 0, []
        for name in b.SECTIONS:
            if name not in sections:
                continue
            own = sorted(sections[name])
            size = len("\n\n".join(t for _, t in own))
            if used + size <= most:
                kept.append((name, [p for p, _ in own], size))
            elif used >= most:
                break
            else:
                taken, n = [], 0
                for p, t in sorted(own, key=lambda x: (-score(x[1]), x[0])):
                    if n + len(t) > most - used:
                        break
                    taken.append((p, t))
                    n += len(t)
                kept.append((name, [p for p, _ in taken], len("\n\n".join(t for _, t in taken))))
            used += kept[-1][2]
        sizes = {n: s for n, _, s in kept}
        text = "|".join([str(key), *(str(p) for _, ps, _ in kept for p in ps), *(str(sizes.get(n, 0)) for n in b.SECTIONS)])
        out += [(key, n, ps, s, hashlib.sha1(text.encode()).hexdigest()) for n, ps, s in kept]
    return sorted(out, key=str)


def test_against_a_plain_loop(spark):
    r = random.Random(8)
    words = ["dose", "n=12", "Median", "of", "the", "results", "3.5 mg", "side effects", "ñ", "x" * 30]
    chunks = [(k % 17, r.choice([*b.SECTIONS, "other"]), k, " ".join(r.choice(words) for _ in range(r.randint(0, 25)))) for k in range(400)]
    chunks += [(90, "abstract", 1, None), (91, None, 1, "x"), (92, "results", 1, ""), (93, "methods", 1, "y" * 5000), (94, "abstract", 1, "z" * 300), (94, "results", 2, "q"), (94, "discussion", 3, "")]
    df = spark.createDataFrame([(*c, 1.0) for c in chunks], "id long, section string, place int, text string, score double").repartition(5)
    for most in (300, 900, 16000):
        got = [(x.id, x.section, list(x.places), x.char_len, x.input_hash) for x in b.bundled(df, "id", "section", "place", "text", most).collect()]
        assert sorted(got, key=str) == plain(chunks, most)
    assert b.bundled(df.limit(0), "id", "section", "place", "text").count() == 0
