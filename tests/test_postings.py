"""Stems by published examples; phrase search against texts read word by word."""

import random
import re

from curata.functions.stem import stem
from curata.operators import postings as p

EXAMPLES = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit
digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis
hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend
adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()


def test_published_examples():
    assert {w: stem(w) for w in EXAMPLES[::2]} == dict(zip(EXAMPLES[::2], EXAMPLES[1::2]))
    assert stem("é") == "é" and stem("x2s") == "x2s" and stem("as") == "as"


def plain(docs, asked, term):
    words = lambda t: [term(w) for w in re.findall("[a-z0-9]+", (t or "").lower())]
    out = []
    for q, phrase in asked:
        v = words(phrase)
        for k, t in docs:
            w = words(t)
            found = [i for i in range(len(w) - len(v) + 1) if v and w[i : i + len(v)] == v]
            if found and k is not None:
                out.append((q, k, found))
    return sorted(out)


def test_phrases_against_brute_force(spark, monkeypatch):
    r = random.Random(6)
    vocabulary = ["running", "runs", "run", "the", "a", "improved", "improvement", "improves", "strength", "x1", "Über"]
    docs = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 40)))) for k in range(200)] + [(500, None), (None, "the run"), (501, "the the the"), (502, "run-the; RUN")]
    asked = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 3)))) for k in range(40)] + [(90, ""), (91, None), (92, "the the"), (93, "absent")]
    df, q = spark.createDataFrame([(*d, 1) for d in docs], "id long, text string, term int").repartition(3), spark.createDataFrame(asked, "q long, text string")
    for term in (stem, p.same):
        index = p.build(df, "id", "text", term=term)
        for sent in (100_000, 0):
            monkeypatch.setattr(p, "SENT_ROWS", sent)
            got = p.search(index, p.phrases(q, "q", "text", term))
            assert sorted((x.phrase, x["key"], list(x.places)) for x in got.collect()) == plain(docs, asked, term)
    assert p.search(p.build(df.limit(0), "id", "text"), p.phrases(q, "q", "text")).count() == 0
    tags = spark.createDataFrame([(1, ["A", "b"]), (2, []), (3, None), (4, [None, "c"])], "id int, tags array<string>")
    assert sorted(x.id for x in p.tagged_with(tags, "tags", ["B", "C"]).collect()) == [1, 4]


def test_an_index_is_a_row_for_each_shard_and_phrases_are_found_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(p, "SHARD_BYTES", 4000)
    docs = [(k, f"the runs of w{k} and w{k % 7}, the RUN") for k in range(500)]
    df, q = spark.createDataFrame(docs, "id long, text string").coalesce(1), spark.createDataFrame([(1, "the run"), (2, "of w3"), (3, "w12")], "q long, text string")
    index = p.build(df, "id", "text", term=p.same)
    assert index.count() < 10  # there was a row for each document and term
    found = p.search(index, p.phrases(q, "q", "text", p.same))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((x.phrase, x["key"], list(x.places)) for x in found.collect()) == plain(docs, [(1, "the run"), (2, "of w3"), (3, "w12")], p.same)
    some = p.search(index, p.phrases(q.where("q = 3"), "q", "text", p.same))
    assert some._jdf.queryExecution().executedPlan().toString().count("binary") <= 2 and some.count() == 1  # one bucket is read
    first = p.phrases(q, "q", "text", p.same, first=1)
    assert sorted((x.phrase, x.term) for x in first.collect()) == [(1, "the"), (2, "of"), (3, "w12")]
