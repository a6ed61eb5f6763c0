"""Chunks of papers: structured abstracts, headers, fallbacks, windows."""

import pytest
from curata.operators import paper_chunks as p
from curata.plans.records import HEADERS

BODY = "Lead text.\n1. INTRODUCTION\nWhy it was done.\nMETHODS:\nHow.\nFUNDING\nMoney.\nRESULTS\n" + "r" * 5000 + "\nIn conclusion:\nDone.\nnot a header line\n"
STRUCTURED = "Title line\nAbstract\nBackground:\nb\nMethods\nm\nResults:\nr\n\n1. Introduction\nHere it begins.\nDiscussion\nTalk."


def chunks(abstract, body, only=False):
    return p.chunks_of(abstract, body, only, HEADERS)


def test_headers_cut_sections():
    got = [(t, label, s, e) for t, label, s, e, _ in chunks("", BODY)]
    assert got == [
        ("1. INTRODUCTION", "introduction", 0, 17), ("METHODS:", "methods", 0, 5), ("RESULTS", "results", 0, 2400), ("RESULTS", "results", 2200, 4600), ("RESULTS", "results", 4400, 5001), ("In conclusion:", "discussion", 0, 24),
    ]
    assert p.chunks_of("", "FUNDING\nMoney.", False, HEADERS) == []


def test_structured_abstract_is_taken_out():
    first, last = p.structured_abstract(STRUCTURED)
    assert STRUCTURED[first:last].startswith("\nAbstract") or STRUCTURED[first:last].startswith("Abstract")
    got = chunks("", STRUCTURED)
    assert [c[:2] for c in got] == [("Abstract", "abstract"), ("1. Introduction", "introduction"), ("Discussion", "discussion")]
    assert [c[0] for c in chunks("Own abstract.", STRUCTURED)] == ["Abstract", "1. Introduction", "Discussion"]
    assert p.structured_abstract(STRUCTURED.replace("Methods", "Other").replace("Results:", "Other")) is None
    assert p.structured_abstract("x" * 1001 + "\n" + STRUCTURED) is None and p.structured_abstract("Abstract\nBackground\nResults\nno more") is None


@pytest.mark.parametrize(("n", "want"), [(0, []), (1750, [(0, 1750)]), (1751, [(0, 1400), (1250, 1751)])])
def test_abstracts(n, want):
    assert [c[2:4] for c in chunks("a" * n, "")] == want
    assert chunks("same", "same ") == chunks("same", BODY, True) == [("Abstract", "abstract", 0, 4, "same")]
    assert [c[:2] for c in chunks("", "plain words\nand more")] == [("Body", "other")]


def test_rows_and_relabelling(spark):
    rows = [(1, "An abstract.", BODY, None, 9), (2, None, None, None, 9), (3, "", "Background\nb\nDiscussion\nd\nConclusion\nc", False, 9), (4, "A", BODY, True, 9), (None, "x [1, 2] y", "", False, 9), (1, "An abstract.", BODY, None, 9)]
    df = spark.createDataFrame(rows, "id long, a string, b string, o boolean, place int")
    got = {}
    for r in p.chunked(df, "id", "a", "b", "o", HEADERS).collect():
        got.setdefault(r.id, []).append(r)
    assert {k: len(v) for k, v in got.items()} == {1: 14, 3: 3, 4: 1, None: 1}
    assert {r.doc_kind for r in got[3]} == {"narrative_review"} and {(r.doc_kind, r.eligible) for r in got[1]} == {(None, True)} and not got[4][0].eligible
    assert got[None][0].text == "x y" and sorted(r.place for r in got[3]) == [0, 1, 2]
    assert p.chunked(df.limit(0), "id", "a", "b", "o", HEADERS).count() == 0
