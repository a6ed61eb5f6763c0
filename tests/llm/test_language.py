import random

from curata.llm import language


def test_fusion_on_held_out_texts_and_edges(spark):
    r = random.Random(6)
    words = {"en": ["the", "and", "with", "thing"], "de": ["der", "und", "nicht", "schön"]}
    docs = [(i, " ".join(r.choices(words[g := ("en", "de")[i % 2]], k=20)), g, "h") for i in range(200)]
    names, model = language.train(spark.createDataFrame(docs + [(None, None, None, None)], "doc_id long, text string, lang string, source string"))
    assert names == ["de", "en"]
    test = [(1000 + i, " ".join(r.choices(words[("en", "de")[i % 2]], k=9)), None, f"s{i % 2}") for i in range(60)] + [(1, None, "xx", None), (2, "", "en", "s0"), (None, "und der", "de", "")]
    pages = [(1, "http://a.b.de/x", "<html lang=de><p>the 12</p>"), (2, None, None), (3, "http://a.b.de/y", '<html LANG="de-AT">' + "<b>und nicht</b>" * 20_000)]
    rows = language.documents_as_rows(spark.createDataFrame(test, "doc_id long, text string, posterior string, source string")).unionByName(language.pages_as_rows(spark.createDataFrame(pages, "page_id long, url string, html string")))
    out = language.identify(rows, names, model, ["doc_id", "page_id"]).collect()
    assert len(out) == len(test) + len(pages) and all(0 <= x.posterior <= 1 + 1e-9 for x in out)
    got = [(x.lang, ("en", "de")[x.doc_id % 2]) for x in out if x.doc_id and x.doc_id >= 1000]
    assert len(got) == 60 and all(a == b for a, b in got)
    assert {x.page_id: x.declared for x in out if x.page_id} == {1: "de", 2: "", 3: "de"}
    assert language.identify(rows.limit(0), names, model, ["doc_id", "page_id"]).count() == 0
