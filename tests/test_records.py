"""XML records, article text and JSON cards on odd inputs."""

import pytest
from curata.operators import json_cards as j
from curata.sources import xml_records as x
from pyspark.sql import functions as F

RECORD = (
    "<PubmedArticle><MedlineCitation><PMID Version='1'>77</PMID><Article><Journal><Title>J T</Title><JournalIssue><PubDate><MedlineDate>2014 Jan</MedlineDate></PubDate></JournalIssue></Journal>"
    "<ArticleTitle> A &amp; B </ArticleTitle><Abstract><AbstractText Label='X'>one &lt;1</AbstractText><AbstractText>two</AbstractText><AbstractText/></Abstract>"
    "<AuthorList><Author><LastName>Li</LastName><Initials>Q</Initials></Author></AuthorList></Article></MedlineCitation>"
    "<PubmedData><ArticleIdList><ArticleId IdType='pii'>p</ArticleId><ArticleId IdType='doi'>10.1/x</ArticleId><ArticleId IdType='doi'>second</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"
)
ARTICLE = (
    "<article><front><article-meta><title-group><article-title>T é</article-title></title-group><abstract><title>Abs</title><p>first</p><sec><title>M</title><p>second</p></sec></abstract></article-meta></front>"
    "<body><sec><title>Methods</title><p>A paragraph that is long enough [ , ] .</p><p>short</p><sec><title>Sub</title><p>Another paragraph, below ± 3</p></sec>"
    "<table-wrap><caption><p>Cap</p></caption><table><thead><tr><th>h1</th><th>h2</th></tr></thead><tbody>" + "<tr><td>1</td><td>2</td></tr>" * 20 + "</tbody></table></table-wrap></sec></body></article>"
)


def test_records_and_articles(spark):
    rows = [(1, RECORD, ARTICLE), (2, RECORD[:-60], ARTICLE[:-30]), (3, None, None), (4, "<PubmedArticle/>", "<article/>"), (5, "", ""), (1, RECORD, ARTICLE)]
    df = spark.createDataFrame([(*r, "own") for r in rows], "k int, xml string, art string, title string")
    got = {}
    for r in x.flattened(df, "xml", ["k"]).collect():
        got.setdefault(r.k, []).append(r)
    assert len(got[1]) == 2 and got[1][0] == got[1][1]
    r = got[1][0]
    assert (r.pmid, r.title, r.abstract, r.journal, r.year, r.doi, r.authors, r.pubtypes, r.id) == ("77", "A & B", "one <1 two", "J T", 2014, "10.1/x", ["Li Q"], [], "pmid_77_chunk_0")
    assert [got[k][0].malformed is not None for k in (1, 2, 3, 4, 5)] == [False, True, False, False, True]
    assert [(got[k][0].pmid, got[k][0].title, got[k][0].year) for k in (2, 3, 4)] == [(None, "", None)] * 3
    text = {r.k: (r.is_article, r.text) for r in x.article_text(df, "art", ["k"]).collect()}
    lines = ["TITLE:", "T e", "ABSTRACT:", "first second", "METHODS:", "A paragraph that is long enough.", "Another paragraph, below +/- 3", "TABLE: Cap", "h1 | h2", *["1 | 2"] * x.TABLE_ROWS]
    assert text[1] == (True, "\n".join(lines))
    assert text[2][0] is False and text[2][1].startswith("T é Abs first") and text[3] == (False, None) and text[4] == text[5] == (False, "")
    assert x.flattened(df.limit(0), "xml", ["k"]).count() == 0


@pytest.mark.parametrize(
    ("answer", "body"),
    [
        ('```json\n{"a": 1}\n```\nbye {x}', '{"a": 1}'), ("```\n{\"a\": [1,2,],\n}\n", '{"a": [1,2] }'), ('Sure: {"a": {"b": 2}} done', '{"a": {"b": 2}}'),
        ("no object", None), ("", None), (None, None), ('{"a": "x\x01y"}', '{"a": "x y"}'), ("} {", None),
    ],
)
def test_repair(spark, answer, body):
    assert spark.createDataFrame([(answer,)], "a string").select(j.repaired(F.col("a"))).first()[0] == body


def test_fold_takes_sections_in_order(spark):
    rows = [
        (1, 2, "abstract", '{"population_size": 40, "dose_g_per_day": 9}'), (1, 1, "abstract", '{"population_size": 30}'), (1, 3, "methods", '{"population_size": 0, "dose_g_per_day": "5"}'),
        (1, 4, "results", '{"population_size": 99, "effect_sizes": []}'), (1, 5, "discussion", '{"safety_notes": "", "adverse_events": ["a"]}'),
        (2, 1, "methods", "broken {"), (2, 2, None, '{"population_size": 5}'), (3, 1, "methods", '{"population_size": 7}'), (3, 2, "abstract", '{"population_size": 8}'), (None, 1, "methods", '{"population_size": 1}'), (4, 1, "methods", None),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "p int, turn int, section string, answer string, n int")
    got = lambda first: {r.p: (r.n, r.dose_g_per_day, r.effect_sizes, r.adverse_events) for r in j.fold(df, ["p"], "section", "answer", "turn", first).collect()}
    assert got(True) == {1: (30, 5.0, None, '["a"]'), 2: (None,) * 4, 3: (7, None, None, None), None: (1, None, None, None), 4: (None,) * 4}
    assert got(False) == {1: (40, 5.0, None, '["a"]'), 2: (None,) * 4, 3: (8, None, None, None), None: (1, None, None, None), 4: (None,) * 4}


def test_checks_and_heuristics(spark):
    good = '{"population": {"n": 3}, "intervention": {}, "outcomes": [{"name": "a"}], "safety": {"adverse_events": []}}'
    odd = '{"population": {"n": "12", "conditions": "x"}, "intervention": [], "outcomes": [{"name": "a"}, {}, 5], "safety": null}'
    want = {good: 100.0, odd: 100.0 - 5 - 3 - 25 - 3 - 5 - 25, "{}": 0.0, "x": 0.0, None: 0.0, '{"population": {}, "intervention": {}, "outcomes": [], "safety": {}}': 70.0}
    got = {r.a: r.c for r in spark.createDataFrame([(a,) for a in want], "a string").select("a", j.checked(F.col("a")).alias("c")).collect()}
    assert {a: c.score for a, c in got.items()} == want and got[good].issues == [] and got[None].issues == [j.NOTHING]
    rows = [
        ("Participants: 45 took 500 mg/d; 10 wks", "n=30", "Improved, yet reduced", "adverse", "x"), ("", "n = 1, N 200 over 2.5 months of 3 g/kg", "ns.", "", None), (None, None, None, None, None), ("creatine " + "y" * 160 + " 5 g/d", "", "", "", "Creatine"),
    ]
    df = spark.createDataFrame(rows, "m string, a string, r string, d string, t string")
    out = [tuple(r)[5:] for r in j.heuristics(df, "m", "a", "r", "d", "t").collect()]
    assert out == [(45, 10, 0.5, "increase", 0, 8, "adverse events discussed"), (200, 11, 3.0, "no_effect", 0, 3, None), (None,) * 7, (None,) * 7]
