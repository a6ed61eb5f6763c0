"""Pages and lines that are long or short enough, but no articles or headers."""

from curata.operators import chunks
from curata.plans import queries as q
from pyspark.sql import functions as F


def test_gate_needs_section_words_outside_boilerplate(spark):
    body = "word " * 300
    pages = [
        (1, f"<p>Methods</p><div>{body}</div><b>Results</b>"),
        (2, f"<p>{body}</p>"),
        (3, f"<nav>Introduction Methods Results</nav><STYLE>results</STYLE><header>discussion</header><p>{body}</p>"),
        (4, "<p>Methods and results</p>"),
        (5, None),
    ]
    df = spark.createDataFrame(pages, "page_id int, html string")
    _, kept = chunks.article_gate(F.col("html"), q._BOILERPLATE, q._SECTION_WORDS, 1200, 2)
    assert [r.page_id for r in df.where(kept).collect()] == [1]


def test_headers(spark):
    lines = ["1. INTRODUCTION", "a plain short line", "Methods", "we did things", "Key Takeaways:", "THIS IS LOUD", "REFERENCES", "x", "In conclusion, all told:", "Results " + "y" * 140 + ":"]
    text = "\n".join(lines)
    df = spark.createDataFrame([(1, text, len(text))], "id int, text string, n long")
    found = chunks.headers(chunks.lines(df, "text", ["id", "n"]), q._COMMON, q._TARGET, q._STOP, q._COLON)
    got = {r.title: (r.is_stop, r.start, r.section_end) for r in chunks.sections(found, "id", "n").collect()}
    at = {x: text.index(x) for x in lines}
    order = [lines[k] for k in (0, 2, 4, 6, 8)]
    ends = [at[x] for x in order[1:]] + [len(text)]
    assert got == {x: (x == "REFERENCES", at[x], e) for x, e in zip(order, ends)}
