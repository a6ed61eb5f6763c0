"""XML records into nested rows, and article XML into text.

Parsing is Spark's own, by schema, so that columns are pruned and only named elements are
read. A record that is no XML keeps its row, with the text it came with.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = "struct<_VALUE: string>"
#: Elements of a record; ``_VALUE`` is an element's text, other names with an underscore are attributes.
RECORD = f"""
MedlineCitation struct<
  PMID: struct<_VALUE: string, _Version: string>,
  Article: struct<
    ArticleTitle: {_TEXT}, Abstract: struct<AbstractText: array<struct<_VALUE: string, _Label: string>>>,
    Journal: struct<ISOAbbreviation: string, Title: string, JournalIssue: struct<PubDate: struct<Year: string, MedlineDate: string>>>,
    AuthorList: struct<Author: array<struct<LastName: string, Initials: string>>>,
    PublicationTypeList: struct<PublicationType: array<struct<_VALUE: string, _UI: string>>>>,
  MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: {_TEXT}>>>,
  KeywordList: struct<Keyword: array<{_TEXT}>>>,
PubmedData struct<ArticleIdList: struct<ArticleId: array<struct<_VALUE: string, _IdType: string>>>>,
_corrupt_record string
"""
_PARAGRAPHS = "p: array<string>"
_TABLE = "struct<caption: struct<p: array<string>, title: string>, table: struct<thead: struct<tr: array<struct<th: array<string>, td: array<string>>>>, tbody: struct<tr: array<struct<td: array<string>, th: array<string>>>>>>"
_FIGURE = "struct<caption: struct<p: array<string>, title: string>>"
ARTICLE = f"""
front struct<`article-meta`: struct<`title-group`: struct<`article-title`: string>, abstract: struct<{_PARAGRAPHS}, sec: array<struct<title: string, {_PARAGRAPHS}>>>>>,
body struct<sec: array<struct<title: string, {_PARAGRAPHS}, sec: array<struct<title: string, {_PARAGRAPHS}>>, `table-wrap`: array<{_TABLE}>, fig: array<{_FIGURE}>>>>,
_corrupt_record string
"""
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "attributePrefix": "_", "valueTag": "_VALUE"}
#: Rows of a table's body that are kept, and the characters that a paragraph must have more of.
TABLE_ROWS, SHORT = 15, 15


def _some(x: Column) -> Column:
    """Null in place of an empty text."""
    return F.when(F.trim(x) != "", x)


def _texts(items: Column) -> Column:
    """The texts of an array that aren't empty, trimmed."""
    kept = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return kept


def flattened(df: DataFrame, xml: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with the fields of each record of ``xml``, and ``malformed``, the text of one that isn't XML.

    Fields: ``pmid, title, abstract`` (parts joined by spaces), ``journal`` (its abbreviation before
    its title), ``year`` (the first four characters of the year, else of the season's date,
    null if no number), ``doi`` (the first id of that type), ``authors, pubtypes, mesh,
    keywords``, ``id`` and ``url``. What is absent is null, an empty text or an empty array;
    a null record has all of it absent and isn't malformed.
    """
    r = df.select(*keep, F.from_xml(F.col(xml), RECORD, _OPTIONS).alias("_r"))
    at = "_r.MedlineCitation.Article"
    pmid = _some(F.col("_r.MedlineCitation.PMID._VALUE"))
    date = F.coalesce(_some(F.col(f"{at}.Journal.JournalIssue.PubDate.Year")), _some(F.col(f"{at}.Journal.JournalIssue.PubDate.MedlineDate")))
    doi = F.get(F.filter(F.col("_r.PubmedData.ArticleIdList.ArticleId"), lambda x: x["_IdType"] == "doi"), 0)["_VALUE"]
    authors = F.transform(F.coalesce(F.col(f"{at}.AuthorList.Author"), F.array().cast("array<struct<LastName:string,Initials:string>>")), lambda x: F.concat_ws(" ", x["LastName"], x["Initials"]))
    return r.select(
        *keep,
        pmid.alias("pmid"),
        F.trim(F.coalesce(F.col(f"{at}.ArticleTitle._VALUE"), F.lit(""))).alias("title"),
        F.array_join(_texts(F.col(f"{at}.Abstract.AbstractText._VALUE")), " ").alias("abstract"),
        F.coalesce(_some(F.col(f"{at}.Journal.ISOAbbreviation")), _some(F.col(f"{at}.Journal.Title")), F.lit("")).alias("journal"),
        F.substring(date, 1, 4).try_cast("int").alias("year"),
        doi.alias("doi"),
        _texts(authors).alias("authors"),
        _texts(F.col(f"{at}.PublicationTypeList.PublicationType._VALUE")).alias("pubtypes"),
        _texts(F.col("_r.MedlineCitation.MeshHeadingList.MeshHeading.DescriptorName._VALUE")).alias("mesh"),
        _texts(F.col("_r.MedlineCitation.KeywordList.Keyword._VALUE")).alias("keywords"),
        F.concat(F.lit("pmid_"), pmid, F.lit("_chunk_0")).alias("id"),
        F.coalesce(F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")), F.lit("")).alias("url"),
        F.col("_r._corrupt_record").alias("malformed"),
    )


# Characters and what stands for them, after compatibility decomposition.
PLAIN = {
    "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "--", "−": "-", " ": " ", " ": " ", "​": "",
    "′": "'", "″": "''", "°": " degrees ", "×": "x", "≤": "<=", "≥": ">=", "±": "+/-",
}


@F.arrow_udf(T.StringType())
def _decomposed(text: pa.Array) -> pa.Array:
    return pc.utf8_normalize(text, form="NFKD")


def plain_ascii(text: Column) -> Column:
    """Decomposed, with common signs spelt in ASCII; all other characters beyond it are dropped."""
    x = _decomposed(text)
    for sign, plain in PLAIN.items():
        x = F.replace(x, F.lit(sign), F.lit(plain))
    return F.regexp_replace(x, r"[^\x00-\x7F]", "")


def _joined(*parts: Column) -> Column:
    """Parts that are arrays of texts as one array."""
    return F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])


def _flat(texts: Column) -> Column:
    return F.coalesce(F.flatten(texts), F.array().cast("array<string>"))


def _caption(x: Column) -> Column:
    return F.concat_ws(" ", F.array_append(_texts(F.array(x["caption"]["title"])), F.array_join(_texts(x["caption"]["p"]), " ")))


def _labelled(name: str, text: Column) -> Column:
    return F.when(F.trim(text) != "", F.array(F.concat(F.lit(f"{name}: "), F.trim(text)))).otherwise(F.array().cast("array<string>"))


def _cells(row: Column, first: str, second: str) -> Column:
    return F.array_join(_texts(_joined(row[first], row[second])), " | ")


def _table(x: Column) -> Column:
    """Caption, one line of header cells, and one for each of the first rows."""
    head = F.array_join(_texts(_flat(F.transform(x["table"]["thead"]["tr"], lambda r: _joined(r["th"], r["td"])))), " | ")
    rows = F.slice(_texts(F.transform(x["table"]["tbody"]["tr"], lambda r: _cells(r, "td", "th"))), 1, TABLE_ROWS)
    return _joined(_labelled("TABLE", _caption(x)), _texts(F.array(head)), rows)


def _section(x: Column) -> Column:
    paragraphs = _joined(x["p"], _flat(F.transform(x["sec"], lambda s: s["p"])))
    long = F.transform(F.filter(_texts(paragraphs), lambda p: F.length(p) > SHORT), lambda p: F.regexp_replace(p, r"\s+", " "))
    title = F.when(F.trim(x["title"]) != "", F.array(F.concat(F.upper(F.trim(x["title"])), F.lit(":"))))
    figures = _flat(F.transform(x["fig"], lambda f: _labelled("FIGURE", _caption(f))))
    return _joined(title, long, _flat(F.transform(x["table-wrap"], _table)), figures)


def article_text(df: DataFrame, xml: str, keep: list[str], name: str = "text") -> DataFrame:
    """``keep`` columns with the plain text of each article, a line for each piece, and whether it was read as XML.

    Title, abstract, then each section: title, paragraphs (those of its subsections after its
    own), tables by caption, header and first rows, captions of figures. Short paragraphs, empty
    brackets, doubled signs and spaces before signs are left out. What isn't XML, or has none
    of these, has its tags stripped. A null article has a null text.
    """
    r = df.select(*keep, F.col(xml).alias("_xml"), F.from_xml(F.col(xml), ARTICLE, _OPTIONS).alias("_a"))
    meta = F.col("_a.front.article-meta")
    title = F.trim(F.coalesce(meta["title-group"]["article-title"], F.lit("")))
    abstract = F.array_join(_texts(_joined(meta["abstract"]["p"], _flat(F.transform(meta["abstract"]["sec"], lambda s: s["p"])))), " ")
    head = _joined(F.when(title != "", F.array(F.lit("TITLE:"), title)), F.when(abstract != "", F.array(F.lit("ABSTRACT:"), abstract)))
    pieces = _joined(head, _flat(F.transform(F.col("_a.body.sec"), _section)))
    r = r.select(*keep, "_xml", F.when(F.col("_a._corrupt_record").isNull(), pieces).alias("_pieces"))
    text = plain_ascii(F.array_join("_pieces", "\n"))
    for pattern, to in ((r"\[\s*(?:,\s*)*\]", ""), (r"\(\s*(?:,\s*)*\)", ""), (r"\s+([.,;:)])", "$1"), (r"([.,;:])\s*\1+", "$1"), ("  +", " "), (r"(?m)^ +| +$", ""), (r"\n{2,}", "\n"), (r"^\n|\n$", "")):
        text = F.regexp_replace(text, pattern, to)
    stripped = F.trim(F.regexp_replace(F.regexp_replace("_xml", "<[^>]+>", " "), r"\s+", " "))
    good = F.coalesce(F.size("_pieces") > 0, F.lit(False))
    return r.select(*keep, F.when(good, text).otherwise(stripped).alias(name), good.alias("is_article"))
