"""Queries over records: tags and goals found in text, XML records, cards from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions import articles as a
from curata.functions import supplements
from curata.operators import bundles, json_cards, paper_chunks, tagging
from curata.plans import queries as curation
from curata.plans.articles import PUBTYPES, TITLES, _deal, _list
from curata.plans.queries import Tables, query
from curata.sources import xml_records

#: Notes that stand in the middle of texts, as the given texts name no supplements.
NOTES = [
    "creatine monohydrate supplementation at a dose of 5 g",
    "a cup of coffee and fish oil",
    "beta-alanine or betaalanine, against placebo, changed peak power and 1 RM",
    "beet juice, nitrates and NO3 " + "in plain words without any sign of the thing that was looked for in this long row of words " * 2 + "intervention",
    "BCAAs, l-leucine and whey isolate in a trial of lean mass and fat mass",
    "vitamin d with 25(OH)D, n-3 and IGF-1",
    "time to exhaustion, repeated sprint ability and the effect on gait speed",
    "bmi and waist circumference fell, an outcome of weight loss",
    "hypertrophy of muscle thickness " + "and so on " * 12 + "with the bench press",
    "a workout at a club",
    "",
    "(epi)gallocatechin, co-enzyme Q10, N-acetylcysteine and ubiquinol ingested",
]


def noted(t: Tables) -> DataFrame:
    """Documents with a note in the middle of their text, a publication type, and whether it is a trial's."""
    d, k = t("documents"), F.col("doc_id")
    half = F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    text = F.coalesce("text", F.lit(""))
    content = F.concat(F.substring(text, F.lit(1), half), F.lit(" "), _deal(NOTES, k), F.lit(" "), F.substring(text, half + 1, F.length(text)))
    pubtype = _deal(PUBTYPES, F.floor(k / 3))
    trial = F.lower(pubtype).rlike("|".join(supplements.TRIALS))
    return d.select("doc_id", content.alias("content"), pubtype.alias("pubtype"), trial.alias("is_trial"))


NOTED = f"""noted AS (SELECT doc_id, substr(x, 1, length(x) // 2) || ' ' || {_list(NOTES)}[doc_id % {len(NOTES)} + 1] || ' ' || substr(x, length(x) // 2 + 1) AS content, pubtype, regexp_matches(lower(pubtype), '{"|".join(supplements.TRIALS)}') AS is_trial
  FROM (SELECT doc_id, coalesce(text, '') AS x, {_list(PUBTYPES)}[(doc_id // 3) % {len(PUBTYPES)} + 1] AS pubtype FROM documents))"""


def _tag_sql(reach: int = 100) -> str:
    """A list of the tags, by patterns tried one after the other, each at its first match."""
    context = "|".join(supplements.CONTEXT)
    out = []
    for label, patterns in supplements.TAGS.items():
        each = []
        for p in patterns:
            start, whole = f"length(regexp_extract(t, '(?is)^(.*?)(?:{p})', 1))", f"length(regexp_extract(t, '(?is)^.*?(?:{p})'))"
            near = f"regexp_matches(substr(t, greatest({start} - {reach}, 0) + 1, {whole} + {reach} - greatest({start} - {reach}, 0)), '{context}')"
            each.append(f"(regexp_matches(t, '{p}', 'i') AND (is_trial OR {near}))")
        out.append(f"CASE WHEN {' OR '.join(each)} THEN '{label}' END")
    return f"list_filter([{', '.join(out)}], lambda z: z IS NOT NULL)"


@query(f"WITH {NOTED}, l AS (SELECT doc_id, is_trial, lower(content) AS t FROM noted) SELECT doc_id, array_to_string(list_sort({_tag_sql()}), ',') AS tags FROM l")
def q_supplement_tags(t: Tables) -> DataFrame:
    """Tags by the whole dictionary, of first matches with a word of context within 100 characters, or in trials."""
    found = tagging.tagged(noted(t), "content", "is_trial", supplements.TAGS, supplements.CONTEXT)
    return found.select("doc_id", F.array_join("tags", ",").alias("tags"))


def _goal_sql(reach: int = 60) -> str:
    """Whether each goal has a match near a word of measurement: matches are marked, and their places summed up from the parts."""
    out = []
    for goal, patterns in a.MEASURED.items():
        each = []
        for p in patterns:
            start = "length(replace(array_to_string(p[1:k], ''), chr(2), ''))"
            end = f"({start} + strpos(p[k + 1], chr(2)) - 1)"
            near = f"regexp_matches(substr(j, greatest({start} - {reach}, 0) + 1, {end} + {reach} - greatest({start} - {reach}, 0)), '{supplements.METRIC}', 'i')"
            split = f"string_split(regexp_replace(j, '({p})', chr(1) || '\\1' || chr(2), 'gi'), chr(1))"
            each.append(f"(regexp_matches(j, '{p}', 'i') AND len(list_filter(range(1, len({split})), lambda k: {near.replace('p[', split + '[')})) > 0)")
        out.append(f"({' OR '.join(each)}) AS {goal}")
    return ", ".join(out)


_GOAL_SIZES = ", ".join(f"len(list_filter([{', '.join(f'''CASE WHEN regexp_matches(content, '{a.any_of(p)}') THEN 1 END''' for p in table.values())}], lambda z: z IS NOT NULL)) AS n_{g}" for g, table in a.GOALS.items())
_TOP = f"greatest({', '.join(f'n_{g}' for g in a.GOALS)})"


@query(f"""WITH {NOTED}, l AS (SELECT doc_id, content, regexp_replace(lower(content), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g') AS j FROM noted), g AS (SELECT doc_id, content, {_goal_sql()}, {_GOAL_SIZES} FROM l),
i AS (SELECT *, CASE {' '.join(f"WHEN {g} THEN '{shown}'" for g, shown in supplements.PREFERRED)} WHEN {' OR '.join(f"contains(lower(content), '{c}')" for c in supplements.EXERCISE)} THEN 'performance' ELSE 'general' END AS inferred,
  {_TOP} AS most, {' + '.join(f"(n_{g} = {_TOP})::INT" for g in a.GOALS)} AS winners FROM g),
s AS (SELECT *, CASE WHEN most = 0 THEN 'general' WHEN winners = 1 THEN CASE {' '.join(f"WHEN n_{g} = most THEN '{g}'" for g in a.GOALS)} END WHEN regexp_matches(content, '{a.SPORT}') THEN 'performance' ELSE 'general' END AS own FROM i)
SELECT doc_id, inferred, CASE WHEN own <> 'general' THEN own ELSE inferred END AS goal FROM s""")
def q_window_goals(t: Tables) -> DataFrame:
    """The goal that stands near a word of measurement, and the record's own goal, if not general, before it."""
    found = tagging.window_goals(noted(t), "content", a.MEASURED, supplements.METRIC, supplements.PREFERRED, supplements.EXERCISE, name="inferred")
    found = tagging.found(found, "content", a.GOALS | {"about": {"sport": [a.SPORT.removeprefix("(?i)")]}})
    own = a.primary_goal(F.array(*[F.size(tagging.of_table(F.col("found"), g)) for g in a.GOALS]), F.array_contains("found", "about|sport"))
    return found.withColumn("own", own).select("doc_id", "inferred", F.when(F.col("own") != "general", F.col("own")).otherwise(F.col("inferred")).alias("goal"))


def _escaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _element(name: str, *inside: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), *inside, F.lit(f"</{name.split()[0]}>"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def xml_of(t: Tables) -> DataFrame:
    """Documents as XML records, each line a part of the abstract; some records are cut off."""
    d, k = t("documents"), F.col("doc_id")
    parts = F.array_join(F.transform(_lines(F.col("text")), lambda x: _element("AbstractText Label='PART'", _escaped(x))), "")
    date = F.when(k % 3 == 0, _element("Year", (F.lit(2000) + k % 20).cast("string"))).when(k % 3 == 1, _element("MedlineDate", (F.lit(1990) + k % 30).cast("string"), F.lit(" Spring"))).otherwise(_element("Year", F.lit("n.d.")))
    doi = F.when(k % 4 == 1, _element("ArticleId IdType='doi'", F.lit("10.1/"), k.cast("string"))).otherwise(F.lit(""))
    article = _element("Article", _element("Journal", _element("Title", F.col("source")), F.when(k % 5 == 0, _element("ISOAbbreviation", F.col("lang"))).otherwise(F.lit("")), _element("JournalIssue", _element("PubDate", date))), _element("ArticleTitle", _escaped(_deal(TITLES, k)), F.lit(" &amp; more ")), _element("Abstract", parts), _element("PublicationTypeList", _element("PublicationType UI='D1'", _deal(PUBTYPES, k)), _element("PublicationType", F.lit("Journal Article"))))
    xml = _element("PubmedArticle", _element("MedlineCitation", _element("PMID Version='1'", (k + 1000).cast("string")), article, _element("KeywordList", _element("Keyword", F.col("lang")), _element("Keyword", F.col("source")))), _element("PubmedData", _element("ArticleIdList", _element("ArticleId IdType='pii'", F.lit("p1")), doi)))
    return d.select("doc_id", F.when(k % 13 == 4, F.substring(xml, F.lit(1), F.length(xml) - 30)).otherwise(xml).alias("xml"))


@query(f"""WITH d AS (SELECT doc_id, doc_id % 13 = 4 AS bad, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS parts, lang, source FROM documents)
SELECT doc_id, CASE WHEN NOT bad THEN CAST(doc_id + 1000 AS VARCHAR) END AS pmid, CASE WHEN bad THEN '' ELSE {_list(TITLES)}[doc_id % {len(TITLES)} + 1] || ' & more' END AS title, sha256(CASE WHEN bad THEN '' ELSE array_to_string(parts, ' ') END) AS abstract_digest,
  CASE WHEN bad THEN '' WHEN doc_id % 5 = 0 THEN lang ELSE source END AS journal, CAST(CASE WHEN bad THEN NULL WHEN doc_id % 3 = 0 THEN 2000 + doc_id % 20 WHEN doc_id % 3 = 1 THEN 1990 + doc_id % 30 END AS INTEGER) AS year,
  CASE WHEN NOT bad AND doc_id % 4 = 1 THEN '10.1/' || doc_id END AS doi, CASE WHEN bad THEN '' ELSE {_list(PUBTYPES)}[doc_id % {len(PUBTYPES)} + 1] || ',Journal Article' END AS pubtypes, CASE WHEN bad THEN '' ELSE lang || ',' || source END AS keywords,
  CASE WHEN bad THEN '' ELSE 'https://pubmed.ncbi.nlm.nih.gov/' || (doc_id + 1000) || '/' END AS url, bad AS malformed FROM d""")
def q_xml_records(t: Tables) -> DataFrame:
    """XML records field by field; those that are cut off keep their row."""
    r = xml_records.flattened(xml_of(t), "xml", ["doc_id"])
    return r.select("doc_id", "pmid", "title", F.sha2("abstract", 256).alias("abstract_digest"), "journal", "year", "doi", F.array_join("pubtypes", ",").alias("pubtypes"), F.array_join("keywords", ",").alias("keywords"), "url", F.col("malformed").isNotNull().alias("malformed"))


def article_of(t: Tables) -> DataFrame:
    """Documents as article XML: lines as paragraphs of a section and its subsection, a table and a figure."""
    d, k = t("documents"), F.col("doc_id")
    lines = _lines(F.col("text"))
    p = lambda some: F.array_join(F.transform(some, lambda x: _element("p", _escaped(x))), "")
    table = _element("table-wrap", _element("caption", _element("p", F.lit("Rows of "), F.col("source"))), _element("table", _element("thead", _element("tr", _element("th", F.lit("lang")), _element("th", F.lit("chars")))), _element("tbody", _element("tr", _element("td", F.col("lang")), _element("td", F.coalesce(F.col("n_chars").cast("string"), F.lit("")))), _element("tr", _element("td", F.lit(" ")), _element("td", F.lit("± 3 °"))))))
    first = _element("sec", _element("title", F.lit("Methods")), p(F.slice(lines, 1, 2)), _element("sec", _element("title", F.lit("Sub")), p(F.slice(lines, 3, 1000000))), table, _element("fig", _element("caption", _element("p", F.lit("A figure [ , ] of it .")))))
    xml = _element("article", _element("front", _element("article-meta", _element("title-group", _element("article-title", _deal(TITLES, k))), _element("abstract", _element("title", F.lit("Abstract")), _element("p", F.lit("On “"), F.col("lang"), F.lit("” texts ;; in short"))))), _element("body", first))
    return d.select("doc_id", F.when(k % 11 == 2, F.concat(F.lit("<p>no article"), F.col("lang"), F.lit("</q>"))).otherwise(xml).alias("xml"))


def _ascii_sql(x: str) -> str:
    for sign, plain in xml_records.PLAIN.items():
        x = f"replace({x}, '{sign}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')"


_CLEANED = _ascii_sql("array_to_string(pieces, chr(10))")
for _pattern, _to in ((r"\[\s*(?:,\s*)*\]", ""), (r"\(\s*(?:,\s*)*\)", ""), (r"\s+([.,;:)])", r"\1"), *((rf"[{c}](\s*[{c}]+)+", c) for c in ".,;:"), ("  +", " "), (r"(?m)^ +| +$", ""), (r"\n{2,}", "\n"), (r"^\n|\n$", "")):
    _CLEANED = f"regexp_replace({_CLEANED}, '{_pattern}', {'chr(10)' if _to == chr(10) else f"'{_to}'"}, 'g')"


@query(f"""WITH l AS (SELECT doc_id, lang, source, n_chars, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS x FROM documents),
p AS (SELECT doc_id, lang, list_concat(['TITLE:', {_list(TITLES)}[doc_id % {len(TITLES)} + 1], 'ABSTRACT:', 'On “' || lang || '” texts ;; in short', 'METHODS:'], list_transform(list_filter(x, lambda z: length(z) > {xml_records.SHORT}), lambda z: regexp_replace(z, '\\s+', ' ', 'g')),
  ['TABLE: Rows of ' || source, 'lang | chars', lang || ' | ' || n_chars, '± 3 °', 'FIGURE: A figure [ , ] of it .']) AS pieces FROM l),
c AS (SELECT doc_id, CASE WHEN doc_id % 11 = 2 THEN 'no article' || lang ELSE {_CLEANED} END AS x FROM p) SELECT doc_id, doc_id % 11 <> 2 AS is_article, CAST(length(x) AS BIGINT) AS n_chars, sha256(x) AS digest FROM c""")
def q_article_text(t: Tables) -> DataFrame:
    """Article XML as text, with tables and captions; what is no XML without its tags."""
    r = xml_records.article_text(article_of(t), "xml", ["doc_id"])
    return r.select("doc_id", "is_article", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("digest"))



def answers_of(t: Tables) -> DataFrame:
    """Turns of conversations as a model's answers about a part of a paper: in a fence, after a sentence, with a comma too many, cut off."""
    c, k, n = t("conversations"), F.col("conv_id"), F.col("turn")
    section = _deal(["methods", "abstract", "results", "discussion", "other"], k + n)
    number = lambda name, x: F.concat(F.lit(f'"{name}": '), x.cast("string"))
    notes = F.concat(F.lit('"safety_notes": "'), F.when((k + n) % 6 == 0, F.lit("")).otherwise(F.concat(F.col("role"), F.lit(" says\\n it is fine"))), F.lit('"'))
    effects = F.concat(F.lit('"effect_sizes": '), F.when(n % 3 == 0, F.lit("[]")).otherwise(F.concat(F.lit('[{"measure": "m'), n.cast("string"), F.lit('", "value": 1}]'))))
    inside = F.concat_ws(", ", number("population_size", (k * 7 + n * 13) % 90 % 50), number("dose_g_per_day", F.floor((k + n) % 9) * 5), F.concat(F.lit('"duration_weeks": "'), (n % 4).cast("string"), F.lit('"')), notes, effects)
    body = F.concat(F.lit("{"), inside, F.when(k % 4 == 1, F.lit(",")).otherwise(F.lit("")), F.lit("}"))
    answer = F.when(k % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```\nThat {is} all."))).when(k % 5 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" As asked."))).when(k % 5 == 2, F.substring(body, F.lit(1), F.length(body) - 9)).otherwise(body)
    return c.select("conv_id", "turn", section.alias("section"), answer.alias("answer"))


_BODY = """'{"population_size": ' || ((k * 7 + n * 13) % 90 % 50) || ', "dose_g_per_day": ' || ((k + n) % 9 * 5) || ', "duration_weeks": "' || (n % 4) || '", "safety_notes": "' || CASE WHEN (k + n) % 6 = 0 THEN '' ELSE role || ' says\\n it is fine' END
  || '", "effect_sizes": ' || CASE WHEN n % 3 = 0 THEN '[]' ELSE '[{"measure":"m' || n || '","value":1}]' END || CASE WHEN k % 4 = 1 THEN ',' ELSE '' END || '}'"""
_ANSWERS = f"""b AS (SELECT *, {_BODY} AS body FROM (SELECT conv_id, turn, role, conv_id AS k, turn AS n, ['methods', 'abstract', 'results', 'discussion', 'other'][(conv_id + turn) % 5 + 1] AS section FROM conversations)),
a AS (SELECT conv_id, turn, section, CASE k % 5 WHEN 0 THEN body WHEN 1 THEN body WHEN 2 THEN substr(body, 1, length(body) - 9) ELSE body END AS body FROM b),
j AS (SELECT conv_id, turn, section, TRY_CAST(regexp_replace(regexp_extract(body, '(?s)\\{{.*\\}}'), ',(\\s*[}}\\]])', '\\1', 'g') AS JSON) AS j, CASE section WHEN 'methods' THEN 1 WHEN 'abstract' THEN 2 WHEN 'results' THEN 3 WHEN 'discussion' THEN 4 ELSE 5 END AS o FROM a),
v AS (SELECT *, nullif(CAST(j->>'population_size' AS INTEGER), 0) AS n, nullif(CAST(j->>'dose_g_per_day' AS DOUBLE), 0) AS dose, nullif(CAST(j->>'duration_weeks' AS DOUBLE), 0) AS weeks, nullif(j->>'effect_sizes', '[]') AS effects, nullif(j->>'safety_notes', '') AS notes FROM j)"""


def _fold_sql(pick: str) -> str:
    take = lambda x, sections: f"{pick}({x}, (o, turn)) FILTER (WHERE section IN ({sections}) AND {x} IS NOT NULL)"
    return f"""WITH {_ANSWERS} SELECT conv_id, {take("n", "'methods', 'abstract'")} AS n, {take("dose", "'methods'")} AS dose_g_per_day, {take("weeks", "'methods'")} AS duration_weeks, {take("effects", "'results'")} AS effect_sizes, {take("notes", "'discussion'")} AS safety_notes FROM v GROUP BY 1"""


def _folded(t: Tables, first: bool) -> DataFrame:
    folded = json_cards.fold(answers_of(t), ["conv_id"], "section", "answer", "turn", first)
    return folded.select("conv_id", "n", "dose_g_per_day", "duration_weeks", "effect_sizes", "safety_notes")


@query(_fold_sql("arg_min"))
def q_card_fold(t: Tables) -> DataFrame:
    """Each field from the first section that says it, methods before the abstract."""
    return _folded(t, True)


@query(_fold_sql("arg_max"))
def q_card_overwrites(t: Tables) -> DataFrame:
    """Each field from the last section that says it, so that the abstract overwrites methods."""
    return _folded(t, False)


#: Sentences of the sections of papers.
METHODS = ["We gave creatine at 5 g/day to participants: 45 for 8 weeks.", "n = 120 took 300 mg/d of caffeine, and 2 months later 7 g/kg of sugar.", "", "Sample size 33; 3.5 months.", "Two groups. " + "No number here. " * 20 + "creatine 20 g/d and 4 wks"]
RESULTS = ["Strength improved, an increase of 9 %.", "Fat mass was reduced against no effect.", "There was no significant change.", "Nothing.", ""]
DISCUSSION = ["No serious adverse events.", "All was fine.", ""]
NAMED = ["creatine", "caffeine", "", "beta-alanine"]
#: The SQL engine's word boundary knows ASCII only.
_SIZE = json_cards.SIZE.replace(r"\b(?:", r"(?:^|[^\p{L}\p{N}_])(?:", 1)
AIMS = ["muscle_gain", "", "endurance"]


@query(f"""WITH s AS (SELECT doc_id, {_list(METHODS)}[doc_id % 5 + 1] AS methods, substr(coalesce(text, ''), 1, length(text) // 2) || ' 12 weeks of 900 mg / day, N=77 ' || substr(coalesce(text, ''), length(text) // 2 + 1) AS abstract, {_list(RESULTS)}[(doc_id // 2) % 5 + 1] AS results, {_list(DISCUSSION)}[(doc_id // 3) % 3 + 1] AS discussion,
  {_list(NAMED)}[(doc_id // 5) % 4 + 1] AS term, {_list(AIMS)}[(doc_id // 7) % 3 + 1] AS goal, lang AS title, source AS journal FROM documents),
c AS (SELECT *, CASE WHEN methods <> '' THEN methods ELSE abstract END AS ctx, lower(results) AS low FROM s),
w AS (SELECT *, CASE WHEN term <> '' AND strpos(lower(ctx), term) > 0 THEN substr(ctx, greatest(strpos(lower(ctx), term) - 1 - 160, 0) + 1, strpos(lower(ctx), term) - 1 + 160 - greatest(strpos(lower(ctx), term) - 1 - 160, 0)) ELSE ctx END AS win,
  TRY_CAST(regexp_extract(ctx, '{json_cards.WEEKS}', 1) AS DOUBLE) AS amount, lower(regexp_extract(ctx, '{json_cards.WEEKS}', 2)) AS unit FROM c),
h AS (SELECT *, TRY_CAST(regexp_extract(methods || chr(10) || chr(10) || abstract, '{_SIZE}', 1) AS INTEGER) AS n, CAST(round_even(CASE WHEN contains(unit, 'mo') THEN amount * 4.345e0 ELSE amount END, 0) AS INTEGER) AS duration_weeks,
  TRY_CAST(regexp_extract(win, '{json_cards.DOSE}', 1) AS DOUBLE) / CASE WHEN lower(regexp_extract(win, '{json_cards.DOSE}', 2)) = 'mg' THEN 1000.0e0 ELSE 1.0e0 END AS dose_g_per_day,
  CASE {' '.join("WHEN " + " OR ".join(f"contains(low, '{w}')" for w in words) + f" THEN '{label}'" for label, words in json_cards.DIRECTIONS)} END AS direction,
  CASE {' '.join(f"WHEN contains(low, '{w}') THEN strpos(low, '{w}') - 1" for _, words in json_cards.DIRECTIONS for w in words)} END AS span_start, contains(lower(discussion || chr(10) || results), 'adverse') AS told FROM w)
SELECT doc_id, n, duration_weeks, round(dose_g_per_day, 6) AS dose_g_per_day, direction, CAST(span_start AS INTEGER) AS span_start, CASE WHEN told THEN 'adverse events discussed' END AS safety_notes,
  CASE WHEN goal <> '' AND direction IS NOT NULL THEN CASE term WHEN '' THEN 'Supplement' WHEN 'creatine' THEN 'Creatine' WHEN 'caffeine' THEN 'Caffeine' ELSE 'Beta-alanine' END || CASE direction WHEN 'increase' THEN ' improves ' WHEN 'decrease' THEN ' reduces ' ELSE ' shows no clear effect on ' END || replace(goal, '_', ' ') || '.' END AS summary,
  array_to_string(list_sort(list_filter([term, goal], lambda x: x <> '')), ',') AS keywords,
  round(CASE WHEN n IS NOT NULL THEN 0.2e0 ELSE 0e0 END + CASE WHEN dose_g_per_day IS NOT NULL THEN 0.2e0 ELSE 0e0 END + CASE WHEN duration_weeks IS NOT NULL THEN 0.15e0 ELSE 0e0 END + CASE WHEN told THEN 0.1e0 ELSE 0e0 END + CASE WHEN coalesce(title, '') <> '' AND coalesce(journal, '') <> '' THEN 0.1e0 ELSE 0e0 END, 4) AS confidence FROM h""")
def q_card_heuristics(t: Tables) -> DataFrame:
    """Cards read from the sections of papers by patterns, with summary, keywords and confidence."""
    d, k = t("documents"), F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    abstract = F.concat(F.substring(text, F.lit(1), half), F.lit(" 12 weeks of 900 mg / day, N=77 "), F.substring(text, half + 1, F.length(text)))
    s = d.select("doc_id", _deal(METHODS, k).alias("methods"), abstract.alias("abstract"), _deal(RESULTS, F.floor(k / 2)).alias("results"), _deal(DISCUSSION, F.floor(k / 3)).alias("discussion"), _deal(NAMED, F.floor(k / 5)).alias("term"), _deal(AIMS, F.floor(k / 7)).alias("goal"), F.col("lang").alias("title"), F.col("source").alias("journal"))
    card = json_cards.assembled(json_cards.heuristics(s, "methods", "abstract", "results", "discussion", "term"), "term", "goal", "title", "journal")
    return card.select("doc_id", "n", "duration_weeks", F.round("dose_g_per_day", 6).alias("dose_g_per_day"), "direction", "span_start", "safety_notes", "summary", F.array_join("keywords", ",").alias("keywords"), "confidence")


HEADERS = paper_chunks.Headers(curation._TARGET, curation._STOP, curation._COLON, tuple(curation._COMMON))
_CLEAN = lambda x: rf"regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), ' '), '\s*\[\d+(?:\s*[,-]\s*\d+)*\]', '', 'g')"
_HEADING_SQL = " ".join(f"WHEN regexp_matches(lower(title), '{p}') THEN '{label}'" for p, label in a.HEADINGS)


@query(rf"""WITH b AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: [{", ".join(f"'{h}'" for h in curation._HEADERS)}][(doc_id + i) % {len(curation._HEADERS)} + 1] || chr(10) || x) AS x, text FROM documents),
d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE {_CLEAN("substr(text, 1, 3000)")} END AS abs, CASE WHEN doc_id % 6 = 1 THEN {_CLEAN("text")} ELSE {_CLEAN("array_to_string(x, chr(10))")} END AS whole, doc_id % 9 = 5 AS brief FROM b),
p AS (SELECT *, NOT brief AND whole <> '' AND NOT (abs <> '' AND regexp_replace(abs, '^\s+|\s+$', '', 'g') = regexp_replace(whole, '^\s+|\s+$', '', 'g')) AS cut FROM d),
l AS (SELECT doc_id, whole, string_split(whole, chr(10)) AS p, length(whole) AS n FROM p WHERE cut), e AS (SELECT doc_id, n, whole, unnest(p) AS line, unnest(range(0, len(p))) AS k FROM l),
o AS (SELECT doc_id, n, whole, length(line) AS size, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM e),
c AS (SELECT *, CASE WHEN ends_with(s, ':') AND contains(lower(s), 'conclusion') THEN false WHEN regexp_full_match(s, '{curation._STOP}', 'i') THEN true WHEN regexp_full_match(s, '{curation._TARGET}', 'i') THEN false END AS is_stop FROM o
  WHERE length(s) BETWEEN 1 AND 140 AND (regexp_matches(s, '{curation._COLON}$') OR regexp_matches(s, '^[0-9]+\.*( |$)') OR (length(regexp_replace(s, '\P{{L}}', '', 'g')) >= 4 AND length(regexp_replace(s, '\P{{Lu}}', '', 'g')) >= 0.6 * length(regexp_replace(s, '\P{{L}}', '', 'g'))) OR lower(s) IN ({", ".join(f"'{w}'" for w in curation._COMMON)}))),
h AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), n) AS stop FROM c WHERE is_stop IS NOT NULL),
s AS (SELECT doc_id, s AS title, CASE {_HEADING_SQL.replace('title', 's')} ELSE 'other' END AS norm, 2400 AS size, 200 AS lap, substr(whole, least(start + size + 1, n) + 1, greatest(stop - least(start + size + 1, n), 0)) AS body FROM h WHERE NOT is_stop),
f AS (SELECT doc_id, title, norm, size, lap, body FROM s WHERE norm <> 'abstract' AND regexp_matches(body, '\S')
  UNION ALL SELECT doc_id, 'Body', 'other', 2400, 200, regexp_replace(whole, '^\s+|\s+$', '', 'g') FROM l WHERE doc_id NOT IN (SELECT doc_id FROM h)
  UNION ALL SELECT doc_id, 'Abstract', 'abstract', CASE WHEN length(abs) <= 1750 THEN greatest(length(abs), 1) ELSE 1400 END, CASE WHEN length(abs) <= 1750 THEN 0 ELSE 150 END, abs FROM p WHERE abs <> ''),
w AS (SELECT doc_id, title, norm, body, size, unnest(range(0, CAST(greatest(1, ceil((length(body) - lap) / CAST(size - lap AS DOUBLE))) AS BIGINT))) * (size - lap) AS pos FROM f WHERE length(body) > 0),
g AS (SELECT doc_id, count(*) FILTER (WHERE norm IN ('methods', 'results')) = 0 AND count(*) FILTER (WHERE norm IN ('abstract', 'introduction', 'discussion')) > 0 AND count(*) >= 3 AS review, count(*) FILTER (WHERE norm = 'results') > 0 AS eligible FROM w GROUP BY 1)
SELECT w.doc_id, title AS section, norm AS section_norm, CAST(pos AS BIGINT) AS start, CAST(least(pos + size, length(body)) AS BIGINT) AS "end", sha256(substr(body, CAST(pos + 1 AS BIGINT), CAST(size AS BIGINT))) AS digest, CASE WHEN review THEN 'narrative_review' END AS doc_kind, eligible FROM w JOIN g ON g.doc_id = w.doc_id""")
def q_paper_chunks(t: Tables) -> DataFrame:
    """Chunks of papers by abstract and headers, relabelled by what sections there are."""
    k = F.col("doc_id")
    d = t("documents").select("doc_id", curation.headed().alias("text"), F.col("text").alias("plain"))
    abstract = F.when(k % 4 == 0, "").otherwise(F.substring("plain", 1, 3000))
    body = F.when(k % 6 == 1, F.col("plain")).otherwise(F.col("text"))
    made = paper_chunks.chunked(d.select("doc_id", abstract.alias("abstract"), body.alias("body"), (k % 9 == 5).alias("only")), "doc_id", "abstract", "body", "only", HEADERS)
    return made.select("doc_id", "section", "section_norm", "start", "end", F.sha2("text", 256).alias("digest"), "doc_kind", "eligible")


LINES = ["Results: mean 4.5 mg, n=12", "side effects in 3 subjects", "no change", "a median of 7", ""]
_HOLDS = " + ".join([f"CASE WHEN contains(low, '{w}') THEN {n} ELSE 0 END" for w, n in bundles.WORDS.items()] + [f"CASE WHEN contains(low, '{w}') THEN 1 ELSE 0 END" for w in bundles.STATISTICS])
_MOST = 900


@query(f"""WITH RECURSIVE c AS (SELECT conv_id, (conv_id + turn) % 6 AS sec, turn AS place, coalesce(text, '') || ' ' || {_list(LINES)}[turn % 5 + 1] AS text FROM conversations),
s AS (SELECT *, {_HOLDS} + least(len(regexp_extract_all(text, '[0-9]+[.]?[0-9]*')) * 0.5e0, 3e0) AS score FROM (SELECT *, lower(text) AS low FROM c WHERE sec < 5)),
g AS (SELECT conv_id, sec, CAST(sum(length(text)) + 2 * (count(*) - 1) AS BIGINT) AS size, list(length(text) ORDER BY score DESC, place) AS sizes, list(place ORDER BY score DESC, place) AS best, list(place ORDER BY place) AS whole FROM s GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY sec) AS k FROM g),
r AS (SELECT conv_id, 0 AS k, CAST(0 AS BIGINT) AS used, NULL::BIGINT AS sec, NULL::BIGINT[] AS places, CAST(0 AS BIGINT) AS char_len FROM (SELECT DISTINCT conv_id FROM g)
  UNION ALL SELECT conv_id, k, used + char_len, sec, places, char_len FROM (SELECT conv_id, k, used, sec, CASE WHEN fits THEN whole ELSE best[1:m] END AS places, CASE WHEN fits THEN size WHEN m > 0 THEN CAST(list_sum(sizes[1:m]) + 2 * (m - 1) AS BIGINT) ELSE 0 END AS char_len
    FROM (SELECT r.conv_id, n.k, r.used, n.sec, whole, best, sizes, size, size <= {_MOST} - r.used AS fits, CAST(len(list_filter(range(1, len(sizes) + 1), lambda i: list_sum(sizes[1:i]) <= {_MOST} - r.used)) AS BIGINT) AS m FROM r JOIN n ON n.conv_id = r.conv_id AND n.k = r.k + 1 WHERE size <= {_MOST} - r.used OR r.used < {_MOST}))),
h AS (SELECT conv_id, sha1(conv_id || coalesce('|' || nullif(string_agg(array_to_string(places, '|'), '|' ORDER BY sec) FILTER (WHERE len(places) > 0), ''), '') || '|' || {" || '|' || ".join(f"coalesce(max(char_len) FILTER (WHERE sec = {k}), 0)" for k in range(5))}) AS input_hash FROM r WHERE k > 0 GROUP BY 1)
SELECT conv_id, {_list(bundles.SECTIONS)}[sec + 1] AS section, array_to_string(places, ',') AS places, char_len, input_hash FROM r JOIN h USING (conv_id) WHERE k > 0""")
def q_bundles(t: Tables) -> DataFrame:
    """Which turns a bundle of a conversation's sections keeps within its budget."""
    c, k, n = t("conversations"), F.col("conv_id"), F.col("turn")
    text = F.concat_ws(" ", F.coalesce("text", F.lit("")), _deal(LINES, n))
    made = bundles.bundled(c.select("conv_id", _deal([*bundles.SECTIONS, "other"], k + n).alias("section"), "turn", text.alias("text")), "conv_id", "section", "turn", "text", _MOST)
    return made.select("conv_id", "section", F.array_join(F.transform("places", lambda p: p.cast("string")), ",").alias("places"), "char_len", "input_hash")
