"""Registered queries of the article rules. Records come from ``documents``: the text with a
clause, title, journal and publication type dealt to it by its id, so that rules meet their terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions import articles as a
from curata.functions import text as tx
from curata.operators import tagging
from curata.plans.queries import Tables, query

TITLES = ["A randomized placebo-controlled trial of creatine", "Meta-analysis of beta-alanine", "Survey of supplement usage in athletes", "Position stand on taurine", "A review of citrulline", "Longitudinal crossover study", "Editorial", "Double-blind random test", "Notes"]
PUBTYPES = ["Meta-Analysis", "Randomized Controlled Trial", "Review", "Cohort Studies", "Journal Article", "Clinical Trial", "Cross-Over Studies", "Editorial", "Systematic Review", "Journal Article", "Pilot Study"]
JOURNALS = ["Nutrients", "Sports Med", "Ann Tests", "J Appl Physiol (1985)"]
CLAUSES = [
    "Results: n = 45 trained men took 5 g/day for 8 weeks; 1RM and power improved (p < 0.05).",
    "In 120 participants over 12 ± 2 months, 6.4 g daily raised lean mass and muscle size.",
    "We asked 30 untrained women about side effects and blood pressure.",
    "Loading 20 g loading and 3 g maintenance; VO2max and time to exhaustion in 1200 athletes.",
    "Body weight and fat mass fell in 55 elderly subjects within 1 year, 200 mg pre-workout.",
    "Sport performance and adaptation, caution in diabetes; 18 volunteers.",
    "No outcome.",
    "Mean ± SD power and soreness, vo2 and sport, in 99999999999999999999 patients.",
]
HEADS = ["Abstract", "2. Materials and Methods", "RESULTS", "Discussion and conclusion", "Background", "Adverse events", "Aims", "Acknowledgements", "Treatment options", "Study design", "Key findings"]
FLOOR = 2.0


def _deal(values: list[str], by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def papers(t: Tables) -> DataFrame:
    d, k = t("documents"), F.col("doc_id")
    content = F.concat(_deal(CLAUSES, F.floor(k / 7)), F.lit("\n"), F.coalesce("text", F.lit("")))
    return d.select("doc_id", _deal(TITLES, k).alias("title"), F.array(_deal(PUBTYPES, k)).alias("pubtypes"), _deal(JOURNALS, k).alias("journal"), (F.lit(2010) + k % 15).alias("year"), content.alias("content"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


PAPERS = f"""papers AS (SELECT doc_id, {_list(TITLES)}[doc_id % {len(TITLES)} + 1] AS title, {_list(PUBTYPES)}[doc_id % {len(PUBTYPES)} + 1] AS pubtype, {_list(JOURNALS)}[doc_id % {len(JOURNALS)} + 1] AS journal,
  2010 + doc_id % 15 AS year, {_list(CLAUSES)}[(doc_id // 7) % {len(CLAUSES)} + 1] || chr(10) || coalesce(text, '') AS content FROM documents)"""


def _first(x: str, rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{label}'" for p, label in rules) + f" ELSE {default} END"


def _labels(x: str, table: dict[str, list[str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({x}, '{a.any_of(p)}') THEN '{k}' END" for k, p in table.items()) + "], lambda z: z IS NOT NULL)"


def _case(x: str, table, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{k}' THEN {v}e0" for k, v in dict(table).items()) + f" ELSE {default} END"


_BY_PUBTYPE = "CASE " + " ".join(f"WHEN lower(pubtype) IN ({', '.join(repr(n) for n in names)}) THEN '{label}'" for names, label in a.STUDY_BY_PUBTYPE)
_TA = "lower(title || ' ' || content)"
_STUDY = f"{_BY_PUBTYPE} WHEN regexp_matches({_TA}, 'double-blind|placebo-controlled') AND contains({_TA}, 'random') THEN 'RCT' ELSE {_first(_TA, a.STUDY_BY_TEXT, chr(39) + 'other' + chr(39))} END"
_CT = "lower(pubtype || ' ' || title || ' ' || content)"
_CATEGORY = _first(_CT, a.CATEGORY, f"CASE WHEN contains({_CT}, 'review') AND NOT regexp_matches({_CT}, 'systematic|meta') THEN 'narrative_review' ELSE 'other' END")
_KT = "lower(title || ' ' || journal || ' ' || content)"
_KIND = _first(_KT, a.DOC_KIND, f"CASE WHEN (contains(lower(pubtype), 'review') OR contains({_KT}, 'review')) AND study NOT IN ('meta-analysis', 'systematic_review') THEN 'narrative_review' WHEN contains(lower(pubtype), 'editorial') OR contains({_KT}, 'editorial') THEN 'editorial' END")
_N = "coalesce(list_max(list_transform(list_concat(" + ", ".join(f"regexp_extract_all(content, '{p}', 1)" for p in a.COUNTS) + "), lambda z: TRY_CAST(z AS BIGINT))), 0)"
_DURATION = f"trim(regexp_extract(content, '{a.DURATION}', 1) || ' ' || regexp_extract(content, '{a.DURATION}', 2))"
TYPED = f"""{PAPERS}, typed AS (SELECT *, {_STUDY} AS study, {_CATEGORY} AS category FROM papers),
kinds AS (SELECT *, {_KIND} AS kind, {_N} AS n, {_DURATION} AS duration FROM typed)"""


@query(f"""WITH {TYPED} SELECT doc_id, study AS study_type, category, kind AS doc_kind, {_case("coalesce(kind, study)", a.STRENGTH, _case("study", a.STRENGTH, "0.3e0"))} AS strength,
  coalesce(kind, study) NOT IN ({', '.join(repr(x) for x in a.NOT_BANKED)}) AND ({' OR '.join(f"regexp_matches(content, '{p}')" for p in a.RESULT_CUES)}) AS eligible FROM kinds""")
def q_study_types(t: Tables) -> DataFrame:
    p = typed(t)
    return p.select("doc_id", F.col("study").alias("study_type"), "category", F.col("kind").alias("doc_kind"), a.strength(F.col("kind"), F.col("study")).alias("strength"), a.eligible(F.col("kind"), F.col("study"), F.col("content")).alias("eligible"))


def typed(t: Tables) -> DataFrame:
    p = papers(t)
    p = p.withColumn("study", a.study_type(F.col("pubtypes"), F.concat_ws(" ", "title", "content"))).withColumn("category", a.study_category(F.concat_ws(" ", F.array_join("pubtypes", " "), "title", "content")))
    return p.withColumn("kind", a.doc_kind(F.concat_ws(" ", "title", "journal", "content"), F.col("pubtypes"), F.col("study"))).withColumn("n", a.sample_size(F.col("content"))).withColumn("duration", a.duration(F.col("content")))


_BOTH = "lower(title || chr(10) || content)"
_TOPICS = [(k, k.replace("-", " "), v) for k, v in a.RARE_TOPICS.items()] + [(k, k, v) for k, v in a.MEDIUM_TOPICS.items()]
_BONUS = "greatest(0.0e0, " + ", ".join(f"CASE WHEN contains({_BOTH}, '{k}') OR contains({_BOTH}, '{other}') THEN {v}e0 ELSE 0.0e0 END" for k, other, v in _TOPICS) + ")"
_RELIABILITY = f"""{_case("by_type", a.TYPE_POINTS, "1.0e0")} + CASE {' '.join(f"WHEN n >= {k} THEN {v}e0" for k, v in a.SIZE_POINTS)} ELSE 0.0e0 END + {' + '.join(f"contains(lower(title), '{w}')::INT::DOUBLE" for w in a.TITLE_WORDS)}
  + CASE WHEN {' OR '.join(f"contains(journal, '{j}')" for j in a.JOURNALS)} THEN 2.0e0 ELSE 0.0e0 END + CASE WHEN year >= 2020 THEN 1.0e0 WHEN year >= 2015 THEN 0.5e0 ELSE 0.0e0 END + {_BONUS}
  + CASE category WHEN 'intervention' THEN 0.25e0 WHEN 'observational_usage' THEN -0.25e0 ELSE 0.0e0 END"""


@query(f"""WITH {TYPED}, r AS (SELECT *, {_BY_PUBTYPE} ELSE 'other' END AS by_type FROM kinds), s AS (SELECT doc_id, study, n, duration, {_RELIABILITY} AS reliability FROM r)
SELECT doc_id, round(reliability, 6) AS reliability, round(least(10.0e0, {_case("study", a.DESIGN_POINTS, "1.0e0")} + CASE WHEN n >= 100 THEN 2.0e0 WHEN n >= 50 THEN 1.5e0 WHEN n >= 30 THEN 1.0e0 ELSE 0.5e0 END
  + CASE WHEN contains(duration, 'year') THEN 1.5e0 WHEN contains(duration, 'month') THEN 1.0e0 ELSE 0.5e0 END), 6) AS design FROM s WHERE reliability >= {FLOOR}""")
def q_reliability(t: Tables) -> DataFrame:
    """Scores of the records that reach the quality floor; the reliability score takes the study type from publication types only."""
    p = typed(t)
    score = a.reliability(a.study_type(F.col("pubtypes")), F.col("n"), F.col("title"), F.col("journal"), F.col("year"), F.col("content"), F.col("category"))
    scored = F.struct(score.alias("reliability"), a.design_score(F.col("study"), F.col("n"), F.col("duration")).alias("design"))
    # As an array's only entry the score is worked out once; a filter on it would be again, for every place that it stands in.
    kept = p.select("doc_id", F.explode(F.filter(F.array(scored), lambda s: s["reliability"] >= FLOOR)).alias("s"))
    return kept.select("doc_id", F.round("s.reliability", 6).alias("reliability"), F.round("s.design", 6).alias("design"))


_GOAL_SIZES = ", ".join(f"len({_labels('content', table)}) AS {g}" for g, table in a.GOALS.items())
_MOST = f"greatest({', '.join(a.GOALS)})"


@query(f"""WITH {PAPERS}, g AS (SELECT *, {_GOAL_SIZES} FROM papers), m AS (SELECT *, {_MOST} AS most, {' + '.join(f"({g} = {_MOST})::INT" for g in a.GOALS)} AS winners FROM g)
SELECT doc_id, CASE WHEN most = 0 THEN 'general' WHEN winners = 1 THEN CASE {' '.join(f"WHEN {g} = most THEN '{g}'" for g in a.GOALS)} END WHEN regexp_matches(content, '{a.SPORT}') THEN 'performance' ELSE 'general' END AS primary_goal,
  array_to_string(list_sort({_labels('content', a.OUTCOMES)}), ',') AS outcomes, array_to_string({_labels('content', a.SAFETY)}, ',') AS safety, regexp_matches(content, '{a.any_of(a.SAFETY['side_effects'])}') AS has_side_effects FROM m""")
def q_goals(t: Tables) -> DataFrame:
    """Goals, outcomes and signs of safety, by one pass over each text."""
    tables = a.GOALS | {"outcomes": a.OUTCOMES, "safety": a.SAFETY, "about": {"sport": [a.SPORT.removeprefix("(?i)")]}}
    p = tagging.found(papers(t).select("doc_id", "content"), "content", tables)
    labels = lambda table: tagging.of_table(F.col("found"), table)
    safety = labels("safety")
    return p.select(
        "doc_id",
        a.primary_goal(F.array(*[F.size(labels(g)) for g in a.GOALS]), F.array_contains("found", "about|sport")).alias("primary_goal"),
        F.array_join(F.array_sort(labels("outcomes")), ",").alias("outcomes"),
        F.array_join(safety, ",").alias("safety"),
        F.array_contains(safety, "side_effects").alias("has_side_effects"),
    )


_DOSES = "list_sort(list_distinct(list_concat(" + ", ".join(f"regexp_extract_all(lower(content), '{p}')" for p in a.DOSES) + ")))"
_PARTS = [_first("content", rules, "NULL") for rules in (a.TRAINING, a.SEX, a.AGES)]


@query(f"""WITH {TYPED}, p AS (SELECT *, concat_ws(' ', {', '.join(_PARTS)}) AS population FROM kinds)
SELECT doc_id, array_to_string({_DOSES}, ',') AS doses, contains(lower(content), 'loading') AS has_loading, n, duration, population, CASE WHEN n >= 100 THEN 'large' WHEN n >= 30 THEN 'medium' ELSE 'small' END AS size_class,
  CASE WHEN contains(duration, 'year') THEN 'long_term' WHEN contains(duration, 'month') THEN 'medium_term' ELSE 'short_term' END AS duration_class,
  CASE WHEN contains(population, 'athlete') THEN 'athletes' WHEN contains(population, 'trained') THEN 'trained' WHEN contains(population, 'elderly') THEN 'elderly' ELSE 'general' END AS population_class FROM p""")
def q_dosage(t: Tables) -> DataFrame:
    x, p = F.col("content"), F.col("population")
    d = papers(t).withColumn("n", a.sample_size(x)).withColumn("duration", a.duration(x)).withColumn("population", a.population(x))
    return d.select("doc_id", a.doses(x).alias("doses"), F.lower(x).contains("loading").alias("has_loading"), "n", "duration", "population", a.size_class(F.col("n")).alias("size_class"), a.duration_class(F.col("duration")).alias("duration_class"), a.population_class(p).alias("population_class"))


_DOI = "CASE doc_id % 3 WHEN 0 THEN ' https://doi.org/10.1%2FABC.' || doc_id WHEN 1 THEN 'http://dx.doi.org/10.2/x' || doc_id ELSE '' END"


@query(f"""WITH k AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id AS VARCHAR) ELSE ' ' END AS pmid, replace(regexp_replace(lower(trim({_DOI})), '^https?://(dx[.])?doi[.]org/', ''), '%2f', '/') AS doi, source, lang FROM documents),
d AS (SELECT doc_id, CASE WHEN trim(pmid) <> '' THEN 'pmid_' || pmid WHEN trim(doi) <> '' THEN 'doi_' || doi ELSE 'hash_' || substr(sha1(coalesce(source, '') || '|' || coalesce(lang, '')), 1, 16) END AS doc_key FROM k)
SELECT doc_id, doc_key, substr(sha1(doc_key), 1, 2) || '/' || substr(sha1(doc_key), 3, 2) AS shard FROM d""")
def q_document_keys(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    doi = F.when(k % 3 == 0, F.concat(F.lit(" https://doi.org/10.1%2FABC."), k)).when(k % 3 == 1, F.concat(F.lit("http://dx.doi.org/10.2/x"), k)).otherwise("")
    pmid = F.when(k % 4 == 0, k.cast("string")).otherwise(" ")
    d = t("documents").select("doc_id", tx.document_key(pmid, tx.normalized_doi(doi), F.col("source"), F.col("lang")).alias("doc_key"))
    return d.select("doc_id", "doc_key", a.shard(F.col("doc_key")).alias("shard"))


@query(f"""WITH h AS (SELECT source, {_list(HEADS)}[doc_id % {len(HEADS)} + 1] AS head FROM documents)
SELECT source, {_first("lower(head)", a.HEADINGS, "'other'")} AS section, CAST(count(*) AS BIGINT) AS n FROM h GROUP BY 1, 2""")
def q_section_histogram(t: Tables) -> DataFrame:
    return t("documents").select("source", a.heading(_deal(HEADS, F.col("doc_id"))).alias("section")).groupBy("source", "section").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, sha256(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, '') || chr(13) || chr(10) || ' as shown [1, 2-4] and [7]', '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), ' '), '\s*\[\d+(?:\s*[,-]\s*\d+)*\]', '', 'g')) AS digest FROM documents""")
def q_clean_text(t: Tables) -> DataFrame:
    shown = F.concat(F.coalesce("text", F.lit("")), F.lit("\r\n as shown [1, 2-4] and [7]"))
    return t("documents").select("doc_id", F.sha2(tx.without_citations(tx.normalized(shown)), 256).alias("digest"))
