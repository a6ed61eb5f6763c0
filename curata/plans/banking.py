"""Registered queries of exclusion rules, tags, mentions in talk, banked grades and resetting quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions import articles as a
from curata.functions import signals
from curata.operators import banking, corpus, limits, tagging
from curata.plans.articles import PAPERS, TYPED, _deal, _list, papers, typed
from curata.plans.queries import Tables, query
from curata.sources.files import cut

TAGS = ["Nitric Oxide", "creatine", "Beta Alanine", "creatine ", "nitric-oxide", "taurine"]
NOTES = ["Survey of usage in rats.", "A questionnaire on knowledge; bench press rose.", "Beetroot and nitrates in vitro.", "L-arginine, cross sectional.", "Nothing more.", "Mitochondrial fish oil.", "Treatment of adults with\nheart disease.", "Therapy of older adults with cancer.", "Prevention of diabetes.", "Obesity in children; no harm.", "Pregnant and overweight.", "Stroke."]
TALK = ["I have High Blood Pressure and take lisinopril.", "Can't sleep, so anxious.", "On Zoloft and warfarin, with CKD.", "No problems.", "Blood sugar is high; my mood is low.", "A beta blocker and a blood thinner for heart disease."]
OUTCOMES = ["Improved power", "worsened sleep", "no change", "Adverse but increased", "harmful"]
GOALS, ITEMS = ["strength", "muscle_gain", "endurance", "weight_loss", "performance", "general"], ["creatine", "caffeine", "nitrate", "citrulline", "taurine", "zma", "hmb"]
_AT = lambda values, k: f"{_list(values)}[({k}) % {len(values)} + 1]"
_HAS = lambda name: f"regexp_matches(x, '{a.any_of(getattr(a, name))}')"
_MEASURED = a.any_of([p for table in a.MEASURED.values() for p in table])


@query(f"""WITH {PAPERS}, n AS (SELECT doc_id, content || chr(10) || {_AT(NOTES, "doc_id // 3")} AS x FROM papers),
t AS (SELECT *, [replace(lower(trim({_AT(TAGS, "doc_id")})), ' ', '-'), replace(lower(trim({_AT(TAGS, "doc_id + 1")})), ' ', '-'), replace(lower(trim({_AT(TAGS, "doc_id + 3")})), ' ', '-')] AS tags FROM n)
SELECT doc_id, NOT regexp_matches(x, '{a.any_of(a.NOT_HUMAN)}') AS on_humans, regexp_matches(x, '{a.any_of(a.SURVEY)}') AND NOT regexp_matches(x, '{_MEASURED}') AS usage_survey,
  {_HAS("DISEASE")} AND NOT {_HAS("SAFE")} AND ({_HAS("CLINIC")} OR NOT ({_HAS("PREVENTION")} OR {_HAS("OBESE")} OR {_HAS("AGED")})) AS clinical,
  array_to_string(list_sort(list_distinct(list_filter(tags, lambda z: z <> 'nitric-oxide' OR regexp_matches(x, '{a.any_of(a.NITRIC_OXIDE)}')))), ',') AS tags FROM t""")
def q_exclusions(t: Tables) -> DataFrame:
    """What excludes a study, and the gate of its tags, by one pass over each text."""
    k = F.col("doc_id")
    d = papers(t).select("doc_id", F.concat("content", F.lit("\n"), _deal(NOTES, F.floor(k / 3))).alias("x"))
    tags = F.array(_deal(TAGS, k), _deal(TAGS, k + 1), _deal(TAGS, k + 3))
    signs = F.col("signs")
    d = tagging.found(d, "x", a.excluded_tables(), "signs")
    return d.select("doc_id", a.on_humans(signs).alias("on_humans"), a.usage_survey(signs).alias("usage_survey"), a.clinical(signs).alias("clinical"), F.array_join(a.gated_tags(tags, signs), ",").alias("tags"))


def _said(x: str, table: dict[str, list[str]]) -> str:
    quoted = lambda words: "|".join(words).replace("'", "''")
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches({x}, '{quoted(words)}') THEN '{k}' END" for k, words in table.items()) + "], lambda z: z IS NOT NULL), ',')"


_TALK = _AT(TALK, "conv_id * 5 + turn")


@query(f"""WITH c AS (SELECT conv_id, lower(string_agg(coalesce(text, '') || ' ' || CASE WHEN turn % 2 = 0 THEN {_TALK} ELSE '' END, chr(10) ORDER BY turn)) AS x FROM conversations GROUP BY 1)
SELECT conv_id, {_said("x", signals.CHAT_CONDITIONS)} AS conditions, {_said("x", signals.CHAT_MEDICINES)} AS meds FROM c""")
def q_chat_signals(t: Tables) -> DataFrame:
    said = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.when(F.col("turn") % 2 == 0, _deal(TALK, F.col("conv_id") * 5 + F.col("turn"))).otherwise(""))
    found = signals.by_conversation(t("conversations").select("conv_id", said.alias("x")), "conv_id", "x", {"conditions": signals.CHAT_CONDITIONS, "meds": signals.CHAT_MEDICINES})
    return found.select("conv_id", F.array_join("conditions", ",").alias("conditions"), F.array_join("meds", ",").alias("meds"))


@query(f"""WITH c AS (SELECT conv_id, turn, lower(coalesce(text, '') || ' ' || {_TALK}) AS x FROM conversations)
SELECT conv_id, turn, {_said("x", signals.TEXT_CONDITIONS)} AS conditions, {_said("x", signals.TEXT_MEDICINES)} AS meds FROM c""")
def q_text_signals(t: Tables) -> DataFrame:
    x = F.concat_ws(" ", F.coalesce("text", F.lit("")), _deal(TALK, F.col("conv_id") * 5 + F.col("turn")))
    return t("conversations").select("conv_id", "turn", F.array_join(signals.mentioned(x, signals.TEXT_CONDITIONS), ",").alias("conditions"), F.array_join(signals.mentioned(x, signals.TEXT_MEDICINES), ",").alias("meds"))


@query(f"""WITH {TYPED}, b AS (SELECT doc_id, {_AT(GOALS, "doc_id // 2")} AS goal, {_AT(ITEMS[:5], "doc_id // 11")} AS item, lower(study) AS study, lower({_AT(OUTCOMES, "doc_id // 5")}) AS o, (doc_id * 37 % 101) / 10.0e0 AS quality, (doc_id % 13)::DOUBLE AS reliability FROM kinds),
w AS (SELECT *, CASE WHEN regexp_matches(o, '{'|'.join(banking.POSITIVE)}') THEN 1 WHEN regexp_matches(o, '{'|'.join(banking.NEGATIVE)}') THEN -1 ELSE 0 END AS way, row_number() OVER (PARTITION BY goal, item ORDER BY quality DESC, doc_id) AS k FROM b),
g AS (SELECT goal, item, count(*) AS n, count(*) FILTER (WHERE contains(study, 'meta')) AS m, count(*) FILTER (WHERE contains(study, 'rct') OR contains(study, 'randomized')) AS r, count(*) FILTER (WHERE way = 1) AS u, count(*) FILTER (WHERE way = -1) AS d,
  avg(quality) AS q, avg(reliability) AS rel, string_agg(doc_id::VARCHAR, ',' ORDER BY k) FILTER (WHERE k <= 3) AS p FROM w GROUP BY 1, 2)
SELECT gs.goal, it.item, CAST(coalesce(n, 0) AS BIGINT) AS n_papers, CAST(coalesce(m, 0) AS BIGINT) AS n_meta, CAST(coalesce(r, 0) AS BIGINT) AS n_rct, CAST(coalesce(u, 0) AS BIGINT) AS n_up, CAST(coalesce(d, 0) AS BIGINT) AS n_down,
  round(coalesce(q, 0e0), 6) AS avg_quality, round(coalesce(rel, 0e0), 6) AS avg_reliability, round(CASE WHEN n IS NULL THEN 0e0 WHEN n < 2 THEN 1e0 WHEN u > d THEN u / n WHEN d > u THEN d / n ELSE 0.5e0 END, 6) AS consistency,
  CASE WHEN m >= 1 AND n >= 3 THEN 'B' WHEN r >= 2 OR m >= 1 OR n >= 2 THEN 'C' ELSE 'D' END AS grade, coalesce(p, '') AS publications
FROM (SELECT unnest({_list(GOALS)}) AS goal) gs CROSS JOIN (SELECT unnest({_list(ITEMS)}) AS item) it LEFT JOIN g ON g.goal = gs.goal AND g.item = it.item""")
def q_level_one(t: Tables) -> DataFrame:
    """The grid is six goals by seven items, of which two have no papers."""
    d, k = typed(t), F.col("doc_id")
    p = d.select("doc_id", "title", "study", _deal(GOALS, F.floor(k / 2)).alias("goal"), _deal(ITEMS[:5], F.floor(k / 11)).alias("item"), _deal(OUTCOMES, F.floor(k / 5)).alias("outcomes"), (k * 37 % 101 / 10.0).alias("quality"), (k % 13).cast("double").alias("reliability"))
    every = lambda values, name: F.explode(F.array(*map(F.lit, values))).alias(name)
    grid = d.sparkSession.range(1).select(every(GOALS, "goal")).select("goal", every(ITEMS, "item"))
    out = banking.level_one(p, grid, ["goal", "item"], "doc_id")
    rounded = ("avg_quality", "avg_reliability", "consistency")
    return out.select(*[F.round(x, 6).alias(x) if x in rounded else x for x in out.columns])


@query("""WITH RECURSIVE b AS (SELECT user_id, min(ts) AS start FROM events WHERE user_id IS NOT NULL GROUP BY 1
UNION ALL SELECT e.user_id, min(e.ts) FROM b JOIN events e ON e.user_id = b.user_id AND e.ts > b.start + INTERVAL 5 DAY GROUP BY 1),
p AS (SELECT event_id, e.user_id, e.ts, count(*) AS period FROM events e JOIN b ON b.user_id = e.user_id AND b.start <= e.ts GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, period ORDER BY ts, event_id) AS used FROM p)
SELECT event_id, user_id, CAST(period AS INTEGER) AS period, CAST(used AS INTEGER) AS used FROM r WHERE used <= 10""")
def q_reset_quota(t: Tables) -> DataFrame:
    """Ten uses within five days of a period's first use; the next period begins with the first use after them."""
    return limits.admitted(t("events"), "user_id", "ts", "event_id", 10, 5)


_SUPPLIES = ["creatine", " caffeine", "", "taurine", "zma"]
_PAIRED = f"""{TYPED}, x AS (SELECT doc_id, list_distinct(list_filter(list_transform([{_AT(_SUPPLIES, "doc_id")}, {_AT(_SUPPLIES, "doc_id // 3 + 1")}], lambda z: trim(z)), lambda z: z <> '')) AS tags, CASE WHEN doc_id % 6 = 0 THEN '' ELSE {_AT(GOALS, "doc_id // 2")} END AS goal,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE {_AT(["trained males", "elderly", "females"], "doc_id")} END AS population, study, lower(journal) AS journal, category, CASE WHEN doc_id % 3 = 0 THEN 'power' ELSE '' END AS outcomes, (doc_id % 13)::DOUBLE AS reliability FROM kinds),
e AS (SELECT doc_id, category, 'supplement_goal' AS family, unnest(tags) || '_' || goal AS combo FROM x WHERE goal <> '' UNION ALL SELECT doc_id, category, 'supplement_population', unnest(tags) || '_' || population FROM x WHERE population <> ''
  UNION ALL SELECT doc_id, category, 'goal_population', goal || '_' || population FROM x WHERE goal <> '' AND population <> '' UNION ALL SELECT doc_id, category, 'study_type_goal', study || '_' || goal FROM x WHERE study <> '' AND goal <> ''
  UNION ALL SELECT doc_id, category, 'journal_supplement', journal || '_' || unnest(tags) FROM x WHERE journal <> ''),
n AS (SELECT count(*) AS total FROM x), c AS (SELECT family, combo, CAST(count(*) AS BIGINT) AS n FROM e WHERE category <> 'observational_usage' GROUP BY 1, 2),
w AS (SELECT family, combo, c.n, CASE WHEN q > 5 THEN -4.0e0 WHEN q > 3 THEN -2.0e0 WHEN q > 2 THEN -1.0e0 WHEN q > 1 THEN 0.0e0 WHEN q > 0.5 THEN 1.5e0 ELSE 3.0e0 END AS weight FROM (SELECT c.*, CAST(c.n AS DOUBLE) / total / CASE WHEN total < 100 THEN 0.10e0 WHEN total < 1000 THEN 0.05e0 ELSE 0.01e0 END AS q FROM c, n) AS c)"""


def _paired(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Records with the fields of the five families, and the weights of their pairs; usage surveys aren't counted, but are in the total."""
    k = F.col("doc_id")
    tags = F.array_distinct(F.filter(F.transform(F.array(_deal(_SUPPLIES, k), _deal(_SUPPLIES, F.floor(k / 3) + 1)), F.trim), lambda x: x != ""))
    x = typed(t).select(
        "doc_id", tags.alias("tags"), F.when(k % 6 == 0, "").otherwise(_deal(GOALS, F.floor(k / 2))).alias("goal"), F.when(k % 7 == 0, "").otherwise(_deal(["trained males", "elderly", "females"], k)).alias("population"),
        "study", "journal", "category", F.when(k % 3 == 0, "power").otherwise("").alias("outcomes"), (k % 13).cast("double").alias("reliability"), F.size(tags).alias("breadth"),
    )
    x = cut(x)
    counts = corpus.combination_counts(x.where("category <> 'observational_usage'"), _pairs())
    return x, corpus.combination_weights(counts, x.count())


def _pairs() -> Column:
    return corpus.paper_pairs("tags", "goal", "population", "study", "journal")


@query(f"WITH {_PAIRED} SELECT family, combo, n, weight FROM w")
def q_family_weights(t: Tables) -> DataFrame:
    """How often the pairs of five families occur, and their weights."""
    return _paired(t)[1].select("family", "combo", "n", "weight")


@query(f"""WITH {_PAIRED}, s AS (SELECT x.*, coalesce(s, 0e0) AS s FROM x LEFT JOIN (SELECT doc_id, sum(weight) AS s FROM e JOIN w USING (family, combo) GROUP BY 1) USING (doc_id)),
g AS (SELECT doc_id, reliability, CASE WHEN category = 'observational_usage' OR outcomes = '' AND category NOT IN ('intervention', 'meta_analysis', 'systematic_review') THEN 0e0 WHEN s > 0 THEN least(s / sqrt(greatest(len(tags), 1)::DOUBLE), 5.0e0, 0.3e0 * reliability) ELSE s END AS c FROM s)
SELECT doc_id, round(c, 6) AS combination_score, round(reliability + c, 6) AS enhanced_score FROM g ORDER BY round(reliability + c, 6) DESC, doc_id LIMIT 100""")
def q_enhanced_top(t: Tables) -> DataFrame:
    """The hundred best records by reliability and gated combination score."""
    x, weights = _paired(t)
    scores = corpus.combination_scores(x, "doc_id", _pairs(), weights, "breadth", "reliability", corpus.gated(F.col("category"), F.col("outcomes")))
    out = scores.join(x.select("doc_id", "reliability"), "doc_id").select("doc_id", F.round("combination_score", 6).alias("combination_score"), F.round(F.col("reliability") + F.col("combination_score"), 6).alias("enhanced_score"))
    return out.orderBy(F.desc("enhanced_score"), "doc_id").limit(100)
