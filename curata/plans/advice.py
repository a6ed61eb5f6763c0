"""Queries of rules over profiles, doses by form, and the bank by profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.operators import plans
from curata.operators import suitability as s
from curata.plans.articles import _deal, _list
from curata.plans.queries import Tables, query
from curata.sources import banks

#: Rules as they come, some of them wrong.
RULES = [
    '{"id": "kidney", "applies_to": ["creatine", "protein"], "severity": "hard_stop", "message": "see a doctor", "profile": {"conditions_any": ["CKD", "Kidney"]}}',
    '{"id": "young", "severity": "Caution", "profile": {"segment": "MACHINERY"}, "message": "few studies"}',
    '{"id": "stimulant", "applies_to": ["CAFFEINE"], "profile": {"conditions_any": ["anxiety"], "segment": "BUILDING"}, "actions": {"grade_delta": -1}}',
    '{"id": "stimulant", "applies_to": ["*"], "severity": "hard_stop"}',
    '{"applies_to": ["*"]}',
    '{"id": "odd", "applies_to": "creatine"}',
    '{"id": "worse", "severity": "fatal"}',
    '{"id": "list", "profile": ["x"]}',
    '{"id": "acts", "actions": "none"}',
    "[1]",
    "no json",
    '{"id": "sleep", "applies_to": [], "profile": {"conditions_any": ["insomnia"], "nation": "7"}, "message": "late in the day"}',
]
FAULTS = [None, None, None, None, "no id", "applies_to is no list", "invalid severity", "profile is no object", "actions is no object", "no object", "no object", None]
NAMES, STATES = ["creatine", "Caffeine", "protein", "zma"], ["ckd", "Anxiety", "insomnia", "none"]


def _rules(t: Tables) -> DataFrame:
    """The rules, numbered by the rows of ``nation``."""
    return s.coerced(t("nation").where(F.col("n_nationkey") < len(RULES)).select(F.col("n_nationkey").alias("pos"), _deal(RULES, F.col("n_nationkey")).alias("text")), "text", "pos")


_FAULTS = "[" + ", ".join("NULL" if f is None else f"'{f}'" for f in FAULTS) + "]"


@query(f"""WITH r AS (SELECT p_partkey AS pos, {_FAULTS}[p_partkey % {len(RULES)} + 1] AS fault, (p_partkey % 97) || '-' || json_extract_string(CASE WHEN {_FAULTS}[p_partkey % {len(RULES)} + 1] IS NULL THEN {_list(RULES)}[p_partkey % {len(RULES)} + 1] ELSE '{{}}' END, '$.id') AS rule_id FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY pos) AS k FROM r) SELECT pos, coalesce(fault, CASE WHEN k > 1 THEN 'repeated id' END) AS error, CASE WHEN fault IS NULL AND k = 1 THEN rule_id END AS rule_id FROM k""")
def q_rule_checks(t: Tables) -> DataFrame:
    """What is wrong with the rules of parts, each part's rule with an id that others may have."""
    k = F.col("p_partkey")
    text = F.replace(_deal(RULES, k), F.lit('"id": "'), F.concat(F.lit('"id": "'), (k % 97).cast("string"), F.lit("-")))
    return s.coerced(t("part").select(k.alias("pos"), text.alias("text")), "text", "pos").select("pos", "error", F.col("rule.id").alias("rule_id"))


@query(f"""WITH c AS (SELECT c_custkey, {_list(NAMES)}[c_custkey % 4 + 1] AS item, ['A', 'B', 'C', 'D', 'F', 'X'][c_custkey % 6 + 1] AS grade, lower({_list(STATES)}[(c_custkey // 5) % 4 + 1]) AS state, c_mktsegment AS seg, c_nationkey AS nation FROM customer),
m AS (SELECT *, lower(item) IN ('creatine', 'protein') AND state = 'ckd' AS hard, list_filter([CASE WHEN seg = 'MACHINERY' THEN 'young' END, CASE WHEN lower(item) = 'caffeine' AND (state = 'anxiety' OR seg = 'BUILDING') THEN 'stimulant' END, CASE WHEN state = 'insomnia' OR nation = 7 THEN 'sleep' END], lambda x: x IS NOT NULL) AS soft FROM c),
f AS (SELECT *, CASE WHEN hard THEN 'F' WHEN len(soft) = 0 THEN grade ELSE CASE grade WHEN 'A' THEN 'B' WHEN 'B' THEN 'C' WHEN 'C' THEN 'D' WHEN 'X' THEN 'X' ELSE 'F' END END AS final_grade FROM m)
SELECT c_custkey, final_grade, CASE WHEN hard THEN 'Avoid: see a doctor' WHEN len(soft) > 0 AND final_grade <> 'F' THEN 'Caution: ' || array_to_string(soft, '; ') ELSE 'OK' END AS suitability, CASE WHEN hard THEN 'kidney' ELSE array_to_string(soft, ',') END AS reasons FROM f""")
def q_suitability(t: Tables) -> DataFrame:
    """What the rules say to customers' items."""
    k = F.col("c_custkey")
    fields = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    items = t("customer").select("c_custkey", _deal(NAMES, k).alias("item"), _deal(["A", "B", "C", "D", "F", "X"], k).alias("grade"), F.array(_deal(STATES, F.floor(k / 5))).alias("conditions"), fields.alias("fields"))
    out = s.suitability(items, "item", "grade", "conditions", "fields", s.compiled(_rules(t), "v1"))
    return out.select("c_custkey", "final_grade", "suitability", F.array_join("reasons", ",").alias("reasons"))


_SHARE = lambda name, form: "CASE " + " ".join(f"WHEN {name} = '{a}' AND {form} = '{b}' THEN {x}e0" for a, b, x, *_ in s.FORMS) + " END"
_PICKED = [f"{a}-{b}" for a, b, *_ in s.FORMS] + ["zma", "creatine"]


@query(f"""WITH c AS (SELECT c_custkey, 40.0e0 + c_custkey % 81 AS weight, {_list([*s.PROTEIN, 'other'])}[c_custkey % 6 + 1] AS goal, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 150 * 1.0e0 END AS grams, CASE WHEN c_custkey % 3 = 1 THEN 0.8e0 END AS per_kg, {_list(_PICKED)}[c_custkey % {len(_PICKED)} + 1] AS name FROM customer),
p AS (SELECT *, split_part(name, '-', 1) AS supplement, CASE WHEN contains(name, '-') THEN substr(name, strpos(name, '-') + 1) END AS form, round_even(greatest(0e0, CASE goal WHEN 'strength' THEN 1.8e0 WHEN 'hypertrophy' THEN 1.8e0 WHEN 'endurance' THEN 1.4e0 WHEN 'weight_loss' THEN 2.0e0 ELSE 1.5e0 END * weight - coalesce(grams, per_kg * weight, 0e0)) / 5.0e0, 0) * 5.0e0 AS gap FROM c),
q AS (SELECT *, {_SHARE("'creatine'", "CASE WHEN supplement = 'creatine' THEN coalesce(form, 'monohydrate') ELSE 'monohydrate' END")} / 100e0 AS share, {_SHARE("supplement", "form")} AS own, {_SHARE("supplement", "CASE supplement WHEN 'protein' THEN 'whey-concentrate' WHEN 'hmb' THEN 'calcium' WHEN 'caffeine' THEN 'anhydrous' ELSE 'monohydrate' END")} AS reference FROM p)
SELECT c_custkey, supplement, form, CAST(round_even(CASE WHEN weight < 70 THEN 3.0e0 ELSE 5.0e0 END * 0.879e0 / share / 0.25e0, 0) * 0.25e0 AS DOUBLE) AS keep_grams, CAST(round_even(0.3e0 * weight * 0.879e0 / share / 0.25e0, 0) * 0.25e0 AS DOUBLE) AS load_grams, CASE WHEN gap >= 20 THEN gap END AS protein_grams, CAST(CASE WHEN gap >= 20 THEN ceil(gap / 25) END AS BIGINT) AS servings,
  round(coalesce(1000e0 * (own / 100) / (reference / 100), 1000e0), 4) AS converted_dose, CASE WHEN weight < 60 THEN 'xs' WHEN weight < 70 THEN 'small' WHEN weight < 85 THEN 'medium' WHEN weight < 100 THEN 'large' ELSE 'xl' END || ':' || CASE WHEN c_custkey % 90 = 0 THEN 'adult' WHEN c_custkey % 90 < 18 THEN 'minor' WHEN c_custkey % 90 < 30 THEN 'young' WHEN c_custkey % 90 < 50 THEN 'adult' ELSE 'mature' END AS bins FROM q""")
def q_doses(t: Tables) -> DataFrame:
    """Doses of creatine by form and weight, protein to add, a dose in the reference form, and bins of profiles."""
    k = F.col("c_custkey")
    c = t("customer").select("c_custkey", (40.0 + k % 81).alias("weight"), _deal([*s.PROTEIN, "other"], k).alias("goal"), F.when(k % 3 == 0, k % 150 * 1.0).alias("grams"), F.when(k % 3 == 1, 0.8).alias("per_kg"), _deal(_PICKED, k).alias("name"))
    name, form = s.parsed_form(F.col("name"))
    c = c.withColumns({"supplement": name, "form": form})
    reference = F.when(F.col("supplement") == "protein", "whey-concentrate").when(F.col("supplement") == "hmb", "calcium").when(F.col("supplement") == "caffeine", "anhydrous").otherwise("monohydrate")
    keep, load = s.creatine_grams(F.col("weight"), F.when(F.col("supplement") == "creatine", F.col("form")))
    gap, servings = s.protein_gap(F.col("goal"), F.col("weight"), F.col("grams"), F.col("per_kg"))
    key = s.bank_key(F.col("goal"), F.col("weight"), F.lit(None).cast("string"), k % 90)
    bins = F.concat_ws(":", F.get(F.split(key, ":"), F.lit(1)), F.get(F.split(key, ":"), F.lit(3)))
    return c.select("c_custkey", "supplement", "form", keep.alias("keep_grams"), load.alias("load_grams"), gap.alias("protein_grams"), servings.alias("servings"), F.round(s.converted(F.col("supplement"), F.col("form"), reference, F.lit(1000.0)), 4).alias("converted_dose"), bins.alias("bins"))


_GRID = " CROSS JOIN ".join(f"(SELECT unnest({_list(v)}) AS {k})" for k, v in s.BANKED.items())


@query(f"""WITH grid AS (SELECT * FROM {_GRID}), items AS (SELECT DISTINCT {_list(NAMES)}[doc_id % 4 + 1] AS supplement FROM documents),
base AS (SELECT {_list(NAMES)}[(doc_id * 3) % 4 + 1] AS supplement, {_list(s.BANKED["goal"][:4])}[doc_id % 4 + 1] AS goal, CASE WHEN count(*) > 50 THEN 'B' ELSE 'C' END AS grade FROM documents GROUP BY 1, 2),
e AS (SELECT {_list(NAMES[:3])}[doc_id % 3 + 1] AS supplement, [NULL, 'xs', 'medium'][(doc_id // 3) % 3 + 1] AS w, ['male', NULL, NULL, 'female'][(doc_id // 2) % 4 + 1] AS s, [NULL, NULL, NULL, NULL, 'mature'][doc_id % 5 + 1] AS a, source || ' ' || doc_id % 9 AS title, n_chars % 17 AS quality, doc_id FROM documents),
m AS (SELECT e.supplement, weight_bin, sex, age_bin, title, min((-quality, doc_id)) AS b, count(*) AS n FROM e JOIN (SELECT DISTINCT weight_bin, sex, age_bin FROM grid) g ON e.w = g.weight_bin OR e.s = g.sex OR e.a = g.age_bin GROUP BY 1, 2, 3, 4, 5),
k AS (SELECT *, row_number() OVER (PARTITION BY supplement, weight_bin, sex, age_bin ORDER BY b, title) AS place FROM m),
told AS (SELECT supplement, weight_bin, sex, age_bin, sum(n) AS n_evidence, string_agg(title, '; ' ORDER BY place) FILTER (WHERE place <= 3) AS citations FROM k GROUP BY 1, 2, 3, 4)
SELECT goal, weight_bin, sex, age_bin, supplement, coalesce(grade, 'D') AS base_grade, CAST(coalesce(n_evidence, 0) AS BIGINT) AS n_evidence, coalesce(citations, '') AS citations FROM grid CROSS JOIN items LEFT JOIN base USING (supplement, goal) LEFT JOIN told USING (supplement, weight_bin, sex, age_bin)""")
def q_bank_levels(t: Tables) -> DataFrame:
    """The bank by profile: first-level grades with what papers say of a profile's weight, sex or age."""
    d, k = t("documents"), F.col("doc_id")
    maybe = lambda values, by: F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.pmod(by, F.lit(len(values))).cast("int"))
    items = d.select(_deal(NAMES, k).alias("supplement"))
    base = d.groupBy(_deal(NAMES, k * 3).alias("supplement"), _deal(s.BANKED["goal"][:4], k).alias("goal")).agg(F.when(F.count("*") > 50, "B").otherwise("C").alias("grade"))
    evidence = d.select(
        _deal(NAMES[:3], k).alias("supplement"), maybe([None, "xs", "medium"], F.floor(k / 3)).alias("weight_bin"), maybe(["male", None, None, "female"], F.floor(k / 2)).alias("sex"), maybe([None] * 4 + ["mature"], k).alias("age_bin"),
        F.concat_ws(" ", "source", (k % 9).cast("string")).alias("title"), (F.col("n_chars") % 17).alias("quality"), k.alias("paper_id"),
    )
    return s.bank_levels(s.profile_grid(d.sparkSession), items, base, evidence)


TALK = ["Is Creatine HCl or whey worth it?", "I drink coffee and take fish oil.", "What of maca?", "Turkesterone, TMG and zma please.", "", "Beet juice or an iron tablet?"]
ILLS, TAKEN = ["hypertension", "panic_disorder", "diabetes", "none"], ["maoi", "none", "anticoagulants"]
_QUOTED = lambda x: x.replace("'", "''")
_NAMED = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(x, '{w}')" for w in words) + f" THEN '{name}' END" for name, words in plans.MENTIONED.items()) + "], lambda z: z IS NOT NULL)"


@query(f"""WITH p AS (SELECT conv_id, {_list(s.BANKED["goal"])}[conv_id % 6 + 1] AS goal, conv_id % 10 = 3 AS pregnant, conv_id * 7 % 90 AS age, {_list(ILLS)}[conv_id % 4 + 1] AS ill, {_list(TAKEN)}[conv_id % 3 + 1] AS taken, lower(string_agg(coalesce(text, '') || ' ' || {_list(TALK)}[(conv_id + turn) % {len(TALK)} + 1], chr(10) ORDER BY turn)) AS x FROM conversations GROUP BY 1),
n AS (SELECT *, {_NAMED} AS named FROM p), g AS (SELECT {_list(s.BANKED["goal"])}[doc_id % 6 + 1] AS goal, {_list([*plans.ALWAYS, "zma", "iron", "omega-3"])}[doc_id % 7 + 1] AS supplement, ['A', 'B', 'C', 'D'][CAST(sum(n_chars) % 4 AS INTEGER) + 1] AS grade FROM documents GROUP BY 1, 2),
e AS (SELECT conv_id, goal, pregnant, named, unnest(list_distinct(list_concat({_list(plans.ALWAYS)}, named))) AS supplement FROM n), j AS (SELECT e.*, coalesce(grade, 'D') AS grade FROM e LEFT JOIN g USING (goal, supplement)),
t AS (SELECT conv_id, CASE WHEN pregnant AND supplement NOT IN ({", ".join(f"'{x}'" for x in plans.PREGNANCY_SAFE)}) THEN 'excluded' WHEN grade = 'A' THEN 'recommended' WHEN grade IN ('B', 'C') THEN 'optional' WHEN list_contains(named, supplement) THEN 'excluded' END AS tier,
  supplement || CASE WHEN pregnant AND supplement NOT IN ({", ".join(f"'{x}'" for x in plans.PREGNANCY_SAFE)}) THEN ': {plans.PREGNANT}' WHEN grade = 'C' THEN ': {plans.CAUTION}' WHEN grade = 'D' THEN ': Insufficient evidence for ' || goal || ' goals (Grade D)' ELSE '' END AS item FROM j),
a AS (SELECT conv_id, {", ".join(f"coalesce(string_agg(item, '|' ORDER BY item) FILTER (WHERE tier = '{x}'), '') AS {x}" for x in ("recommended", "optional", "excluded"))} FROM t GROUP BY 1)
SELECT conv_id, array_to_string(named, ',') AS mentioned, recommended, optional, excluded, array_to_string(list_filter([CASE WHEN pregnant THEN '{_QUOTED(plans.WARNINGS["pregnancy"])}' END, CASE WHEN age > 0 AND age < 18 THEN '{plans.WARNINGS["minor"]}' END, CASE WHEN age >= 65 THEN '{plans.WARNINGS["older"]}' END, CASE ill WHEN 'hypertension' THEN '{plans.WARNINGS["hypertension"]}'
  WHEN 'diabetes' THEN '{plans.WARNINGS["diabetes"]}' WHEN 'panic_disorder' THEN '{plans.WARNINGS["anxiety"]}' END, CASE taken WHEN 'maoi' THEN '{plans.WARNINGS["maoi"]}' WHEN 'anticoagulants' THEN '{plans.WARNINGS["anticoagulants"]}' END], lambda z: z IS NOT NULL), '|') AS warnings FROM n JOIN a USING (conv_id)""")
def q_plans(t: Tables) -> DataFrame:
    """The plan of each conversation, from what it mentions, its profile, and the grades of goals."""
    c, k, n = t("conversations"), F.col("conv_id"), F.col("turn")
    said = c.select("conv_id", F.concat_ws(" ", F.coalesce("text", F.lit("")), _deal(TALK, k + n)).alias("x"))
    # Words are looked up turn by turn, so a conversation's text is never put together.
    found = plans.mentioned(said, "x").select("conv_id", F.explode_outer("mentioned").alias("m")).groupBy("conv_id").agg(F.collect_set("m").alias("set"))
    named = F.filter(F.array(*map(F.lit, plans.MENTIONED)), lambda x: F.array_contains("set", x))
    p = found.select("conv_id", named.alias("mentioned"), _deal(s.BANKED["goal"], k).alias("goal"), (k % 10 == 3).alias("pregnant"), (k * 7 % 90).alias("age"), F.array(_deal(ILLS, k)).alias("ills"), F.array(_deal(TAKEN, k)).alias("taken"))
    d = F.col("doc_id")
    grades = t("documents").groupBy(_deal(s.BANKED["goal"], d).alias("goal"), _deal([*plans.ALWAYS, "zma", "iron", "omega-3"], d).alias("supplement")).agg(_deal(["A", "B", "C", "D"], F.sum("n_chars")).alias("grade"))
    out = plans.assembled(p, "conv_id", "goal", "pregnant", "mentioned", grades).join(p.select("conv_id", "mentioned", plans.warnings(F.col("age"), F.col("pregnant"), F.col("ills"), F.col("taken")).alias("warnings")), "conv_id")
    return out.select("conv_id", F.array_join("mentioned", ",").alias("mentioned"), *[F.array_join(x, "|").alias(x) for x in ("recommended", "optional", "excluded", "warnings")])


@query(f"""SELECT source, {_list(s.BANKED["goal"])}[doc_id % 6 + 1] AS goal, {_list(NAMES)}[doc_id % 4 + 1] AS supplement, CASE WHEN count(*) >= 5 THEN 'B' WHEN count(*) >= 3 THEN 'C' ELSE 'D' END AS grade, round(avg(n_chars), 4) AS score FROM documents WHERE source IS NOT NULL GROUP BY 1, 2, 3""")
def q_bank_json(t: Tables) -> DataFrame:
    """Grades of each source, written as JSON in two shapes and read again."""
    k = F.col("doc_id")
    graded = F.when(F.count("*") >= 5, "B").when(F.count("*") >= 3, "C").otherwise("X")
    entries = t("documents").where("source IS NOT NULL").groupBy("source", _deal(s.BANKED["goal"], k).alias("goal"), _deal(NAMES, k).alias("supplement")).agg(graded.alias("grade"), F.round(F.avg("n_chars"), 4).alias("score"))
    flat = F.pmod(F.xxhash64("source"), F.lit(2)) == 0
    written = banks.write(entries.where(flat), ["source"]).unionByName(banks.write(entries.where(~flat), ["source"], nested=True))
    return banks.load(written, "bank", ["source"])
