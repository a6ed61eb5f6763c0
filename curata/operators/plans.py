"""Plans from talk and profiles: what is mentioned, graded, left out and warned of."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.operators import tagging

# Supplements with the words that mention them, in order; every plan's candidates; what pregnancy allows.
MENTIONED = {
    "creatine": ["creatine", "monohydrate", "hcl", "anhydrous"], "caffeine": ["caffeine", "coffee", "pre-workout"], "protein": ["protein", "whey", "casein"], "beta-alanine": ["beta-alanine", "beta alanine", "carnosine"],
    "citrulline": ["citrulline", "l-citrulline"], "nitrate": ["nitrate", "beetroot", "beet juice"], "hmb": ["hmb", "beta-hydroxy"], "bcaa": ["bcaa", "branched chain"], "taurine": ["taurine"], "carnitine": ["carnitine", "l-carnitine"],
    "glutamine": ["glutamine", "l-glutamine"], "zma": ["zma", "zinc magnesium"], "ashwagandha": ["ashwagandha"], "rhodiola": ["rhodiola"], "fish-oil": ["fish oil", "omega-3", "omega 3", "omega3"], "omega-3": ["omega-3", "omega 3", "fish oil", "dha", "epa"],
    "vitamin-d": ["vitamin d", "vitamin-d", "vit d"], "magnesium": ["magnesium", "mag"], "glycine": ["glycine"], "collagen": ["collagen"], "glucosamine": ["glucosamine"], "curcumin": ["curcumin", "turmeric"],
    "b12": ["b12", "b-12", "vitamin b12", "cobalamin"], "iron": ["iron", "ferrous"], "folate": ["folate", "folic acid"], "leucine": ["leucine", "l-leucine"], "tribulus": ["tribulus"], "d-aspartic-acid": ["d-aspartic", "daa", "d aspartic acid"],
    "tongkat-ali": ["tongkat", "tongkat ali"], "deer-antler": ["deer antler", "velvet antler"], "ecdysteroids": ["ecdysteroid", "turkesterone"], "betaine": ["betaine", "tmg"], "cla": ["cla", "conjugated linoleic"],
}
ALWAYS = ["creatine", "caffeine", "protein", "beta-alanine"]
PREGNANCY_SAFE = ["protein", "prenatal-vitamin", "omega-3", "vitamin-d", "folate"]
# Warnings of a whole plan.
WARNINGS = {
    "pregnancy": "⚠️ Pregnancy: Conservative supplement approach recommended. Consult OB/GYN before use.",
    "minor": "⚠️ Minor (age < 18): Food-first approach strongly recommended. Avoid stimulants.",
    "older": "ℹ️ Older adult: May benefit from protein and HMB for muscle preservation.",
    "hypertension": "⚠️ Hypertension: Monitor blood pressure. Caffeine may cause transient increases.",
    "diabetes": "⚠️ Diabetes: Monitor blood glucose response to supplements.",
    "anxiety": "⚠️ Anxiety: Stimulants avoided due to potential to worsen symptoms.",
    "maoi": "🚫 MAOI: All stimulants avoided due to serious interaction risk.",
    "anticoagulants": "⚠️ Anticoagulants: Monitor for bleeding. Some supplements may affect clotting.",
}
CONDITIONS = {"hypertension": ["hypertension", "high_blood_pressure"], "diabetes": ["diabetes"], "anxiety": ["anxiety", "panic_disorder"]}
CAUTION, PREGNANT = "Moderate evidence - may provide benefits", "Not recommended during pregnancy"


def mentioned(df: DataFrame, text: str, name: str = "mentioned") -> DataFrame:
    """``df`` with the supplements that a text mentions, each once, in the table's order; one pass over each text."""
    table = {s: [re.escape(w) for w in words] for s, words in MENTIONED.items()}
    return tagging.found(df, text, {"s": table}, name).withColumn(name, tagging.of_table(F.col(name), "s"))


def warnings(age: Column, pregnant: Column, conditions: Column, medicines: Column) -> Column:
    """What a profile is warned of, in order; nulls and an age of 0 warn of nothing. Conditions and medicines are normalised."""
    none = F.array().cast("array<string>")
    own, taken = F.coalesce(conditions, none), F.coalesce(medicines, none)
    said = [
        F.when(F.coalesce(pregnant, F.lit(False)), WARNINGS["pregnancy"]),
        F.when((age > 0) & (age < 18), WARNINGS["minor"]),
        F.when(age >= 65, WARNINGS["older"]),
        *[F.when(F.arrays_overlap(own, F.array(*map(F.lit, names))), WARNINGS[c]) for c, names in CONDITIONS.items()],
        *[F.when(F.array_contains(taken, m), WARNINGS[m]) for m in ("maoi", "anticoagulants")],
    ]
    return F.array_compact(F.array(*said))


def assembled(profiles: DataFrame, key: str, goal: str, pregnant: str, named: str, grades: DataFrame) -> DataFrame:
    """``key, recommended, optional, excluded``: the plan of each profile from its candidates' grades.

    Candidates are ``ALWAYS`` and what is ``named``. A grade of A is recommended, B and C optional (with a note at C),
    all else excluded with a reason, unless it isn't named: then it is left out, as is what ``grades`` (goal, supplement,
    grade; unique) doesn't have. In pregnancy all but what is safe is excluded. Lists are sorted; a plan has as many items as
    its profile has candidates. Keys are unique; a profile without items has empty lists.
    """
    named_ = F.coalesce(F.col(named), F.array().cast("array<string>"))
    each = profiles.select(F.col(key).alias("_key"), F.col(goal).alias("goal"), F.coalesce(F.col(pregnant), F.lit(False)).alias("_pregnant"), named_.alias("_named"), F.explode(F.array_union(F.array(*map(F.lit, ALWAYS)), named_)).alias("supplement"))
    g = each.join(grades.select("goal", "supplement", "grade"), ["goal", "supplement"], "left").withColumn("grade", F.coalesce("grade", F.lit("D")))
    asked = F.array_contains("_named", F.col("supplement"))
    unsafe = F.col("_pregnant") & ~F.col("supplement").isin(PREGNANCY_SAFE)
    low = F.concat(F.lit("Insufficient evidence for "), F.coalesce("goal", F.lit("general")), F.lit(" goals (Grade "), F.col("grade"), F.lit(")"))
    tier = F.when(unsafe, "excluded").when(F.col("grade") == "A", "recommended").when(F.col("grade").isin("B", "C"), "optional").when(asked, "excluded")
    reason = F.when(unsafe, PREGNANT).when(F.col("grade") == "C", CAUTION).when(~F.col("grade").isin("A", "B"), low)
    items = g.select("_key", tier.alias("tier"), F.concat_ws(": ", "supplement", reason).alias("item")).where("tier IS NOT NULL")
    lists = [F.array_sort(F.collect_list(F.when(F.col("tier") == t, F.col("item")))).alias(t) for t in ("recommended", "optional", "excluded")]
    plans = profiles.select(F.col(key).alias("_key")).join(items.groupBy("_key").agg(*lists), "_key", "left")
    none = F.array().cast("array<string>")
    return plans.select(F.col("_key").alias(key), *[F.coalesce(x, none).alias(x) for x in ("recommended", "optional", "excluded")])
