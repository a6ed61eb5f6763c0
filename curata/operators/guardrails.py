"""Safety rules: which items a profile may take, cautions, caps of doses, warnings.

A profile (``conditions``, ``meds``, ``age``, ``pregnancy``) becomes its triggers, in order;
these meet a small broadcast table of rules, and each profile and item keeps the first
reason to block it, all cautions and the last cap. Rules are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions import text as tx

# Conditions under which an item is not given.
CONTRAINDICATED = {
    "creatine": ["renal_disease", "kidney_disease", "chronic_kidney_disease", "ckd", "dialysis", "nephropathy", "kidney_failure"],
    "caffeine": ["arrhythmia", "atrial_fibrillation", "severe_anxiety", "panic_disorder", "insomnia", "tachycardia", "heart_palpitations"],
    "nitrate": ["hypotension", "low_blood_pressure", "nitrate_medications", "viagra", "sildenafil", "tadalafil", "phosphodiesterase_inhibitors"],
    "citrulline": ["hypotension"],
    "protein": ["severe_kidney_disease"],
}
# What conditions, ages and medicines block, advise against and cap, with notes.
MINOR, PREGNANT, OLDER = "Recommend food-first approach for minors. Stimulants not advised.", "Conservative approach recommended during pregnancy. Consult healthcare provider.", "reduced for older adults"
CONDITIONS = {
    "hypertension": ([], ["nitrate", "stimulants", "licorice"], {"caffeine": 200}, "Blood pressure monitoring recommended. Caffeine may increase BP transiently."),
    "diabetes": ([], ["carb-based-supplements", "high-dose-carnitine"], {}, "Monitor blood glucose response to supplements. Some may affect insulin sensitivity."),
    "anxiety": (["caffeine", "stimulants"], [], {}, "Stimulants may exacerbate anxiety symptoms."),
    "insomnia": (["caffeine", "stimulants"], [], {}, "Avoid stimulants if sleep issues present."),
    "gerd": ([], ["caffeine", "citric_acid_supplements"], {}, "Caffeine may worsen acid reflux in some individuals."),
}
MEDICINES = {
    "ssri": ([], ["caffeine", "stimulants", "5-htp", "st-johns-wort"], "Stimulants may increase anxiety or interact with serotonergic medications."),
    "maoi": (["stimulants", "tyramine", "caffeine"], [], "Serious interaction risk with MAOIs. Avoid all stimulants."),
    "anticoagulants": ([], ["high-dose-omega3", "garlic", "ginger", "vitamin-e", "vitamin-k"], "May affect clotting. Monitor INR if on warfarin."),
    "bp_meds": ([], ["stimulants", "nitrate", "licorice"], "May alter blood pressure response. Monitor BP regularly."),
    "diabetes_meds": ([], ["carb-based-supplements"], "May affect blood sugar. Monitor glucose levels."),
    "thyroid_meds": ([], ["kelp", "iodine", "soy"], "Some supplements may interfere with thyroid hormone absorption."),
}
# Parts of medicines' names, in order, and their class.
MEDICINE_CLASS = [
    ("fluoxetine|sertraline|escitalopram|citalopram|paroxetine|prozac|zoloft|lexapro", "ssri"), ("phenelzine|tranylcypromine|isocarboxazid|nardil|parnate", "maoi"),
    ("warfarin|coumadin|apixaban|rivaroxaban|eliquis|xarelto|heparin", "anticoagulants"), ("lisinopril|amlodipine|losartan|metoprolol|atenolol|carvedilol", "bp_meds"),
    ("metformin|insulin|glipizide|glyburide|januvia|jardiance", "diabetes_meds"),
]
#: The tier, inclusion and reason that a grade gives; ``{goal}`` and ``{grade}`` are filled in.
TIERS = {"A": ("recommended", True, None), "B": ("optional", True, None), "C": ("optional", True, "Moderate evidence - may provide benefits")}


def condition(x: Column) -> Column:
    return F.replace(F.replace(F.trim(F.lower(x)), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))


def medicine(x: Column) -> Column:
    """The class of a medicine by its name, else other."""
    return tx.first_match(F.trim(F.lower(x)), MEDICINE_CLASS, "other")


def rules() -> list[tuple[int, str, str, str, str, str, float | None]]:
    """``step, trigger, value, item, effect, note, amount``: steps give the order of reasons."""
    out = [(1, "condition", k, item, "block", f"Contraindicated with {k.replace('_', ' ')}", None) for item, conditions in CONTRAINDICATED.items() for k in conditions]
    for k, (block, caution, cap, note) in CONDITIONS.items():
        out += [(2, "condition", k, x, "block", f"Not recommended with {k.replace('_', ' ')}", None) for x in block]
        out += [(7, "condition", k, x, "caution", note, None) for x in caution]
        out += [(7, "condition", k, x, "cap", f"{k.replace('_', ' ')} limit", float(v)) for x, v in cap.items()]
    out += [(3, "age", "minor", x, "block", "Not recommended for minors (age < 18)", None) for x in ("caffeine", "stimulants", "experimental")]
    out += [(4, "pregnancy", "yes", x, "block", "Not recommended during pregnancy", None) for x in ("high-dose-caffeine", "experimental", "ecdysteroids", "tribulus", "d-aspartic-acid")]
    for k, (avoid, caution, note) in MEDICINES.items():
        out += [(5, "medicine", k, x, "block", f"Avoid with {k} medications", None) for x in avoid]
        out += [(8, "medicine", k, x, "caution", f"{k.upper()}: {note}", None) for x in caution]
    out += [(5, "age", "minor", x, "caution", MINOR, None) for x in ("high-dose-protein", "creatine")]
    out += [(6, "pregnancy", "yes", x, "caution", PREGNANT, None) for x in ("nitrate", "beta-alanine")]
    out += [(6, "pregnancy", "yes", "caffeine", "cap", "pregnancy limit (ACOG guideline)", 200.0), (8, "age", "minor", "caffeine", "cap", "minor limit (conservative)", 100.0), (9, "age", "older", "caffeine", "share", OLDER, 0.75)]
    return out


def triggers(profiles: DataFrame, key: str) -> DataFrame:
    """``key, trigger, value, place`` of each profile; nulls trigger nothing, an age of 0 is unknown."""
    one = lambda kind, values: F.transform(values, lambda v, i: F.struct(F.lit(kind).alias("trigger"), v.alias("value"), i.alias("place")))
    empty = F.array().cast("array<string>")
    age = F.when((F.col("age") > 0) & (F.col("age") < 18), F.array(F.lit("minor"))).when(F.col("age") >= 65, F.array(F.lit("older"))).otherwise(empty)
    pregnant = F.when(F.col("pregnancy"), F.array(F.lit("yes"))).otherwise(empty)
    given = lambda x, f: F.transform(F.coalesce(x, empty), f)
    parts = F.concat(one("condition", given(F.col("conditions"), condition)), one("medicine", given(F.col("meds"), medicine)), one("age", age), one("pregnancy", pregnant))
    return profiles.select(key, F.explode(parts).alias("t")).select(key, "t.*")


def judged(spark: SparkSession, profiles: DataFrame, key: str, items: list[str]) -> DataFrame:
    """``key, item, is_safe, reason, cautions, max_mg, share`` of every profile and each of ``items``."""
    table = spark.createDataFrame(rules(), "step int, trigger string, value string, item string, effect string, note string, amount double")
    met = triggers(profiles, key).join(F.broadcast(table), ["trigger", "value"]).where(F.col("item").isin(items))
    order = F.struct("step", "place")
    of = lambda effect, x: F.when(F.col("effect") == effect, x)
    notes = F.array_join(F.transform(F.array_sort(F.collect_list(of("caution", F.struct("step", "place", "note")))), lambda x: x["note"]), "; ")
    found = met.groupBy(key, "item").agg(F.min_by("note", of("block", order)).alias("reason"), notes.alias("cautions"), F.max_by("amount", of("cap", order)).alias("max_mg"), F.max(of("share", F.col("amount"))).alias("share"))
    grid = profiles.select(key, F.explode(F.array(*map(F.lit, items))).alias("item"))
    out = grid.join(found, [key, "item"], "left")
    return out.select(key, "item", F.col("reason").isNull().alias("is_safe"), F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("cautions", F.lit("")).alias("cautions"), "max_mg", "share")


def tier(grade: Column, goal: Column) -> tuple[Column, Column, Column]:
    """Tier, inclusion and reason by grade; anything below C is left out."""
    name, included = F.lit("not_recommended"), F.lit(False)
    reason = F.concat(F.lit("Insufficient evidence for "), goal, F.lit(" goals (Grade "), grade, F.lit(")"))
    for g, (t, i, r) in TIERS.items():
        name, included, reason = F.when(grade == g, t).otherwise(name), F.when(grade == g, i).otherwise(included), F.when(grade == g, F.lit(r)).otherwise(reason)
    return name, included, reason


def weight_bin(kg: Column) -> Column:
    return tx.bracket(kg, [(100, "xl"), (85, "large"), (70, "medium"), (60, "small")], "xs")


def age_bin(age: Column) -> Column:
    """No age, or 0, is adult."""
    return F.when(F.coalesce(age, F.lit(0)) == 0, "adult").otherwise(tx.bracket(age, [(50, "mature"), (30, "adult"), (18, "young")], "minor"))
