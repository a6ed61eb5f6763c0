"""Rules over profiles: checked, compiled and applied; doses by form; the bank by profile.

Rules that are applied, and forms, are small dimensions, which travel as one row with all of them; profiles and
items are tables of any size, and each row is settled by expressions, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# How bad a rule may be, and the ladder of grades.
SEVERITIES, LADDER = ["hard_stop", "caution"], "ABCDF"
RULE = "struct<id:string,applies_to:array<string>,severity:string,message:string,conditions:array<string>,fields:map<string,string>,pos:bigint>"


def coerced(rules: DataFrame, text: str, pos: str) -> DataFrame:
    """``pos, rule, error``: each rule's JSON as a struct, or what is wrong with it.

    An id is required; ``applies_to`` is a list, by default of ``*``; the severity is one of
    ``SEVERITIES`` in any case, by default a caution; profile and actions are objects. Of rules with
    one id the first by ``pos`` counts; later ones are in error. ``conditions_any`` in a profile is
    a list of conditions, all else in it fields. ``pos`` is unique.
    """
    v = F.try_parse_json(F.col(text))
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get("_v", path, "variant")), F.lit("VOID"))
    get = lambda path, as_: F.try_variant_get("_v", path, as_)
    r = rules.select(F.col(pos).cast("long").alias("pos"), v.alias("_v"))
    severity = F.lower(F.coalesce(F.when(get("$.severity", "string") != "", get("$.severity", "string")), F.lit("caution")))
    falsy = lambda path: kind(path).isin("VOID", "ARRAY<VOID>", "OBJECT<>") | F.coalesce(get(path, "string").isin("", "0", "false"), F.lit(False))
    bad = lambda path, start: ~falsy(path) & ~kind(path).startswith(start)
    error = (
        F.when(F.col("_v").isNull() | ~kind("$").startswith("OBJECT"), "no object")
        .when(F.coalesce(get("$.id", "string"), F.lit("")) == "", "no id")
        .when(bad("$.applies_to", "ARRAY"), "applies_to is no list")
        .when(~severity.isin(SEVERITIES), "invalid severity")
        .when(bad("$.profile", "OBJECT"), "profile is no object")
        .when(bad("$.actions", "OBJECT"), "actions is no object")
    )
    applies = F.coalesce(get("$.applies_to", "array<string>"), F.array(F.lit("*")))
    fields = F.map_filter(F.coalesce(get("$.profile", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda k, _: k != "conditions_any")
    rule = F.struct(
        get("$.id", "string").alias("id"),
        F.when(F.size(applies) == 0, F.array(F.lit("*"))).otherwise(applies).alias("applies_to"),
        severity.alias("severity"),
        F.coalesce(get("$.message", "string"), F.lit("")).alias("message"),
        F.transform(F.coalesce(get("$.profile.conditions_any", "array<string>"), F.array().cast("array<string>")), F.lower).alias("conditions"),
        F.transform_values(fields, lambda _, x: F.try_variant_get(x, "$", "string")).alias("fields"),
        F.col("pos"),
    )
    read = r.select("pos", rule.alias("rule"), error.alias("error"))
    first = read.where("error IS NULL").groupBy("rule.id").agg(F.min("pos").alias("first"))
    known = read.join(first.select(F.col("id").alias("_id"), "first"), F.col("rule.id") == F.col("_id"), "left")
    again = F.when(F.col("error").isNull() & (F.col("pos") > F.col("first")), "repeated id")
    return known.select("pos", F.when(F.coalesce("error", again).isNull(), F.col("rule").cast(RULE)).alias("rule"), F.coalesce("error", again).alias("error"))


def compiled(rules: DataFrame, version: str) -> DataFrame:
    """One row: the good rules in order as JSON, with the version, and its digest."""
    good = rules.where("error IS NULL").agg(F.array_sort(F.collect_list("rule"), lambda a, b: F.sign(a["pos"] - b["pos"]).cast("int")).alias("rules"))  # rules are few
    payload = F.to_json(F.struct(F.lit(version).alias("index_version"), F.transform("rules", lambda r: r.dropFields("pos")).alias("rules")))
    return good.select("rules", payload.alias("payload"), F.sha2(payload, 256).alias("sha256"))


def lowered(grade: Column, steps: Column) -> Column:
    """The grade so many steps down, not past F; other grades stay."""
    ladder = F.array(*map(F.lit, LADDER))
    at = F.array_position(ladder, grade)
    return F.when(at > 0, F.get(ladder, (F.least(at - 1 + steps, F.lit(len(LADDER) - 1))).cast("int"))).otherwise(grade)


def suitability(items: DataFrame, item: str, grade: str, conditions: str, fields: str, rules: DataFrame, most: int = 1) -> DataFrame:
    """``items`` with ``final_grade, suitability, reasons``, by the rules of ``compiled``.

    A rule applies to ``*`` or the item's name, in any case, and fits a profile that has any of its
    conditions, or any of its fields' values. The first hard stop that fits gives F and is
    the only reason; else each caution that fits is a reason, in the rules' order, and the first ``most``
    lower the grade by a step each. Null conditions and fields are empty.
    """
    held = items.crossJoin(F.broadcast(rules.select(F.col("rules").alias("_rules"))))  # one row
    own = F.transform(F.coalesce(F.col(conditions), F.array().cast("array<string>")), F.lower)
    applies = lambda r: F.array_contains(r["applies_to"], "*") | F.exists(r["applies_to"], lambda x: F.lower(x) == F.lower(F.col(item)))
    fits = lambda r: F.arrays_overlap(r["conditions"], own) | F.exists(F.map_entries(r["fields"]), lambda e: F.coalesce(F.try_element_at(F.col(fields), e["key"]) == e["value"], F.lit(False)))
    met = held.withColumn("_met", F.filter("_rules", lambda r: applies(r) & F.coalesce(fits(r), F.lit(False))))
    hard, soft = F.filter("_met", lambda r: r["severity"] == "hard_stop"), F.filter("_met", lambda r: r["severity"] == "caution")
    met = met.withColumns({"_hard": F.get(hard, F.lit(0)), "_soft": F.transform(soft, lambda r: r["id"])})
    stopped = F.col("_hard").isNotNull()
    final = F.when(stopped, "F").otherwise(lowered(F.col(grade), F.least(F.size("_soft"), F.lit(most))))
    said = F.when(stopped, F.concat(F.lit("Avoid: "), F.col("_hard.message"))).when((F.size("_soft") > 0) & (final != "F"), F.concat(F.lit("Caution: "), F.array_join("_soft", "; "))).otherwise("OK")
    out = met.withColumns({"final_grade": final, "suitability": said, "reasons": F.when(stopped, F.array(F.col("_hard.id"))).otherwise(F.col("_soft"))})
    return out.drop("_rules", "_met", "_hard", "_soft")


# Forms of supplements with the active share, the grade of research, the price factor, and which one is the reference.
FORMS = [
    ("creatine", "monohydrate", 87.9, "A", 1.0, True), ("creatine", "anhydrous", 100.0, "B", 1.2, False), ("creatine", "hcl", 78.2, "C", 2.0, False), ("creatine", "ethyl-ester", 82.4, "D", 1.8, False),
    ("protein", "whey-concentrate", 80.0, "A", 1.0, True), ("protein", "whey-isolate", 90.0, "A", 1.4, False), ("protein", "casein", 80.0, "B", 1.2, False), ("protein", "soy", 85.0, "B", 0.9, False), ("protein", "pea", 80.0, "C", 1.1, False),
    ("hmb", "calcium", 83.0, "B", 1.0, True), ("hmb", "free-acid", 100.0, "C", 1.5, False), ("caffeine", "anhydrous", 100.0, "A", 1.0, True), ("caffeine", "citrate", 50.0, "C", 1.3, False),
]
# Fixed values of doses: maintenance of creatine by weight, its loading a kilogram, protein a kilogram by goal, and steps of rounding.
LIGHT, LIGHT_GRAMS, HEAVY_GRAMS, LOADING = 70, 3.0, 5.0, 0.3
PROTEIN = {"strength": 1.8, "hypertrophy": 1.8, "endurance": 1.4, "weight_loss": 2.0, "general": 1.5}
CREATINE_STEP, PROTEIN_STEP, SERVING, LEAST_GAP, USUAL = 0.25, 5.0, 25, 20, 1.5


def _active(supplement: Column, form: Column) -> Column:
    table = F.create_map(*[F.lit(x) for s, f, share, *_ in FORMS for x in (f"{s}:{f}", share)])
    return F.try_element_at(table, F.concat_ws(":", supplement, form))


def stepped(x: Column, step: float) -> Column:
    """To the nearest multiple of ``step``, halves to the even one."""
    return F.bround(x / step) * step


def creatine_grams(weight: Column, form: Column) -> tuple[Column, Column]:
    """Grams a day of a form of creatine, to keep up and to load; null for other forms. A null form is the reference."""
    share = _active(F.lit("creatine"), F.coalesce(form, F.lit("monohydrate"))) / 100
    base = F.lit(0.879)
    keep = F.when(weight < LIGHT, LIGHT_GRAMS).otherwise(HEAVY_GRAMS)
    return stepped(keep * base / share, CREATINE_STEP), stepped(F.lit(LOADING) * weight * base / share, CREATINE_STEP)


def protein_gap(goal: Column, weight: Column, grams: Column, per_kg: Column) -> tuple[Column, Column]:
    """Grams of protein a day to add, and servings of them; null below the least gap. Eaten grams count before grams a kilogram."""
    target = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PROTEIN.items() for x in kv]), goal), F.lit(USUAL)) * weight
    gap = stepped(F.greatest(F.lit(0.0), target - F.coalesce(grams, per_kg * weight, F.lit(0.0))), PROTEIN_STEP)
    some = F.when(gap >= LEAST_GAP, gap)
    return some, F.ceil(some / SERVING)


def converted(supplement: Column, form: Column, to: Column, dose: Column) -> Column:
    """The dose of another form with the same active amount; the dose itself if a form isn't known."""
    a, b = _active(supplement, form), _active(supplement, to)
    return F.coalesce(dose * (a / 100) / (b / 100), dose)


def parsed_form(name: Column) -> tuple[Column, Column]:
    """Supplement and form of a name, at its first hyphen; a name without one has no form."""
    parts = F.split(name, "-", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def form_options(forms: DataFrame) -> DataFrame:
    """``forms`` (supplement, form, grade, cost, is_reference) with ``place``: the reference first, then by grade from D up to A, as ties by form."""
    place = F.row_number().over(Window.partitionBy("supplement").orderBy(F.desc("is_reference"), F.desc("grade"), F.asc("form")))
    return forms.withColumn("place", place)


# Bins of weight and age, and the axes of the bank's profiles.
WEIGHTS, AGES, SEXES = [(60, "xs"), (70, "small"), (85, "medium"), (100, "large")], [(18, "minor"), (30, "young"), (50, "adult")], ["male", "female", "other"]
BANKED = {"goal": ["strength", "hypertrophy", "endurance", "weight_loss", "performance", "general"], "weight_bin": ["xs", "small", "medium", "large", "xl"], "sex": SEXES, "age_bin": ["young", "adult", "mature"]}


def _bin(x: Column, limits: list[tuple[int, str]], last: str) -> Column:
    out = F.lit(last)
    for limit, label in reversed(limits):
        out = F.when(x < limit, label).otherwise(out)
    return out


def bank_key(goal: Column, weight: Column, sex: Column, age: Column) -> Column:
    """``goal:weight:sex:age`` in bins; an unknown sex is other, an unknown age or one of 0 adult."""
    age_bin = F.when(age.isNull() | (age == 0), "adult").otherwise(_bin(age, AGES, "mature"))
    return F.concat_ws(":", goal, _bin(weight, WEIGHTS, "xl"), F.coalesce(sex, F.lit("other")), age_bin)


def profile_grid(spark: SparkSession) -> DataFrame:
    """Every profile of the bank: the product of ``BANKED``, whose size is fixed."""
    out = spark.range(1).select()
    for name, values in BANKED.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return out


def bank_levels(grid: DataFrame, items: DataFrame, base: DataFrame, evidence: DataFrame) -> DataFrame:
    """``goal, weight_bin, sex, age_bin, supplement, base_grade, n_evidence, citations``: the second level over the first.

    ``base`` grades ``supplement, goal`` (D if absent); ``evidence`` (supplement, weight_bin, sex,
    age_bin, title, quality, paper_id; a null bin fits none) counts for profiles that share any of its bins.
    Citations are the three best titles, each once: by quality, then id. ``items`` (supplement) and the grid are dimensions.
    """
    each = grid.crossJoin(F.broadcast(items.select("supplement").distinct()))
    axes = ["weight_bin", "sex", "age_bin"]
    one = evidence.groupBy("supplement", *axes, "title").agg(F.min_by(F.struct("quality", "paper_id"), F.struct(-F.col("quality"), F.col("paper_id"))).alias("b"), F.count("*").alias("n"))
    # By bins, not papers: a row for each title and the bins that it names.
    fits = [F.col(f"e.{a}") == F.col(f"p.{a}") for a in axes]
    profiles = grid.select(*axes).distinct()
    met = one.alias("e").join(F.broadcast(profiles.alias("p")), fits[0] | fits[1] | fits[2]).select(F.col("e.supplement").alias("supplement"), *[F.col(f"p.{a}").alias(a) for a in axes], "title", "b", "n")
    titled = met.groupBy("supplement", *axes, "title").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("b.quality")).alias("q"), F.col("b.paper_id").alias("paper_id"))).alias("b"))
    place = F.row_number().over(Window.partitionBy("supplement", *axes).orderBy("b", "title"))
    best = titled.withColumn("_place", place)
    told = best.groupBy("supplement", *axes).agg(F.sum("n").alias("n_evidence"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_place") <= 3, F.struct("_place", "title")))), lambda x: x["title"]), "; ").alias("citations"))
    graded = each.join(base.select("supplement", "goal", F.col("grade").alias("base_grade")), ["supplement", "goal"], "left").join(told, ["supplement", *axes], "left")
    return graded.select("goal", *axes, "supplement", F.coalesce("base_grade", F.lit("D")).alias("base_grade"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.coalesce("citations", F.lit("")).alias("citations"))
