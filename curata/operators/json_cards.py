"""Cards from JSON that models wrote: repair, paths, a fold by section, heuristics of text, and checks.

JSON is read as variants by path, so that fields of any shape are taken or left without a
schema, and a field of the wrong type is null. The fold of a paper's parts is an aggregate
that combines before it is shuffled; no group of parts is held in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sections in the order in which their word counts, and those that each field is taken from.
PRIORITY = {"methods": 1, "abstract": 2, "results": 3, "discussion": 4}
FIELDS = {
    "n": ("$.population_size", "int", ["methods", "abstract"]),
    "dose_g_per_day": ("$.dose_g_per_day", "double", ["methods"]),
    "duration_weeks": ("$.duration_weeks", "double", ["methods"]),
    "effect_sizes": ("$.effect_sizes", "string", ["results"]),
    "significance": ("$.statistical_significance", "string", ["results"]),
    "safety_notes": ("$.safety_notes", "string", ["discussion"]),
    "adverse_events": ("$.adverse_events", "string", ["discussion"]),
}


def repaired(text: Column) -> Column:
    """The JSON object in a model's answer: what a code fence holds, else from the first to the last brace.

    Commas before a closing bracket go, and so do control characters. Null without an object.
    """
    t = F.trim(F.coalesce(text, F.lit("")))
    fenced = F.regexp_extract(t, r"(?s)^```[^\n]*\n(.*?)(?:\n\s*```|$)", 1)
    body = F.when(t.startswith("```"), fenced).otherwise(t)
    found = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    clean = F.regexp_replace(F.regexp_replace(found, r"[\x00-\x1f\x7f]", " "), r",(\s*[}\]])", "$1")
    return F.when(clean != "", clean)


def parsed(text: Column) -> Column:
    """The repaired answer as a variant; null where it is still no JSON."""
    return F.try_parse_json(repaired(text))


def field(v: Column, path: str, kind: str) -> Column:
    """The value at a path, or a text that reads as one; null for what can't be one, and for a zero or an empty text or list, which say nothing."""
    x = F.try_variant_get(v, path, kind)
    return F.when((x != 0) if kind in ("int", "double") else ~x.isin("", "[]", "{}"), x)


def fold(parts: DataFrame, keys: list[str], section: str, answer: str, tie: str, first: bool = True) -> DataFrame:
    """``keys`` and, for each of ``FIELDS``, the value of the first section by ``PRIORITY`` that has one.

    With ``first`` false later sections overwrite earlier ones. Among parts of one section the
    smaller ``tie`` is first, the larger last. Groups in which no part has a value keep their row.
    """
    order = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col(section)), F.lit(len(PRIORITY) + 1))
    rows = parts.select(*keys, F.col(section).alias("_section"), F.struct(order.alias("o"), F.col(tie).alias("t")).alias("_at"), parsed(F.col(answer)).alias("_v"))
    values = rows.select(*keys, "_section", "_at", *[field(F.col("_v"), path, kind).alias(name) for name, (path, kind, _) in FIELDS.items()])
    chosen = F.min_by if first else F.max_by
    told = {name: F.col("_section").isin(sections) & F.col(name).isNotNull() for name, (_, _, sections) in FIELDS.items()}
    return values.groupBy(*keys).agg(*[chosen(F.when(told[name], F.col(name)), F.when(told[name], F.col("_at"))).alias(name) for name in FIELDS])


# Fixed values of the heuristics: patterns of sizes, durations and doses, and words of direction in order.
SIZE = r"(?i)\b(?:n|sample size|participants)\s*[:=]?\s*(\d{2,4})\b"
WEEKS = r"(?i)\b(\d{1,2}(?:\.\d+)?)\s*(wk|wks|week|weeks|mo|mos|month|months)\b"
DOSE = r"(?i)\b(\d+(?:\.\d+)?)\s*(g|mg)\s*/\s*(?:d|day|kg)\b"
MONTH, NEAR = 4.345, 160
DIRECTIONS = [
    ("increase", ["increase", "increased", "improved", "improvement", "greater than placebo"]),
    ("decrease", ["decrease", "decreased", "reduced", "reduction", "less than placebo"]),
    ("no_effect", ["no significant", "no effect", "ns.", "n.s."]),
]
CONFIDENCE = {"n": 0.20, "dose_g_per_day": 0.20, "duration_weeks": 0.15, "safety_notes": 0.10}
TITLED = 0.10
VERBS = {"increase": "improves", "decrease": "reduces", "no_effect": "shows no clear effect on"}


def _number(text: Column, pattern: str, group: int, kind: str) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast(kind)


def heuristics(df: DataFrame, methods: str, abstract: str, results: str, discussion: str, term: str) -> DataFrame:
    """``df`` with ``n, duration_weeks, dose_g_per_day, direction, span_start, span_end, safety_notes`` read from its sections.

    The size comes from methods, then abstract; weeks (months by 4.345, rounded half to even)
    and dose (milligrams as grams) from methods, or the abstract if there are none. A dose is
    looked for around the first place of ``term``, if it is named, else anywhere. The direction is the
    first of ``DIRECTIONS`` with a word in the results; the span is that of the first word of the list there. Null
    sections are empty; a null or absent term is not named.
    """
    own = {x: f"_{x}_" for x in ("methods", "abstract", "results", "discussion", "context", "at", "window", "amount")}
    text = {x: F.coalesce(F.col(c), F.lit("")) for x, c in (("methods", methods), ("abstract", abstract), ("results", results), ("discussion", discussion))}
    # Columns of their own, one after the other, so that nothing is worked out twice.
    df = df.withColumns({own["methods"]: text["methods"], own["abstract"]: text["abstract"], own["results"]: F.lower(text["results"]), own["discussion"]: F.lower(F.concat(text["discussion"], F.lit("\n"), text["results"]))})
    df = df.withColumn(own["context"], F.when(F.col(own["methods"]) != "", F.col(own["methods"])).otherwise(F.col(own["abstract"])))
    named = F.coalesce(F.lower(F.col(term)), F.lit(""))
    df = df.withColumn(own["at"], F.when(named != "", F.position(named, F.lower(own["context"]))).otherwise(0))
    context, at = F.col(own["context"]), F.col(own["at"])
    start = F.greatest(at - 1 - NEAR, F.lit(0))
    df = df.withColumn(own["window"], F.when(at > 0, F.substring(context, start + 1, at - 1 + NEAR - start)).otherwise(context))
    weeks = F.struct(_number(context, WEEKS, 1, "double").alias("n"), F.lower(F.regexp_extract(context, WEEKS, 2)).alias("unit"))
    grams = F.struct(_number(F.col(own["window"]), DOSE, 1, "double").alias("n"), F.lower(F.regexp_extract(own["window"], DOSE, 2)).alias("unit"))
    df = df.withColumn(own["amount"], F.struct(weeks.alias("weeks"), grams.alias("grams")))
    weeks, grams = F.col(own["amount"])["weeks"], F.col(own["amount"])["grams"]
    n = _number(F.concat(F.col(own["methods"]), F.lit("\n\n"), F.col(own["abstract"])), SIZE, 1, "int")
    low = F.col(own["results"])
    direction = F.lit(None).cast("string")
    for label, words in reversed(DIRECTIONS):
        direction = F.when(F.greatest(*[low.contains(w) for w in words]), label).otherwise(direction)
    first, last = F.lit(None).cast("int"), F.lit(None).cast("int")
    for word in reversed([w for _, words in DIRECTIONS for w in words]):
        place = F.position(F.lit(word), low)
        first, last = F.when(place > 0, place - 1).otherwise(first), F.when(place > 0, place - 1 + len(word)).otherwise(last)
    new = {
        "n": n,
        "duration_weeks": F.bround(F.when(weeks["unit"].contains("mo"), weeks["n"] * MONTH).otherwise(weeks["n"])).cast("int"),
        "dose_g_per_day": F.when(grams["unit"] == "mg", grams["n"] / 1000.0).otherwise(grams["n"]),
        "direction": direction,
        "span_start": first,
        "span_end": last,
        "safety_notes": F.when(F.col(own["discussion"]).contains("adverse"), "adverse events discussed"),
    }
    return df.withColumns(new).drop(*own.values())


def assembled(df: DataFrame, term: str, goal: str, title: str, journal: str) -> DataFrame:
    """``df`` (with ``heuristics``) with ``summary``, ``keywords`` and ``confidence``.

    The summary is a sentence on goal and direction, null without both; the confidence sums what is known.
    """
    verb = F.element_at(F.create_map(*[F.lit(x) for kv in VERBS.items() for x in kv]), F.col("direction"))
    who = F.initcap(F.coalesce(F.when(F.col(term) != "", F.col(term)), F.lit("Supplement")))
    summary = F.when(F.col(goal) != "", F.concat(who, F.lit(" "), verb, F.lit(" "), F.replace(F.col(goal), F.lit("_"), F.lit(" ")), F.lit(".")))
    known = [F.when(F.col(x).isNotNull(), w).otherwise(0.0) for x, w in CONFIDENCE.items()]
    titled = F.when((F.coalesce(title, F.lit("")) != "") & (F.coalesce(journal, F.lit("")) != ""), TITLED).otherwise(0.0)
    keywords = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.col(x) != "", F.col(x)) for x in (term, goal)]))))
    return df.withColumns({"summary": summary, "keywords": keywords, "confidence": F.round(sum(known, titled), 4)})


# Fixed values of the checks of a card: sections, fields that must be numbers or lists, and what each fault costs.
SECTIONS = ["population", "intervention", "outcomes", "safety"]
NUMBERS = [("population", "n", 5.0), ("intervention", "dose_g_per_day", 3.0), ("intervention", "dose_mg_per_kg", 3.0), ("intervention", "duration_weeks", 3.0)]
LISTS = [("population", x, 3.0) for x in ("conditions", "stratification_criteria", "inclusion_criteria", "exclusion_criteria")] + [("intervention", "supplement_forms", 5.0), ("safety", "adverse_events", 3.0), ("safety", "contraindications", 3.0)]
MISSING, NO_OBJECT, NO_LIST, ODD, NAMELESS, EMPTY, NOTHING = 20.0, 25.0, 15.0, 5.0, 3.0, 30.0, "No data extracted"


def _kind(v: Column, path: str) -> Column:
    """The type of what a path leads to: OBJECT, ARRAY, a scalar's; null if there is nothing."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def checked(answer: Column) -> Column:
    """``score`` from 100 down, not below 0, and the ``issues`` of a card's JSON, in order of the fields.

    A card that is no JSON object has 0. Null values count as absent lists and numbers, not as faults.
    """
    v = parsed(answer)
    kinds = {x: _kind(v, f"$.{x}") for x in SECTIONS}
    is_object = lambda x: F.coalesce(kinds[x].startswith("OBJECT"), F.lit(False))
    faults = [F.when(kinds[x].isNull(), F.struct(F.lit(f"Missing required section: {x}").alias("issue"), F.lit(MISSING).alias("cost"))) for x in SECTIONS]
    fault = lambda cond, issue, cost: F.when(cond, F.struct(F.lit(issue).alias("issue"), F.lit(cost).alias("cost")))
    faults += [fault(kinds[x].isNotNull() & ~is_object(x), f"Invalid {x} format", NO_OBJECT) for x in SECTIONS if x != "outcomes"]
    for section, name, cost in NUMBERS:
        kind = _kind(v, f"$.{section}.{name}")
        faults.append(fault(is_object(section) & kind.isNotNull() & ~kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|VOID)$"), f"{section}.{name} is not a number", cost))
    for section, name, cost in LISTS:
        kind = _kind(v, f"$.{section}.{name}")
        faults.append(fault(is_object(section) & kind.isNotNull() & ~kind.rlike("^(ARRAY.*|VOID)$"), f"{section}.{name} is not a list", cost))
    is_list = F.coalesce(kinds["outcomes"].startswith("ARRAY"), F.lit(False))
    faults.append(fault(kinds["outcomes"].isNotNull() & ~is_list, "outcomes is not a list", NO_LIST))
    names = F.coalesce(F.try_variant_get(v, "$.outcomes", "array<variant>"), F.array().cast("array<variant>"))
    plain = lambda o: ~F.coalesce(F.schema_of_variant(o), F.lit("")).startswith("OBJECT")
    odd = F.size(F.filter(names, plain))
    nameless = F.size(F.filter(names, lambda o: ~plain(o) & (F.coalesce(F.try_variant_get(o, "$.name", "string"), F.lit("")) == "")))
    for n, what, cost in ((odd, " outcomes are no objects", ODD), (nameless, " outcomes without a name", NAMELESS)):
        faults.append(F.when(is_list & (n > 0), F.struct(F.concat(n.cast("string"), F.lit(what)).alias("issue"), (n * cost).alias("cost"))))
    empty = [kinds[x].isNull() | kinds[x].isin("OBJECT<>", "ARRAY<VOID>", "VOID") for x in SECTIONS]
    faults.append(fault(empty[0] & empty[1] & empty[2] & empty[3], "All sections are empty", EMPTY))
    found = F.array_compact(F.array(*faults))
    score = F.greatest(F.lit(0.0), F.aggregate(found, F.lit(100.0), lambda s, x: s - x["cost"]))
    good = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.struct(F.when(good, score).otherwise(0.0).alias("score"), F.when(good, F.transform(found, lambda x: x["issue"])).otherwise(F.array(F.lit(NOTHING))).alias("issues"))
