"""Rules over article records: study types, categories, scores, goals, doses, keys, headings.

All are column expressions over built-in functions. The word lists and numbers are fixed
values, which results depend on; patterns ignore case where they say so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curata.functions import text as tx

# Publication types, in order, and the study type each gives.
STUDY_BY_PUBTYPE = [
    (["meta-analysis"], "meta-analysis"),
    (["systematic review"], "systematic_review"),
    (["randomized controlled trial", "randomised controlled trial"], "RCT"),
    (["controlled clinical trial"], "controlled_trial"),
    (["clinical trial"], "clinical_trial"),
    (["cross-over studies", "crossover studies"], "crossover"),
    (["cohort studies", "prospective studies", "retrospective studies"], "cohort"),
    (["case-control studies", "case-control study"], "case_control"),
    (["cross-sectional studies", "cross-sectional study"], "cross_sectional"),
    (["pilot projects", "pilot study"], "pilot"),
    (["multicenter study"], "clinical_trial"),
    (["review"], "review"),
]
# Hints in lower-cased title and abstract, after blinding with randomisation.
STUDY_BY_TEXT = [(r"\bcross[-\s]?over\b", "crossover"), ("systematic review", "systematic_review"), ("randomized|randomised", "controlled_trial")]
CATEGORY = [
    ("meta-?analysis", "meta_analysis"),
    ("systematic review", "systematic_review"),
    ("randomized|randomised|placebo|controlled trial|crossover|cross-over", "intervention"),
    ("cross[- ]sectional|survey|questionnaire|prevalence|usage|use patterns", "observational_usage"),
]
DOC_KIND = [("position stand|position statement", "position-stand"), ("consensus", "consensus"), ("guideline", "guideline"), ("perspective|viewpoint|opinion", "perspective")]
STRENGTH = {"meta-analysis": 1.0, "systematic_review": 0.9, "RCT": 0.8, "crossover": 0.7, "cohort": 0.5, "case_control": 0.4, "narrative_review": 0.2, "position-stand": 0.25, "guideline": 0.25, "consensus": 0.25, "perspective": 0.15, "editorial": 0.1}
NOT_BANKED = ["narrative_review", "position-stand", "guideline", "consensus", "perspective", "editorial"]
RESULT_CUES = [r"(?mi)^\s*results?\s*[:\-]", r"(?i)p\s*[<=>]\s*\d", r"(?i)95%\s*ci|confidence interval", r"(?i)(increase|decrease|improv\w+|reduc\w+)", r"(?i)mean\s*[±\+\-]"]
COUNTS = [r"(?i)n\s*=\s*(\d+)", r"(?i)(\d+)\s*participants", r"(?i)(\d+)\s*subjects", r"(?i)(\d+)\s*patients", r"(?i)(\d+)\s*volunteers", r"(?i)(\d+)\s*individuals"]
#: ``COUNTS`` as one pattern: where two of them overlap, they have the same number.
COUNTED = r"(?i)n\s*=\s*\d+|\d+\s*(?:participants|subjects|patients|volunteers|individuals)"
# Fixed values of the reliability score.
TYPE_POINTS = [("meta-analysis", 12.0), ("RCT", 10.0), ("crossover", 7.0), ("cohort", 4.0)]
SIZE_POINTS = [(1000, 5.0), (500, 4.0), (100, 3.0), (50, 2.0), (20, 1.0)]
TITLE_WORDS = ["systematic review", "meta-analysis", "double-blind", "placebo-controlled", "randomized", "controlled trial", "crossover", "longitudinal"]
JOURNALS = ["J Appl Physiol", "Med Sci Sports Exerc", "J Strength Cond Res", "Eur J Appl Physiol", "Int J Sport Nutr Exerc Metab", "Sports Med", "Am J Clin Nutr", "Nutrients", "J Int Soc Sports Nutr"]
RARE_TOPICS = {"tribulus": 3.0, "d-aspartic-acid": 3.0, "deer-antler": 3.0, "ecdysteroids": 3.0, "betaine": 2.5, "taurine": 2.5, "carnitine": 2.0, "zma": 2.0, "glutamine": 1.5, "cla": 1.5, "hmb": 1.0}
MEDIUM_TOPICS = {"citrulline": 1.0, "nitrate": 1.0, "beta-alanine": 0.5}
# Fixed values of the design score.
DESIGN_POINTS = [("meta-analysis", 3.0), ("RCT", 2.5), ("crossover", 2.0), ("cohort", 1.5)]
# Outcome labels of each goal, with their patterns.
GOALS = {
    "muscle_gain": {
        "muscle_mass": [r"\bmuscle mass\b", r"\blean mass\b", r"\bfat-free mass\b", r"\bFFM\b"],
        "muscle_size": [r"\bmuscle size\b", r"\bCSA\b", r"\bcross-sectional area\b"],
        "muscle_volume": [r"\bmuscle volume\b", r"\bthigh volume\b", r"\barm volume\b"],
        "muscle_thickness": [r"\bmuscle thickness\b", r"\bultrasound\b"],
        "body_composition": [r"\bbody composition\b", r"\bDEXA\b", r"\bbodpod\b"],
    },
    "weight_loss": {
        "weight_loss": [r"\bweight loss\b", r"\bweight reduction\b", r"\bbody weight\b"],
        "fat_loss": [r"\bfat loss\b", r"\bfat mass\b", r"\bpercent body fat\b"],
        "waist_circumference": [r"\bwaist circumference\b", r"\bwaist-to-hip\b"],
        "bmi": [r"\bBMI\b", r"\bbody mass index\b"],
        "visceral_fat": [r"\bvisceral fat\b", r"\babdominal fat\b"],
    },
    "strength": {
        "max_strength": [r"\b1RM\b", r"\bmax strength\b", r"\bbench press\b", r"\bsquat\b"],
        "power": [r"\bpower\b", r"\bCMJ\b", r"\bvertical jump\b", r"\bexplosive\b"],
        "recovery": [r"\brecovery\b", r"\bDOMS\b", r"\bsoreness\b"],
    },
    "endurance": {
        "vo2max": [r"\bvo2(max)?\b", r"\bvo₂(max)?\b", r"\bmaximal oxygen uptake\b"],
        "time_trial": [r"\btime[- ]to[- ]exhaustion\b", r"\btime trial\b", r"\btte\b"],
        "yo_yo": [r"\byo[- ]yo\b"],
        "running_economy": [r"\brunning economy\b"],
        "cycling_test": [r"\bwatts\b", r"\bpower output\b", r"\bwingate\b"],
    },
    "performance": {
        "sport_performance": [r"\bsport performance\b", r"\bathletic performance\b"],
        "training_adaptation": [r"\btraining adaptation\b", r"\badaptation\b"],
        "muscle_function": [r"\bmuscle function\b", r"\bmuscle performance\b"],
    },
}
SPORT = "(?i)sport|athletic|competition"
OUTCOMES = {
    "strength": [r"\b1 ?RM\b", r"\bmax(imum)? strength\b", r"\bbench press\b", r"\bsquat\b"],
    "hypertrophy": [r"\blean mass\b", r"\bfat[- ]free mass\b", r"\bCSA\b", r"\bhypertroph(y|ic)\b"],
    "power": [r"\bCMJ\b", r"\bvertical jump\b", r"\bpower\b"],
    "endurance": [r"\bVO2\b", r"\btime to exhaustion\b", r"\bendurance\b"],
    "soreness": [r"\bDOMS\b", r"\bsoreness\b"],
}
SAFETY = {
    "side_effects": [r"\bside effects?\b", r"\badverse events?\b", r"\btolerability\b"],
    "contraindications": [r"\bcontraindicated\b", r"\bnot recommended\b", r"\bcaution\b"],
    "pregnancy": [r"\bpregnancy\b", r"\bpregnant\b", r"\blactation\b"],
    "diabetes": [r"\bdiabetes\b", r"\bdiabetic\b", r"\bglucose\b"],
    "hypertension": [r"\bhypertension\b", r"\bblood pressure\b", r"\bhypertensive\b"],
}
_AMOUNT = r"(\d+(?:\.\d+)?)\s*(g|mg|mcg|gram[s]?|milligram[s]?)"
DOSES = [rf"{_AMOUNT}\s*(per\s*day|daily|/day)", rf"{_AMOUNT}\s*(pre|post|before|after)(?:-?\s*workout)?", rf"{_AMOUNT}\s*(loading|maintenance)"]
DURATION = r"(?i)(\d+(?:\.\d+)?)\s*(?:±\s*\d+(?:\.\d+)?)?\s*(weeks?|months?|days?|years?)"
TRAINING = [(r"(?i)\bathlete[s]?\b", "athletes"), (r"(?i)\btrained\b", "trained"), (r"(?i)\buntrained\b", "untrained")]
SEX = [(r"(?i)\b(male|men|males)\b", "males"), (r"(?i)\b(female|women|females)\b", "females")]
AGES = [(r"(?i)\belderly|older adult[s]?\b", "elderly"), (r"(?i)\badult[s]?\b", "adults")]
# Headings, in lower case and in order, and the section each belongs to.
HEADINGS = [
    ("abstract", "abstract"), ("introduction|background|pathophysiology", "introduction"), ("management|treatment|therapy|pharmacotherapy|future directions|limitations|perspectives|outlook|conclusion", "discussion"),
    (r"\b(aim|aims|objective|objectives)\b", "introduction"), (r"method|\b(subjects|patients)\s+and\s+methods\b|study design|participants", "methods"), (r"\bresults\b|findings", "results"), ("complications|adverse", "complications"), ("discussion", "discussion"),
]

# Signs of studies on animals or cells, of surveys, of the outcomes that keep a survey, and of what keeps the tag nitric-oxide.
NOT_HUMAN = [
    r"\brat(s)?\b", r"\bmice\b", r"\bmouse\b", r"\bmurine\b", r"\bin vitro\b", r"\bcell culture\b", r"\bcellular\b", r"\bfish\b", r"\bzebrafish\b", r"\bporcine\b",
    r"\bbovine\b", r"\bcanine\b", r"\bfeline\b", r"\bprimate(s)?\b", r"\bpetri dish\b", r"\btissue culture\b", r"\bmitochondrial\b",
]
SURVEY = [r"\b(prevalence|survey|questionnaire|knowledge|attitude|usage|consumption pattern)s?\b", r"\bcross[-\s]?sectional\b"]
MEASURED = {
    "strength": [
        r"\b1\s?rm\b", r"\b(one|1|3|5|10)(-|\s)?repetition max(imum)?\b", r"\brm\b", r"\bmax(imum)? strength\b", r"\bmvc\b", r"\bmaximal voluntary contraction\b", r"\bbench press\b", r"\bsquat\b",
        r"\bdeadlift\b", r"\bleg press\b", r"\bisokinetic\b", r"\bhandgrip\b", r"\bgrip strength\b", r"\breps? to failure\b", r"\btraining volume\b", r"\bvolume load\b",
    ],
    "muscle_gain": [r"\bhypertroph(y|ic)\b", r"\bmuscle (size|thickness|volume|cross[-\s]?sectional area|csa)\b", r"\blean mass\b", r"\bfat[-\s]?free mass\b", r"\bffm\b", r"\bfat free mass\b"],
    "endurance": [
        r"\bvo2( ?max| ?peak)?\b", r"\bpeak oxygen uptake\b", r"\btime[-\s]to[-\s]exhaustion\b", r"\btime trial\b", r"\bcycling time trial\b", r"\brunning time trial\b", r"\btt\b",
        r"\b6[-\s]?minute walk\b", r"\b6mwt\b", r"\byo[-\s]?yo\b", r"\brepeated sprint ability\b", r"\bshuttle run\b",
    ],
    "performance": [
        r"\bathletic performance\b", r"\bsport performance\b", r"\bfunctional performance\b", r"\bsprint( 10| 20| 30)? ?m?\b", r"\bagility\b", r"\bjump\b", r"\bcmj\b", r"\bvertical jump\b",
        r"\bpower\b", r"\bpeak power\b", r"\bmean power\b", r"\bwingate\b", r"\bsit[-\s]?to[-\s]?stand\b", r"\bsppb\b", r"\bgait speed\b", r"\btug test\b",
    ],
    "weight_loss": [r"\bweight (loss|reduction)\b", r"\bfat mass\b", r"\bpercent body fat\b", r"\bbody composition\b", r"\bbmi\b", r"\bwaist (circumference|to[-\s]?hip)\b", r"\bvisceral fat\b"],
}
# Signs of studies of patients, in order: words of safety, of disease, of its treatment, and what keeps a study.
SAFE = [r"\badverse event", r"\bside effect", r"\badverse reaction", r"\btoxicity", r"\bcontraindication", r"\bsafety", r"\badverse", r"\btolerability", r"\bharm", r"\bcomplication"]
DISEASE = [
    r"\bcancer\b", r"\bneoplasm", r"\btumor", r"\bcarcinoma", r"\boncology", r"\bchemotherapy", r"\bradiotherapy", r"\bheart disease", r"\bheart failure", r"\bcoronary artery", r"\bmyocardial infarction",
    r"\bcardiac disease", r"\bcardiovascular disease", r"\bstroke", r"\barrhythmia", r"\bkidney disease", r"\brenal disease", r"\brenal failure", r"\bdialysis", r"\bchronic kidney", r"\bckd\b", r"\besrd\b",
    r"\bliver disease", r"\bhepatic disease", r"\bcirrhosis", r"\bhepatitis", r"\bdiabetes", r"\bdiabetic", r"\binsulin resistance", r"\bglucose intolerance", r"\bprediabetes", r"\bhyperglycemia",
    r"\bparkinson", r"\balzheimer", r"\bdementia", r"\bmultiple sclerosis", r"\bepilepsy", r"\btraumatic brain injury", r"\btbi\b", r"\bchronic obstructive", r"\bcopd\b", r"\bhiv\b", r"\baids\b", r"\bimmune deficiency",
    r"\bautoimmune", r"\bchildren\b", r"\bpediatric", r"\badolescent", r"\bunder 18", r"\bminors\b", r"\bjuvenile", r"\bpregnancy\b", r"\bpregnant\b", r"\blactation", r"\bbreastfeeding", r"\bbreast feeding",
    r"\bmaternal\b", r"\bprenatal", r"\bpostnatal", r"\bpatient[s]?\b.*\b(cancer|cardiac|renal|liver|diabetes|disease)", r"\bdiseased individual", r"\bclinical patient",
]
CLINIC = [
    r"\btreatment.*\b(cancer|cardiac|renal|liver|diabetes|disease)", r"\btherapy.*\b(cancer|cardiac|renal|liver|diabetes|disease)", r"\bintervention.*\b(cancer|cardiac|renal|liver|diabetes|disease)",
    r"\bpatient[s]?\b.*\bwith.*\b(cancer|cardiac|renal|liver|diabetes|disease)",
]
PREVENTION = [r"\bpreventing", r"\bprevention", r"\brisk reduction", r"\brisk factor", r"\bpreventative", r"\bprotective", r"\bprimary prevention"]
OBESE, AGED = [r"\bobesity|\boverweight|\bbmi\b"], [r"\belderly|\bolder adult|\baging\b"]
NITRIC_OXIDE = [r"\bnitrate(s)?\b", r"\bbeet(root)?\b", r"\bcitrulline\b", r"\bl-?arginine\b", r"\barginine akg\b"]


def any_of(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def study_type(pubtypes: Column, text: Column | None = None) -> Column:
    """The first publication type that says it, else hints in ``text`` (title and abstract), else other."""
    known = F.transform(F.coalesce(pubtypes, F.array().cast("array<string>")), F.lower)
    out = F.lit("other")
    if text is not None:
        t = F.lower(F.coalesce(text, F.lit("")))
        blinded = t.rlike("double-blind|placebo-controlled") & t.contains("random")
        out = F.when(blinded, "RCT").otherwise(tx.first_match(t, STUDY_BY_TEXT, "other"))
    for names, label in reversed(STUDY_BY_PUBTYPE):
        out = F.when(F.arrays_overlap(known, F.array(*map(F.lit, names))), label).otherwise(out)
    return out


def study_category(text: Column) -> Column:
    """From publication types, title and abstract in one text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    rest = F.when(t.contains("review") & ~t.rlike("systematic|meta"), "narrative_review").otherwise("other")
    for pattern, label in reversed(CATEGORY):
        rest = F.when(t.rlike(pattern), label).otherwise(rest)
    return rest


def doc_kind(text: Column, pubtypes: Column, study: Column) -> Column:
    """A kind of review or opinion that the text (title, journal, abstract) shows, else null."""
    t, p = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.array_join(F.coalesce(pubtypes, F.array().cast("array<string>")), " "))
    review = (p.contains("review") | t.contains("review")) & ~study.isin("meta-analysis", "systematic_review")
    rest = F.when(review, "narrative_review").when(p.contains("editorial") | t.contains("editorial"), "editorial")
    for pattern, label in reversed(DOC_KIND):
        rest = F.when(t.rlike(pattern), label).otherwise(rest)
    return rest


def _lookup(value: Column, table: dict[str, float] | list[tuple[str, float]], default: Column) -> Column:
    out = default
    for k, v in dict(table).items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def strength(kind: Column, study: Column) -> Column:
    return _lookup(F.coalesce(kind, study), STRENGTH, _lookup(study, STRENGTH, F.lit(0.3)))


def eligible(kind: Column, study: Column, abstract: Column) -> Column:
    """Kinds that count as evidence, if the abstract shows results."""
    cue = F.lit(False)
    for p in RESULT_CUES:
        cue = cue | abstract.rlike(p)
    return ~F.coalesce(kind, study).isin(NOT_BANKED) & F.coalesce(cue, F.lit(False))


def sample_size(text: Column) -> Column:
    """The largest number that counts people, 0 without one."""
    return F.coalesce(tx.largest_in(text, COUNTED), F.lit(0).cast("bigint"))


def reliability(study: Column, n: Column, title: Column, journal: Column, year: Column, abstract: Column, category: Column) -> Column:
    """Points for type, size, title words, journal and recency, the rarest topic's bonus, and a nudge by category."""
    t, both = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))))
    words = sum((t.contains(w).cast("double") for w in TITLE_WORDS), F.lit(0.0))
    known = F.lit(False)
    for j in JOURNALS:
        known = known | F.coalesce(journal, F.lit("")).contains(j)
    rare = [F.when(both.contains(k) | both.contains(k.replace("-", " ")), v).otherwise(0.0) for k, v in RARE_TOPICS.items()]
    medium = [F.when(both.contains(k), v).otherwise(0.0) for k, v in MEDIUM_TOPICS.items()]
    bonus = F.greatest(F.lit(0.0), *rare, *medium)
    recent = F.when(year >= 2020, 1.0).when(year >= 2015, 0.5).otherwise(0.0)
    nudge = F.when(category == "intervention", 0.25).when(category == "observational_usage", -0.25).otherwise(0.0)
    return _lookup(study, TYPE_POINTS, F.lit(1.0)) + tx.bracket(n, SIZE_POINTS, 0.0) + words + F.when(known, 2.0).otherwise(0.0) + recent + bonus + nudge


def design_score(study: Column, n: Column, duration: Column) -> Column:
    """Points for type, size and duration, 10 at most."""
    d = F.coalesce(duration, F.lit(""))
    time = F.when(d.contains("year"), 1.5).when(d.contains("month"), 1.0).otherwise(0.5)
    return F.least(F.lit(10.0), _lookup(study, DESIGN_POINTS, F.lit(1.0)) + tx.bracket(n, [(100, 2.0), (50, 1.5), (30, 1.0)], 0.5) + time)


def primary_goal(counts: Column, sport: Column) -> Column:
    """The goal of ``GOALS`` with most outcome labels; performance, in sport, or general, if more than one has them or none."""
    names = list(GOALS)

    def chosen(n: Column) -> Column:
        most = F.array_max(n)
        single = F.size(F.filter(n, lambda x: x == most)) == 1
        first = F.element_at(F.array(*map(F.lit, names)), F.array_position(n, most).cast("int"))
        return F.when(most == 0, "general").when(single, first).when(sport, "performance").otherwise("general")

    return F.element_at(F.transform(F.array(counts), chosen), 1)  # counted once, read often


def doses(text: Column) -> Column:
    """Distinct dose phrases, sorted and joined by commas."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in DOSES]))), ",")


def duration(text: Column) -> Column:
    """The first number with a unit of time, a tolerance after it left out; empty without one."""
    t = F.coalesce(text, F.lit(""))
    return F.trim(F.concat_ws(" ", F.regexp_extract(t, DURATION, 1), F.regexp_extract(t, DURATION, 2)))


def population(text: Column) -> Column:
    parts = [tx.first_match(text, rules, None) for rules in (TRAINING, SEX, AGES)]
    return F.concat_ws(" ", *parts)


def size_class(n: Column) -> Column:
    return tx.bracket(n, [(100, "large"), (30, "medium")], "small")


def duration_class(d: Column) -> Column:
    return tx.first_match(F.lower(F.coalesce(d, F.lit(""))), [("year", "long_term"), ("month", "medium_term")], "short_term")


def population_class(p: Column) -> Column:
    return tx.first_match(F.coalesce(p, F.lit("")), [("athlete", "athletes"), ("trained", "trained"), ("elderly", "elderly")], "general")


def heading(title: Column) -> Column:
    """The canonical section of a heading, else other."""
    return tx.first_match(F.lower(F.coalesce(title, F.lit(""))), HEADINGS, "other")


def shard(key: Column) -> Column:
    """Two levels of folders from a key's digest."""
    h = F.sha1(key)
    return F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2))


def excluded_tables() -> dict[str, dict[str, list[str]]]:
    """The tables that ``on_humans``, ``usage_survey``, ``clinical`` and ``gated_tags`` look at."""
    measured = [p for table in MEASURED.values() for p in table]
    return {"is": {"animal": NOT_HUMAN, "survey": SURVEY, "measured": measured, "nitric": NITRIC_OXIDE, "safety": SAFE, "disease": DISEASE, "clinic": CLINIC, "prevention": PREVENTION, "weight": OBESE, "age": AGED}}


def on_humans(signs: Column) -> Column:
    """No sign of a study on animals or cells."""
    return ~F.array_contains(signs, "is|animal")


def usage_survey(signs: Column) -> Column:
    """A survey that measures no outcome of training."""
    return F.array_contains(signs, "is|survey") & ~F.array_contains(signs, "is|measured")


def clinical(signs: Column) -> Column:
    """A study of patients: a disease, and no word of safety; kept are prevention, weight and old age, unless it is about treatment."""
    has = lambda x: F.array_contains(signs, f"is|{x}")
    return has("disease") & ~has("safety") & (has("clinic") | ~(has("prevention") | has("weight") | has("age")))


def gated_tags(tags: Column, signs: Column) -> Column:
    """Tags in lower case with hyphens, distinct and sorted; nitric-oxide only where the text speaks of its sources."""
    plain = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.replace(F.lower(F.trim(x)), F.lit(" "), F.lit("-")))
    kept = F.filter(plain, lambda x: (x != "nitric-oxide") | F.array_contains(signs, "is|nitric"))
    return F.array_sort(F.array_distinct(F.array_compact(kept)))


# Fixed values of relabelling from title and journal: kinds in order, kinds that always replace a type, types that a review doesn't replace, and points by label.
RETRO_KINDS = [("position stand|position statement", "position-stand"), ("consensus", "consensus"), ("guideline", "guideline"), ("perspective|viewpoint|opinion", "perspective")]
REPLACING = ["position-stand", "guideline", "consensus", "editorial", "perspective"]
PRIMARY = ["meta-analysis", "systematic_review", "RCT", "crossover", "cohort", "case_control", "clinical_trial", "controlled_trial"]
RETRO_POINTS = {
    "meta-analysis": 13.0, "systematic_review": 11.0, "RCT": 10.0, "crossover": 7.0, "cohort": 4.0, "case_control": 3.5, "narrative_review": 3.0, "position-stand": 4.0, "guideline": 4.0, "consensus": 4.0, "perspective": 2.0, "editorial": 2.0,
}


def retro_kind(title: Column, journal: Column) -> Column:
    """The kind that title and journal show, null for none; a review of trials is none."""
    t = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(journal, F.lit(""))))
    rest = F.when(t.contains("review") & ~t.rlike("systematic|meta-?analysis"), "narrative_review").when(t.contains("editorial"), "editorial")
    for pattern, label in reversed(RETRO_KINDS):
        rest = F.when(t.rlike(pattern), label).otherwise(rest)
    return rest


def relabelled(title: Column, journal: Column, study: Column, conservative: bool = True) -> Column:
    """``study_type, doc_kind, eligible, strength, reliability`` of a stored record by its title and journal.

    A narrative review replaces a type, but for primary ones (with hyphens as underscores) if ``conservative``. A null type is empty.
    """
    old = F.trim(F.coalesce(study, F.lit("")))
    kind = retro_kind(title, journal)
    keeps = F.replace(old, F.lit("-"), F.lit("_")).isin(PRIMARY) if conservative else F.lit(False)
    new = F.when(kind.isin(REPLACING), kind).when((kind == "narrative_review") & ~keeps, kind).otherwise(old)
    label = F.coalesce(kind, new)
    points = _lookup(label, RETRO_POINTS, _lookup(new, RETRO_POINTS, F.lit(3.0)))
    return F.struct(new.alias("study_type"), kind.alias("doc_kind"), (~label.isin(NOT_BANKED)).alias("eligible"), _lookup(label, STRENGTH, _lookup(new, STRENGTH, F.lit(0.3))).alias("strength"), points.alias("reliability"))
