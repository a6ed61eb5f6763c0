"""Tags and window goals against every pattern tried on every text."""

import random
import re

from curata.functions import articles as a
from curata.functions import supplements as s
from curata.operators import tagging


def plain_tags(text, trial):
    t, out = (text or "").lower(), set()
    for label, patterns in s.TAGS.items():
        for p in patterns:
            m = re.search(p, t, re.I)
            if m and (trial or any(w in t[max(0, m.start() - 100) : m.end() + 100] for w in s.CONTEXT)):
                out.add(label)
    return sorted(out)


def plain_goal(text):
    low = (text or "").lower()
    joined = " ".join(re.split(r"\W+", low))
    hit = {g: any(re.search(s.METRIC, joined[max(0, m.start() - 60) : m.end() + 60], re.I) for p in ps for m in re.finditer(p, joined, re.I)) for g, ps in a.MEASURED.items()}
    for goal, shown in s.PREFERRED:
        if hit[goal]:
            return shown
    return "performance" if any(c in low for c in s.EXERCISE) else "general"


TERMS = ["creatine HCl", "Beta-Alanine", "β-alanine", "betaalanine", "vitamin  D", "25(OH)D", "25 OHD", "(epi)gallocatechin", "epigallocatechin", "n-3", "omega 3", "NO3", "beet", "beetroot juice", "IGF-1", "d-Aspartic acid", "BCAAs", "Iſoleucine"]
GOAL_TERMS = ["1 RM", "bench press", "lean mass", "VO2 max", "time-to-exhaustion", "sit to stand", "BMI", "weight loss", "agility", "jump", "hypertrophic", "tt", "yo-yo"]
METRICS = ["improved", "improve", "reps", "effect", "placebo", "dose", "supplementation", "overtime", "strength", "x" * 57]


def texts(n):
    r = random.Random(4)
    word = lambda: r.choice([*TERMS, *GOAL_TERMS, *METRICS, "ñandú", "of", "and,", "the\n", "word" * r.randint(1, 9)])
    return [" ".join(word() for _ in range(r.randint(1, 60))) for _ in range(n)]


def test_against_all_patterns(spark):
    rows = [(k, t, [True, False, None][k % 3], 5) for k, t in enumerate(texts(300))]
    rows += [(-7, "weight loss effect", False, 5), (-1, None, True, 5), (-2, "", False, 5), (-3, "creatine " + "x" * 92 + " dose", False, 5), (-4, "creatine " + "x" * 100 + " dose", False, 5), (-5, "creatine " + "y " * 200 + "creatine dose", False, 5), (-6, "CREATINE monohydrate dose", False, 5)]
    df = spark.createDataFrame(rows, "id long, text string, trial boolean, tags int").repartition(3)
    got = {r.id: list(r.tags) for r in tagging.tagged(df, "text", "trial", s.TAGS, s.CONTEXT).collect()}
    assert got == {k: plain_tags(t, trial) for k, t, trial, _ in rows}
    assert got[-3] == ["creatine"] and got[-4] == got[-5] == [] and got[-6] == ["creatine", "creatine-monohydrate"]
    goals = {r.id: r.goal for r in tagging.window_goals(df, "text", a.MEASURED, s.METRIC, s.PREFERRED, s.EXERCISE).collect()}
    assert goals == {k: plain_goal(t) for k, t, _, _ in rows}
    assert len(set(goals.values())) == 5
    assert tagging.tagged(df.limit(0), "text", "trial", s.TAGS, s.CONTEXT).count() == 0


def test_ties_by_preference_and_windows():
    d = tagging.Dictionary(a.MEASURED)
    goal = lambda t: tagging.goal_of(t, d, re.compile(s.METRIC, re.I), s.PREFERRED, s.EXERCISE, 60)
    assert goal("bmi effect, lean mass, squat") == "strength" and goal("bmi effect lean mass") == "muscle_gain" and goal("bmi effect; vo2") == "performance"
    assert goal("bmi " + "z" * 60 + " effect") == "general" and goal("bmi " + "z" * 52 + " effect") == "weight_loss"
    assert goal("no word of it, only a workout") == "performance" and goal("") == "general"


def test_needed_strings():
    assert tagging.needed(r"\bbeta-?alanine\b") == {"alanine"} and tagging.needed(r"\b(male|female)s?\b") == {"male", "female"}
    assert tagging.needed(r"\d+|x") is None and tagging.needed(r"(abc)?d") == {"d"} and tagging.needed(r"(?:ab){2}c") in ({"ab"}, {"abab"})
    r = random.Random(9)
    patterns = [p for ps in [*s.TAGS.values(), *a.MEASURED.values()] for p in ps]
    assert all(tagging.needed(p) for p in patterns)
    for t in texts(200):
        for p in r.sample(patterns, 30):
            if re.search(p, t, re.I):
                assert any(x in tagging.folded(t) for x in tagging.needed(p))
