"""Edges of banked grades, mentions, exclusions and resetting quotas."""

from datetime import datetime, timedelta

from curata.functions import articles as a
from curata.functions import signals
from curata.operators import banking, limits, tagging
from pyspark.sql import functions as F

PAPER = "goal string, item string, id long, study string, outcomes string, quality double, reliability double, title string"


def test_level_one_edges(spark):
    grid = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "c")], "goal string, item string")
    papers = [
        ("g", "a", 2, "RCT", "Improved", 1.0, None, "t"), ("g", "a", 1, "Meta-Analysis", None, 1.0, 4.0, "t"), ("g", "a", 3, None, "worsened, then improved", None, 2.0, "t"),
        ("g", "a", 4, "cohort", "harmful", 9.0, 2.0, " "), ("g", "b", 5, "randomized", "adverse", 2.0, 2.0, None), ("x", "a", 6, "RCT", "", 1.0, 1.0, "t"),
    ]
    got = {r.item: r.asDict() for r in banking.level_one(spark.createDataFrame(papers, PAPER), grid, ["goal", "item"], "id").collect()}
    assert len(got) == 3
    assert (got["a"]["n_papers"], got["a"]["n_meta"], got["a"]["n_rct"], got["a"]["n_up"], got["a"]["n_down"]) == (4, 1, 1, 2, 1)
    assert (got["a"]["grade"], got["a"]["consistency"], got["a"]["avg_reliability"], got["a"]["publications"]) == ("B", 0.5, 2.0, "1,2,3")
    assert (got["b"]["grade"], got["b"]["consistency"], got["b"]["publications"]) == ("D", 1.0, "")
    assert (got["c"]["grade"], got["c"]["n_papers"], got["c"]["consistency"]) == ("D", 0, 0.0)
    assert {r.grade for r in banking.level_one(spark.createDataFrame([], PAPER), grid, ["goal", "item"], "id").collect()} == {"D"}


def test_reset_quota_against_a_loop(spark):
    began = datetime(2024, 1, 1)
    uses = [(k, k % 3 if k % 11 else None, began + timedelta(hours=(k * k * 7) % 2000) if k % 17 else None) for k in range(200)]
    uses += [(1000 + k, 9, began + timedelta(days=30 * k)) for k in range(4)]  # exactly at the end of a period: not later than it
    df = spark.createDataFrame(uses, "id long, user long, ts timestamp")
    want, state = set(), {}
    for k, user, ts in sorted((x for x in uses if x[1] is not None and x[2] is not None), key=lambda x: (x[2], x[0])):
        start, period, used = state.get(user, (None, 0, 0))
        if start is None or ts > start + timedelta(days=30):
            start, period, used = ts, period + 1, 0
        if used < 4:
            want.add((k, user, period, used + 1))
        state[user] = (start, period, used + 1)
    assert {tuple(r) for r in limits.admitted(df, "user", "ts", "id", 4, 30).collect()} == want
    assert limits.admitted(df.limit(0), "user", "ts", "id", 4).collect() == []


def test_exclusions_and_tags(spark):
    rows = [(1, "Rats were fed", ["Nitric Oxide", "A b"]), (2, "A rating of citrulline", [" nitric-oxide", "a-b", "A B"]), (3, None, None), (4, "Questionnaire", []), (5, "Survey of squat", ["x", None])]
    df = spark.createDataFrame(rows, "id int, text string, tags array<string>")
    df, x = tagging.found(df, "text", a.excluded_tables(), "signs"), F.col("signs")
    got = {r.id: (r.h, r.s, r.t) for r in df.select("id", a.on_humans(x).alias("h"), a.usage_survey(x).alias("s"), a.gated_tags(F.col("tags"), x).alias("t")).collect()}
    assert got == {1: (False, False, ["a-b"]), 2: (True, False, ["a-b", "nitric-oxide"]), 3: (True, False, []), 4: (True, True, []), 5: (True, False, ["x"])}


def test_studies_of_patients(spark):
    rows = {"treatment of heart\ndisease": False, "treatment of heart disease; aging": True, "Treatment of liver disease in older adults": True, "Prevention of diabetes": False, "obesity in children": False, "Children": True, "Cancer, an adverse event": False, "Stroke in the elderly": False, "patients with\ncancer": True, "": False, None: False}
    df = tagging.found(spark.createDataFrame([(t,) for t in rows], "text string"), "text", a.excluded_tables(), "signs")
    assert {r.text: r.c for r in df.select("text", a.clinical(F.col("signs")).alias("c")).collect()} == rows


def test_signals_are_ordered_and_null_says_nothing(spark):
    df = spark.createDataFrame([(1, "CKD"), (1, "so anxious"), (2, None), (3, "")], "c int, x string")
    got = {r.c: (r.conditions, r.meds) for r in signals.by_conversation(df, "c", "x", {"conditions": signals.CHAT_CONDITIONS, "meds": signals.CHAT_MEDICINES}).collect()}
    assert got == {1: (["anxiety", "kidney_disease"], []), 2: ([], []), 3: ([], [])}
