"""Rules on odd input, profiles and grades; doses and forms at their edges."""

from curata.operators import plans
from curata.operators import suitability as s
from curata.plans.advice import FAULTS, RULES
from curata.sources import banks
from pyspark.sql import functions as F


def rules(spark, texts):
    return s.coerced(spark.createDataFrame(list(enumerate(texts)), "pos long, text string"), "text", "pos")


def test_rules_are_checked_and_compiled(spark):
    got = {r.pos: (r.error, r.rule) for r in rules(spark, [*RULES, None, ""]).collect()}
    assert [got[k][0] for k in range(len(RULES))] == [f if k != 3 else "repeated id" for k, f in enumerate(FAULTS)]
    assert got[12][0] == got[13][0] == "no object"
    r = got[2][1]
    assert (r.id, r.applies_to, r.severity, r.conditions, r.fields) == ("stimulant", ["CAFFEINE"], "caution", ["anxiety"], {"segment": "BUILDING"})
    assert got[11][1].applies_to == ["*"] and got[4][1] is None
    a, b = (s.compiled(rules(spark, x), "v1").first() for x in (RULES, RULES[:3]))
    assert [r.id for r in a.rules] == ["kidney", "young", "stimulant", "sleep"] and a.sha256 != b.sha256
    assert s.compiled(rules(spark, RULES), "v1").first().sha256 == a.sha256 and len(s.compiled(rules(spark, ["x"]), "v").first().rules) == 0


def test_hard_stops_before_cautions(spark):
    texts = [
        '{"id": "c1", "profile": {"conditions_any": ["a"]}}', '{"id": "c2", "profile": {"sex": "male"}}', '{"id": "h1", "severity": "HARD_STOP", "applies_to": ["X"], "profile": {"age": 17}, "message": "no"}',
        '{"id": "h2", "severity": "hard_stop", "applies_to": ["x"], "profile": {"age": 17}, "message": "never"}', '{"id": "none"}',
    ]
    rows = [
        (1, "x", "A", ["A"], {"sex": "male"}), (2, "x", "A", [], {"age": "17"}), (3, "y", "A", ["b"], {"age": "17"}), (4, "x", "D", ["a"], None), (5, "x", "F", None, {"sex": "male"}), (6, "x", "?", ["a"], {}), (7, None, None, None, None), (1, "x", "A", ["A"], {"sex": "male"}),
    ]
    df = spark.createDataFrame([(*r, "own") for r in rows], "id int, item string, grade string, conditions array<string>, fields map<string,string>, rules string")
    good = s.compiled(rules(spark, texts), "v")
    out = s.suitability(df, "item", "grade", "conditions", "fields", good)
    assert out.columns == [*df.columns, "final_grade", "suitability", "reasons"] and out.count() == len(rows)
    got = {r.id: (r.final_grade, r.suitability, r.reasons) for r in out.collect()}
    assert got == {
        1: ("B", "Caution: c1; c2", ["c1", "c2"]), 2: ("F", "Avoid: no", ["h1"]), 3: ("A", "OK", []), 4: ("F", "OK", ["c1"]), 5: ("F", "OK", ["c2"]), 6: ("?", "Caution: c1", ["c1"]), 7: (None, "OK", []),
    }
    assert {r.id: r.final_grade for r in s.suitability(df, "item", "grade", "conditions", "fields", good, 2).collect()}[1] == "C"


def test_doses_and_forms(spark):
    df = spark.createDataFrame([(69.9, None), (70.0, "hcl"), (80.0, "anhydrous"), (80.0, "dust")], "w double, f string")
    keep, load = s.creatine_grams(F.col("w"), F.col("f"))
    assert [tuple(r) for r in df.select(keep, load).collect()] == [(3.0, 21.0), (5.5, 23.5), (4.5, 21.0), (None, None)]
    df = spark.createDataFrame([("strength", 100.0, 160.0, None), ("strength", 100.0, None, 1.0), ("x", 10.0, None, None), (None, 100.0, 500.0, 1.0), ("weight_loss", 61.0, 100.0, None)], "g string, w double, a double, b double")
    assert [tuple(r) for r in df.select(*s.protein_gap(F.col("g"), F.col("w"), F.col("a"), F.col("b"))).collect()] == [(20.0, 1), (80.0, 4), (None, None), (None, None), (20.0, 1)]
    df = spark.createDataFrame([("whey-protein-x",), ("zinc",), ("",), (None,)], "n string")
    assert [tuple(r) for r in df.select(*s.parsed_form(F.col("n"))).collect()] == [("whey", "protein-x"), ("zinc", None), ("", None), (None, None)]
    x = s.converted(F.lit("caffeine"), F.lit("citrate"), F.lit("anhydrous"), F.lit(200.0))
    assert spark.range(1).select(x, s.converted(F.lit("zma"), F.lit("a"), F.lit("b"), F.lit(7.0))).first()[:] == (100.0, 7.0)
    forms = spark.createDataFrame([(a, b, g, c, r) for a, b, _, g, c, r in s.FORMS], "supplement string, form string, grade string, cost double, is_reference boolean")
    assert [r.form for r in s.form_options(forms).where("supplement = 'protein'").orderBy("place").collect()] == ["whey-concentrate", "pea", "casein", "soy", "whey-isolate"]
    df = spark.createDataFrame([(59.9, 0, None), (100.0, 17, "male"), (60.0, 50, "female")], "w double, a int, s string")
    assert [r[0] for r in df.select(s.bank_key(F.lit("g"), F.col("w"), F.col("s"), F.col("a"))).collect()] == ["g:xs:other:adult", "g:xl:male:minor", "g:small:female:mature"]
    assert s.profile_grid(spark).distinct().count() == 270


def test_plans(spark):
    rows = [(1, "strength", False, ["zma", "iron", "caffeine"]), (2, "strength", True, ["omega-3"]), (3, None, None, None), (4, "endurance", False, [])]
    p = spark.createDataFrame([(*r, "own") for r in rows], "id int, g string, preg boolean, named array<string>, tier string")
    grades = spark.createDataFrame([("strength", "creatine", "A"), ("strength", "caffeine", "C"), ("strength", "omega-3", "B"), ("strength", "protein", "D"), ("strength", "iron", "F")], "goal string, supplement string, grade string")
    got = {r.id: (r.recommended, r.optional, r.excluded) for r in plans.assembled(p, "id", "g", "preg", "named", grades).collect()}
    low = "Insufficient evidence for strength goals (Grade "
    assert got == {
        1: (["creatine"], [f"caffeine: {plans.CAUTION}"], [f"iron: {low}F)", f"zma: {low}D)"]), 2: ([], ["omega-3"], [f"{x}: {plans.PREGNANT}" for x in ("beta-alanine", "caffeine", "creatine")]), 3: ([], [], []), 4: ([], [], []),
    }
    said = spark.createDataFrame([(1, "Magnesium, OMEGA 3 and d-Aspartic; coffee"), (2, None), (3, "")], "id int, x string")
    assert {r.id: r.mentioned for r in plans.mentioned(said, "x").collect()} == {1: ["caffeine", "fish-oil", "omega-3", "magnesium", "d-aspartic-acid"], 2: [], 3: []}
    w = plans.warnings(F.col("a"), F.col("p"), F.col("c"), F.col("m"))
    df = spark.createDataFrame([(70, True, ["high_blood_pressure", "diabetes"], ["maoi"]), (17, False, ["panic_disorder"], None), (0, None, None, None), (None, None, [], [])], "a int, p boolean, c array<string>, m array<string>")
    assert [[k for x in r[0] for k, v in plans.WARNINGS.items() if v == x] for r in df.select(w).collect()] == [["pregnancy", "older", "hypertension", "diabetes", "maoi"], ["minor", "anxiety"], [], []]


def test_banks_in_any_shape(spark):
    texts = {
        1: '{"strength:creatine": {"grade": "A", "score": 1.5}, "strength:a:b": {"grade": "Z"}}', 2: '{"evidence_data": {"strength": {"zma": {"grade": "F", "score": "x"}, "iron": {}}}}', 3: '{"level1": {}}', 4: "no json", 5: None, 6: "[1]", 7: '{"strength": 5}',
    }
    df = spark.createDataFrame([(k, t, "own") for k, t in texts.items()], "id int, text string, grade string")
    got = sorted(tuple(r) for r in banks.load(df, "text", ["id"]).collect())
    assert got == [(1, "strength", "a:b", "D", None), (1, "strength", "creatine", "A", 1.5), (2, "strength", "iron", "D", None), (2, "strength", "zma", "F", None)]
