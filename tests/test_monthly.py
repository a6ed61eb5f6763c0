"""Monthly tiers, running sums over ranges, and distributions against plain loops."""

import random
from collections import Counter

from curata.operators import monthly as m
from pyspark.sql import functions as F


def test_tiers(spark):
    limits = spark.createDataFrame([("many", 100, 4.0), ("few", 3, 1.75)], "tag string, n long, threshold double")
    rows = [(k, ["many"], 3.0, "other", k) for k in range(20)] + [
        (100, ["many", "few", "many", None], 2.0, "other", 0), (101, ["few"], 1.0, "other", 99), (102, None, 9.0, "other", 0), (103, [], 1.0, "systematic_review", 0), (104, None, None, None, None),
        (105, ["new"], 1.5, "other", 0), (106, ["new"], 1.4, "other", 0), (107, ["few"], 2.6, "other", 5), (108, ["few"], 2.6, "other", 5), (109, ["few"], 2.6, "other", 5),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, tags array<string>, q double, study string, d long, n int")
    got = {r.id: (r.tier, r.tags) for r in m.three_tiers(df, limits, "id", "tags", "q", "study", "d").collect()}
    want = {k: (1, ["many"]) if k >= 10 else (3, []) for k in range(20)}
    want |= {100: (2, ["few"]), 101: (3, []), 102: (1, []), 103: (1, []), 104: (3, []), 105: (2, ["new"]), 106: (3, []), 107: (2, ["few"]), 108: (1, ["few"]), 109: (1, ["few"])}
    assert got == want and m.three_tiers(df.limit(0), limits, "id", "tags", "q", "study", "d").count() == 0


def test_running_sums_and_breaker(spark):
    r = random.Random(1)
    rows = [(k, r.choice(["a", "a", "a", "b", None]), r.randint(0, 5), r.randint(0, 9), "own") for k in range(500)]
    df = spark.createDataFrame(rows, "id long, day string, ts int, cost long, spent_by string").repartition(7)
    want, spent = {}, Counter()
    for k, day, ts, cost, _ in sorted(rows, key=lambda x: (str(x[1]), x[2], x[0])):
        want[k] = (spent[day], spent[day] <= 200)
        spent[day] += cost
    out = m.breaker(df, "day", ["ts", "id"], "cost", 200)
    assert {x.id: (x.spent, x.admitted) for x in out.collect()} == want and out.columns == [*df.columns, "spent", "admitted"]
    assert m.breaker(df.limit(0), "day", ["ts", "id"], "cost", 200).count() == 0


def test_distributions(spark):
    df = spark.createDataFrame([("a", ["x", "y"]), ("a", []), (None, ["x", None])], "s string, t array<string>")
    got = {(r.dimension, r.value): (r.n, r.share) for r in m.distributions(df, {"s": F.col("s"), "t": F.col("t")}).collect()}
    assert got == {("s", "a"): (2, 66.67), ("s", None): (1, 33.33), ("t", "x"): (2, 66.67), ("t", "y"): (1, 33.33), ("t", None): (1, 33.33)}
