"""Order statistics by histograms against sorted lists."""

import random

from curata.operators import selection
from pyspark.sql import functions as F


def test_against_sorted_groups(spark, monkeypatch):
    r = random.Random(1)
    rows = [("hot", r.choice([1.5, 2.5, 1e-300])) for _ in range(3000)] + [("hot", r.gauss(0, 1e6)) for _ in range(3000)]
    rows += [(f"g{k % 40}", float(k * 37 % 101)) for k in range(900)] + [("wide", x) for x in (-1.7e308, 1.7e308, 0.0, 5e-324)] + [(None, 3.0), (None, None), ("one", 7.0), ("none", None), ("nan", float("nan"))]
    at = {"low": F.lit(0), "median": F.floor(F.col("n") / 2), "p75": F.floor(F.col("n") * 0.75), "high": F.col("n") - 1, "out": F.col("n"), "below": F.lit(-1)}
    groups = {}
    for k, x in rows:
        if x is not None and x == x:
            groups.setdefault(k, []).append(x)
    want = {}
    for k, x in groups.items():
        x.sort()
        n = len(x)
        want[k] = (n, x[0], x[n // 2], x[int(n * 0.75)], x[-1], None, None)
    for sent, few in ((100_000, 1), (0, 1024), (100_000, 50)):
        monkeypatch.setattr(selection, "SENT_ROWS", sent)
        monkeypatch.setattr(selection, "FEW", few)
        df = spark.createDataFrame([(*x, 1) for x in rows], "g string, x double, low int").repartition(5)
        got = {x.g: tuple(x)[1:] for x in selection.picks(df, ["g"], "x", at).collect()}
        assert got == want
    plan = selection.picks(df, ["g"], "x", {"low": F.lit(0)})
    assert plan.count() == len(want) and selection.picks(df.limit(0), ["g"], "x", at).count() == 0
    whole = selection.picks(df.withColumn("k", F.col("x").cast("int")).where("abs(x) < 1000"), [], "k", {"median": F.floor(F.col("n") / 2)}).collect()
    plain = sorted(int(x) for _, x in rows if x is not None and abs(x) < 1000)
    assert [(x.n, x.median) for x in whole] == [(len(plain), plain[len(plain) // 2])]
