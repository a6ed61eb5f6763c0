"""Keyed tables: touched buckets only, a switch at the end, streams whose batches count once."""

import os

import pytest
from curata.sources import files, keyed
from curata.streaming import sinks, stateful
from pyspark.sql import functions as F


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def listing(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(f"{path}/data") for f in names}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.range(1000).select("id", F.lit("old").alias("x"), F.lit(1).alias("v"))
    assert keyed.read(spark, path) is None
    assert keyed.upsert(spark, path, base, "id", "r1", buckets=16)
    before, first = listing(path), keyed.manifest(spark, path)["bucket"]
    ids = [3, 500, 999, 5000, 3]
    news = spark.createDataFrame([(i, f"new{k}", 2, k) for k, i in enumerate(ids)] + [(None, "no key", 2, 9)], "id long, x string, v int, extra int")
    assert keyed.upsert(spark, path, news, "id", "r2", [F.desc("v"), F.desc("extra")])
    second = keyed.manifest(spark, path)["bucket"]
    changed = {b for b in second if first.get(b) != second[b]}
    assert 0 < len(changed) <= 4 and {k: v for k, v in listing(path).items() if k in before} == before
    got = {r.id: (r.x, r.v, r.extra) for r in keyed.read(spark, path).collect()}
    assert len(got) == 1001 and got[3] == ("new4", 2, 4) and got[5000] == ("new3", 2, 3) and got[4] == ("old", 1, None)
    assert not keyed.upsert(spark, path, base, "id", "r2") and keyed.read(spark, path).count() == 1001
    assert [r.x for r in keyed.read(spark, path, [500], "id").collect()] == ["new1"]
    assert rows(keyed.deltas(spark, path).groupBy("run").count()) == [("r1", 1000), ("r2", 5)]


def test_failure_before_the_switch_and_prune(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    df = lambda r: spark.createDataFrame(r, "id long, x string")
    keyed.upsert(spark, path, df([(1, "a"), (2, "b")]), "id", "r1", buckets=2)
    with monkeypatch.context() as m:
        m.setattr(keyed, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            keyed.upsert(spark, path, df([(1, "half")]), "id", "r2")
    assert rows(keyed.read(spark, path)) == [(1, "a"), (2, "b")] and keyed.deltas(spark, path).count() == 2
    assert keyed.upsert(spark, path, df([(1, "whole")]), "id", "r2")
    assert rows(keyed.read(spark, path)) == [(1, "whole"), (2, "b")]
    assert keyed.rewrite(spark, path, df([(2, None), (9, "new")]), "id", keyed.patched("id", ["x"]), "r3")
    assert rows(keyed.read(spark, path)) == [(1, "whole"), (2, "b")]
    assert keyed.rewrite(spark, path, df([(2, "c"), (9, "new")]), "id", keyed.patched("id", ["x"]), "r4")
    assert keyed.rewrite(spark, path, df([(1, None), (7, None)]), "id", keyed.removed("id"), "r5")
    assert rows(keyed.read(spark, path)) == [(2, "c")]
    assert keyed.prune(spark, path, 1) and rows(keyed.read(spark, path)) == [(2, "c")]
    stamped = str(tmp_path / "s")
    for run, at in (("a", "2024-01-01"), ("b", "2024-02-01")):
        keyed.rewrite(spark, stamped, df([(1, "x")] + [(2, "y")] * (run == "a")), "id", keyed.newest("id", [F.desc("_new")], "updated_at", f"{at} 00:00:00"), run)
    assert {r.id: str(r.updated_at)[:10] for r in keyed.read(spark, stamped).collect()} == {1: "2024-02-01", 2: "2024-01-01"}


def test_batches_count_once_and_texts_upgrade(spark, tmp_path, monkeypatch):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "t", "checkpoint"))
    schema = "id long, has_text boolean, ts long, x string"
    order = sinks.fullest("has_text", "ts", "x")
    go = lambda: sinks.into_table(stateful.arrivals(spark, source, spark.createDataFrame([], schema).schema), path, "id", checkpoint, "papers", order, 4)
    put = lambda k, r: spark.createDataFrame(r, schema).coalesce(1).write.parquet(f"{source}/arrival={k:03d}")
    put(0, [(1, False, 1, "abstract"), (2, True, 1, "full"), (2, True, 1, "full")])
    go()
    before = files.cut(keyed.read(spark, path))
    put(1, [(1, True, 2, "full one"), (2, False, 3, "later abstract"), (3, None, 3, "unknown"), (None, True, 3, "none")])
    commit = keyed._commit

    def once(*a):
        commit(*a)
        raise OSError("lost after the switch, before the stream's own commit")

    with monkeypatch.context() as m:
        m.setattr(keyed, "_commit", once)
        with pytest.raises(Exception, match="lost after"):
            go()
    after = rows(keyed.read(spark, path).select("id", "x"))
    assert after == [(1, "full one"), (2, "full"), (3, "unknown")]
    go()  # the batch is run again, and adds nothing
    assert rows(keyed.read(spark, path).select("id", "x")) == after
    assert keyed.deltas(spark, path).groupBy("run").count().count() == 2
    assert [r.id for r in sinks.upgraded(before, keyed.read(spark, path), "id", "has_text").collect()] == [1]
    replayed = keyed.newest("id", order)(None, keyed.deltas(spark, path).drop("run"))
    assert rows(replayed.select("id", "x")) == after
