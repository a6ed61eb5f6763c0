import gzip
import hashlib
import json
import os

import pytest
from curata.functions import articles as a
from curata.functions import text as tx
from curata.operators import evidence, tables
from curata.plans.queries import QUERIES
from curata.sources import files, master
from curata.streaming import incremental
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType().add("id", "long").add("x", "string")


def test_json_lines_tolerant_and_strict(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"id": 1, "x": "a"}\n{broken\n{"id": 2}\n')
    path = str(tmp_path / "a.jsonl.gz")
    assert sorted(map(tuple, files.read_jsonl(spark, path, SCHEMA).collect())) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        files.read_jsonl(spark, path, SCHEMA, strict=True).collect()
    files.write_jsonl(files.read_jsonl(spark, path, SCHEMA), str(tmp_path / "out"), "gzip")
    assert files.read_jsonl(spark, str(tmp_path / "out"), SCHEMA).count() == 2
    os.makedirs(tmp_path / "store" / "ab" / "cd")
    (tmp_path / "store" / "ab" / "cd" / "k.json").write_text(json.dumps({"id": 7, "x": "z"}, indent=1))
    assert [tuple(r) for r in files.read_store(spark, str(tmp_path / "store"), SCHEMA).collect()] == [(7, "z")]


def test_snapshots_and_retention(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(4):
        files.write_snapshot(spark.createDataFrame([(k, "v")], SCHEMA), path, f"2024010{k}")
    assert [r.id for r in files.latest_snapshot(spark, path).collect()] == [3]
    assert files.prune(spark, path, keep=2) == ["20240100", "20240101"]
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3]
    assert files.prune(spark, path, keep=2) == []


def test_master_adds_once_and_keeps_deltas(spark, tmp_path):
    path = str(tmp_path / "m")
    assert master.current(spark, path) is None
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    first = master.add(spark, path, df([(1, "a"), (1, "a"), (2, "b"), (None, "n")]), "id", "r1", "2024-01-01", mark="2024-01-01")
    assert (first["added"], first["size_after"]) == (2, 2)
    again = master.add(spark, path, df([(9, "never")]), "id", "r1", "2024-01-01")
    assert again["size_after"] == 2
    second = master.add(spark, path, df([(2, "other"), (3, "c")]).withColumn("extra", F.lit(1)), "id", "r2", "2024-01-02")
    assert (second["added"], second["size_before"], second["size_after"], second["mark"]) == (1, 2, 3, "2024-01-01")
    rows = {r.id: (r.x, r.extra) for r in master.current(spark, path).collect()}
    assert rows == {1: ("a", None), 2: ("b", None), 3: ("c", 1)}
    assert sorted(r.id for r in master.rebuilt(spark, path).collect()) == [1, 2, 3]
    have = spark.createDataFrame([(1, False), (2, True), (3, None)], "id long, full boolean")
    new = spark.createDataFrame([(1, True), (2, True), (3, True), (4, True), (3, True)], "id long, full boolean")
    assert sorted(r.id for r in master.upgrades(have, new, "id", "full").collect()) == [1, 3]


def test_master_without_marks_and_after_a_failed_run(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    master.add(spark, path, df([(1, "a")]), "id", "r1", "2024-01-01")

    def fails(*_):
        raise OSError("between delta and pointer")

    with monkeypatch.context() as m:
        m.setattr(spark, "createDataFrame", fails)
        with pytest.raises(OSError):
            master.add(spark, path, spark.read.parquet(f"{path}/versions/1").selectExpr("id + 1 AS id", "x"), "id", "r2", "2024-01-02")
    assert master.current(spark, path).count() == 1
    master.add(spark, path, df([(2, "b")]), "id", "r3", "2024-01-03")
    assert sorted(map(tuple, master.rebuilt(spark, path).collect())) == sorted(map(tuple, master.current(spark, path).collect())) == [(1, "a"), (2, "b")]


def test_upsert_and_streams(spark, tmp_path):
    base = spark.createDataFrame([(1, "old"), (2, "keep")], SCHEMA)
    new = spark.createDataFrame([(1, "new", 2), (1, "newer", 3), (5, "added", 1)], "id long, x string, v int")
    got = {r.id: r.x for r in tables.upsert(base, new, ["id"], [F.desc("v")]).collect()}
    assert got == {1: "newer", 2: "keep", 5: "added"}
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "2024-01-01 10:00:00"), (1, "2024-01-01 11:00:00"), (2, "2024-01-02 10:00:00")], "k int, ts string").select("k", F.to_timestamp("ts").alias("ts")).coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    for _ in range(2):  # the second run resumes from the checkpoint and adds nothing
        stream = incremental.first_seen(spark.readStream.schema(schema).parquet(source), "ts", "k", "2 days")
        incremental.append_deltas(stream, "ts", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.k, str(r.delta_date)) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "2024-01-01"), (2, "2024-01-02")]
    marked = incremental.since(spark.read.parquet(source), "ts", "2024-01-02 12:00:00")
    assert sorted(r.k for r in marked.collect()) == [2]


def test_rules_on_known_records(spark):
    rows = [
        (1, ["Journal Article"], "Double-blind random test", "n = 45 men, 12 participants; 8 weeks of 5 g/day", "RCT", 45, "8 weeks", "5 g/day"),
        (2, ["Review", "Meta-Analysis"], "", "11 ± 4 months, 99999999999999999999 patients", "meta-analysis", 0, "11 months", ""),
        (3, None, None, None, "other", 0, "", ""),
        (4, ["Review"], "x", "20 mg pre-workout and 3 g maintenance", "review", 0, "", "20 mg pre-workout,3 g maintenance"),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "id int, p array<string>, title string, x string")
    got = df.select("id", a.study_type(F.col("p"), F.concat_ws(" ", "title", "x")), a.sample_size(F.col("x")), a.duration(F.col("x")), a.doses(F.col("x"))).collect()
    assert {tuple(r) for r in got} == {(r[0], *r[4:]) for r in rows}
    keys = spark.createDataFrame([("1", "d"), (" ", "https://doi.org/10.1%2FX"), (None, None)], "p string, d string").select(tx.document_key(F.col("p"), tx.normalized_doi(F.col("d")), F.lit("t"))).collect()
    assert [k[0] for k in keys] == ["pmid_1", "doi_10.1/x", "hash_" + hashlib.sha1(b"t").hexdigest()[:16]]
    assert spark.range(1).select(tx.without_citations(tx.normalized(F.lit("a\r\n\n\n\nb\t c [1, 2-4].")))).first()[0] == "a\n\nb c."


def test_groups_without_effects_get_the_lowest_grade(spark):
    df = spark.createDataFrame([("a", "rct", 40.7, None, "unknown", 1), ("b", "rct", 60.0, 0.4, None, 2), ("b", "rct", 60.0, 0.5, None, 3)], "g string, design string, n double, effect double, direction string, paper_id int")
    got = {r.g: (r.n_effects, r.grade, r.top_refs) for r in evidence.pool(df, ["g"]).collect()}
    assert got["a"] == (0, "D", None) and got["b"][0] == 2 and got["b"][2] == "2,3"


def test_gate_takes_long_scripts(spark, tmp_path):
    html = "<script>" + "<" * 20001 + "b </script>" + "word " * 400
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert QUERIES["q_html_gate"](spark, str(tmp_path)).count() == 1
