"""The paged source: planned slices, filters that reach it, rows against what was staged."""

import json
import os
from datetime import date, timedelta

import pytest
from curata.sources import paged
from pyspark.sql import functions as F

SCHEMA = "id long, x string, day date"


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("service"))
    days = F.when(F.col("id") < 600, 0).otherwise(F.col("id") % 40)  # the first day is hot
    df = spark.range(1000).withColumn("ts", F.to_timestamp(F.date_add(F.lit(date(2024, 1, 1)), days.cast("int")))).withColumn("x", F.when(F.col("id") % 7 > 0, F.concat(F.lit("x"), "id")))
    paged.stage(df.unionByName(spark.createDataFrame([(5000, None, None)], "id long, ts timestamp, x string")), "ts", "id", folder, 20)
    return folder, df


def test_rows_and_pushed_days(spark, service):
    folder, df = service
    read = lambda: paged.read(spark, folder, SCHEMA, simple=50, target=60)
    want = lambda d: sorted((r.id, r.x, r.day) for r in d.select("id", "x", F.to_date("ts").alias("day")).collect())
    got = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert got(read()) == sorted(want(df), key=str)
    some = read().where("day > DATE '2024-01-09' AND day <= DATE '2024-01-15' AND id % 2 = 0")
    assert got(some) == sorted(want(df.where("to_date(ts) > DATE '2024-01-09' AND to_date(ts) <= DATE '2024-01-15' AND id % 2 = 0")), key=str)
    assert some.rdd.getNumPartitions() < read().rdd.getNumPartitions()
    hidden = f"{folder}/pages/day=2024-01-20"
    os.rename(hidden, f"{folder}/away")
    try:  # a day out of the range is not looked at, one in it is
        assert read().where("day = DATE '2024-01-11'").count() == 10
        assert read().where("day >= DATE '2024-01-20' AND day < DATE '2024-01-21'").count() == 0
    finally:
        os.rename(f"{folder}/away", hidden)
    assert read().where("day = DATE '2030-01-01'").count() == 0
    assert read().where("day IS NULL").count() == 0


def test_slices():
    days = {date(2024, 1, 1) + timedelta(days=k): (n, -(-n // 10)) for k, n in enumerate([500, 5, 5, 5, 90, 0, 30, 30])}
    every = lambda found: sorted((d, p) for s in found for d, first, end in s.parts for p in range(first, end))
    want = sorted((d, p) for d, (_, pages) in days.items() for p in range(pages))
    rows = lambda s: sum(days[d][0] * (end - first) / max(1, days[d][1]) for d, first, end in s.parts)
    for depth in (0, 1, 3):
        found = paged.slices(days, date.min, date.max, 100, 60, depth)
        assert every(found) == want and max(map(rows, found)) <= 70
    assert len(paged.slices(days, date(2024, 1, 2), date(2024, 1, 4), 100, 60, 3)) == 1
    assert paged.slices({}, date.min, date.max) == []


def test_broken_lines_and_batches(spark, tmp_path):
    at = tmp_path / "pages" / "day=2024-01-01" / "page=0"
    at.mkdir(parents=True)
    (at / "a.json").write_text('{"id": 1, "x": "a\x01b"}\n\n{"id": 2}\n')
    (tmp_path / "hits").mkdir()
    (tmp_path / "hits" / "h.json").write_text(json.dumps({"day": "2024-01-01", "hits": 2, "pages": 1}))
    assert sorted(map(tuple, paged.read(spark, str(tmp_path), SCHEMA).select("id", "x").collect())) == [(1, "ab"), (2, None)]
    ids = spark.createDataFrame([(k % 130,) for k in range(300)], "id long")
    got = sorted((r.batch, list(r.ids)) for r in paged.batches(ids, "id", 50).collect())
    assert got == [(0, list(range(50))), (1, list(range(50, 100))), (2, list(range(100, 130)))]
    assert [r.id for r in paged.union_ids([ids, spark.createDataFrame([(500,), (None,)], "id long")], "id", 3).collect()] == [0, 1, 2]
    rows = spark.createDataFrame([(1, date(2024, 1, 1)), (2, date(2024, 2, 1)), (3, date(2024, 2, 2))], "id long, day date")
    assert sorted(r.id for r in paged.ids_by_mode(rows, "id", "incremental", date(2024, 2, 2)).collect()) == [2, 3]
    assert paged.ids_by_mode(rows, "id", "bootstrap").count() == 3


def test_files_and_tasks_grow_slower_than_pages(spark, tmp_path, monkeypatch):
    df = spark.range(4000).withColumn("ts", F.to_timestamp(F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 3).cast("int")))).withColumn("x", F.when(F.col("id") % 7 > 0, F.concat(F.lit("x"), "id")))
    paged.stage(df, "ts", "id", str(tmp_path), 20)
    files = [f for _, _, some in os.walk(tmp_path / "pages") for f in some if f.endswith(".json")]
    assert len(files) == 3  # there were 201, one for each page
    want = sorted((r.id, r.x) for r in df.select("id", "x").collect())
    for tasks in (192, 5):
        monkeypatch.setattr(paged, "TASKS", tasks)
        rows = paged.read(spark, str(tmp_path), SCHEMA, simple=50, target=60)
        assert sorted((r.id, r.x) for r in rows.collect()) == sorted(want, key=lambda r: r[0])
    days = {date(2024, 1, 1) + timedelta(days=k): (6000, 300) for k in range(4)}
    found = paged.slices(days, date.min, date.max, 100, 60, 3)
    every = lambda some: sorted((d, p) for s in some for d, first, end in s.parts for p in range(first, end))
    few = paged.together(found, 7)
    assert len(found) > 7 == len(few) and every(few) == every(found)
    assert max(len(s.parts) for s in few) <= 2  # following pages are one part


def test_numbers_that_json_has_no_form_for(spark, tmp_path):
    rows = spark.range(40).selectExpr("id", "timestamp'2024-01-01' AS ts", "CASE WHEN id = 3 THEN double('NaN') WHEN id = 4 THEN double('-Infinity') WHEN id > 5 THEN id / 4 END AS v")
    paged.stage(rows, "ts", "id", str(tmp_path), 20)
    got = {r.id: str(r.v) for r in paged.read(spark, str(tmp_path), "id long, v double, day date").collect()}
    assert got == {r.id: str(r.v) for r in rows.collect()}
