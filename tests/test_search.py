"""Searches of many queries, in blocks."""

import duckdb
import numpy as np
from curata.operators import search
from curata.plans.queries import ORACLES, QUERIES
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


def test_each_query_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    r = np.random.default_rng(1)
    vectors = r.integers(-4, 5, (60, 8)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(99, None)], "id long, v array<double>").repartition(3)
    found = search.nearest_each(df, df.where("id % 10 = 0"), "id", "v", 5, F.lit(0.0)).collect()
    got = {(x.query_id, x["rank"]): x.id for x in found}
    want = {}
    for q in range(0, 60, 10):
        d = np.round(np.sqrt(((vectors - vectors[q]) ** 2).sum(1)), 6)
        for k, i in enumerate(sorted(range(60), key=lambda i: (d[i], i))[:5]):
            want[q, k + 1] = i
    assert got == want
    assert search.nearest_each(df, df.limit(0), "id", "v", 5, F.lit(0.0)).count() == 0


def test_all_queries_are_answered(spark):
    asked = {r[0] for r in spark.read.parquet(f"{DIR}/embeddings.parquet").where("vec_id % 20 = 0").select("vec_id").collect()}
    assert {r.query_id for r in QUERIES["q_vector_search_each"](spark, DIR).collect()} == asked
    items = {r[0] for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id").collect()}
    assert {r.item_id for r in QUERIES["q_keyword_search_each"](spark, DIR).collect()} == items


def test_vectors_out_of_the_ordinary_and_a_plan_that_does_not_grow(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(i, r.integers(-3, 4, 6).astype(float).tolist()) for i in range(400)]
    rows[7], rows[20], rows[30], rows[41] = (7, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (20, [0.0] * 5), (30, [float("nan")] * 6), (41, [float("inf")] * 6)
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(4)
    bonus = F.when(F.col("id") % 3 == 0, 0.5).otherwise(0.0)
    pairs = df.crossJoin(df.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")))
    scored = pairs.select("query_id", "id", F.round(search.distance(F.col("v"), F.col("q")) - bonus, 6).alias("s"))
    order = search.Window.partitionBy("query_id").orderBy("s", "id")
    want = {(x.query_id, x["rank"], x.id, str(x.s)) for x in scored.withColumn("rank", F.row_number().over(order)).where("rank <= 5").collect()}
    sizes = []
    for block in (32_768, 4):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        near = search.nearest_each(df, df.where("id % 10 = 0"), "id", "v", 5, bonus)
        assert {(x.query_id, x["rank"], x.id, str(x.rank_score)) for x in near.collect()} == want
        sizes.append(near._jdf.queryExecution().analyzed().toString().count("MapInArrow"))
    assert sizes[0] == 1  # 40 queries had 1 block; the plan had a join for every 256 queries


def test_keyword_search_in_shards_and_blocks_gives_what_sql_gives(spark, monkeypatch):
    r = np.random.default_rng(3)
    word = lambda: r.choice(["the", "The", "a1", "b", "Über", "c-d", "e", "x"])
    docs = [(k, " ".join(word() for _ in range(r.integers(0, 30)))) for k in range(300)]
    docs += [(900 + k, "b b the e e x") for k in range(60)] + [(7, "the a1 b"), (7, docs[7][1]), (None, "the b"), (None, "x"), (5000, None), (5001, "")]
    items = [(k, " ".join(word() for _ in range(r.integers(1, 5)))) for k in range(30)] + [(3, "the x x"), (50, None), (51, "absent"), (None, "b e")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    want = sorted(map(str, con.execute(f"SELECT item_id, rank, doc_id, score FROM ({ORACLES['q_keyword_search_each']})").fetchall()))
    df, asked = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for shard, block in ((4 << 20, 4 << 20), (500, 100)):
        monkeypatch.setattr(search, "SHARD_BYTES", shard)
        monkeypatch.setattr(search, "ASKED_BYTES", block)
        found = search.bm25_each(df, "doc_id", "text", asked, "item_id", "text", 20).select("item_id", "rank", "doc_id", "score")
        assert sorted(str(tuple(x)) for x in found.collect()) == want
    monkeypatch.setattr(search, "ASKED_BYTES", 4 << 20)
    single = df.where("doc_id > 7").select("doc_id", "text")
    kept = search._block_scores(single, None, "doc_id", "text", asked, "bigint", "bigint", 20, 1.2, 0.75).groupBy("_query", F.spark_partition_id()).count()
    assert kept.agg(F.max("count")).first()[0] <= 20  # a task passed on every row that held a word
    assert search.bm25_each(df.limit(0), "doc_id", "text", asked, "item_id", "text", 20).count() == 0
    assert search.bm25_each(df, "doc_id", "text", asked.limit(0), "item_id", "text", 20).count() == 0
