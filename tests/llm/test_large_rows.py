"""Tables of large rows are written in row groups of few rows, whatever a task has of them."""

import pyarrow.parquet as pq
from curata.llm import common as c
from pyspark.sql import functions as F


def groups(df):
    return [f.row_group(k).num_rows for path in df.inputFiles() for f in [pq.ParquetFile(path.removeprefix("file://")).metadata] for k in range(f.num_row_groups)]


def test_row_groups_of_large_rows_are_bounded(spark):
    rows = spark.range(12, numPartitions=1).select("id", F.transform(F.sequence(F.lit(1), F.lit(400_000)), lambda x: F.xxhash64(x, "id")).alias("x"))
    cut = c.cut(rows, large_rows=True)
    assert max(groups(cut)) <= 5 and sum(groups(cut)) == 12
    assert {(r.id, r.n) for r in cut.select("id", F.size("x").alias("n")).collect()} == {(k, 400_000) for k in range(12)}


def test_units_and_shards_are_such_tables(spark, monkeypatch):
    from curata.llm import lexical, lm

    asked = []
    cut = c.cut
    monkeypatch.setattr(c, "cut", lambda df, large_rows=False: asked.append((df.columns[0], large_rows)) or cut(df, large_rows))
    lm.encoded(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"))
    lexical.op11_lexical_search(spark, "/root/testdata/sf0.001")
    assert asked == [("unit", True), ("ids", True)]
