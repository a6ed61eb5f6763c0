"""Exact top-k search by exhaustive term-at-a-time accumulation.

Queries go out in blocks of about ``QUERY_BYTES``; what each block finds is written, so
that the plan and the driver's load don't grow with their number. A task turns its
candidates into postings by component and, for each query row's non-zero terms,
scatters weighted postings into a dense score array of a bounded tile; the best k
of each query are kept while tiles pass, and the tasks' lists merge by one window.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.llm import common as c

#: Bytes of query vectors sent out at a time.
QUERY_BYTES = 32 << 20
TILE_QUERIES, TILE_ROWS = 128, 1024


def integers(vector: Column) -> Column:
    """floor(1024 * x) of each component, or null where the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(1024.0) * x.cast("double"))))


def _dense(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for k, r in enumerate(rows):
        out[k, : min(len(r), width)] = r[:width]
    return out


def _column(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    x = batch.column(name)
    flat = np.asarray(x.flatten())
    sizes = np.asarray(pa.compute.list_value_length(x)).astype(np.int64) if len(x) else np.zeros(0, np.int64)
    if len(sizes) and (sizes == sizes[0]).all():
        return _dense([], width) if not len(flat) and not sizes[0] == 0 else _fit(flat.reshape(len(sizes), sizes[0]), width)
    return _dense(np.split(flat, np.cumsum(sizes)[:-1]), width)


def _fit(m: np.ndarray, width: int) -> np.ndarray:
    if m.shape[1] == width:
        return m
    out = np.zeros((len(m), width), np.int64)
    out[:, : min(width, m.shape[1])] = m[:, :width]
    return out


def accumulate(queries: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Scores of query rows against candidates; ``postings`` is component by candidate."""
    scores = np.zeros((len(queries), postings.shape[1]), np.int64)
    for term in range(queries.shape[1]):
        rows = np.flatnonzero(queries[:, term])
        listed = np.flatnonzero(postings[term])
        if len(listed) == postings.shape[1] and len(rows) == len(queries):
            scores += queries[:, term, None] * postings[term]
        elif len(rows) and len(listed):
            scores[np.ix_(rows, listed)] += queries[rows, term, None] * postings[term, listed]
    return scores


def _best(number: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k entries of each query number, by score descending, then id."""
    order = np.lexsort((ids, -scores, number))
    number, ids, scores = number[order], ids[order], scores[order]
    begin = np.searchsorted(number, number)
    keep = np.arange(len(number)) - begin < k
    return number[keep], ids[keep], scores[keep]


def search(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding", columns: tuple[str, str, str, str] = ("query_id", "rank", "vec_id", "score")) -> DataFrame:
    """The ``k`` highest integer inner products of each query row among ``vectors``.

    One row per query row and rank: query id, rank from 1, candidate id, score; ties go
    to the smaller id. A query's candidates are the rows of other ids; repeated
    candidate rows stand for themselves, repeated query rows are answered each.
    Null vectors, vectors with null or non-finite components, and null ids take no
    part, as query or candidate. Missing trailing components count as zero. Scores
    are 64-bit integers. With no queries or candidates there are no rows.
    """
    spark = vectors.sparkSession
    pick = lambda d: d.select(F.col(vec_id).cast("long").alias("id"), integers(F.col(vector)).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    base, asked = pick(vectors), pick(queries)
    size = asked.agg(F.sum(F.size("v"))).first()[0] or 0
    blocks = max(1, -(-8 * size // QUERY_BYTES))
    schema = "number int, query_id long, id long, score long"
    folder = f"{c.shared_dir(spark)}/curata-{uuid.uuid4().hex}"
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == b).toArrow().sort_by([("id", "ascending")])
        vectors_of = [x.values.to_numpy() for x in block.column("v")]
        width = max([1, *map(len, vectors_of)])
        sent = spark.sparkContext.broadcast((block.column("id").to_numpy(), _dense(vectors_of, width)))

        def apply(batches: Iterator[pa.RecordBatch], sent=sent, width=width) -> Iterator[pa.RecordBatch]:
            query_ids, q = sent.value
            kept = (np.zeros(0, np.int64),) * 3
            worst = np.full(len(q), np.iinfo(np.int64).min)
            for whole in batches:
                for at in range(0, whole.num_rows, TILE_ROWS):
                    part = whole.slice(at, TILE_ROWS)
                    ids = np.asarray(part.column("id"))
                    postings = np.ascontiguousarray(_column(part, "v", width).T)
                    found = [kept]
                    for first in range(0, len(q), TILE_QUERIES):
                        s = accumulate(q[first : first + TILE_QUERIES], postings)
                        own = query_ids[first : first + TILE_QUERIES, None] == ids
                        least = worst[first : first + TILE_QUERIES].copy()
                        if s.shape[1] > k:  # own rows, at most, take places above the limit
                            spare = k + own.sum(1).max(initial=0)
                            if spare < s.shape[1]:
                                least = np.maximum(least, np.partition(s, -spare, axis=1)[:, -spare])
                        r, col = np.nonzero((s >= least[:, None]) & ~own)
                        found.append(_best(r + first, ids[col], s[r, col], k))
                    kept = _best(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
                    count = np.bincount(kept[0], minlength=len(q))
                    full = np.flatnonzero(count >= k)
                    worst[full] = kept[2][np.cumsum(count)[full] - 1]
            number, ids, scores = kept
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(query_ids[number], pa.int64()), pa.array(ids), pa.array(scores)], names=["number", "query_id", "id", "score"])

        order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc("id"))
        ranked = base.mapInArrow(apply, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if blocks > 1:
            ranked.write.parquet(f"{folder}/block={b}")
    if blocks > 1:
        ranked = spark.read.schema(ranked.schema).parquet(folder)
    return ranked.select(F.col("query_id").alias(columns[0]), F.col("rank").alias(columns[1]), F.col("id").alias(columns[2]), F.col("score").alias(columns[3]))


def op5_topk(spark, sf_dir: str) -> DataFrame:
    """The ten best rows for each row whose vec_id is divisible by 100; null ids and bad vectors take no part."""
    vectors = c.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
