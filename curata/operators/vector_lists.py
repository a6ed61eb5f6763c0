"""An inverted-file index of vectors: every row in the list of its nearest centroid, few lists a query.

Centroids are fitted on a bounded sample; every row is indexed. A list of more than
``LIST_ROWS`` rows is dealt into parts, and its queries into blocks, so that a task holds one
part and one block at most. Components become integers, so distances are exact and ties
are plain. ``exact`` probes as well all lists that the distance found so far can't rule
out: a list's rows are at least as far off as its centroid less the list's radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.sources.files import cut

#: Rows that centroids are fitted on, for each list.
SAMPLE = 64
LIST_ROWS, BLOCK_QUERIES = 20_000, 5_000
SCALE = 1024
_SLACK = 1e-6
#: Distances that a task holds at a time.
PAIRS = 1 << 20


@dataclass
class Lists:
    """The index: rows ``id, v, list, part``, centroids, radii by list, and parts by list."""

    rows: DataFrame
    centroids: np.ndarray
    radii: np.ndarray
    parts: np.ndarray


def integers(vector: Column) -> Column:
    """floor(1024 * x) of each component; null where the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).astype(np.int64).reshape(len(flat), -1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``."""
    return np.maximum(0, (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1))


def _centroids(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from the first distinct rows; an empty list keeps its centroid."""
    x = np.unique(sample, axis=0)
    x = x[np.random.default_rng(0).permutation(len(x))]
    centres = x[:lists].astype(float)
    for _ in range(rounds):
        near = _squared(sample.astype(float), centres).argmin(1)
        for k in np.unique(near):
            centres[k] = sample[near == k].mean(0)
    return centres


def _nearest(rows: DataFrame, centroids: np.ndarray, n: int, keep: str) -> DataFrame:
    """``id, keep`` with ``list, gap`` for the ``n`` nearest centroids of each row (all, if 0): a row each."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)
    n = min(n or len(centroids), len(centroids))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                d = np.sqrt(_squared(_matrix(batch.column(keep)).astype(float), sent.value))
                near = np.argsort(d, axis=1, kind="stable")[:, :n]
                take = pa.array(np.repeat(np.arange(len(d)), n))
                gap = np.take_along_axis(d, near, 1)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column(keep).take(take), pa.array(near.ravel().astype(np.int32)), pa.array(gap.ravel())], names=["id", keep, "list", "gap"])

    return rows.select("id", keep).mapInArrow(apply, f"id long, {keep} array<long>, list int, gap double")


def build(vectors: DataFrame, key: str, vector: str, lists: int) -> Lists | None:
    """Index all usable rows of ``vectors`` (vectors of one length); None without any.

    Rows with a null key, a null vector, or one with null or non-finite components are left out.
    The ``lists * SAMPLE`` rows of least hash are the sample.
    """
    rows = cut(vectors.select(F.col(key).cast("long").alias("id"), integers(F.col(vector)).alias("v")).where("id IS NOT NULL AND v IS NOT NULL"))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(lists * SAMPLE).select("v").toArrow()
    if not sample.num_rows:
        return None
    centroids = _centroids(_matrix(sample.column("v")), lists)
    placed = cut(_nearest(rows, centroids, 1, "v"))
    sizes, radii = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in placed.groupBy("list").agg(F.count("*").alias("n"), F.max("gap").alias("gap")).collect():  # a row a list
        sizes[r["list"]], radii[r["list"]] = r["n"], r["gap"]
    parts = np.maximum(1, -(-sizes // LIST_ROWS))
    dealt = F.pmod(F.xxhash64("id"), F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("list") + 1)).cast("int")
    return Lists(cut(placed.select("id", "v", "list", dealt.alias("part"))), centroids, radii, parts)


def _best_pairs(x: np.ndarray, ids: np.ndarray, q: np.ndarray, asked_ids: np.ndarray, k: int) -> list[np.ndarray]:
    """``query_id, id, distance`` of the ``k`` best rows of ``x`` for each of ``q``, for about ``PAIRS`` distances at a time."""
    out: tuple[list, list, list] = ([], [], [])
    step = max(1, min(256, PAIRS // len(x)))
    for at in range(0, len(q), step):
        d = _squared(q[at : at + step], x)
        least = np.partition(d, min(k, d.shape[1] - 1), axis=1)[:, min(k, d.shape[1] - 1), None]
        a, b = np.nonzero((d <= least) & (asked_ids[at : at + step, None] != ids))
        order = np.lexsort((ids[b], d[a, b], a))
        a, b = a[order], b[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < k
        for held_list, values in zip(out, (asked_ids[at + a[keep]], ids[b[keep]], d[a[keep], b[keep]]), strict=True):
            held_list.append(values)
    return [np.concatenate([np.zeros(0, np.int64), *y]).astype(np.int64) for y in out]


def _probe(index: Lists, pairs: DataFrame, k: int) -> DataFrame:
    """``query_id, id, distance``: the ``k`` best rows of each part of the lists that ``pairs`` (id, q, list) name."""
    counts = {r["list"]: r["n"] for r in pairs.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list
    blocks = [max(1, -(-counts.get(x, 0) // BLOCK_QUERIES)) for x in range(len(index.centroids))]
    of = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("list") + 1)
    asked = pairs.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), of(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), of(index.parts) - 1)))
    held = index.rows.where(F.col("list").isin(list(counts))).withColumn("block", F.explode(F.sequence(F.lit(0), of(blocks) - 1)))

    def apply(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            columns = [np.zeros(0, np.int64)] * 3
        else:
            columns = _best_pairs(_matrix(rows.column("v")), rows.column("id").to_numpy(), _matrix(queries.column("q")), queries.column("id").to_numpy(), k)
        return pa.table({"query_id": columns[0], "id": columns[1], "distance": columns[2]})

    group = ["list", "part", "block"]
    return held.groupBy(*group).cogroup(asked.groupBy(*group)).applyInArrow(apply, "query_id long, id long, distance long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Lists, queries: DataFrame, key: str, vector: str, k: int, probes: int, exact: bool = False) -> DataFrame:
    """``query_id, rank, id, distance``: the ``k`` nearest other rows of each query row, by squared integer distance.

    Ties go to the smaller id; keys are unique. Without ``exact``, only rows in the
    ``probes`` nearest lists are found. Queries without a usable vector have no rows.
    """
    asked = queries.select(F.col(key).cast("long").alias("id"), integers(F.col(vector)).alias("q")).where("id IS NOT NULL AND q IS NOT NULL")
    pairs = cut(_nearest(asked, index.centroids, 0 if exact else probes, "q"))
    near = Window.partitionBy("id").orderBy("gap", "list")
    first = pairs.withColumn("place", F.row_number().over(near)) if exact else pairs.withColumn("place", F.lit(0))
    found = cut(_best(_probe(index, first.where(F.col("place") <= probes).select("id", "q", "list"), k), k))
    if exact:
        reach = found.groupBy("query_id").agg(F.max("distance").alias("d"), F.count("*").alias("n"))
        radius = F.element_at(F.array(*[F.lit(float(r)) for r in index.radii]), F.col("list") + 1)
        rest = first.where(F.col("place") > probes).join(reach, F.col("id") == F.col("query_id"), "left")
        open_ = rest.where(F.col("n").isNull() | (F.col("n") < k) | (F.col("gap") - radius <= F.sqrt("d") * (1 + _SLACK) + _SLACK))
        more = _probe(index, cut(open_.select("id", "q", "list")), k)
        found = _best(found.drop("rank").unionByName(more), k)
    return found.select("query_id", "rank", "id", "distance")


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of ``truth``'s pairs that ``found`` has."""
    both = truth.select("query_id", "id").join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").count()
    return both / max(1, truth.count())
