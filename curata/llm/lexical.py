"""Ranked lexical search: an index of shards, each searched by MaxScore.

``index`` makes one row a shard of about ``SHARD_BYTES`` of text, with its own terms,
postings (document and frequency) and document lengths; it is built once and searched for
many. ``search`` takes queries in blocks. Each task keeps the best k documents of every
query over its shards, and with them the score that a further document must reach. In
a shard, a query's lists are taken by falling upper bound: as long as a document
that only the lists from here on hold could still reach that score, the list is essential
and all its postings are added up. The lists after that are non-essential: they are probed,
and only for documents whose sum so far plus the bounds left can qualify. Scores are
integers, so the ranking is exact.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curata.llm import common as c

SHARD_BYTES = 4 << 20
#: Bytes of query text sent out at a time.
QUERY_BYTES = 8 << 20
INDEX = "ids array<long>, lengths array<int>, terms array<string>, listed array<int>, docs array<int>, freqs array<int>"


def terms(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """All terms of the texts in order, and the row of each."""
    data, offsets = c.utf8(texts)
    low = c.LOWER[data]
    is_word = c.ALNUM_WORD[low]
    starts, ends, rows = c.spans(is_word, offsets)
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(low[is_word])), rows


def _shard(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch | None:
    words, rows = terms(texts)
    if not len(words):
        return None
    lengths = c.row_counts(rows, len(texts))
    holding = np.flatnonzero(lengths)
    doc = (np.cumsum(lengths > 0) - 1)[rows]
    found = words.dictionary_encode()
    key, freqs = np.unique(np.asarray(found.indices).astype(np.int64) * len(holding) + doc, return_counts=True)
    columns = [
        ids.take(pa.array(holding)),
        pa.array(lengths[holding], pa.int32()),
        found.dictionary,
        pa.array(np.bincount(key // len(holding), minlength=len(found.dictionary)), pa.int32()),
        pa.array(key % len(holding), pa.int32()),
        pa.array(freqs, pa.int32()),
    ]
    names = ["ids", "lengths", "terms", "listed", "docs", "freqs"]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in columns], names=names)


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a shard of ``docs``; rows without terms (null and empty texts, too) are in none.

    Every other row is a document of its own, with a null or a repeated id as well.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.slices(batch, "t", SHARD_BYTES):
                shard = _shard(part.column("i"), part.column("t"))
                if shard is not None:
                    yield shard

    return docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(apply, INDEX)


@dataclass
class Block:
    """Queries sent out together: ids, distinct terms, and each query's term numbers and weights."""

    ids: pa.Array
    words: pa.Array
    number: np.ndarray
    weight: np.ndarray
    first: np.ndarray


def _block(ids: pa.Array, texts: pa.Array) -> Block:
    """Queries' distinct terms, weighted by their repeats."""
    words, rows = terms(texts)
    found = words.dictionary_encode()
    size = max(1, len(found.dictionary))
    key, repeats = np.unique(rows * size + np.asarray(found.indices).astype(np.int64), return_counts=True)
    first = np.searchsorted(key // size, np.arange(len(texts) + 1))
    return Block(ids, found.dictionary, key % size, repeats.astype(np.int64), first)


def _values(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(name).flatten()


def document_frequencies(shards: DataFrame, words: pa.Array) -> np.ndarray:
    """How many documents hold each of ``words``: counted in the tasks, summed by word."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words), np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                place = pc.index_in(words, value_set=_values(row, "terms"))
                here = np.flatnonzero(np.asarray(place.is_valid()))
                total[here] += np.asarray(_values(row, "listed"))[np.asarray(place.drop_null())]
        here = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(here, pa.int32()), pa.array(total[here], pa.int64())], names=["word", "df"])

    out = np.zeros(len(words), np.int64)
    found = shards.select("terms", "listed").mapInArrow(apply, "word int, df long").groupBy("word").agg(F.sum("df").alias("df")).toArrow()
    out[found.column("word").to_numpy()] = found.column("df").to_numpy()
    return out


class Best:
    """The best k documents of each query so far, by falling score, then id (null last)."""

    def __init__(self, queries: int, k: int):
        self.k = k
        none = np.zeros(0, np.int64)
        self.of = [(none, none, none)] * queries
        self.least = np.ones(queries, np.int64)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        s, i, u = (np.concatenate(x) for x in zip(self.of[q], (scores, ids, unknown), strict=True))
        order = np.lexsort((i, u, -s))[: self.k]
        self.of[q] = s[order], i[order], u[order]
        if len(order) == self.k:
            self.least[q] = s[order[-1]]


def search_shard(row: pa.RecordBatch, block: Block, n: int, total: int, best: Best) -> int:
    """Search one shard for all queries of the block; the number of postings that were looked at."""
    place = pc.index_in(block.words, value_set=_values(row, "terms"))
    held = np.flatnonzero(np.asarray(place.is_valid()))
    if not len(held):
        return 0
    listed = np.asarray(_values(row, "listed")).astype(np.int64)
    ends = np.cumsum(listed)
    at = np.asarray(place.drop_null())
    size = listed[at]
    begin = np.cumsum(size) - size
    take = np.repeat(ends[at] - size - begin, size) + np.arange(size.sum())
    docs = np.asarray(_values(row, "docs"))[take]
    freqs = np.asarray(_values(row, "freqs"))[take].astype(np.int64)
    lengths = np.asarray(_values(row, "lengths")).astype(np.int64)
    m = 75 + (25 * n * lengths) // total
    gains = (1_000_000_000 * freqs) // (1000 * freqs + 12 * m[docs])
    most = np.maximum.reduceat(gains, begin)
    ids = _values(row, "ids")
    unknown = np.asarray(ids.is_null()).astype(np.int64)
    ids = np.asarray(ids.fill_null(0))
    local = np.full(len(block.words), -1)
    local[held] = np.arange(len(held))
    sums = np.zeros(len(lengths), np.int64)
    looked = 0
    for q in range(len(block.first) - 1):
        of = slice(block.first[q], block.first[q + 1])
        here = local[block.number[of]]
        weight = block.weight[of][here >= 0]
        here = here[here >= 0]
        bound = weight * most[here]
        order = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)
        least = best.least[q]
        if rest[0] < least:
            continue
        sums[:] = 0
        held_by = None
        for step, x in enumerate(order):
            t = here[x]
            postings = slice(begin[t], begin[t] + size[t])
            if held_by is None and rest[step] >= least:  # essential
                sums[docs[postings]] += weight[x] * gains[postings]
                looked += size[t]
                if rest[step + 1] >= least and len(sums) > best.k:
                    least = max(least, np.partition(sums, -best.k)[-best.k])
                continue
            if held_by is None:
                held_by = np.flatnonzero(sums)
            held_by = held_by[sums[held_by] + rest[step] >= least]
            if not len(held_by):
                break
            own = docs[postings]
            found = np.minimum(np.searchsorted(own, held_by), len(own) - 1)
            same = own[found] == held_by
            sums[held_by[same]] += weight[x] * gains[postings][found[same]]
            looked += len(held_by)
        good = np.flatnonzero(sums >= least) if held_by is None else held_by[sums[held_by] >= least]
        if len(good):
            best.add(q, sums[good], ids[good], unknown[good])
    return looked


def search(shards: DataFrame, queries: DataFrame, k: int = 20, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The ``k`` best documents of ``shards`` (an ``index``) for each row of ``queries``.

    ``item_id``, ``rank`` from 1, ``doc_id``, ``score``; only scores above 0, ties to the smaller
    doc_id, null last. Repeated queries are answered each, those with a null id too; a null or
    empty text has no terms and gets no rows. The index is read once to count and once to
    search for every ``QUERY_BYTES`` of query text, so work grows with queries times documents.
    """
    spark = shards.sparkSession
    sizes = shards.select(F.size("ids").cast("long").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("l"))
    n, total = (int(x or 0) for x in sizes.agg(F.sum("n"), F.sum("l")).first())
    asked = queries.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // QUERY_BYTES))
    schema = f"number int, item_id {dict(asked.dtypes)['item_id']}, doc_id long, score long"
    folder = f"{c.shared_dir(spark)}/curata-{uuid.uuid4().hex}"
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        block = _block(part.column("item_id").combine_chunks(), part.column("text"))
        df = document_frequencies(shards, block.words)
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        block.weight = block.weight * weights[block.number]
        sent = spark.sparkContext.broadcast(block)

        def apply(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            best = Best(len(block.ids), k)
            for batch in batches:
                for at in range(batch.num_rows):
                    search_shard(batch.slice(at, 1), block, n, total, best)
            number = np.repeat(np.arange(len(best.of)), [len(s) for s, _, _ in best.of])
            scores, ids, unknown = (np.concatenate([np.zeros(0, np.int64), *[x[j] for x in best.of]]) for j in range(3))
            columns = [pa.array(number, pa.int32()), block.ids.take(pa.array(number)), pa.array(ids, mask=unknown > 0), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=["number", "item_id", "doc_id", "score"])

        order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = shards.mapInArrow(apply, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if blocks > 1:
            ranked.write.parquet(f"{folder}/block={b}")
    if blocks > 1:
        ranked = spark.read.schema(ranked.schema).parquet(folder)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item; null texts have no terms, rows with null ids are ranked too."""
    shards = c.cut(index(c.table(spark, sf_dir, "documents")), large_rows=True)
    return search(shards, c.table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
q AS (SELECT row_number() OVER () AS number, item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, term, CAST(count(*) AS BIGINT) AS tf, max(m) AS m
  FROM (SELECT r, doc_id, 75 + (25 * len(w) * s.n) // s.l AS m, unnest(w) AS term FROM d, s) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(s.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY 1),
g AS (SELECT number, item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN f USING (term) GROUP BY 1, 2, 3, 4),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY number ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM g WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""
