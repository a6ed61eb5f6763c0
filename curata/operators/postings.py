"""Full-text search by postings with positions: built once, asked for many phrases.

Texts are indexed in shards of about ``SHARD_BYTES``, a row each: the keys of its documents
and, for each bucket of terms, a column with these terms' documents and positions. A query
reads the columns of its terms' buckets only. As all terms of a document are in one row,
tasks settle phrases by themselves: each term's positions, less its place in the phrase,
must have one in common. Nothing is shuffled, and work grows with shards times phrases.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions.stem import stem
from curata.functions.words import slices, words
from curata.sources import files

BUCKETS = 32
SHARD_BYTES = 4 << 20
#: Phrase terms up to which they are sent to all tasks.
SENT_ROWS = 100_000


def same(word: str) -> str:
    return word


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def _packed(terms: list[str], *numbers: np.ndarray) -> bytes:
    joined = "\n".join(terms).encode()
    head = np.array([len(joined), *[len(x) for x in numbers]], np.int32)
    return b"".join([head.tobytes(), joined, *[x.astype(np.int32).tobytes() for x in numbers]])


def _unpacked(blob: bytes) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, how many documents and places each has, and these documents (one for each place) and places."""
    head = np.frombuffer(blob, np.int32, 5)
    at, out = 20 + int(head[0]), []
    for n in head[1:]:
        out.append(np.frombuffer(blob, np.int32, n, at))
        at += 4 * int(n)
    sizes, docs, counts, places = out
    terms = blob[20 : 20 + int(head[0])].decode().split("\n") if len(sizes) else []
    ends = np.cumsum(counts)
    held = np.cumsum(sizes)
    return terms, sizes, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], held])]), np.repeat(docs, counts), places


def _shard(keys: pa.Array, texts: pa.Array, term: Callable[[str], str]) -> list[pa.Array] | None:
    """A row's columns, or None without words."""
    flat, rows = words(texts)
    if not len(flat):
        return None
    coded = flat.dictionary_encode()
    made = [term(w) for w in coded.dictionary.to_pylist()]
    distinct = list(dict.fromkeys(made))
    buckets = np.array([_bucket(w) for w in distinct])
    by = np.argsort(buckets, kind="stable")
    terms, cuts = [distinct[k] for k in by], np.searchsorted(buckets[by], np.arange(BUCKETS + 1))
    number = {w: k for k, w in enumerate(terms)}
    of = np.array([number[w] for w in made], np.int64)[np.asarray(coded.indices)]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    order = np.argsort(of * len(keys) + rows, kind="stable")
    of, rows, place = of[order], rows[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 0) | (np.diff(rows) != 0)]))
    docs, counts, sizes = rows[first], np.diff(np.append(first, len(rows))), np.bincount(of[first], minlength=len(terms))
    held = np.concatenate([[0], np.cumsum(sizes)])[cuts]
    seen = np.append(first, len(rows))[held]
    out = [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)]
    for b in range(BUCKETS):
        d = slice(held[b], held[b + 1])
        out.append(pa.array([_packed(terms[cuts[b] : cuts[b + 1]], sizes[cuts[b] : cuts[b + 1]], docs[d], counts[d], place[seen[b] : seen[b + 1]])], pa.binary()))
    return out


def build(df: DataFrame, key: str, text: str, folder: str | None = None, term: Callable[[str], str] = stem) -> DataFrame:
    """The index of ``df``, written under ``folder`` (by default in the shared one): ``keys`` and the buckets ``b0, b1, ...`` of each shard.

    Words are runs of a-z and 0-9 in lower case; ``term`` makes terms of them. Rows with a null key or
    without words have none; ``key`` is unique.
    """
    spark = df.sparkSession
    names = ["keys", *[f"b{b}" for b in range(BUCKETS)]]
    schema = f"keys array<{dict(df.dtypes)[key]}>, " + ", ".join(f"{x} binary" for x in names[1:])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in slices(batches, "t", SHARD_BYTES):
            if (made := _shard(shard.column("key"), shard.column("t"), term)) is not None:
                yield pa.RecordBatch.from_arrays(made, names=names)

    made = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(apply, schema)
    folder = folder or f"{files.shared_dir(spark)}/curata-{uuid.uuid4().hex}"
    made.write.options(**files.LARGE_ROWS).parquet(folder)
    return read(spark, folder, schema)


def bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(folder)


def phrases(df: DataFrame, key: str, text: str, term: Callable[[str], str] = stem, first: int | None = None) -> DataFrame:
    """``key, at, term, n``: the terms of each phrase (of its ``first`` words, if given) by place, and how many there are."""
    kind = dict(df.dtypes)[key]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, rows = words(batch.column("t"))
            at = np.arange(len(rows)) - np.searchsorted(rows, rows)
            kept = np.flatnonzero(at < (len(at) if first is None else first))
            rows, at = rows[kept], at[kept]
            sizes = np.bincount(rows, minlength=batch.num_rows)[rows]
            terms = [term(w) for w in flat.take(pa.array(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("phrase").take(pa.array(rows)), pa.array(at.astype(np.int32)), pa.array(terms, pa.string()), pa.array(sizes.astype(np.int32))], names=["phrase", "at", "term", "n"])

    return df.select(F.col(key).alias("phrase"), F.col(text).alias("t")).mapInArrow(apply, f"phrase {kind}, at int, term string, n int")


class _Postings:
    """One shard's postings, unpacked by bucket as they are asked for."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.batch, self.row, self.buckets, self.found = batch, row, {}, {}

    def places(self, term: str) -> np.ndarray | None:
        """Document and place, in one number each, where ``term`` stands, in order."""
        if term not in self.found:
            b = _bucket(term)
            if b not in self.buckets:
                terms, _, n, docs, places = _unpacked(self.batch.column(f"b{b}")[self.row].as_py())
                self.buckets[b] = {w: k for k, w in enumerate(terms)}, np.concatenate([[0], np.cumsum(n)]), docs, places
            number, cuts, docs, places = self.buckets[b]
            k = number.get(term)
            self.found[term] = None if k is None else (docs[cuts[k] : cuts[k + 1]].astype(np.int64) << 32) + places[cuts[k] : cuts[k + 1]]
        return self.found[term]


def _common(shard: _Postings, terms: list[str]) -> np.ndarray | None:
    """Where the phrase starts, or None: the rarest term's places go through the others'."""
    held = []
    for at, w in enumerate(terms):
        if (x := shard.places(w)) is None:
            return None
        held.append((len(x), at, x))
    held.sort(key=lambda x: x[:2])
    starts = held[0][2] - held[0][1]
    for _, at, x in held[1:]:
        near = np.searchsorted(x, starts + at)
        starts = starts[x[np.minimum(near, len(x) - 1)] == starts + at]
    return starts if len(starts) else None


def search(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """``phrase, key, places``: where each of ``asked`` (``phrases``, unique by key) stands, by its first term's positions.

    Phrases without terms are found nowhere.
    """
    asked = files.cut(asked)
    held = [r[0] for r in asked.select(bucket(F.col("term"))).distinct().collect()]  # at most BUCKETS
    postings = postings.select("keys", *[f"b{b}" for b in sorted(held)])
    kind, key_kind = dict(asked.dtypes)["phrase"], postings.schema["keys"].dataType.elementType.simpleString()
    if asked.count() > SENT_ROWS:
        return _search_joined(postings, asked, sorted(held), key_kind)
    by: dict = {}
    rows = asked.toArrow()  # at most SENT_ROWS
    for row in rows.to_pylist():
        by.setdefault(row["phrase"], {})[row["at"]] = row["term"]
    terms = [[x[k] for k in sorted(x)] for x in by.values()]
    sent = postings.sparkSession.sparkContext.broadcast((pa.array(list(by), rows.schema.field("phrase").type), terms))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                shard, keys = _Postings(batch, row), batch.column("keys")[row].values
                for k, some in enumerate(terms):
                    if (starts := _common(shard, some)) is not None:
                        docs, first = np.unique(starts >> 32, return_index=True)
                        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(starts)).astype(np.int32)), pa.array((starts & 0xFFFFFFFF).astype(np.int32)))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(len(docs), k))), keys.take(pa.array(docs)), places], names=["phrase", "key", "places"])

    return postings.mapInArrow(apply, f"phrase {kind}, key {key_kind}, places array<int>")


def _search_joined(postings: DataFrame, asked: DataFrame, held: list[int], key_kind: str) -> DataFrame:
    """``search`` for more phrases than are sent to all tasks: postings and phrases meet by term, then by document."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys = batch.column("keys")[row].values
                for b in held:
                    terms, sizes, n, docs, places = _unpacked(batch.column(f"b{b}")[row].as_py())
                    of = np.repeat(np.arange(len(terms)), n)
                    first = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 0) | (np.diff(docs) != 0)])) if len(of) else of
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(of)).astype(np.int32)), pa.array(places))
                    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()).take(pa.array(of[first])), keys.take(pa.array(docs[first])), lists], names=["term", "key", "places"])

    met = postings.mapInArrow(apply, f"term string, key {key_kind}, places array<int>").join(asked, "term")
    moved = met.select("phrase", "key", "n", F.transform("places", lambda p: p - F.col("at")).alias("starts"))
    by = moved.groupBy("phrase", "key", "n").agg(F.collect_list("starts").alias("all")).where(F.size("all") == F.col("n"))  # as many as the phrase has terms
    common = F.array_sort(F.aggregate("all", F.get("all", F.lit(0)), lambda a, x: F.array_intersect(a, x)))
    return by.select("phrase", "key", common.alias("places")).where(F.size("places") > 0)


def tagged_with(df: DataFrame, tags: str, wanted: list[str]) -> DataFrame:
    """Rows of which some tag is one of ``wanted``, whatever its case; null arrays have none."""
    low = [w.lower() for w in wanted]
    return df.where(F.exists(F.coalesce(F.col(tags), F.array().cast("array<string>")), lambda t: F.coalesce(F.lower(t).isin(low), F.lit(False))))
