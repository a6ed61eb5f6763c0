"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Symbols are lower-cased words. Patterns are the windows of ``WINDOW`` consecutive
item words (a shorter, non-empty item is one pattern), grouped by length, as the
shift tables need patterns of one length. For a group, a block is the last two
words (one, for patterns of one word): SHIFT tells for a block how far the window
may move, a shift of zero leads to the bucket of the patterns that end in that
block, and a direct comparison of the words confirms an occurrence. Texts are
scanned in lanes of bounded length side by side, so that numpy does the steps of
many lanes at once; each lane only looks at the words that the shifts lead to.

Patterns are sent to the executors in blocks of at most ``BLOCK_BYTES`` of item
text, which are applied one after the other in the same task, with no shuffle; so
what is broadcast at a time does not grow with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm import common as c

WINDOW = 10
#: Item text per broadcast block of patterns.
BLOCK_BYTES = 32 << 20
LANE = 256
_VALUES = c.byte_values(6)


def _window_hash(hashes: np.ndarray, ends: np.ndarray, m: int) -> np.ndarray:
    out = np.zeros(len(ends), c.U64)
    for k in range(m):
        out = c.mix(out + hashes[ends - (m - 1 - k)])
    return out


class Machine:
    """SHIFT table and buckets of the patterns of one length.

    A pattern is ``m`` words of an item: rows of ``starts`` and ``ends`` in ``raw``, the items' lower-cased bytes.
    """

    def __init__(self, m: int, raw: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, last: np.ndarray, item: np.ndarray, ids: np.ndarray):
        self.m, self.block = m, min(2, m)
        self.bits = int(np.clip(np.ceil(np.log2(8 * m * max(1, len(last)))), 12, 24))
        self.shift = np.full(1 << self.bits, m - self.block + 1, np.uint8)
        for q in range(self.block - 1, m):
            slot = self._block_index(hashes, last - (m - 1 - q))
            self.shift[slot] = np.minimum(self.shift[slot], m - 1 - q)
        #: Suffix-hash buckets: patterns by their whole hash, which their suffix block leads to.
        self.bucket = _window_hash(hashes, last, m)
        order = np.argsort(self.bucket, kind="stable")
        self.bucket, self.last, self.item = self.bucket[order], last[order], item[order]
        self.raw, self.starts, self.ends, self.ids = raw, starts, ends, ids

    def items_of(self, h: int, words: list[bytes]) -> set[str]:
        """The items that have just these words as a pattern, compared directly."""
        out: set[str] = set()
        k = int(np.searchsorted(self.bucket, h))
        while k < len(self.bucket) and self.bucket[k] == h:
            own = range(int(self.last[k]) - self.m + 1, int(self.last[k]) + 1)
            if str(self.ids[self.item[k]]) not in out and all(self.raw[self.starts[i] : self.ends[i]].tobytes() == w for i, w in zip(own, words, strict=True)):
                out.add(str(self.ids[self.item[k]]))
            k += 1
        return out

    def _block_index(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        x = hashes[at] if self.block == 1 else hashes[at] + hashes[at - 1] * c.U64(0xD6E8FEB86659FD93)
        return (c.mix(x) >> c.U64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of last words of windows that are, by their hashes, patterns, and these hashes."""
        lanes = np.maximum(0, count - self.m + 1)
        parts = -(-lanes // LANE)
        row = np.repeat(np.arange(len(first)), parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = first[row] + self.m - 1 + part * LANE
        stop = np.minimum(at + LANE, first[row] + count[row])
        found = []
        while len(at):
            step = self.shift[self._block_index(hashes, at)]
            zero = step == 0
            if zero.any():
                found.append(at[zero])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, c.U64)
        at = np.sort(np.concatenate(found))
        h = _window_hash(hashes, at, self.m)
        k = np.minimum(np.searchsorted(self.bucket, h), len(self.bucket) - 1)
        hit = self.bucket[k] == h
        return at[hit], h[hit]


def build(items: pa.Table) -> list[Machine]:
    """The machines of a block of items (``i``, ``t``); items without words add nothing."""
    data, offsets = c.utf8(items.column("t"))
    raw = c.LOWER[data]
    starts, ends, rows = c.spans(c.ALNUM_WORD[raw], offsets)
    hashes = c.span_hashes(raw, starts, ends, _VALUES)
    count = c.row_counts(rows, items.num_rows)
    size = np.minimum(WINDOW, count)[rows]
    place = np.arange(len(rows)) - (np.cumsum(count) - count)[rows]
    ids = np.array([str(x) for x in items.column("i").to_pylist()], object)
    out = []
    for m in np.unique(size).tolist():
        last = np.flatnonzero((size == m) & (place >= m - 1))
        out.append(Machine(m, raw, hashes, starts, ends, last, rows[last], ids))
    return out


def scan(texts: pa.Array, machines: list[Machine]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """Word counts, hit word intervals (end exclusive, merged) and item ids of each text."""
    data, offsets = c.utf8(texts)
    low = c.LOWER[data]
    starts, ends, rows = c.spans(c.ALNUM_WORD[low], offsets)
    n = len(offsets) - 1
    count = c.row_counts(rows, n)
    first = np.cumsum(count) - count
    hashes = c.span_hashes(low, starts, ends, _VALUES)
    raw = low.tobytes()
    hits: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    items: list[set[str]] = [set() for _ in range(n)]
    for x in machines:
        for at, h in zip(*x.find(hashes, first, count), strict=True):
            i = int(at) - x.m + 1
            words = [raw[s:e] for s, e in zip(starts[i : i + x.m], ends[i : i + x.m], strict=True)]
            if of := x.items_of(h, words):
                row = rows[at]
                hits[row].append((i - int(first[row]), i - int(first[row]) + x.m))
                items[row].update(of)
    return count, [merged(h) for h in hits], items


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def occurrences(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all, if None) with what of ``items`` occurs in each text.

    Adds ``_words`` (number of words), ``_hits`` (array of merged word intervals, end
    exclusive) and ``_items`` (sorted ids, as strings, of the items of which a window
    occurs). Null and empty texts have no words and no hits. Items with a null id or
    no words take no part; repeated items count once; with no items nothing is hit.
    Columns of the three names are replaced.
    """
    spark = docs.sparkSession
    keep = [x for x in (docs.columns if keep is None else keep) if x.lower() not in ("_words", "_hits", "_items")]
    plain = c.unused([*keep, "_words", "_hits", "_items"], "_text")
    items = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    empty = "array<struct<start:bigint,end:bigint>>"
    df = docs.select(*keep, F.col(text).alias(plain), F.lit(0).cast("long").alias("_words"), F.array().cast(empty).alias("_hits"), F.array().cast("array<string>").alias("_items"))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        machines = spark.sparkContext.broadcast(build(part.toArrow()))

        def apply(batches: Iterator[pa.RecordBatch], machines=machines) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in c.slices(batch, plain):
                    count, hits, found = scan(part.column(plain), machines.value)
                    if blocks > 1:
                        hits = [merged(h + [(x["start"], x["end"]) for x in old]) for h, old in zip(hits, part.column("_hits").to_pylist(), strict=True)]
                        found = [f | set(old) for f, old in zip(found, part.column("_items").to_pylist(), strict=True)]
                    new = {
                        "_words": pa.array(count, pa.int64()),
                        "_hits": pa.array([[{"start": s, "end": e} for s, e in h] for h in hits], _HITS),
                        "_items": pa.array([sorted(f) for f in found], pa.list_(pa.string())),
                    }
                    yield pa.RecordBatch.from_arrays([new.get(x, part.column(x)) for x in part.schema.names], names=part.schema.names)

        df = df.mapInArrow(apply, df.schema)
    return df.drop(plain)


def hit_counts(df: DataFrame) -> DataFrame:
    """``occurrences`` reduced to counts, the digest of the item ids and the verdict."""
    n_hit = F.aggregate("_hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"])
    return df.select(
        *[x for x in df.columns if x not in ("_words", "_hits", "_items")],
        F.col("_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows in every document; null ids and repeated rows are answered like others."""
    docs = c.table(spark, sf_dir, "documents")
    return hit_counts(occurrences(docs, c.table(spark, sf_dir, "benchmark"), keep=["doc_id"]))
