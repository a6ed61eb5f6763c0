"""Quality classifier: random-indexing word vectors pooled per document, then a
two-layer network in numpy whose probabilities are calibrated by a temperature.

Words fall into ``BUCKETS`` hash buckets. Each bucket has a sparse random index
vector; its word vector is the sum of its neighbours' index vectors over the
training texts. A document is the mean of its words' vectors, beside shares of
punctuation marks and a few surface measures. Vectors and network are fitted on a
sample of at most about ``SAMPLE`` labelled rows, drawn by a hash of the id, which
bounds what reaches the driver; scoring covers every row and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm import common as c

#: Most labelled rows that a fit uses, in expectation.
SAMPLE = 12_000
BUCKETS, WIDTH, HIDDEN = 1 << 14, 48, 32
THRESHOLD = 0.3
#: Tasks that sum context vectors; each sends one table to the driver.
FIT_TASKS = 6
_VALUES = c.byte_values(10)
_MARKS = np.full(256, -1, np.int64)
_MARKS[[b for b in range(33, 127) if not chr(b).isalnum()]] = np.arange(32)


def _index_vectors() -> np.ndarray:
    """Ternary vectors, a quarter of the entries at +1 or -1, from a hash."""
    h = c.mix(np.arange(BUCKETS * WIDTH, dtype=c.U64) + c.U64(1)) % c.U64(8)
    return ((h == 0).astype(np.float32) - (h == 1).astype(np.float32)).reshape(BUCKETS, WIDTH)


def _words(texts: pa.Array) -> tuple[np.ndarray, ...]:
    data, offsets = c.utf8(texts)
    low = c.LOWER[data]
    starts, ends, rows = c.spans(c.SPACE_WORD[low], offsets)
    return data, offsets, starts, ends, rows, c.span_hashes(low, starts, ends, _VALUES)


def contexts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sums of neighbours' index vectors, and word counts, by bucket."""
    *_, rows, hashes = _words(texts)
    bucket = (hashes % c.U64(BUCKETS)).astype(np.int64)
    pair = np.flatnonzero(rows[1:] == rows[:-1])
    a, b = bucket[pair], bucket[pair + 1]
    key, times = np.unique(np.concatenate([a * BUCKETS + b, b * BUCKETS + a]), return_counts=True)
    out, index = np.zeros((BUCKETS, WIDTH), np.float32), _index_vectors()
    left, right = key // BUCKETS, key % BUCKETS
    for d in range(WIDTH):
        out[:, d] = np.bincount(left, weights=times * index[right, d], minlength=BUCKETS)
    return out, np.bincount(bucket, minlength=BUCKETS).astype(np.float32)


def features(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Pooled word vectors, mark shares and surface measures of each text."""
    data, offsets, starts, ends, rows, hashes = _words(texts)
    n = len(offsets) - 1
    words = np.maximum(1, c.row_counts(rows, n)).astype(np.float64)
    size = np.maximum(1, np.diff(offsets)).astype(np.float64)
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    pooled = np.zeros((n, WIDTH))
    if len(rows):
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        pooled[rows[first]] = np.add.reduceat(vectors[(hashes % c.U64(BUCKETS)).astype(np.int64)], first, axis=0, dtype=np.float32)
    mark = _MARKS[data]
    at = np.flatnonzero(mark >= 0)
    marks = np.bincount(row_of[at] * 32 + mark[at], minlength=n * 32).reshape(n, 32) / words[:, None]
    share = lambda which: np.bincount(row_of[which], minlength=n) / size
    seen = np.unique(hashes ^ c.mix(rows.astype(c.U64) + c.U64(1)), return_index=True)[1]
    length = np.bincount(rows, weights=ends - starts, minlength=n)
    square = np.bincount(rows, weights=(ends - starts).astype(np.float64) ** 2, minlength=n)
    surface = [
        np.log(words), np.log(size), length / words, np.sqrt(np.maximum(0, square / words - (length / words) ** 2)), np.bincount(rows[seen], minlength=n) / words, np.log(np.maximum(1, np.bincount(rows[seen], minlength=n))) / np.log(words + 1),
        share((data >= 65) & (data <= 90)), share((data >= 48) & (data <= 57)), share(data == 10), share(data >= 128), share((data == 32) | (data == 9)), share(mark >= 0),
    ]
    return np.concatenate([pooled / words[:, None], np.sqrt(marks), np.stack(surface, 1)], 1).astype(np.float32)


@dataclass
class Model:
    """Word vectors, scaling, two layers and a temperature."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x).astype(np.float64) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, epochs: int = 60) -> Model:
    """Adam on the cross-entropy of four fifths of the rows; the rest choose the epoch and the temperature."""
    r = np.random.default_rng(10)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    m = Model(vectors, mean, scale, r.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), 0.0, 1.0)
    if len(y) < 10 or y.min() == y.max():  # nothing to tell apart: the share of ones, everywhere
        m.w2[:] = 0
        p = (y.sum() + 1) / (len(y) + 2)
        m.b2 = float(np.log(p / (1 - p)))
        return m
    held = np.arange(len(y)) % 5 == 4
    z, names = np.clip((x - mean) / scale, -6, 6), ("w1", "b1", "w2", "b2")
    first, second = ([np.zeros_like(np.asarray(getattr(m, k), float)) for k in names] for _ in range(2))
    loss = lambda t, k: float(np.mean(np.logaddexp(0, -(2 * y[k] - 1) * m.logit(x[k]) / t)))
    best, step, rows = (np.inf, None), 0, np.flatnonzero(~held)
    for _ in range(epochs):
        r.shuffle(rows)
        for at in np.array_split(rows, max(1, len(rows) // 128)):
            h = np.tanh(z[at] @ m.w1 + m.b1)
            g = (1 / (1 + np.exp(-np.clip(h @ m.w2 + m.b2, -40, 40))) - y[at]) / len(at)
            back = np.outer(g, m.w2) * (1 - h * h)
            grads = [z[at].T @ back + 1e-4 * m.w1, back.sum(0), h.T @ g + 1e-4 * m.w2, g.sum()]
            step += 1
            for k, name in enumerate(names):
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                setattr(m, name, getattr(m, name) - 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
        if (now := loss(1.0, held)) < best[0]:
            best = (now, [np.copy(getattr(m, k)) for k in names])
    for name, value in zip(names, best[1], strict=True):
        setattr(m, name, value)
    m.temperature = min(np.geomspace(0.4, 4, 60), key=lambda t: loss(t, held))
    return m


def held_out(doc_id: str = "doc_id", parts: int = 5) -> Column:
    """Whether crc32 of the id's text is divisible by ``parts``; null ids are never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on labelled, not held-out rows; several labels of an id are averaged and rounded."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    share = min(1.0, SAMPLE / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(10)), F.lit(1 << 52)) < int(share * (1 << 52)))
    # The draw bounds this side at about SAMPLE rows of 12 bytes.
    sample = c.cut(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id").repartition(FIT_TASKS))

    def context_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((BUCKETS, WIDTH), np.float32), np.zeros(BUCKETS, np.float32)]
        for whole in batches:
            for batch in c.slices(whole, "text"):
                for k, x in enumerate(contexts(batch.column("text"))):
                    total[k] += x
        yield pa.RecordBatch.from_arrays([pa.array([t.tobytes()]) for t in total], names=["vectors", "counts"])

    parts = sample.select("text").mapInArrow(context_tables, "vectors binary, counts binary").collect()
    vectors = sum((np.frombuffer(p[0], np.float32) for p in parts), np.zeros(BUCKETS * WIDTH, np.float32)).reshape(BUCKETS, WIDTH)
    counts = sum((np.frombuffer(p[1], np.float32) for p in parts), np.zeros(BUCKETS, np.float32))
    rare = np.log1p(counts.sum() / np.maximum(1, counts)) / 10
    vectors = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-6) * rare[:, None]
    sent = spark.sparkContext.broadcast(vectors.astype(np.float32))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in c.slices(whole, "text"):
                x = features(batch.column("text"), sent.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    rows = sorted((int(r[0]), int(r[1]), bytes(r[2])) for r in sample.select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text").mapInArrow(described, "doc_id long, y int, x binary").collect())
    width = WIDTH + 32 + 12
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(-1, width) if rows else np.zeros((1, width), np.float32)
    return train(x.astype(np.float64), np.array([r[1] for r in rows], float), sent.value)


def classify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns (all, if None) with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Only the text enters a score; null and empty texts get the score of a text without
    words. Rows are kept as they are, repeated ones and null ids included; columns of the
    two names are replaced. A score that equals the threshold is predicted 1.
    """
    keep = [x for x in docs.columns if x.lower() not in ("score", "predicted")] if keep is None else keep
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
    plain = c.unused(schema.names, "_text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in batches:
            for batch in c.slices(whole, plain):
                s = m.score(features(batch.column(plain), m.vectors))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return docs.select(*keep, F.col(text).alias(plain)).mapInArrow(apply, schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of every document; null ids are never held out, null texts score as empty."""
    docs = c.table(spark, sf_dir, "documents")
    scored = classify(docs, fit(docs, c.table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
