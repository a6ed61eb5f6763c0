"""Embedding whitening by TSQR, without a covariance matrix.

Entries become integers, so the sums that centre the rows are exact. Every task
centres its rows and folds them, block by block, into the R factor of their QR
decomposition; R factors merge in a tree, ``FAN`` at a time. The last one has the
singular values and right vectors of all centred rows: these whiten. What tasks
hold and pass on depends on the width of the vectors, not on their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm import common as c

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Factors that a task of a merge reads.
FAN = 16
_LONG, LIMB = 1 << 63, 40


@dataclass
class Whitening:
    """Row count, exact sums, right vectors (rows) and eigenvalues by falling value, and these as shares (NaN if all are 0)."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    shares: np.ndarray

    @property
    def rank(self) -> int:
        return int((self.values > 0).sum())


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id`` and ``v`` of the rows whose vector is neither null nor holds null or non-finite entries."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(F.col(vector).isNotNull() & ~bad).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def _entries(batch: pa.RecordBatch, width: int | None = None) -> Iterator[np.ndarray]:
    """Integers of a batch's vectors, in matrices of rows of one length, or of ``width``, in row order.

    Missing trailing entries count as 0. Integers beyond 64 bits come as Python's.
    """
    column = batch.column("v")
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.values)[column.offsets[0].as_py() : column.offsets[len(column)].as_py()] if len(column) else np.zeros(0)
    x = np.floor(SCALE * flat)
    x = x.astype(np.int64) + SHIFT if np.abs(x).max(initial=0) < 2.0**52 else np.array([int(v) + SHIFT for v in x], object)
    ends = np.cumsum(sizes)
    edges = np.flatnonzero(np.diff(sizes)) + 1
    blocks = []
    for first, last in zip([0, *edges], [*edges, len(sizes)], strict=True):
        if last > first:
            size = int(sizes[first])
            blocks.append(x[ends[first] - size : ends[last - 1]].reshape(last - first, size))
    if width is None:
        yield from blocks
    elif blocks:
        yield np.concatenate([np.pad(b, ((0, 0), (0, width - b.shape[1])), constant_values=SHIFT) for b in blocks])


def _column_sums(x: np.ndarray) -> list[int]:
    largest = max(map(abs, (int(x.min(initial=0)), int(x.max(initial=0)))))
    return [int(s) for s in (x if largest * len(x) < _LONG else x.astype(object)).sum(0)]


def _add(total: dict[int, list[int]], at: int, n: int, s: int) -> None:
    have = total.setdefault(at, [0, 0])
    have[0] += n
    have[1] += s


def _limbs(s: int) -> list[int]:
    """``s`` in digits of ``LIMB`` bits, lowest first, with its sign, so that tasks' sums add in 64 bits."""
    sign, rest, out = (1, -1)[s < 0], abs(s), []
    while rest or not out:
        out.append(sign * (rest & ((1 << LIMB) - 1)))
        rest >>= LIMB
    return out


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and digits of the sum at each position; position -1 counts all rows."""
    total: dict[int, list[int]] = {}
    for batch in batches:
        for x in _entries(batch):
            _add(total, -1, len(x), 0)
            for at, s in enumerate(_column_sums(x)):
                _add(total, at, len(x), s)
    at, limb, count, value = [], [], [], []
    for k, (n, s) in sorted(total.items()):
        for j, x in enumerate(_limbs(s)):
            at.append(k)
            limb.append(j)
            count.append(0 if j else n)
            value.append(x)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(limb, pa.int32()), pa.array(count, pa.int64()), pa.array(value, pa.int64())], names=["at", "limb", "n", "s"])


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the exact sum at each position, missing entries as 0."""
    found = rows.select("v").mapInArrow(_partial_sums, "at int, limb int, n long, s long").groupBy("at", "limb").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    by: dict[int, list[int]] = {}
    for r in found:  # a few rows a position
        _add(by, r["at"], r["n"], r["s"] << (LIMB * r["limb"]))
    n = by.pop(-1, [0, 0])[0]
    return n, [by[k][1] + SHIFT * (n - by[k][0]) for k in range(len(by))]


def scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly."""
    largest = max(map(abs, (int(x.min(initial=0)), int(x.max(initial=0)))))
    if n * largest < _LONG // 2 and max(map(abs, sums), default=0) < _LONG // 2:
        return n * x.astype(np.int64) - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(d: np.ndarray) -> list[int | None]:
    """Exact row sums of squares; None beyond 64 bits."""
    largest = max(map(abs, (int(d.min(initial=0)), int(d.max(initial=0)))))
    if d.dtype != object and largest**2 * d.shape[1] < _LONG:
        return (d * d).sum(1).tolist()
    return [s if s < _LONG else None for s in (sum(int(x) ** 2 for x in row) for row in d)]


def _part() -> int:
    return TaskContext.get().partitionId()


def merge_tree(parts: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """One array from the ``parts`` (part long, x array<double>), ``FAN`` merged in a task at a time, in order of their numbers."""
    parts = c.cut(parts)
    last = parts.agg(F.max("part")).first()[0]
    if last is None:
        return None

    def merged(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        found = found.sort_by([("part", "ascending")])
        x = merge([r.values.to_numpy() for r in found.column("x")])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "x": pa.array([x], pa.list_(pa.float64()))})

    while last > 0:
        parts = parts.groupBy(F.expr(f"part div {FAN}").alias("above")).applyInArrow(merged, "part long, x array<double>")
        last //= FAN
    return np.array(parts.first()["x"])


def fit(rows: DataFrame) -> Whitening:
    """The whitening of all ``rows`` (``usable``): centre by exact sums, QR, merge, SVD.

    Eigenvalues that are zero to double precision are given as 0. No rows, or vectors
    without entries, have no components.
    """
    n, sums = totals(rows)
    width = len(sums)
    if not width:
        return Whitening(n, sums, np.zeros((0, 0)), np.zeros(0), np.zeros(0))

    def stacked(blocks: list[np.ndarray]) -> np.ndarray:
        r = np.linalg.qr(np.concatenate(blocks), mode="r")
        return np.pad(r, ((0, width - len(r)), (0, 0)))

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for x in _entries(batch, width):
                centred = scaled(x, n, sums).astype(float) / n
                r = stacked([centred] if r is None else [r, centred])
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([_part()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["part", "x"])

    parts = rows.select("v").mapInArrow(factors, "part long, x array<double>")
    r = merge_tree(parts, lambda found: stacked([x.reshape(width, width) for x in found]).ravel())
    _, s, vectors = np.linalg.svd(r.reshape(width, width))
    s[s <= s.max() * max(n, width) * np.finfo(float).eps] = 0
    shares = (s / s[0]) ** 2 if s[0] else np.full(width, np.nan)
    return Whitening(n, sums, vectors, (s / np.sqrt(n)) ** 2, shares / shares.sum())


def _projected(d: np.ndarray, model: Whitening, k: int) -> np.ndarray:
    return (d.astype(float) / model.n) @ (model.vectors[:k] / np.sqrt(model.values[:k, None])).T


def identity_error(rows: DataFrame, model: Whitening, components: int = COMPONENTS) -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity.

    Over the components of positive eigenvalue among the first ``components``; None without any.
    Tasks keep counts, means and centred products, which merge in a tree.
    """
    k, width = min(components, model.rank), len(model.sums)
    if not k:
        return None

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, gap = a[0] + b[0], b[1 : k + 1] - a[1 : k + 1]
        products = a[k + 1 :] + b[k + 1 :] + (np.outer(gap, gap) * (a[0] * b[0] / n)).ravel()
        return np.concatenate([[n], a[1 : k + 1] + gap * (b[0] / n), products])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in _entries(batch, width):
                w = _projected(scaled(x, model.n, model.sums), model, k)
                mean = w.mean(0)
                own = np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])
                total = own if total is None else joined(total, own)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([_part()], pa.int64()), pa.array([total], pa.list_(pa.float64()))], names=["part", "x"])

    def all_joined(found: list[np.ndarray]) -> np.ndarray:
        total = found[0]
        for x in found[1:]:
            total = joined(total, x)
        return total

    total = merge_tree(rows.select("v").mapInArrow(moments, "part long, x array<double>"), all_joined)
    return float(np.abs(total[k + 1 :].reshape(k, k) / total[0] - np.eye(k)).max())


def transform(rows: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """``id``, ``deviation`` (sum of (n*x - S)^2, null beyond 64 bits) and ``whitened`` of each row.

    ``whitened`` has one entry a component, up to ``components`` or the vectors' width; null
    where the eigenvalue is 0.
    """
    width, k = len(model.sums), min(components, model.rank)
    shown = min(components, width)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _entries(batch, width):
                d = scaled(x, model.n, model.sums)
                w = np.zeros((len(x), shown))
                w[:, :k] = _projected(d, model, k)
                null = np.zeros(w.shape, bool)
                null[:, k:] = True
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * shown, pa.int32()), pa.array(w.ravel(), mask=null.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(deviations(d), pa.int64()), lists], names=["id", "deviation", "whitened"])

    return rows.mapInArrow(apply, "id long, deviation long, whitened array<double>")


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every usable vector, a row each.

    Rows with a null id and repeated rows are answered and counted like others; null vectors
    and those with null or non-finite entries are left out; shorter vectors count as
    filled up with zeros. Components of eigenvalue 0 (as with equal rows) have null for
    ``whitened`` and 0 for ``explained`` (null if all are 0). Equal eigenvalues keep the order
    of the decomposition. No usable rows give none.
    """
    rows = usable(c.table(spark, sf_dir, "embeddings"))
    model = fit(rows)
    error = identity_error(rows, model)
    shares = F.array(*[F.lit(None if np.isnan(x) else float(x)).cast("double") for x in model.shares[:COMPONENTS]]).cast("array<double>")
    each = transform(rows, model).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        F.col("id").alias("vec_id"),
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
