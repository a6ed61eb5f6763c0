"""Shared pieces: table access, cut lineage, and numpy text kernels.

The kernels work on the UTF-8 buffer of an Arrow string column, a bounded slice
of it at a time, so that a task's memory depends on the slice and on the longest
single text, never on the partition.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a kernel takes at a time (a longer single text is taken whole).
SLICE_BYTES = 1 << 20
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one of our own only where unset and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="curata-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: For tables with rows of some MB: Parquet's row groups of about 8 MB, measured after each row, not only after 100.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4"}


def cut(df: DataFrame, large_rows: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Later stages then depend on files that outlive any executor, not on lineage. Writers and
    readers hold a row group at a time: with ``large_rows``, few rows, whatever a task has of them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/curata-{uuid.uuid4().hex}"
    df.write.options(**(LARGE_ROWS if large_rows else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column has it (names differ by more than case)."""
    taken = {x.lower() for x in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key is hot with more than one in ``HOT_PART`` rows, so fewer than that many keys are.
HOT_PART = 1000


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left.join(right, key, how)`` (inner or left) where keys of ``left`` may be very frequent.

    ``right`` has one row a key, of bounded size. Hot keys and null ones meet a broadcast of
    their fewer than ``HOT_PART`` rows of ``right``; the others are shuffled. ``left`` is read
    three times: cut it before if it is costly.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = left.count()
    hot = counts.where((F.col("n") > total / HOT_PART) & (F.col("n") > 1)).select(key)
    if hot.isEmpty():
        return left.join(right, key, how)
    hot = cut(hot)
    near = F.broadcast(right.join(F.broadcast(hot), key))
    mark = unused([*left.columns, *right.columns], "is_hot")
    marked = left.join(F.broadcast(hot.withColumn(mark, F.lit(True))), key, "left")
    many = marked.where(F.col(mark) | F.col(key).isNull()).drop(mark).join(near, key, how)
    few = marked.where(F.col(mark).isNull() & F.col(key).isNotNull()).drop(mark).join(right, key, how)
    return many.unionByName(few)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit words."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


mix = _mix
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        _powers[:] = [
            np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)]), dtype=U64)
            for b in (_BASE, _INVERSE)
        ]
    return _powers[0][:n], _powers[1][:n]


def byte_values(seed: int) -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D) + U64(seed))


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()


@functools.cache
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def release() -> None:
    """Give freed memory back to the system: a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of about ``limit`` text bytes."""
    _, offsets = utf8(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        yield batch.slice(row, end - row)
        row = end
    release()


def spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of True inside each row."""
    n = len(is_word)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = offsets[(offsets > 0) & (offsets < n)]
    before = np.concatenate([[False], is_word[:-1]])
    before[edge] = False
    after = np.concatenate([is_word[1:], [False]])
    after[edge - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    rows = np.searchsorted(offsets[:-1], starts, "right") - 1
    return starts, ends, rows


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A mixed 64-bit polynomial hash of each non-empty span; equal bytes, equal hash."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    ahead, back = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(values[data] * ahead[:-1], out=total[1:])
    return _mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(U64))


def row_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


#: Words split at the ASCII white space codes 0x20 and 0x09-0x0D.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Words of digits, letters a-z and everything above ASCII, after lower-casing A-Z.
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x61:0x7B] = ALNUM_WORD[0x80:] = True
