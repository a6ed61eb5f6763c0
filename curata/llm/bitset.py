"""Fixed-size bit sets of keys, to thin out a large side before it is shuffled.

A set has ``BITS`` bits whatever it holds (4 MB), so sending it to the executors is
bounded. It may say yes to keys that it doesn't hold (to most, if very many are in
it), never no to one that it holds: an exact join follows wherever it is used.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm import common as c

BITS = 1 << 25
_PAGE = 32768


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key.cast("long"), F.lit(77)), F.lit(BITS)) + 1


def pages(keys: DataFrame, key: str) -> DataFrame:
    """At most ``BITS / 32768`` rows: page number and 4 KB of bits."""
    s = keys.select(_slot(F.col(key)).alias("s"))
    return s.groupBy(F.bitmap_bucket_number("s").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))


def collected(keys: DataFrame, key: str) -> np.ndarray:
    """The set as bytes, on the driver."""
    out = np.zeros(BITS // 8, np.uint8)
    for page, bits in pages(keys, key).collect():
        at = (page - 1) * _PAGE // 8
        out[at : at + len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def holds(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether the slots (from ``with_slot``) may be in the set."""
    s = slots - 1
    return (bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1


def with_slot(df: DataFrame, key: str, name: str = "_slot") -> DataFrame:
    return df.withColumn(name, F.coalesce(_slot(F.col(key)), F.lit(1)))


def without(df: DataFrame, drop: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``drop``; only rows that may be in it are shuffled.

    Null keys stay. ``drop`` is cut, as it is read twice.
    """
    own = c.unused(df.columns, "key_")
    drop = c.cut(drop.select(F.col(key).cast("long").alias(own)).where(F.col(own).isNotNull()).distinct())
    page, bits, maybe = (c.unused([*df.columns, own], x) for x in ("page_", "bits_", "maybe_"))
    sent = F.broadcast(pages(drop, own).select(F.col("page").alias(page), F.col("bits").alias(bits)))
    slot = F.coalesce(_slot(F.col(key)), F.lit(1))
    marked = df.withColumn(page, F.bitmap_bucket_number(slot)).join(sent, page, "left")
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held_bit = byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0
    marked = marked.withColumn(maybe, F.coalesce(F.col(key).isNotNull() & F.col(bits).isNotNull() & held_bit, F.lit(False))).select(*df.columns, maybe)
    held = marked.where(F.col(maybe)).join(drop, F.col(key).cast("long") == F.col(own), "left_anti")
    return marked.where(~F.col(maybe)).drop(maybe).unionByName(held.drop(maybe))
