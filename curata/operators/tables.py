"""Upserts, snapshots, schema evolution, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def upsert(base: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``base`` with rows of ``incoming`` added or in place of the same key; missing columns are null."""
    new = latest(incoming, keys, order)
    return base.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def backfill(base: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Nulls in ``columns`` of ``base`` filled from ``updates``."""
    u = updates.select(key, *[F.col(x).alias(f"_{x}") for x in columns])
    return base.join(u, key, "left").select(*[F.coalesce(x, f"_{x}").alias(x) if x in columns else F.col(x) for x in base.columns])


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing(df: DataFrame, required: list[str]) -> DataFrame:
    """``column, n_missing``: rows in which a required column is null or, as text, blank."""
    n = [F.sum((F.col(x).isNull() | (F.trim(F.col(x).cast("string")) == "")).cast("long")).alias(x) for x in required]
    pairs = F.array(*[F.struct(F.lit(x).alias("column"), F.coalesce(F.col(x), F.lit(0)).alias("n_missing")) for x in required])
    return df.agg(*n).select(F.explode(pairs).alias("x")).select("x.*")
