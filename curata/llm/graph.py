"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm import common as c


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (``u, v``, longs): root is its component's smallest node.

    Every round groups by node with map-side minima and joins them back; what joins a node
    with very many neighbours goes by broadcast, apart from the rest. Rounds are cut, and end
    when only stars are left. Loops and repeated edges count once; no edges, no rows.
    """
    e = c.cut(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _only_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = c.hot_join(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        e = c.cut(small.where("u <> v").distinct())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _only_stars(e: DataFrame) -> bool:
    """Whether every edge ``u > v`` is its ``u``'s only one and leads to a ``v`` that is no ``u``."""
    ends = e.select(F.col("u").alias("node"), "v").unionByName(e.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("v")))
    seen = ends.groupBy("node").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.max(F.col("v").isNull()).alias("root"))
    return seen.where("least < most OR root AND least IS NOT NULL").agg(F.count("*")).first()[0] == 0
