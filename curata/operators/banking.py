"""Grades of every goal and item from its papers: counts, quality, consistency, publications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words in the outcomes of a paper that speak for or against.
POSITIVE = ["improved", "increased", "enhanced", "beneficial", "positive"]
NEGATIVE = ["decreased", "worsened", "negative", "harmful", "adverse"]


def polarity(outcomes: Column) -> Column:
    """1, -1 or 0 by the first list of words that is met; null is 0."""
    x = F.lower(F.coalesce(outcomes, F.lit("")))
    return F.when(x.rlike("|".join(POSITIVE)), 1).when(x.rlike("|".join(NEGATIVE)), -1).otherwise(0)


def consistency(up: Column, down: Column, n: Column) -> Column:
    """The larger side's share of all papers, half if both are equal, 1 for fewer than two papers."""
    return F.when(n < 2, 1.0).when(up > down, up / n).when(down > up, down / n).otherwise(0.5)


def count_grade(metas: Column, trials: Column, n: Column) -> Column:
    """A grade from counts of study types alone: B, C or D."""
    return F.when((metas >= 1) & (n >= 3), "B").when((trials >= 2) | (metas >= 1) | (n >= 2), "C").otherwise("D")


def level_one(papers: DataFrame, grid: DataFrame, keys: list[str], paper_id: str, top: int = 3) -> DataFrame:
    """A row for each row of ``grid`` (distinct ``keys``): counts, averages, consistency, grade, publications.

    ``papers`` has ``keys``, the id, ``study``, ``outcomes``, ``quality``, ``reliability``
    and ``title``. Rows of the grid without papers get D and zeros. Publications are the ``top``
    titled papers by quality, ties to the smaller id, comma-joined; only the first of each group
    leave their task. Null scores count as 0, as do null outcomes as neutral.
    """
    study = F.lower(F.coalesce("study", F.lit("")))
    n, up, down = F.col("n_papers"), F.col("n_up"), F.col("n_down")
    found = papers.withColumn("way", polarity(F.col("outcomes"))).groupBy(*keys).agg(
        F.count("*").alias("n_papers"), F.count_if(study.contains("meta")).alias("n_meta"), F.count_if(study.contains("rct") | study.contains("randomized")).alias("n_rct"), F.count_if(F.col("way") == 1).alias("n_up"),
        F.count_if(F.col("way") == -1).alias("n_down"), F.avg(F.coalesce("quality", F.lit(0.0))).alias("avg_quality"), F.avg(F.coalesce("reliability", F.lit(0.0))).alias("avg_reliability"),
    )
    found = found.withColumn("consistency", consistency(up, down, n)).withColumn("grade", count_grade(F.col("n_meta"), F.col("n_rct"), n))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("quality"), paper_id))
    best = papers.where(F.trim("title") != "").select(*keys, paper_id, "quality", place.alias("place")).where(F.col("place") <= top)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", paper_id))), lambda x: x[paper_id].cast("string"))
    refs = best.groupBy(*keys).agg(F.array_join(listed, ",").alias("publications"))
    zero = [F.coalesce(x, F.lit(0).cast("bigint")).alias(x) for x in ("n_papers", "n_meta", "n_rct", "n_up", "n_down")]
    share = [F.coalesce(x, F.lit(0.0)).alias(x) for x in ("avg_quality", "avg_reliability", "consistency")]
    out = grid.join(found, keys, "left").join(refs, keys, "left")
    return out.select(*keys, *zero, *share, F.coalesce("grade", F.lit("D")).alias("grade"), F.coalesce("publications", F.lit("")).alias("publications"))
