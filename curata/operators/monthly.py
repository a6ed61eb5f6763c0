"""What a month's new papers add: always, by tag thresholds, or not at all; and running totals within days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.sources.files import cut

# Where a tag has many papers, how many of its newest count then and before, their least quality, what always counts, and the least threshold.
MANY, NEWEST_MANY, NEWEST_FEW, NEWEST_QUALITY, EXCEPTIONAL, LEAST = 100, 10, 2, 2.5, 4.5, 1.5
ALWAYS = ["meta-analysis", "systematic_review"]


def three_tiers(papers: DataFrame, thresholds: DataFrame, key: str, tags: str, quality: str, study: str, date: str) -> DataFrame:
    """``key, tier, tags``: tier 1 with all tags, 2 with the tags whose threshold is met, 3 with none.

    Tier 1 are reviews of trials, exceptional quality, and the newest of each tag, by ``date``, then larger
    ``key``, that have the least quality for it. ``thresholds`` has ``tag, n, threshold``; a tag that it lacks has few papers and the least
    threshold. Repeated tags count once; papers without tags are only kept by tier 1. A null quality is 0; ``key`` is unique.
    """
    p = papers.select(F.col(key).alias("_key"), F.array_distinct(F.array_compact(F.coalesce(F.col(tags), F.array().cast("array<string>")))).alias("_tags"), F.coalesce(F.col(quality), F.lit(0.0)).alias("_q"), F.col(study).alias("_s"), F.col(date).alias("_d"))
    each = p.select("_key", "_q", "_d", F.explode("_tags").alias("tag"))
    t = each.join(thresholds.select("tag", "n", "threshold"), "tag", "left")
    room = F.when(F.col("n") >= MANY, NEWEST_MANY).otherwise(NEWEST_FEW)
    newest = Window.partitionBy("tag").orderBy(F.desc("_d"), F.desc("_key"))
    # Only the first few of a tag can be its newest, so its rows are cut down before they are shuffled.
    ranked = t.where(F.col("_q") >= NEWEST_QUALITY).withColumn("_place", F.row_number().over(newest)).where(F.col("_place") <= NEWEST_MANY)
    fresh = ranked.where(F.col("_place") <= room).select("_key").distinct().withColumn("_fresh", F.lit(True))
    met = t.where(F.col("_q") >= F.coalesce("threshold", F.lit(LEAST))).groupBy("_key").agg(F.array_sort(F.collect_list("tag")).alias("_met"))  # a paper's tags
    j = p.join(fresh, "_key", "left").join(met, "_key", "left")
    first = F.coalesce(F.col("_s").isin(ALWAYS), F.lit(False)) | (F.col("_q") >= EXCEPTIONAL) | F.coalesce("_fresh", F.lit(False))
    tier = F.when(first, 1).when(F.size("_met") > 0, 2).otherwise(3)
    kept = F.when(tier == 1, F.array_sort("_tags")).when(tier == 2, F.col("_met")).otherwise(F.array().cast("array<string>"))
    return j.select(F.col("_key").alias(key), tier.alias("tier"), kept.alias("tags"))


def running(df: DataFrame, group: str, order: list[str], amount: str, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows of its group before it in ``order``, which is unique in a group.

    Rows are dealt in ranges of group and order, once; each range sums its own, and takes what the ranges before
    hold, so a group of any size is spread over tasks.
    """
    ranged = cut(df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(df.schema[amount].dataType)
    sums = ranged.groupBy("_part", group).agg(F.sum(amount).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    offsets = sums.select("_part", F.col(group).alias("_group"), F.coalesce(before, zero).alias("_before"))
    joined = ranged.withColumn("_own", F.coalesce(F.sum(amount).over(own), zero)).join(offsets, (ranged["_part"] == offsets["_part"]) & ranged[group].eqNullSafe(offsets["_group"]))
    return joined.select(*[ranged[c] for c in df.columns], (F.col("_own") + F.col("_before")).alias(name))


def breaker(uses: DataFrame, day: str, order: list[str], cost: str, most: int) -> DataFrame:
    """``uses`` with ``spent``, what the day cost before each, and ``admitted``: not more than ``most`` so far.

    Costs are whole units and not negative, so a day that is over its limit stays so, and refused uses change nothing.
    """
    return running(uses, day, order, cost, "spent").withColumn("admitted", F.col("spent") <= most)


def _named(name: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(name).alias("dimension"), x.cast("string").alias("value"))


def distributions(df: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """``dimension, value, n, share``: how often each value of each dimension occurs, in per cent of all rows, in one pass.

    An array counts each of its values; null is a value.
    """
    kinds = dict(df.select(*[c.alias(name) for name, c in dimensions.items()]).dtypes)
    pairs = []
    for name, c in dimensions.items():
        values = c if kinds[name].startswith("array") else F.array(c)
        pairs.append(F.transform(values, _named(name)))
    counted = df.select(F.explode(F.concat(*pairs)).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_total"))
    return counted.crossJoin(F.broadcast(total)).select("dimension", "value", "n", F.round(100.0 * F.col("n") / F.col("_total"), 2).alias("share"))  # one row
