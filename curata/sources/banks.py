"""Banks of grades as JSON: written as one object, read in any of their shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields that hold the entries, if the entries aren't the object itself.
INSIDE = ["evidence_data", "level1", "bank"]
SHAPE = "map<string,variant>"


def load(banks: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep, goal, supplement, grade, score``: the entries of each bank's JSON.

    Entries are keyed ``goal:supplement``, at the first colon, or by goal and then supplement, in the object or in one of
    ``INSIDE``. A grade that is none of A to F is D, as is an absent one; a score that is no number is null. What isn't
    JSON, or no object, has no entries. Of several shapes of one entry each gives a row.
    """
    v = F.try_parse_json(F.col(text))
    held = F.coalesce(*[F.try_variant_get("_v", f"$.{x}", SHAPE) for x in INSIDE], F.try_variant_get("_v", "$", SHAPE))
    outer = banks.select(*keep, v.alias("_v")).select(*keep, F.explode(held).alias("_key", "_entry"))
    parts = F.split("_key", ":", 2)
    flat = F.create_map(F.get(parts, F.lit(1)), F.col("_entry"))
    nested = F.try_variant_get("_entry", "$", SHAPE)
    inner = outer.select(*keep, F.get(parts, F.lit(0)).alias("goal"), F.explode(F.when(F.size(parts) == 2, flat).otherwise(nested)).alias("supplement", "_entry"))
    grade = F.try_variant_get("_entry", "$.grade", "string")
    return inner.select(*keep, "goal", "supplement", F.when(grade.isin("A", "B", "C", "D", "F"), grade).otherwise("D").alias("grade"), F.try_variant_get("_entry", "$.score", "double").alias("score"))


def write(entries: DataFrame, keys: list[str], nested: bool = False) -> DataFrame:
    """``keys, bank``: one JSON object of the entries (goal, supplement, grade, score) of each group, keyed by both or by goal first.

    A bank has as many entries as there are goals and supplements; they are unique.
    """
    entry = F.struct("grade", "score")
    if not nested:
        pairs = F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "goal", "supplement").alias("k"), entry.alias("v"))))
        return entries.groupBy(*keys).agg(F.to_json(pairs).alias("bank"))
    by_goal = entries.groupBy(*keys, "goal").agg(F.map_from_entries(F.collect_list(F.struct("supplement", entry.alias("v")))).alias("m"))
    whole = by_goal.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("goal", "m"))).alias("m"))
    return whole.select(*keys, F.to_json(F.struct(F.col("m").alias("evidence_data"))).alias("bank"))
