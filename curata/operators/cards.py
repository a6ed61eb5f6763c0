"""Checks of evidence cards, and their statistics over a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALID, HIGH, EXCELLENT = 0.60, 0.80, 0.90


def _filled(*columns: str) -> Column:
    out = F.lit(True)
    for x in columns:
        out = out & F.coalesce(F.trim(F.col(x).cast("string")) != "", F.lit(False))
    return out


def checks() -> list[tuple[str, float, Column]]:
    """What a card should hold, the weight of it, and whether it does."""
    effect = F.exists(F.coalesce("effects", F.array().cast("array<struct<value:double,p_value:double>>")), lambda e: e["value"].isNotNull() & e["p_value"].isNotNull())
    return [
        ("population_size", 0.20, F.col("population_size").isNotNull()),
        ("dose_g_per_day", 0.20, F.col("dose").isNotNull()),
        ("duration_weeks", 0.15, F.col("weeks").isNotNull()),
        ("effect_sizes_with_p_values", 0.25, effect),
        ("safety_information", 0.10, F.coalesce("has_safety", F.lit(False))),
        ("complete_metadata", 0.10, _filled("title", "journal", "year", "pmid")),
    ]


def checked(cards: DataFrame) -> DataFrame:
    """``cards`` with ``score`` (0 to 1), ``is_valid`` and ``missing``, the names of failed checks in order."""
    all_of = checks()
    score = sum((F.when(ok, weight).otherwise(0.0) for _, weight, ok in all_of[1:]), F.when(all_of[0][2], all_of[0][1]).otherwise(0.0))
    missing = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, _, ok in all_of]))
    return cards.withColumn("score", score).withColumn("is_valid", F.col("score") >= VALID).withColumn("missing", missing)


def batch(checked: DataFrame) -> DataFrame:
    """One row: counts by score, the average, and how many cards lack each field (``field:count``, by name)."""
    s, n = F.col("score"), F.count_if
    lacks = [n(F.array_contains("missing", name)).alias(f"lacks_{name}") for name, *_ in checks()]
    parts = F.array(*[F.when(F.col(f"lacks_{name}") > 0, F.concat_ws(":", F.lit(name), f"lacks_{name}")) for name in sorted(x for x, *_ in checks())])
    out = checked.agg(
        F.count("*").alias("total"), n(s >= VALID).alias("valid"), n(s >= HIGH).alias("high"), F.round(F.avg("score"), 6).alias("average"), n(s >= EXCELLENT).alias("excellent"),
        n((s >= HIGH) & (s < EXCELLENT)).alias("good"), n((s >= VALID) & (s < HIGH)).alias("fair"), n(s < VALID).alias("poor"), *lacks,
    )
    return out.select("total", "valid", "high", "average", "excellent", "good", "fair", "poor", F.array_join(F.array_compact(parts), ",").alias("missing"))
