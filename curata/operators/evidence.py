"""Pooling study effects into grades, and personal adjustments of grades."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.functions.text import grade_step


@dataclass(frozen=True)
class GradeConfig:
    """Fixed values of the grading rules."""

    designs: dict[str, float] = field(default_factory=lambda: {"meta_analysis": 1.2, "randomized_controlled_trial": 1.0, "rct": 1.0, "controlled": 0.7, "observational": 0.4, "cohort": 0.4, "case_control": 0.3, "cross_sectional": 0.2})
    other_design: float = 0.5
    least_weight: float = 3.0
    small: float = 0.05
    b: float = 0.25
    a: float = 0.45
    null_band: float = 0.05
    negative: float = 0.10
    fallback: float = 0.35


def study_weight(design: Column, n: Column, cfg: GradeConfig) -> Column:
    """Design weight times ln(1 + n), n a whole number; hyphens count as underscores, no n as zero."""
    name = F.replace(F.lower(F.coalesce(design, F.lit(""))), F.lit("-"), F.lit("_"))
    base = F.lit(cfg.other_design)
    for k, v in cfg.designs.items():
        base = F.when(name == k, F.lit(v)).otherwise(base)
    return base * F.log1p(F.floor(F.greatest(F.coalesce(n, F.lit(0)), F.lit(0))).cast("double"))


def effect_value(effect: Column, direction: Column, cfg: GradeConfig) -> Column:
    """The effect, else a value for its direction, within -1 and 1; null if neither is known."""
    d = F.lower(direction)
    known = F.when(d == "increase", cfg.fallback).when(d == "decrease", -cfg.fallback).when(d.isin("no_effect", "uncertain"), 0.0)
    value = F.coalesce(effect, known)
    return F.when(value.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def pool(df: DataFrame, keys: list[str], cfg: GradeConfig = GradeConfig(), refs: int = 10) -> DataFrame:
    """One row per group of ``design, n, effect, direction, paper_id``: pooled effect, consistency, grade.

    Sums of weights by sign come along with the pooled sum, so consistency needs no
    second pass. ``top_refs`` are the smallest paper ids, joined. A group with fewer than
    two usable effects, or none, has grade D and no refs.
    """
    e = df.withColumn("_w", study_weight(F.col("design"), F.col("n"), cfg)).withColumn("_e", effect_value(F.col("effect"), F.col("direction"), cfg))
    part = lambda c: F.sum(F.when(c, F.col("_w")).otherwise(0.0))
    g = e.groupBy(*keys).agg(part(F.col("_e").isNotNull()).alias("w"), F.coalesce(F.sum(F.col("_w") * F.col("_e")), F.lit(0.0)).alias("we"), part(F.col("_e") > 0).alias("up"), part(F.col("_e") < 0).alias("down"), F.count("_e").alias("n_effects"))
    few = (F.col("w") <= 0) | (F.col("n_effects") < 2)
    pooled = F.when(few, 0.0).otherwise(F.col("we") / F.col("w"))
    same = F.when(few, 0.0).when(pooled > 0, F.col("up") / F.col("w")).when(pooled < 0, F.col("down") / F.col("w")).otherwise(0.5)
    g = g.withColumn("pooled_effect", pooled).withColumn("consistency", same)
    confidence = F.least(F.lit(1.0), F.lit(0.35) + 0.4 * (F.col("w") / (cfg.least_weight + 1e-9)) + 0.25 * F.col("consistency"))
    size, steady = F.abs("pooled_effect"), F.col("consistency") >= 0.6
    grade = (
        F.when(few | (F.col("w") < cfg.least_weight), "D")
        .when(steady & ((size < cfg.null_band) | (F.col("pooled_effect") <= -cfg.negative)), "F")
        .when((size >= cfg.a) & (confidence >= 0.7), "A")
        .when((size >= cfg.b) & (confidence >= 0.5), "B")
        .when(((size >= cfg.small) & (size < 0.15)) | ((size >= 0.15) & ~steady), "C")
        .otherwise("D")
    )
    ids = e.where("_e IS NOT NULL").select(*keys, "paper_id").distinct().withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("paper_id"))).where(F.col("_k") <= refs)
    top = ids.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("paper_id")), lambda x: x.cast("string")), ",").alias("top_refs"))
    out = g.select(*keys, "n_effects", F.round("w", 6).alias("weight"), F.round("pooled_effect", 6).alias("pooled_effect"), F.round("consistency", 6).alias("consistency"), F.round(confidence, 6).alias("confidence"), grade.alias("grade"), few.alias("_few"))
    return out.join(top, keys, "left").withColumn("top_refs", F.when(~F.col("_few"), F.col("top_refs"))).drop("_few")


def adjust_grades(items: DataFrame, rules: DataFrame, grade: str = "grade") -> DataFrame:
    """Apply matching rules (``item_key, severity, message``, one row per match) to ``items``.

    A hard stop gives F; any caution lowers a grade by one step. Messages are joined in order.
    """
    per = rules.groupBy("item_key").agg(F.max((F.col("severity") == "hard_stop").cast("int")).alias("hard"), F.max((F.col("severity") == "caution").cast("int")).alias("soft"), F.array_join(F.array_sort(F.collect_set("message")), "; ").alias("reasons"))
    out = items.join(per, "item_key", "left")
    adjusted = F.when(F.col("hard") == 1, "F").when(F.col("soft") == 1, grade_step(F.col(grade), F.lit(1))).otherwise(F.col(grade))
    verdict = F.when(F.col("hard") == 1, "Avoid").when(F.col("soft") == 1, "Caution").otherwise("OK")
    return out.withColumn("adjusted", adjusted).withColumn("verdict", verdict).withColumn("reasons", F.coalesce("reasons", F.lit(""))).drop("hard", "soft")
