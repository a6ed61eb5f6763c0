"""Bundles of a paper's sections within a budget of characters, the most telling chunks first."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.operators import tagging

# Sections in the order in which they are taken, what words and signs of numbers add to a chunk's score, and the budget.
SECTIONS = ["abstract", "results", "methods", "complications", "discussion"]
WORDS = {
    "sample size": 5, "n=": 5, "participants": 4, "subjects": 4, "dose": 5, "mg": 4, "grams": 4, "supplementation": 4, "intervention": 4, "adverse events": 4, "side effects": 4, "safety": 3, "contraindications": 3,
    "results": 3, "findings": 3, "outcomes": 3, "efficacy": 3, "effectiveness": 3, "statistical significance": 3, "p-value": 3, "confidence interval": 3, "significant": 2, "improvement": 2, "increase": 2, "decrease": 2,
    "method": 2, "procedure": 2, "protocol": 2, "study design": 2, "conclusion": 2, "discussion": 1, "background": 1, "introduction": 1,
}
STATISTICS = ["mean", "sd", "std", "median", "range", "ci", "or", "rr", "hr"]
NUMBER, EACH, MOST_NUMBERS, BUDGET, BETWEEN = r"\d+\.?\d*", 0.5, 3.0, 16000, 2


def scored(chunks: DataFrame, text: str, name: str = "score") -> DataFrame:
    """``chunks`` with what words, numbers and terms of statistics their texts hold; each word counts once. A null text has 0."""
    tables = {"w": {w: [re.escape(w)] for w in WORDS}, "s": {w: [re.escape(w)] for w in STATISTICS}}
    found = tagging.found(chunks, text, tables, "_found")
    weight = F.create_map(*[F.lit(x) for w, n in WORDS.items() for x in (f"w|{w}", float(n))], *[F.lit(x) for w in STATISTICS for x in (f"s|{w}", 1.0)])
    words = F.aggregate("_found", F.lit(0.0), lambda a, x: a + F.element_at(weight, x))
    numbers = F.least(F.coalesce(F.regexp_count(text, F.lit(NUMBER)), F.lit(0)) * EACH, F.lit(MOST_NUMBERS))
    return found.withColumn(name, words + numbers).drop("_found")


def bundled(chunks: DataFrame, key: str, section: str, place: str, text: str, most: int = BUDGET) -> DataFrame:
    """``key, section, places, char_len, input_hash``: the chunks of each section that a paper's bundle keeps.

    Sections are taken in order. One that fits what is left of ``most`` characters (its chunks joined by an empty line) is kept
    whole, its chunks by place. Of one that doesn't, chunks are taken by falling score, then place, until the first
    that doesn't fit; when nothing is left, sections have none. The hash is of key, kept places and lengths. Only
    places, lengths and scores meet by paper, not texts; other sections and null texts are left out. ``place`` is a number,
    unique in a paper.
    """
    of = F.create_map(*[F.lit(x) for k, s in enumerate(SECTIONS) for x in (s, k)])
    rows = scored(chunks.where(F.col(section).isin(SECTIONS) & F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.element_at(of, F.col(section)).alias("_at"), F.col(place).cast("long").alias("_place"), F.col(text).alias("_text")), "_text", "_score")
    each = rows.groupBy("_key", "_at").agg(
        F.sum(F.length("_text")).alias("_size"),
        F.array_sort(F.collect_list(F.struct((-F.col("_score")).alias("s"), F.col("_place").alias("p"), F.length("_text").alias("n")))).alias("_chunks"),
    )
    joined = lambda size, n: size + BETWEEN * F.greatest(n - 1, F.lit(0))
    each = each.select("_key", F.struct(F.col("_at").alias("at"), joined(F.col("_size"), F.size("_chunks")).cast("long").alias("size"), F.col("_chunks").alias("chunks")).alias("_s"))
    papers = each.groupBy("_key").agg(F.array_sort(F.collect_list("_s")).alias("_all"))  # five sections at most
    kept = "array<struct<at:int,places:array<bigint>,size:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("over"), F.array().cast(kept).alias("kept"))

    def part(chunks: Column, left: Column) -> Column:
        """The first chunks that fit ``left``: their number and size."""
        begin = F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).alias("n"), F.lit(False).alias("full"))
        more = lambda a, x: a["full"] | (a["size"] + x["n"] > left)
        return F.aggregate(chunks, begin, lambda a, x: F.when(more(a, x), F.struct(a["size"].alias("size"), a["n"].alias("n"), F.lit(True).alias("full"))).otherwise(F.struct((a["size"] + x["n"]).alias("size"), (a["n"] + 1).alias("n"), F.lit(False).alias("full"))))

    def step(a: Column, s: Column) -> Column:
        left = F.lit(most) - a["used"]
        fits = s["size"] <= left
        taken = part(s["chunks"], left)
        whole = F.array_sort(F.transform(s["chunks"], lambda x: x["p"]))
        some = F.transform(F.slice(s["chunks"], 1, F.greatest(taken["n"], F.lit(0))), lambda x: x["p"])
        size = F.when(fits, s["size"]).otherwise(F.when(taken["n"] > 0, joined(taken["size"], taken["n"])).otherwise(0)).cast("long")
        now = F.struct(s["at"].alias("at"), F.when(fits, whole).otherwise(some).alias("places"), size.alias("size"))
        over = a["over"] | (~fits & (left <= 0))
        return F.when(over, F.struct(a["used"].alias("used"), F.lit(True).alias("over"), a["kept"].alias("kept"))).otherwise(F.struct((a["used"] + size).alias("used"), F.lit(False).alias("over"), F.concat(a["kept"], F.array(now)).cast(kept).alias("kept")))

    out = papers.select("_key", F.aggregate("_all", start, step, lambda a: a["kept"]).alias("_kept"))
    lengths = [F.coalesce(F.get(F.filter("_kept", _at(k)), F.lit(0))["size"], F.lit(0)).cast("string") for k in range(len(SECTIONS))]
    ids = F.transform(F.flatten(F.transform("_kept", lambda x: x["places"])), lambda p: p.cast("string"))
    digest = F.sha1(F.array_join(F.concat(F.array(F.col("_key").cast("string")), ids, F.array(*lengths)), "|"))
    rows = out.select("_key", digest.alias("input_hash"), F.explode("_kept").alias("k"))
    names = F.array(*map(F.lit, SECTIONS))
    return rows.select(F.col("_key").alias(key), F.get(names, F.col("k.at")).alias(section), F.col("k.places").alias("places"), F.col("k.size").alias("char_len"), "input_hash")


def _at(k: int) -> Callable[[Column], Column]:
    return lambda x: x["at"] == k
