"""Exact order statistics of groups of any size, by rounds of histograms.

A round counts, for each wanted place, the group's rows by bins of the range that still
holds the place; counts combine before they are shuffled, so no task sorts or holds a group.
The bin with the place gives the next range, from its least to its largest value, until one
value is left, or so few rows that they are gathered and sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.sources.files import cut

BINS = 256
#: Rows of a range that are gathered.
FEW = 1024
#: Ranges of up to so many groups and places are sent to all tasks; more are joined.
SENT_ROWS = 100_000


def picks(df: DataFrame, keys: list[str], value: str, at: dict[str, Column]) -> DataFrame:
    """``keys, n`` and the value at each place of ``at`` in a group's order (from 0, by the count ``n``).

    Places are index picks, not interpolations; one outside the group gives null. Null and NaN
    values aren't counted; groups without others have no row. Null keys form a group.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_v"))
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    places = F.array(*[F.struct(F.lit(name).alias("name"), place.cast("long").alias("k")) for name, place in at.items()])
    state = groups.select(*keys, "n", "low", "high", F.explode(places).alias("p")).select(*keys, "n", F.col("p.name").alias("name"), F.col("p.k").alias("k"), "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("c"))
    state = cut(state.withColumn("low", F.when((F.col("k") >= 0) & (F.col("k") < F.col("n")), F.col("low"))))
    columns = [*keys, "n", "name", "low"]
    done, few = [state.where("low IS NULL OR low = high").select(columns)], []
    part = lambda scale: (F.col("_v") / scale - F.col("low") / scale) / (F.col("high") / scale - F.col("low") / scale)
    share = F.when(F.col("high") - F.col("low") < F.lit(float("inf")), part(1)).otherwise(part(2))  # a range may be wider than a double

    def met(ranges: DataFrame) -> DataFrame:
        """The rows in each range."""
        same = [F.col(f"r.{x}").eqNullSafe(F.col(f"s.{x}")) for x in keys]
        side = F.broadcast(ranges) if ranges.count() <= SENT_ROWS else ranges
        held = rows.alias("r").join(side.alias("s"), [*same, F.col("_v") >= F.col("low"), F.col("_v") <= F.col("high")])
        return held.select(*[F.col(f"s.{x}").alias(x) for x in keys], *[F.col(f"s.{x}") for x in ranges.columns if x not in keys], "_v")

    while True:
        few.append(state.where(F.col("low") < F.col("high")).where(F.col("c") <= FEW))
        state = state.where(F.col("low") < F.col("high")).where(F.col("c") > FEW)
        if state.isEmpty():
            break
        bin_ = F.least(F.lit(BINS - 1), F.floor(share * BINS)).alias("bin")
        counted = met(state).select(*keys, "name", "n", "k", "below", bin_, "_v").groupBy(*keys, "name", "n", "k", "below", "bin").agg(F.count("*").alias("c"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        upto = F.sum("c").over(Window.partitionBy(*keys, "name").orderBy("bin")) + F.col("below")  # at most BINS rows
        chosen = counted.withColumn("upto", upto).where((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("c") <= F.col("k")))
        state = cut(chosen.select(*keys, "n", "name", "k", "low", "high", (F.col("upto") - F.col("c")).alias("below"), "c"))
        done.append(state.where("low = high").select(columns))
    small = few[0]
    for x in few[1:]:
        small = small.unionByName(x)
    # A range that several places share is gathered once; it has FEW rows at most.
    wanted = cut(small.groupBy(*keys, "n", "below", "low", "high").agg(F.collect_list(F.struct("name", (F.col("k") - F.col("below")).alias("at"))).alias("places")))
    gathered = met(wanted.drop("places")).groupBy(*keys, "n", "below", "low", "high").agg(F.array_sort(F.collect_list("_v")).alias("all"))
    again = [F.col(f"w.{x}").eqNullSafe(F.col(f"g.{x}")) for x in [*keys, "below"]]
    found = wanted.alias("w").join(gathered.alias("g"), again).select(*[F.col(f"w.{x}").alias(x) for x in keys], "w.n", F.explode("w.places").alias("p"), "g.all")
    found = found.select(*keys, "n", F.col("p.name").alias("name"), F.get("all", F.col("p.at")).alias("low"))
    for x in done:
        found = found.unionByName(x)
    kind = df.schema[value].dataType
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("low"))).cast(kind).alias(name) for name in at])
