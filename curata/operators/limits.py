"""Quotas whose period begins anew with the first use after it has run out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curata.sources.files import cut


def periods(uses: DataFrame, user: str, ts: str, days: int = 30) -> DataFrame:
    """``user, start`` of every period: the first use, then the first one more than ``days`` after a start.

    One round a period: each joins the latest starts with the uses and takes the least later time,
    combined before the shuffle, so rounds grow with the span of time, not with uses. Each is cut.
    Rows with a null user or time have no period.
    """
    known = cut(uses.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).select(user, ts))
    last = cut(known.groupBy(user).agg(F.min(ts).alias("start")))
    rounds = [last]
    while not last.isEmpty():
        later = known.join(last, user).where(F.col(ts) > F.col("start") + F.make_dt_interval(F.lit(days)))
        last = cut(later.groupBy(user).agg(F.min(ts).alias("start")))
        rounds.append(last)
    return reduce(DataFrame.unionByName, rounds)


def admitted(uses: DataFrame, user: str, ts: str, key: str, limit: int, days: int = 30) -> DataFrame:
    """``key, user, period, used``: the first ``limit`` uses of each period, which are allowed; all others are not.

    Ties in time go to the smaller ``key``. Only the first ``limit`` of each group leave their task.
    """
    starts = periods(uses, user, ts, days).groupBy(user).agg(F.array_sort(F.collect_list("start")).alias("starts"))
    dealt = uses.select(key, user, ts).join(starts, user)
    dealt = dealt.select(key, user, ts, F.size(F.filter("starts", lambda s: s <= F.col(ts))).alias("period")).where("period > 0")
    used = F.row_number().over(Window.partitionBy(user, "period").orderBy(ts, key))
    return dealt.select(key, user, "period", used.alias("used")).where(F.col("used") <= limit)
