"""Queries of reports: distributions, quotas, manifests, runs, the monthly tiers, and costs within days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curata.functions import text as tx
from curata.operators import corpus, monthly, selection
from curata.plans.articles import _deal, _list
from curata.plans.queries import Tables, query

_BINS = "CASE WHEN n_chars / 500.0e0 >= 4 THEN '4.0+' WHEN n_chars / 500.0e0 >= 3 THEN '3.0-3.9' WHEN n_chars / 500.0e0 >= 2 THEN '2.0-2.9' ELSE '<2.0' END"
TAGS = ["creatine", "caffeine", "zma", "boron", "maca"]


@query(f"""WITH d AS (SELECT 'source' AS dimension, source AS value FROM documents UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'quality', {_BINS} FROM documents
  UNION ALL SELECT 'tag', unnest([{_list(TAGS)}[doc_id % 5 + 1], {_list(TAGS)}[doc_id % 3 + 1]]) FROM documents)
SELECT dimension, value, CAST(count(*) AS BIGINT) AS n, round(100.0e0 * count(*) / (SELECT count(*) FROM documents), 2) AS share FROM d GROUP BY 1, 2""")
def q_distributions(t: Tables) -> DataFrame:
    """Sources, languages, bins of quality and tags, all in one pass."""
    k = F.col("doc_id")
    quality = tx.bracket(F.col("n_chars") / 500.0, [(4, "4.0+"), (3, "3.0-3.9"), (2, "2.0-2.9")], "<2.0")
    return monthly.distributions(t("documents"), {"source": F.col("source"), "lang": F.col("lang"), "quality": quality, "tag": F.array(_deal(TAGS, k), _deal(TAGS[:3], k))})


@query("""WITH o AS (SELECT doc_id, source, lang, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS a, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS b FROM documents),
r AS (SELECT source, count(*) AS reserved FROM o WHERE a <= 10 OR b <= 2 GROUP BY 1), k AS (SELECT source, count(*) AS kept FROM o WHERE (a <= 10 OR b <= 2) AND n_chars >= 2000 GROUP BY 1)
SELECT coalesce(r.source, k.source) AS source, CAST(coalesce(reserved, 0) AS BIGINT) AS reserved, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CASE WHEN reserved > 0 THEN round(coalesce(kept, 0) / CAST(reserved AS DOUBLE), 4) END AS ratio FROM r FULL JOIN k ON r.source IS NOT DISTINCT FROM k.source""")
def q_quota_report(t: Tables) -> DataFrame:
    """How many of each source's reserved rows were kept."""
    d = t("documents").select("doc_id", "source", "lang", "n_chars")
    ids = corpus.protected_ids(d, "doc_id", "source", "lang", [F.desc("n_chars"), F.asc("doc_id")])
    kept = F.count_if(F.col("n_chars") >= 2000)
    return d.join(ids, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("reserved"), kept.alias("kept"), F.round(kept / F.count("*"), 4).alias("ratio"))


@query("""WITH m AS (SELECT d.doc_id, d.source, length(d.text) AS n, e.vec_id IS NOT NULL AS has_vector, l.quality FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT source, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (has_vector) AS BIGINT) AS with_vector, CAST(count(*) FILTER (coalesce(n, 0) = 0) AS BIGINT) AS empty, CAST(count(*) FILTER (n >= 1200) AS BIGINT) AS full_text, CAST(count(*) FILTER (quality IS NOT NULL AND has_vector) AS BIGINT) AS both,
  CASE WHEN max(CASE WHEN has_vector THEN 2 WHEN quality IS NOT NULL THEN 1 ELSE 0 END) = 2 THEN 'vectors' WHEN max(CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END) = 1 THEN 'labels' ELSE 'none' END AS best, round(100.0e0 * count(*) FILTER (has_vector) / count(*), 2) AS vector_share FROM m GROUP BY 1""")
def q_manifest(t: Tables) -> DataFrame:
    """What there is of each source's documents: vectors, labels, full texts."""
    d = t("documents").select("doc_id", "source", F.length("text").alias("n"))
    m = d.join(t("embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("v")), "doc_id", "left").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    has = F.coalesce("v", F.lit(False))
    labelled = F.col("quality").isNotNull()
    return m.groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(has).alias("with_vector"), F.count_if(F.coalesce("n", F.lit(0)) == 0).alias("empty"), F.count_if(F.coalesce(F.col("n") >= 1200, F.lit(False))).alias("full_text"), F.count_if(labelled & has).alias("both"),
        F.when(F.bool_or(has), "vectors").when(F.bool_or(labelled), "labels").otherwise("none").alias("best"), F.round(100.0 * F.count_if(has) / F.count("*"), 2).alias("vector_share"),
    )


@query("""WITH r AS (SELECT event_type, value, CAST(ts AS DATE) AS day, user_id, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, CAST(max(n) AS BIGINT) AS n, min(value) AS least, max(CASE WHEN k = n // 2 THEN value END) AS median, max(value) AS most, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, CAST(count(DISTINCT user_id) AS BIGINT) AS users, round(max(n) / CAST(count(DISTINCT day) AS DOUBLE), 4) AS per_day FROM r GROUP BY 1""")
def q_run_stats(t: Tables) -> DataFrame:
    """Counts, rates, order statistics and ranges of runs by kind."""
    e = t("events").where(F.col("value").isNotNull())
    order = selection.picks(e, ["event_type"], "value", {"least": F.lit(0), "median": F.floor(F.col("n") / 2), "most": F.col("n") - 1})
    day = F.to_date("ts")
    rest = e.groupBy("event_type").agg(F.min(day).cast("string").alias("first_day"), F.max(day).cast("string").alias("last_day"), F.count_distinct("user_id").alias("users"), F.count_distinct(day).alias("days"))
    return order.join(rest, "event_type").select("event_type", "n", "least", "median", "most", "first_day", "last_day", "users", F.round(F.col("n") / F.col("days"), 4).alias("per_day"))


_MONTH = f"""p AS (SELECT doc_id, list_distinct([{_list(TAGS)}[doc_id % 5 + 1], {_list(TAGS)}[doc_id % 3 + 1]]) AS tags, (doc_id * 37 % 50) / 10.0e0 AS q, {_list(["meta-analysis", "RCT", "other", "cohort", "RCT", "other", "review"])}[doc_id % 7 + 1] AS study, doc_id * 7 % 365 AS d FROM documents),
old AS (SELECT {_list(TAGS[:4])}[doc_id % 4 + 1] AS tag, (doc_id * 13 % 50) / 10.0e0 AS q FROM documents WHERE doc_id % 4 < 2 OR doc_id % 40 = 2 OR doc_id % 4 = 3), r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY q) - 1 AS k, count(*) OVER (PARTITION BY tag) AS n FROM old),
th AS (SELECT tag, max(n) AS n, CASE WHEN max(n) < 100 THEN greatest(1.5e0, round(max(CASE WHEN k = n // 4 THEN q END), 2)) ELSE greatest(2.0e0, round(max(CASE WHEN k = n // 2 THEN q END), 2)) END AS threshold FROM r GROUP BY 1)"""


@query(f"""WITH {_MONTH}, e AS (SELECT doc_id, q, d, unnest(tags) AS tag FROM p), j AS (SELECT e.*, n, coalesce(threshold, 1.5e0) AS threshold FROM e LEFT JOIN th USING (tag)),
f AS (SELECT DISTINCT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY d DESC, doc_id DESC) AS place FROM j WHERE q >= 2.5) WHERE place <= CASE WHEN n >= 100 THEN 10 ELSE 2 END),
m AS (SELECT doc_id, string_agg(tag, ',' ORDER BY tag) AS met FROM j WHERE q >= threshold GROUP BY 1),
x AS (SELECT p.*, met, CASE WHEN study IN ('meta-analysis', 'systematic_review') OR q >= 4.5 OR f.doc_id IS NOT NULL THEN 1 WHEN met IS NOT NULL THEN 2 ELSE 3 END AS tier FROM p LEFT JOIN f ON f.doc_id = p.doc_id LEFT JOIN m ON m.doc_id = p.doc_id)
SELECT doc_id, tier, CASE tier WHEN 1 THEN array_to_string(list_sort(tags), ',') WHEN 2 THEN met ELSE '' END AS tags FROM x""")
def q_monthly_tiers(t: Tables) -> DataFrame:
    """What a month's papers add, by thresholds of each tag's earlier papers."""
    d, k = t("documents"), F.col("doc_id")
    papers = d.select("doc_id", F.array(_deal(TAGS, k), _deal(TAGS[:3], k)).alias("tags"), (k * 37 % 50 / 10.0).alias("q"), _deal(["meta-analysis", "RCT", "other", "cohort", "RCT", "other", "review"], k).alias("study"), (k * 7 % 365).alias("d"))
    old = d.where("doc_id % 4 < 2 OR doc_id % 40 = 2 OR doc_id % 4 = 3").select(_deal(TAGS[:4], k).alias("tag"), (k * 13 % 50 / 10.0).alias("q"))
    s = selection.picks(old, ["tag"], "q", {"p25": F.floor(F.col("n") / 4), "p50": F.floor(F.col("n") / 2)})
    limits = s.select("tag", "n", F.when(F.col("n") < 100, F.greatest(F.lit(1.5), F.round("p25", 2))).otherwise(F.greatest(F.lit(2.0), F.round("p50", 2))).alias("threshold"))
    tiers = monthly.three_tiers(papers, limits, "doc_id", "tags", "q", "study", "d")
    return tiers.select("doc_id", "tier", F.array_join("tags", ",").alias("tags"))


@query("""WITH e AS (SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, ts, CAST(round_even(coalesce(value, 0) * 100, 0) AS BIGINT) AS cost FROM events), s AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM e)
SELECT event_id, day, CAST(spent AS BIGINT) AS spent, spent <= 250000 AS admitted FROM s""")
def q_cost_breaker(t: Tables) -> DataFrame:
    """Which uses of a day are admitted before its cost is over a limit."""
    e = t("events").select("event_id", F.to_date("ts").cast("string").alias("day"), "ts", F.bround(F.coalesce("value", F.lit(0.0)) * 100).cast("long").alias("cost"))
    return monthly.breaker(e, "day", ["ts", "event_id"], "cost", 250000).select("event_id", "day", "spent", "admitted")


@query(f"""WITH e AS (SELECT doc_id, lang, source, n_chars, unnest(list_distinct([{_list(TAGS)}[doc_id % 5 + 1], {_list(TAGS)}[doc_id % 3 + 1]])) AS tag FROM documents), c AS (SELECT tag, lang || ' ' || source AS title, max(n_chars) AS best FROM e GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY best DESC, title) AS place FROM c) SELECT tag, CAST(place AS INTEGER) AS place, title, best FROM k WHERE place <= 3""")
def q_citations(t: Tables) -> DataFrame:
    """The three best titles of each tag, each once."""
    k = F.col("doc_id")
    each = t("documents").select(F.concat_ws(" ", "lang", "source").alias("title"), "n_chars", F.explode(F.array_distinct(F.array(_deal(TAGS, k), _deal(TAGS[:3], k)))).alias("tag"))
    once = each.groupBy("tag", "title").agg(F.max("n_chars").alias("best"))
    place = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("best"), "title"))
    return once.withColumn("place", place).where(F.col("place") <= 3).select("tag", "place", "title", "best")
