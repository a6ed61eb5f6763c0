"""Registered queries of the curation engine, each beside the SQL that gives its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curata.functions import text as tx
from curata.operators import chunks, corpus, evidence, search, selection, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Tables = Callable[[str], DataFrame]


def query(sql: str | None = None):
    """Register a function of a table reader under its name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _cards(t: Tables) -> DataFrame:
    part = t("part").select("p_partkey", "p_brand")
    line = t("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return line.select(
        F.col("p_brand").alias("supplement"), F.col("l_returnflag").alias("goal"),
        F.when(F.col("l_linenumber") == 1, "rct").when(F.col("l_linenumber") == 2, "meta-analysis").when(F.col("l_linenumber") == 3, "cohort").otherwise("other").alias("design"),
        F.col("l_quantity").alias("n"), F.when(F.col("l_linenumber") % 2 == 1, F.col("l_discount") * 8).alias("effect"),
        F.when(F.col("l_linestatus") == "O", "increase").when(F.col("l_tax") < 0.03, "decrease").when(F.col("l_tax") < 0.06, "no_effect").alias("direction"), F.col("l_orderkey").alias("paper_id"),
    )


_CARDS = """cards AS (
  SELECT p_brand AS supplement, l_returnflag AS goal, CASE l_linenumber WHEN 1 THEN 1.0 WHEN 2 THEN 1.2 WHEN 3 THEN 0.4 ELSE 0.5 END * ln(1 + l_quantity) AS w,
    greatest(-1.0, least(1.0, coalesce(CASE WHEN l_linenumber % 2 = 1 THEN l_discount * 8 END, CASE WHEN l_linestatus = 'O' THEN 0.35 WHEN l_tax < 0.03 THEN -0.35 WHEN l_tax < 0.06 THEN 0.0 END))) AS e0,
    (l_linenumber % 2 = 1 AND l_discount IS NOT NULL) OR l_linestatus = 'O' OR l_tax < 0.06 AS known, l_orderkey AS paper_id
  FROM lineitem JOIN part ON l_partkey = p_partkey
), eff AS (SELECT supplement, goal, w, CAST(e0 AS DOUBLE) AS e, paper_id FROM cards WHERE known)"""


@query(f"""WITH {_CARDS}, g AS (
  SELECT supplement, goal, CAST(count(*) FILTER (WHERE known) AS BIGINT) AS n_effects, coalesce(sum(w) FILTER (WHERE known), 0.0) AS w, coalesce(sum(w * e0) FILTER (WHERE known), 0.0) AS we, coalesce(sum(w) FILTER (WHERE known AND e0 > 0), 0.0) AS up, coalesce(sum(w) FILTER (WHERE known AND e0 < 0), 0.0) AS down FROM cards GROUP BY 1, 2
), p AS (SELECT *, CASE WHEN w <= 0 OR n_effects < 2 THEN 0.0 ELSE we / w END AS pe FROM g
), s AS (SELECT *, CASE WHEN w <= 0 OR n_effects < 2 THEN 0.0 WHEN pe > 0 THEN up / w WHEN pe < 0 THEN down / w ELSE 0.5 END AS s FROM p
), c AS (SELECT *, least(1.0, 0.35 + 0.4 * (w / (3.0 + 1e-9)) + 0.25 * s) AS c FROM s
), r AS (SELECT supplement, goal, paper_id, row_number() OVER (PARTITION BY supplement, goal ORDER BY paper_id) AS k FROM (SELECT DISTINCT supplement, goal, paper_id FROM eff)
), refs AS (SELECT supplement, goal, string_agg(CAST(paper_id AS VARCHAR), ',' ORDER BY paper_id) AS top_refs FROM r WHERE k <= 10 GROUP BY 1, 2)
SELECT c.supplement, c.goal, n_effects, round(w, 6) AS weight, round(pe, 6) AS pooled_effect, round(s, 6) AS consistency, round(c, 6) AS confidence,
  CASE WHEN w <= 0 OR n_effects < 2 OR w < 3.0 THEN 'D' WHEN s >= 0.6 AND (abs(pe) < 0.05 OR pe <= -0.10) THEN 'F' WHEN abs(pe) >= 0.45 AND c >= 0.7 THEN 'A' WHEN abs(pe) >= 0.25 AND c >= 0.5 THEN 'B'
    WHEN (abs(pe) >= 0.05 AND abs(pe) < 0.15) OR (abs(pe) >= 0.15 AND s < 0.6) THEN 'C' ELSE 'D' END AS grade, CASE WHEN w > 0 AND n_effects >= 2 THEN top_refs END AS top_refs
FROM c LEFT JOIN refs USING (supplement, goal)""")
def q_pooled_grades(t: Tables) -> DataFrame:
    return evidence.pool(_cards(t), ["supplement", "goal"])


@query("""WITH d AS (SELECT doc_id, text, greatest(1, CAST(ceil((length(text) - 200) / 2200.0) AS INTEGER)) AS n FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, text, unnest(range(0, n)) * 2200 AS s FROM d)
SELECT doc_id, CAST(s AS BIGINT) AS start, CAST(least(s + 2400, length(text)) AS BIGINT) AS "end", CAST(length(substr(text, s + 1, 2400)) AS BIGINT) AS size,
  substr(sha256(doc_id || '|' || s || '|' || substr(substr(text, s + 1, 2400), 1, 64)), 1, 16) AS chunk_id FROM w""")
def q_chunk_windows(t: Tables) -> DataFrame:
    w = chunks.windows(t("documents"), "text", 2400, 200, ["doc_id"])
    key = F.substring(F.sha2(F.concat_ws("|", "doc_id", "start", F.substring("chunk", 1, 64)), 256), 1, 16)
    return w.select("doc_id", "start", "end", F.length("chunk").cast("long").alias("size"), key.alias("chunk_id"))


_FAMILIES = {"alpha": ["(?i)password", "(?i)secret"], "beta": ["@"], "gamma": ["[0-9]{3}"], "delta": ["\\|"]}


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)password|(?i)secret') THEN 'alpha' END, CASE WHEN regexp_matches(text, '@') THEN 'beta' END,
  CASE WHEN regexp_matches(text, '[|]') THEN 'delta' END, CASE WHEN regexp_matches(text, '[0-9]{3}') THEN 'gamma' END], lambda x: x IS NOT NULL), ',') AS tags FROM documents""")
def q_tags(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.array_join(tx.tags(F.col("text"), _FAMILIES), ",").alias("tags"))


@query("""SELECT doc_id, list_max(list_transform(regexp_extract_all(text, '([0-9]{1,6})', 1), lambda x: CAST(x AS BIGINT))) AS largest,
  CAST(len(regexp_extract_all(text, '[0-9]+%')) AS BIGINT) AS n_percent, CASE WHEN regexp_matches(text, '^[A-Z]') THEN 'capital' WHEN regexp_matches(text, '^[a-z]') THEN 'small' ELSE 'other' END AS kind,
  CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS n_the FROM documents""")
def q_extraction(t: Tables) -> DataFrame:
    x = F.col("text")
    return t("documents").select(
        "doc_id", tx.largest_number(x, ["([0-9]{1,6})"]).alias("largest"), F.size(F.regexp_extract_all(x, F.lit("[0-9]+%"), F.lit(0))).cast("long").alias("n_percent"),
        tx.first_match(x, [("^[A-Z]", "capital"), ("^[a-z]", "small")], "other").alias("kind"), tx.occurrences(x, F.lit("the")).alias("n_the"),
    )


@query("""SELECT lang, source, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN n_chars >= 4000 THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN n_chars >= 1500 AND n_chars < 4000 THEN 1 ELSE 0 END) AS BIGINT) AS mid,
  CAST(sum(CASE WHEN n_chars < 1500 THEN 1 ELSE 0 END) AS BIGINT) AS low, round(100.0 * sum(CASE WHEN n_chars >= 1500 THEN 1 ELSE 0 END) / count(*), 2) AS share FROM documents GROUP BY 1, 2""")
def q_quality_bins(t: Tables) -> DataFrame:
    n = lambda c: F.count_if(c).alias
    return t("documents").groupBy("lang", "source").agg(
        F.count("*").alias("n"), n(F.col("n_chars") >= 4000)("high"), n((F.col("n_chars") >= 1500) & (F.col("n_chars") < 4000))("mid"), n(F.col("n_chars") < 1500)("low"),
        F.round(100.0 * F.count_if(F.col("n_chars") >= 1500) / F.count("*"), 2).alias("share"),
    )


@query("""WITH r AS (SELECT l_suppkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, CAST(max(n) AS BIGINT) AS n, min(v) AS low, max(CASE WHEN k = n // 2 THEN v END) AS median, max(CASE WHEN k = CAST(floor(n * 0.75) AS BIGINT) THEN v END) AS p75, max(v) AS high FROM r GROUP BY 1""")
def q_order_stats(t: Tables) -> DataFrame:
    n = F.col("n")
    at = {"low": F.lit(0), "median": F.floor(n / 2), "p75": F.floor(n * 0.75), "high": n - 1}
    return selection.picks(t("lineitem"), ["l_suppkey"], "l_extendedprice", at)


@query("""WITH r AS (SELECT p_brand, CAST(p_size AS DOUBLE) / 10 AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
g AS (SELECT p_brand, CAST(max(n) AS BIGINT) AS n, max(CASE WHEN k = n // 4 THEN v END) AS p25, max(CASE WHEN k = n // 2 THEN v END) AS p50 FROM r GROUP BY 1)
SELECT p_brand, n, CASE WHEN n < 100 THEN greatest(1.5, round(p25, 2)) ELSE greatest(2.0, round(p50, 2)) END AS threshold FROM g""")
def q_thresholds(t: Tables) -> DataFrame:
    p = t("part").withColumn("v", F.col("p_size").cast("double") / 10)
    s = selection.picks(p, ["p_brand"], "v", {"p25": F.floor(F.col("n") / 4), "p50": F.floor(F.col("n") / 2)})
    return s.select("p_brand", "n", F.when(F.col("n") < 100, F.greatest(F.lit(1.5), F.round("p25", 2))).otherwise(F.greatest(F.lit(2.0), F.round("p50", 2))).alias("threshold"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE k <= 3""")
def q_top_per_group(t: Tables) -> DataFrame:
    return corpus.top_per_group(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, n, users, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS total FROM d""")
def q_growth(t: Tables) -> DataFrame:
    d = t("events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    # One row a day, so the single ordered partition grows with the calendar, not the data.
    return d.select(F.col("day").cast("string").alias("day"), "n", "users", F.sum("n").over(Window.orderBy("day")).alias("total"))


@query("""WITH c AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn ROWS UNBOUNDED PRECEDING) AS s FROM conversations) SELECT conv_id, turn, CAST(s AS BIGINT) AS used FROM c WHERE s <= 600""")
def q_budget_prefix(t: Tables) -> DataFrame:
    n = F.length("text")
    w = Window.partitionBy("conv_id").orderBy(n.desc(), "turn").rowsBetween(Window.unboundedPreceding, 0)
    return t("conversations").select("conv_id", "turn", F.sum(n).over(w).alias("used")).where("used <= 600")


_ORDER = "n_chars DESC, doc_id"
_PROTECTED = f"""a AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY {_ORDER}) AS k FROM documents), b AS (SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY {_ORDER}) AS k FROM documents),
p AS (SELECT doc_id FROM a WHERE k <= 10 UNION SELECT doc_id FROM b WHERE k <= 2)"""


@query(f"""WITH {_PROTECTED}, r AS (SELECT doc_id, row_number() OVER (ORDER BY {_ORDER}) AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM p))
SELECT doc_id, TRUE AS reserved FROM p UNION ALL SELECT doc_id, FALSE FROM r WHERE k <= greatest(0, 400 - (SELECT count(*) FROM p))""")
def q_quota_selection(t: Tables) -> DataFrame:
    docs = t("documents").select("doc_id", "source", "lang", "n_chars")
    order = [F.desc("n_chars"), F.asc("doc_id")]
    kept = corpus.protected_ids(docs, "doc_id", "source", "lang", order)
    chosen = corpus.select_with_quota(docs, kept, "doc_id", order, 400)
    return chosen.join(kept.withColumn("reserved", F.lit(True)), "doc_id", "left").select("doc_id", F.coalesce("reserved", F.lit(False)).alias("reserved"))


_COMBOS = {"source_lang": ["source", "lang"], "lang_size": ["lang", "size"], "source_size": ["source", "size"]}
_COUNTS = """d AS (SELECT doc_id, source, lang, CASE WHEN n_chars >= 4000 THEN 'large' WHEN n_chars >= 1000 THEN 'medium' ELSE 'small' END AS size, n_chars FROM documents),
e AS (SELECT doc_id, n_chars, 'source_lang' AS family, source || '|' || lang AS combo FROM d UNION ALL SELECT doc_id, n_chars, 'lang_size', lang || '|' || size FROM d UNION ALL SELECT doc_id, n_chars, 'source_size', source || '|' || size FROM d),
n AS (SELECT count(*) AS total FROM d), c AS (SELECT family, combo, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY 1, 2),
q AS (SELECT family, combo, c.n, CAST(c.n AS DOUBLE) / total / CASE WHEN total < 100 THEN 0.10 WHEN total < 1000 THEN 0.05 ELSE 0.01 END AS ratio FROM c, n),
w AS (SELECT family, combo, n, CASE WHEN ratio > 5 THEN -4.0 WHEN ratio > 3 THEN -2.0 WHEN ratio > 2 THEN -1.0 WHEN ratio > 1 THEN 0.0 WHEN ratio > 0.5 THEN 1.5 ELSE 3.0 END AS weight FROM q)"""


def _sized(t: Tables) -> DataFrame:
    size = tx.bracket(F.col("n_chars"), [(4000, "large"), (1000, "medium")], "small")
    return t("documents").select("doc_id", "source", "lang", size.alias("size"), F.lit(4).alias("breadth"), (F.col("n_chars") / 500.0).alias("reliability"))


@query(f"WITH {_COUNTS} SELECT family, combo, n, CAST(weight AS DOUBLE) AS weight FROM w")
def q_combination_weights(t: Tables) -> DataFrame:
    docs = _sized(t)
    return corpus.combination_weights(corpus.combination_counts(docs, _COMBOS), docs.count())


@query(f"""WITH {_COUNTS}, s AS (SELECT doc_id, CAST(sum(weight) AS DOUBLE) AS s, max(n_chars) / 500.0 AS r FROM e JOIN w USING (family, combo) GROUP BY 1)
SELECT doc_id, round(CASE WHEN s > 0 THEN least(s / sqrt(4.0), 5.0, 0.3 * r) ELSE s END, 6) AS combination_score FROM s""")
def q_combination_scores(t: Tables) -> DataFrame:
    docs = _sized(t)
    weights = corpus.combination_weights(corpus.combination_counts(docs, _COMBOS), docs.count())
    return corpus.combination_scores(docs, "doc_id", _COMBOS, weights, "breadth", "reliability").select("doc_id", F.round("combination_score", 6).alias("combination_score"))


_ELIMINATED = """d AS (SELECT doc_id, source || '|' || lang AS a, lang || '|' || size AS b, source || '|' || size AS c, n_chars / 500.0e0 AS r FROM (SELECT *, CASE WHEN n_chars >= 4000 THEN 'large' WHEN n_chars >= 1000 THEN 'medium' ELSE 'small' END AS size FROM documents)),
p1 AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS x, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS y FROM documents),
kept AS (SELECT doc_id FROM p1 WHERE x <= 2 OR y <= 1)"""
_WEIGHT = "CASE WHEN {x} > 5 THEN -4.0e0 WHEN {x} > 3 THEN -2.0e0 WHEN {x} > 2 THEN -1.0e0 WHEN {x} > 1 THEN 0.0e0 WHEN {x} > 0.5 THEN 1.5e0 ELSE 3.0e0 END"
_SHARE = "CAST(count(*) OVER (PARTITION BY round, {x}) AS DOUBLE) / count(*) OVER (PARTITION BY round) / CASE WHEN count(*) OVER (PARTITION BY round) < 100 THEN 0.10e0 WHEN count(*) OVER (PARTITION BY round) < 1000 THEN 0.05e0 ELSE 0.01e0 END"


@query(f"""WITH RECURSIVE {_ELIMINATED}, r AS (SELECT 0 AS round, d.*, kept.doc_id IS NOT NULL AS safe FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
UNION ALL SELECT round + 1, doc_id, a, b, c, r, safe FROM (SELECT *, row_number() OVER (PARTITION BY safe ORDER BY score + r, doc_id) AS place, count(*) OVER () AS n, count(*) FILTER (WHERE NOT safe) OVER () AS free FROM (SELECT *, CASE WHEN s > 0 THEN least(s / 2.0e0, 5.0e0, 0.3e0 * r) ELSE s END AS score FROM
  (SELECT *, {" + ".join(_WEIGHT.format(x=f"s{x}") for x in "abc")} AS s FROM (SELECT *, {", ".join(f"{_SHARE.format(x=x)} AS s{x}" for x in "abc")} FROM r)))) WHERE n > 150 AND free > 0 AND (safe OR place > least(1000, n - 150)))
SELECT doc_id FROM r WHERE round = (SELECT max(round) FROM r)""")
def q_diversity_elimination(t: Tables) -> DataFrame:
    docs = _sized(t)
    order = [F.desc("reliability"), F.asc("doc_id")]
    kept = corpus.protected_ids(docs, "doc_id", "source", "lang", order, 2, 1)
    return corpus.eliminate(docs, "doc_id", _COMBOS, "breadth", "reliability", kept, 150, step=1000).select("doc_id")


@query("SELECT d.doc_id FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.vec_id IS NULL AND length(d.text) > 0")
def q_not_embedded(t: Tables) -> DataFrame:
    return t("documents").where("length(text) > 0").join(t("embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id")


@query("SELECT d.doc_id, d.source, l.quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q_update_join(t: Tables) -> DataFrame:
    docs = t("documents").select("doc_id", "source", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    return tables.backfill(docs, t("labels"), "doc_id", ["quality", "toxic"]).withColumn("toxic", F.coalesce("toxic", F.lit(0)))


@query("""WITH g AS (SELECT DISTINCT r_name, p_brand FROM region CROSS JOIN (SELECT DISTINCT p_brand FROM part)), h AS (SELECT p_brand, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_size > 45 GROUP BY 1)
SELECT r_name, g.p_brand, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'D' WHEN n >= 10 THEN 'B' ELSE 'C' END AS grade FROM g LEFT JOIN h ON g.p_brand = h.p_brand""")
def q_profile_grid(t: Tables) -> DataFrame:
    brands = t("part").select("p_brand").distinct()
    counts = t("part").where("p_size > 45").groupBy("p_brand").agg(F.count("*").alias("n"))
    goals = t("region").agg(F.collect_set("r_name").alias("goals"))  # one row: a fixed list
    grid = brands.crossJoin(F.broadcast(goals)).select("p_brand", F.explode("goals").alias("r_name"))
    return grid.join(counts, "p_brand", "left").select("r_name", "p_brand", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "D").when(F.col("n") >= 10, "B").otherwise("C").alias("grade"))


_RULES = [("r1", "the", "hard_stop", "stop word"), ("r2", "user", "caution", "from a user"), ("r3", "la", "caution", "foreign word")]


@query("""WITH i AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS item_key, role, text, ['A', 'B', 'C', 'D'][CAST(turn % 4 AS INTEGER) + 1] AS grade FROM conversations),
m AS (SELECT item_key, 'hard_stop' AS severity, 'stop word' AS message FROM i WHERE regexp_matches(lower(text), '(^|[^a-z])the([^a-z]|$)') UNION ALL SELECT item_key, 'caution', 'from a user' FROM i WHERE role = 'user' UNION ALL SELECT item_key, 'caution', 'foreign word' FROM i WHERE regexp_matches(lower(text), '(^|[^a-z])la([^a-z]|$)')),
p AS (SELECT item_key, max(severity = 'hard_stop') AS hard, max(severity = 'caution') AS soft, string_agg(DISTINCT message, '; ' ORDER BY message) AS reasons FROM m GROUP BY 1)
SELECT item_key, grade, coalesce(reasons, '') AS reasons, CASE WHEN hard THEN 'F' WHEN soft THEN CASE grade WHEN 'A' THEN 'B' WHEN 'B' THEN 'C' WHEN 'C' THEN 'D' ELSE 'F' END ELSE grade END AS adjusted, CASE WHEN hard THEN 'Avoid' WHEN soft THEN 'Caution' ELSE 'OK' END AS verdict
FROM i LEFT JOIN p USING (item_key)""")
def q_rule_adjustments(t: Tables) -> DataFrame:
    items = t("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("item_key"), "role", F.lower("text").alias("text"), F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("turn") % 4 + 1).cast("int")).alias("grade"))
    word = lambda x: F.col("text").rlike(f"(^|[^a-z]){x}([^a-z]|$)")
    hits = F.array_compact(F.array(*[F.when(F.col("role") == "user" if x == "user" else word(x), F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message"))) for _, x, s, m in _RULES]))
    matches = items.select("item_key", F.explode(hits).alias("m")).select("item_key", "m.*")
    return evidence.adjust_grades(items.select("item_key", "grade"), matches)


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(v.embedding[i] AS DOUBLE) - CAST(q.e[i] AS DOUBLE)) ** 2))) - CASE WHEN label = 3 THEN 0.05 ELSE 0.0 END, 6) AS rank_score FROM embeddings v, q)
SELECT vec_id, label, rank_score FROM s ORDER BY s.rank_score, vec_id LIMIT 20""")
def q_vector_search(t: Tables) -> DataFrame:
    df = t("embeddings")
    probe = df.where("vec_id = 0").select("embedding").first()
    near = search.nearest(df if probe else df.limit(0), "embedding", probe[0] if probe else [], 20, F.when(F.col("label") == 3, 0.05).otherwise(0.0), "vec_id")
    return near.select("vec_id", "label", "rank_score")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, label, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(v.embedding[i] AS DOUBLE) - CAST(q.e[i] AS DOUBLE)) ** 2))) - CASE WHEN label = 3 THEN 0.05 ELSE 0.0 END, 6) AS rank_score FROM embeddings v, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score, vec_id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, label, rank_score FROM r WHERE rank <= 20""")
def q_vector_search_each(t: Tables) -> DataFrame:
    df = t("embeddings")
    near = search.nearest_each(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding", 20, F.when(F.col("label") == 3, 0.05).otherwise(0.0))
    return near.select("query_id", "rank", "vec_id", "label", "rank_score")


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, CAST(len(w) AS DOUBLE) AS n, CAST(len(list_filter(w, lambda x: x = 'the')) AS DOUBLE) AS a, CAST(len(list_filter(w, lambda x: x = 'que')) AS DOUBLE) AS b FROM w),
s AS (SELECT CAST(count(*) AS DOUBLE) AS t, avg(n) AS m, CAST(sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS da, CAST(sum(CASE WHEN b > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS db FROM c)
SELECT doc_id, round(ln(1 + (t - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (t - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / m)), 4) AS score FROM c, s WHERE a > 0 OR b > 0""")
def q_keyword_search(t: Tables) -> DataFrame:
    return search.bm25(t("documents"), "doc_id", "text", ["the", "que"]).select("doc_id", F.round("score", 4).alias("score"))


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> ''))) AS term FROM benchmark),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS m FROM w), e AS (SELECT doc_id, CAST(len(w) AS DOUBLE) AS l, unnest(w) AS term FROM w),
f AS (SELECT doc_id, l, term, CAST(count(*) AS DOUBLE) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3), d AS (SELECT term, CAST(count(*) AS DOUBLE) AS d FROM f GROUP BY 1),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))), 6) AS score FROM q JOIN f USING (term) JOIN d USING (term), n GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20""")
def q_keyword_search_each(t: Tables) -> DataFrame:
    found = search.bm25_each(t("documents"), "doc_id", "text", t("benchmark"), "item_id", "text", 20)
    return found.select("item_id", "rank", "doc_id", "score")


@query("""WITH p AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>[^<]*(<[^/][^<]*|</[^s][^<]*)*</script>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\n\\t]+', ' ', 'g')) AS x FROM pages)
SELECT page_id, CAST(length(x) AS BIGINT) AS n_chars, length(x) >= 1200 AS kept FROM p""")
def q_html_gate(t: Tables) -> DataFrame:
    x = F.regexp_replace("html", "<script[^>]*+>[^<]*+(?:<[^/][^<]*+|</[^s][^<]*+)*+</script>", " ")  # possessive: no recursion
    x = F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), "[ \\n\\t]+", " "))
    return t("pages").select("page_id", F.length(x).cast("long").alias("n_chars"), (F.length(x) >= 1200).alias("kept"))


_BOILERPLATE = ["script", "style", "nav", "footer", "header"]
_SECTION_WORDS = ["introduction", "methods", "results", "discussion", "materials and methods"]
_STRIPPED = "regexp_replace(coalesce(html, ''), '<!--.*?-->', ' ', 'gs')"
for _tag in _BOILERPLATE:
    _STRIPPED = rf"regexp_replace({_STRIPPED}, '<{_tag}\b[^>]*>.*?</{_tag}\s*>', ' ', 'gis')"
_STRIPPED = f"regexp_replace({_STRIPPED}, '<[^>]*>', ' ', 'g')"
for _entity, _plain in chunks.ENTITIES:
    _STRIPPED = f"replace({_STRIPPED}, '{_entity}', '{_plain.replace(chr(39), chr(39) * 2)}')"


@query(rf"""WITH p AS (SELECT page_id, trim(regexp_replace({_STRIPPED}, '[ \t\n\r]+', ' ', 'g')) AS x FROM pages)
SELECT page_id, CAST(length(x) AS BIGINT) AS n_chars, length(x) >= 1200 AND {" + ".join(f"contains(lower(x), '{w}')::INT" for w in _SECTION_WORDS)} >= 2 AS kept FROM p""")
def q_article_gate(t: Tables) -> DataFrame:
    text, kept = chunks.article_gate(F.col("html"), _BOILERPLATE, _SECTION_WORDS, 1200, 2)
    return t("pages").select("page_id", F.length(text).cast("long").alias("n_chars"), kept.alias("kept"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def q_latest_wins(t: Tables) -> DataFrame:
    return tables.latest(t("events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT item_id FROM benchmark")
def q_union_ids(t: Tables) -> DataFrame:
    return t("documents").where("lang = 'en'").select("doc_id").union(t("labels").where("quality = 1").select("doc_id")).union(t("benchmark").select("item_id")).distinct()


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY pri, event_id) AS k FROM
  (SELECT user_id, event_id, 0 AS pri FROM events WHERE ts >= TIMESTAMP '2024-01-20' UNION ALL SELECT user_id, event_id, 1 FROM events WHERE ts < TIMESTAMP '2024-01-20')) WHERE k = 1""")
def q_new_before_old(t: Tables) -> DataFrame:
    e = t("events").select("user_id", "event_id", F.when(F.col("ts") >= F.to_timestamp(F.lit("2024-01-20")), 0).otherwise(1).alias("pri"))
    return tables.latest(e, ["user_id"], [F.asc("pri"), F.asc("event_id")]).select("user_id", "event_id")


@query("""SELECT CAST(ts AS DATE)::VARCHAR AS day, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) / 1000000.0 * 0.15 + value / 1000000.0 * 0.6), 9) AS cost FROM events GROUP BY 1, 2""")
def q_daily_cost(t: Tables) -> DataFrame:
    cost = F.get_json_object("props", "$.k").cast("double") / 1000000.0 * 0.15 + F.col("value") / 1000000.0 * 0.6
    return t("events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(cost), 9).alias("cost"))


@query("""WITH m AS (SELECT max(ts) AS hwm FROM events WHERE event_type = 'signup') SELECT event_id, user_id FROM events, m WHERE ts >= hwm - INTERVAL 1 DAY""")
def q_high_water_mark(t: Tables) -> DataFrame:
    mark = t("events").where("event_type = 'signup'").agg(F.max("ts").alias("hwm"))
    return t("events").crossJoin(F.broadcast(mark)).where(F.expr("ts >= hwm - INTERVAL 1 DAY")).select("event_id", "user_id")


@query("""SELECT user_id, CAST(count(*) AS BIGINT) AS n, count(*) >= 5 AS limited FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-10' GROUP BY 1""")
def q_rate_limit(t: Tables) -> DataFrame:
    e = t("events").where((F.col("event_type") == "view") & (F.col("ts") >= F.to_timestamp(F.lit("2024-01-10"))))
    return e.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("limited", F.col("n") >= 5)


@query("""SELECT conv_id, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, CAST(count(*) AS BIGINT) AS n_chunks, CAST(sum(length(text)) + 2 * (count(*) - 1) AS BIGINT) AS char_len FROM conversations GROUP BY 1, 2""")
def q_section_bundles(t: Tables) -> DataFrame:
    return chunks.bundle(t("conversations"), ["conv_id", "role"], "turn", "text")


@query("""SELECT lang, CAST(count(*) AS BIGINT) AS total, CAST(count(l.doc_id) AS BIGINT) AS covered, round(100.0 * count(l.doc_id) / count(*), 2) AS share FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def q_coverage(t: Tables) -> DataFrame:
    j = t("documents").select("doc_id", "lang").join(t("labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return j.groupBy("lang").agg(F.count("*").alias("total"), F.count("hit").alias("covered"), F.round(100.0 * F.count("hit") / F.count("*"), 2).alias("share"))


@query("SELECT substr(sha256(lower(text) || '|' || lang), 1, 16) AS dedupe_key, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def q_duplicate_keys(t: Tables) -> DataFrame:
    key = F.substring(F.sha2(F.concat_ws("|", F.lower("text"), "lang"), 256), 1, 16)
    return tables.duplicated(t("documents").select(key.alias("dedupe_key")), ["dedupe_key"])


@query("""SELECT 'doc_id' AS "column", CAST(count(*) FILTER (doc_id IS NULL) AS BIGINT) AS n_missing FROM documents UNION ALL SELECT 'text', count(*) FILTER (text IS NULL OR trim(text) = '') FROM documents UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL OR trim(lang) = '') FROM documents""")
def q_required_keys(t: Tables) -> DataFrame:
    return tables.missing(t("documents"), ["doc_id", "text", "lang"])


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p, length(text) AS n FROM documents), e AS (SELECT doc_id, n, unnest(p) AS line, unnest(range(0, len(p))) AS k, p FROM l),
o AS (SELECT doc_id, n, line, k, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM e)
SELECT doc_id, k AS line_no, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), n) AS section_end FROM o WHERE length(line) <= 140 AND length(line) > 0""")
def q_sections(t: Tables) -> DataFrame:
    docs = t("documents").withColumn("n", F.length("text").cast("long"))
    heads = chunks.lines(docs, "text", ["doc_id", "n"]).where("length(line) <= 140 AND length(line) > 0")
    return chunks.sections(heads, "doc_id", "n").select("doc_id", "line_no", "start", "section_end")


_COLON = "[:\uff1a\ufe55\ua789]"
_COMMON = ["introduction", "background", "methods", "results", "discussion", "conclusion", "conclusions", "findings", "participants"]
# Headers of sections, and of the parts that end them; patterns.
_CORE = [
    r"ABSTRACT", r"INTRODUCTION", r"BACKGROUND", r"AIM", r"AIMS", r"OBJECTIVE", r"OBJECTIVES", r"MATERIALS\s+AND\s+METHODS", r"(?:SUBJECTS|PATIENTS)\s+AND\s+METHODS", r"STUDY\s+DESIGN",
    r"PARTICIPANTS", r"METHODS", r"METHODOLOGY", r"RESULTS", r"RESULT", r"FINDINGS", r"DISCUSSION", r"CONCLUSION", r"CONCLUSIONS", r"DISCUSSION\s+AND\s+CONCLUSIONS?", r"COMPLICATIONS",
]
_END = [
    r"TITLE", r"ABBREVIATIONS", r"ACKNOWLEDG(?:E)?MENTS?", r"FUNDING", r"AUTHOR(?:S)?\s+AND\s+AFFILIATIONS", r"AUTHOR\s+INFORMATION", r"CONTRIBUTIONS", r"CORRESPONDING\s+AUTHORS?",
    r"ETHICS(?:\s+DECLARATIONS?)?", r"ETHICAL\s+APPROVAL.*", r"CONSENT\s+FOR\s+PUBLICATION", r"CLINICAL\s+TRIALS?\s+REGISTRATION", r"TRIAL\s+REGISTRATION", r"SUPPLEMENTARY\s+INFORMATION",
    r"RIGHTS\s+AND\s+PERMISSIONS", r"ABOUT\s+THIS\s+ARTICLE", r"DATA\s+AVAILABILITY", r"SIMILAR\s+CONTENT\s+BEING\s+VIEWED\s+BY\s+OTHERS", r"REFERENCES",
]
#: Core terms, lines without letters and title words; the last two need a colon. As case is ignored, a title word is any of two letters or more.
_TARGET = rf"(?:\d+\.?\s*)?(?:{'|'.join(_CORE)})\s*{_COLON}?|(?:\d+\.?\s*)?[0-9\s()\[\]{{}}&/\\+,:;.-]{{1,160}}{_COLON}|(?:\d+\.?\s*)?[A-Za-z]{{2,}}(?:\s+[A-Za-z]{{2,}}){{0,6}}\s*{_COLON}"
_STOP = rf"(?:{'|'.join(_END)})\s*{_COLON}?"
#: Headers that are put before the paragraphs of a text, as the given texts have none.
_HEADERS = ["Abstract", "1. INTRODUCTION", "Materials and Methods:", "RESULTS", "Discussion and Conclusions", "FUNDING", "2 Study design", "In conclusion:", "Author Information", "Some words that are no header", "Key Takeaways:", ""]


def headed() -> Column:
    """A document's text with headers before its paragraphs."""
    header = lambda i: F.element_at(F.array(*map(F.lit, _HEADERS)), (F.pmod(F.col("doc_id") + i + 1, F.lit(len(_HEADERS))) + 1).cast("int"))
    return F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(header(i), F.lit("\n"), x)), "\n")


@query(rf"""WITH b AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: [{", ".join(f"'{h}'" for h in _HEADERS)}][(doc_id + i) % {len(_HEADERS)} + 1] || chr(10) || x) AS x FROM documents),
l AS (SELECT doc_id, string_split(array_to_string(x, chr(10)), chr(10)) AS p, length(array_to_string(x, chr(10))) AS n FROM b), e AS (SELECT doc_id, n, unnest(p) AS line, unnest(range(0, len(p))) AS k FROM l),
o AS (SELECT doc_id, n, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s, k, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM e),
c AS (SELECT *, CASE WHEN ends_with(s, ':') AND contains(lower(s), 'conclusion') THEN false WHEN regexp_full_match(s, '{_STOP}', 'i') THEN true WHEN regexp_full_match(s, '{_TARGET}', 'i') THEN false END AS is_stop FROM o
  WHERE length(s) BETWEEN 1 AND 140 AND (regexp_matches(s, '{_COLON}$') OR regexp_matches(s, '^[0-9]+\.*( |$)') OR (length(regexp_replace(s, '\P{{L}}', '', 'g')) >= 4 AND length(regexp_replace(s, '\P{{Lu}}', '', 'g')) >= 0.6 * length(regexp_replace(s, '\P{{L}}', '', 'g'))) OR lower(s) IN ({", ".join(f"'{w}'" for w in _COMMON)}))),
h AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), n) AS section_end FROM c WHERE is_stop IS NOT NULL)
SELECT doc_id, k AS line_no, s AS title, start, section_end FROM h WHERE NOT is_stop""")
def q_article_sections(t: Tables) -> DataFrame:
    """Sections of texts whose paragraphs have headers before them."""
    docs = t("documents").select("doc_id", headed().alias("text")).withColumn("n", F.length("text").cast("long"))
    heads = chunks.headers(chunks.lines(docs, "text", ["doc_id", "n"]), _COMMON, _TARGET, _STOP, _COLON)
    return chunks.sections(heads, "doc_id", "n").where("NOT is_stop").select("doc_id", "line_no", "title", "start", "section_end")


@query("""WITH c AS (SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS u, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, CASE WHEN u = 1 AND n >= 3 THEN 'single' ELSE role END AS label FROM c""")
def q_group_relabel(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id")
    return t("conversations").select("conv_id", "turn", F.when((F.count_if(F.col("role") == "user").over(w) == 1) & (F.count("*").over(w) >= 3), "single").otherwise(F.col("role")).alias("label"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END || ':' || c_mktsegment AS bank_key, CAST(round_even(c_acctbal / 5.0, 0) * 5 AS BIGINT) AS rounded, CAST(ceil(greatest(0.0, 8000.0 - c_acctbal) / 2500.0) AS BIGINT) AS servings FROM customer""")
def q_dose_bins(t: Tables) -> DataFrame:
    b = F.col("c_acctbal")
    return t("customer").select("c_custkey", F.concat_ws(":", tx.bracket(b, [(5000, "high"), (0, "mid")], "low"), "c_mktsegment").alias("bank_key"), (F.bround(b / 5.0) * 5).cast("long").alias("rounded"), F.ceil(F.greatest(F.lit(0.0), 8000.0 - b) / 2500.0).alias("servings"))


@query("""WITH s AS (SELECT doc_id, (CASE WHEN length(text) > 0 THEN 0.3 ELSE 0 END + CASE WHEN lang IN ('en', 'de') THEN 0.2 ELSE 0 END + CASE WHEN n_chars >= 500 THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]') THEN 0.2 ELSE 0 END) AS s FROM documents)
SELECT doc_id, round(CAST(s AS DOUBLE), 4) AS score, round(CAST(s AS DOUBLE), 4) >= 0.6 AS valid FROM s""")
def q_validation(t: Tables) -> DataFrame:
    checks = [(F.length("text") > 0, 0.3), (F.col("lang").isin("en", "de"), 0.2), (F.col("n_chars") >= 500, 0.3), (F.col("text").rlike("[0-9]"), 0.2)]
    score = F.round(sum((F.when(k, w).otherwise(0.0) for k, w in checks), F.lit(0.0)), 4)
    return t("documents").select("doc_id", score.alias("score"), (score >= 0.6).alias("valid"))
