"""Registered queries of safety rules, tiers, card checks, quotas and selection reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curata.operators import cards, guardrails as g
from curata.plans.articles import _deal, _list
from curata.plans.queries import Tables, query

CONDITIONS = ["Hypertension", "anxiety", "Low Blood-Pressure", "gerd", "insomnia", "kidney disease", "none", "diabetes"]
MEDS = ["Sertraline 50mg", "nardil", "Warfarin", "lisinopril", "aspirin", "Insulin"]
ITEMS = ["creatine", "caffeine", "nitrate", "beta-alanine", "citrulline", "protein", "tribulus", "licorice", "garlic"]
_Q = lambda x: "'" + str(x).replace("'", "''") + "'"
_RULES = ", ".join(f"({s}, {_Q(t)}, {_Q(v)}, {_Q(i)}, {_Q(e)}, {_Q(n)}, {'NULL' if a is None else a})" for s, t, v, i, e, n, a in g.rules())
_MED = "CASE " + " ".join(f"WHEN regexp_matches(lower(m), '{p}') THEN '{k}'" for p, k in g.MEDICINE_CLASS) + " ELSE 'other' END"


@query(f"""WITH p AS (SELECT c_custkey AS k, [{_list(CONDITIONS)}[c_custkey % 8 + 1], {_list(CONDITIONS)}[(c_custkey // 8) % 8 + 1]] AS cs, {_list(MEDS)}[c_custkey % 6 + 1] AS m, c_custkey % 80 AS age, c_custkey % 13 = 0 AS pregnancy FROM customer),
t AS (SELECT k, 'condition' AS trigger, replace(replace(lower(cs[i]), ' ', '_'), '-', '_') AS value, i - 1 AS place FROM p, range(1, 3) r(i)
  UNION ALL SELECT k, 'medicine', {_MED}, 0 FROM p UNION ALL SELECT k, 'age', 'minor', 0 FROM p WHERE age > 0 AND age < 18 UNION ALL SELECT k, 'age', 'older', 0 FROM p WHERE age >= 65 UNION ALL SELECT k, 'pregnancy', 'yes', 0 FROM p WHERE pregnancy),
r(step, trigger, value, item, effect, note, amount) AS (VALUES {_RULES}),
met AS (SELECT k, r.*, step * 100 + place AS o FROM t JOIN r USING (trigger, value)),
f AS (SELECT k, item, min_by(note, o) FILTER (WHERE effect = 'block') AS reason, string_agg(note, '; ' ORDER BY o) FILTER (WHERE effect = 'caution') AS cautions, max_by(amount, o) FILTER (WHERE effect = 'cap') AS max_mg, max(amount) FILTER (WHERE effect = 'share') AS share FROM met GROUP BY 1, 2)
SELECT p.k AS c_custkey, i.item, reason IS NULL AS is_safe, coalesce(reason, '') AS reason, coalesce(cautions, '') AS cautions, CAST(max_mg AS DOUBLE) AS max_mg, CAST(share AS DOUBLE) AS share
FROM p CROSS JOIN (SELECT unnest({_list(ITEMS)}) AS item) i LEFT JOIN f ON f.k = p.k AND f.item = i.item""")
def q_guardrails(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    p = t("customer").select(
        "c_custkey", F.array(_deal(CONDITIONS, k), _deal(CONDITIONS, F.floor(k / 8))).alias("conditions"), F.array(_deal(MEDS, k)).alias("meds"), (k % 80).alias("age"), (k % 13 == 0).alias("pregnancy"),
    )
    return g.judged(p.sparkSession, p, "c_custkey", ITEMS)


@query("""WITH s AS (SELECT s_suppkey, ['A', 'B', 'C', 'D', 'F'][s_suppkey % 5 + 1] AS grade, ['strength', 'endurance'][s_suppkey % 2 + 1] AS goal, 50 + s_suppkey % 60 AS kg, s_suppkey % 70 AS age FROM supplier)
SELECT s_suppkey, grade, CASE grade WHEN 'A' THEN 'recommended' WHEN 'B' THEN 'optional' WHEN 'C' THEN 'optional' ELSE 'not_recommended' END AS tier, grade IN ('A', 'B', 'C') AS included,
  CASE WHEN grade IN ('A', 'B') THEN NULL WHEN grade = 'C' THEN 'Moderate evidence - may provide benefits' ELSE 'Insufficient evidence for ' || goal || ' goals (Grade ' || grade || ')' END AS reason,
  goal || ':' || CASE WHEN kg < 60 THEN 'xs' WHEN kg < 70 THEN 'small' WHEN kg < 85 THEN 'medium' WHEN kg < 100 THEN 'large' ELSE 'xl' END || ':other:' || CASE WHEN age = 0 THEN 'adult' WHEN age < 18 THEN 'minor' WHEN age < 30 THEN 'young' WHEN age < 50 THEN 'adult' ELSE 'mature' END AS bank_key FROM s""")
def q_tiers(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    grade, goal = _deal(list("ABCDF"), k), _deal(["strength", "endurance"], k)
    tier, included, reason = g.tier(grade, goal)
    key = F.concat_ws(":", goal, g.weight_bin(50 + k % 60), F.lit("other"), g.age_bin(k % 70))
    return t("supplier").select("s_suppkey", grade.alias("grade"), tier.alias("tier"), included.alias("included"), reason.alias("reason"), key.alias("bank_key"))


def _cards(t: Tables) -> DataFrame:
    line = t("lineitem")
    some = lambda c, x: F.when(c, F.col(x))
    return line.select(
        "l_orderkey", "l_linenumber", some(F.col("l_linenumber") != 2, "l_quantity").alias("population_size"), some(F.col("l_discount") < 0.08, "l_discount").alias("dose"), some(F.col("l_tax") < 0.06, "l_tax").alias("weeks"),
        F.array(F.struct(some(F.col("l_returnflag") != "R", "l_tax").alias("value"), some(F.col("l_linestatus") == "O", "l_tax").alias("p_value"))).alias("effects"),
        (F.col("l_suppkey") % 3 == 0).alias("has_safety"), F.lit("t").alias("title"), F.when(F.col("l_partkey") % 5 > 0, "j").otherwise("").alias("journal"), F.lit(2020).alias("year"), F.lit("1").alias("pmid"),
    )


_CHECKS = """c AS (SELECT l_orderkey, l_linenumber, l_linenumber <> 2 AS a, l_discount < 0.08 AS b, l_tax < 0.06 AS c, l_returnflag <> 'R' AND l_linestatus = 'O' AS d, l_suppkey % 3 = 0 AS e, l_partkey % 5 > 0 AS f FROM lineitem),
s AS (SELECT *, CASE WHEN a THEN 0.20e0 ELSE 0e0 END + CASE WHEN b THEN 0.20e0 ELSE 0e0 END + CASE WHEN c THEN 0.15e0 ELSE 0e0 END + CASE WHEN d THEN 0.25e0 ELSE 0e0 END + CASE WHEN e THEN 0.10e0 ELSE 0e0 END + CASE WHEN f THEN 0.10e0 ELSE 0e0 END AS score,
  list_filter([CASE WHEN NOT a THEN 'population_size' END, CASE WHEN NOT b THEN 'dose_g_per_day' END, CASE WHEN NOT c THEN 'duration_weeks' END, CASE WHEN NOT d THEN 'effect_sizes_with_p_values' END, CASE WHEN NOT e THEN 'safety_information' END, CASE WHEN NOT f THEN 'complete_metadata' END], lambda z: z IS NOT NULL) AS missing FROM c)"""


@query(f"WITH {_CHECKS} SELECT l_orderkey, l_linenumber, round(score, 2) AS score, score >= 0.60e0 AS is_valid, array_to_string(missing, ',') AS missing FROM s")
def q_card_checks(t: Tables) -> DataFrame:
    return cards.checked(_cards(t)).select("l_orderkey", "l_linenumber", F.round("score", 2).alias("score"), "is_valid", F.array_join("missing", ",").alias("missing"))


@query(f"""WITH {_CHECKS}, m AS (SELECT field, count(*) AS n FROM (SELECT unnest(missing) AS field FROM s) GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE score >= 0.60e0) AS BIGINT) AS valid, CAST(count(*) FILTER (WHERE score >= 0.80e0) AS BIGINT) AS high, round(avg(score), 6) AS average,
  CAST(count(*) FILTER (WHERE score >= 0.90e0) AS BIGINT) AS excellent, CAST(count(*) FILTER (WHERE score >= 0.80e0 AND score < 0.90e0) AS BIGINT) AS good, CAST(count(*) FILTER (WHERE score >= 0.60e0 AND score < 0.80e0) AS BIGINT) AS fair, CAST(count(*) FILTER (WHERE score < 0.60e0) AS BIGINT) AS poor,
  (SELECT string_agg(field || ':' || n, ',' ORDER BY field) FROM m) AS missing FROM s""")
def q_card_batch(t: Tables) -> DataFrame:
    return cards.batch(cards.checked(_cards(t)))


@query("""WITH e AS (SELECT user_id, ts, event_id FROM events), f AS (SELECT user_id, min(ts) AS first FROM e GROUP BY 1)
SELECT event_id, user_id, period, CAST(k AS INTEGER) AS used, k > 2 AS over FROM (SELECT event_id, e.user_id, CAST(floor((epoch_us(ts) - epoch_us(first)) / 864000000000.0) AS BIGINT) AS period,
  row_number() OVER (PARTITION BY e.user_id, CAST(floor((epoch_us(ts) - epoch_us(first)) / 864000000000.0) AS BIGINT) ORDER BY ts, event_id) AS k FROM e JOIN f USING (user_id))""")
def q_fixed_quota(t: Tables) -> DataFrame:
    """Uses within ten-day periods from each user's first event, two free."""
    e = t("events").select("user_id", "ts", "event_id")
    first = e.groupBy("user_id").agg(F.min("ts").alias("first"))
    period = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / F.lit(864_000_000_000.0)).cast("long")
    e = e.join(first, "user_id").withColumn("period", period)
    used = F.row_number().over(Window.partitionBy("user_id", "period").orderBy("ts", "event_id"))
    return e.withColumn("used", used).select("event_id", "user_id", "period", "used", (F.col("used") > 2).alias("over"))


@query("""WITH c AS (SELECT lang, source, CAST(count(*) AS BIGINT) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2), t AS (SELECT sum(n) AS total FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, lang, source) AS k FROM c)
SELECT lang, source, n, CAST(k AS INTEGER) AS place, round(100.0 * n / total, 4) AS share, CASE WHEN n > 0.10 * total THEN 'over' WHEN n < 0.01 * total THEN 'under' ELSE 'within' END AS state FROM r, t WHERE k <= 15""")
def q_top_combos(t: Tables) -> DataFrame:
    """The 15 commonest pairs with their shares of all, against a target of 1 to 10 per cent."""
    c = t("documents").where("lang IS NOT NULL AND source IS NOT NULL").groupBy("lang", "source").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    top = c.orderBy(F.desc("n"), "lang", "source").limit(15).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "lang", "source")))
    n, all_of = F.col("n"), F.col("total")
    return top.join(F.broadcast(total)).select("lang", "source", "n", "place", F.round(100.0 * n / all_of, 4).alias("share"), F.when(n > 0.10 * all_of, "over").when(n < 0.01 * all_of, "under").otherwise("within").alias("state"))
