"""Queries of streams, stores and indexes: state, paged readers, keyed tables, vector lists, postings."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.functions import articles as a
from curata.functions import stem
from curata.operators import postings, selection, vector_lists
from curata.plans import banking  # noqa: F401  (it registers the batch form of the quota)
from curata.plans.articles import JOURNALS, TITLES, _deal, _list
from curata.plans.queries import ORACLES, Tables, query
from curata.sources import files, keyed, paged
from curata.streaming import sinks, stateful

#: The least partitions of a stream's state, which its first run fixes: as many as tasks can run at a time.
STATE_PARTITIONS = 4


def state_partitions(df: DataFrame) -> int:
    return max(STATE_PARTITIONS, df.sparkSession.sparkContext.defaultParallelism)


def folder(df: DataFrame) -> str:
    """A folder of one's own below the shared one."""
    return f"{files.shared_dir(df.sparkSession)}/curata-{uuid.uuid4().hex}"


@query(ORACLES["q_reset_quota"])
def q_stream_quota(t: Tables) -> DataFrame:
    """The quota of ``q_reset_quota`` as a stream that takes its events in four batches and is stopped after two."""
    events = t("events").select("event_id", "user_id", "ts")
    spark, at = events.sparkSession, folder(events)
    middle = F.to_timestamp(F.lit("2024-01-12"))
    for part, parts, first in ((events.where(F.col("ts") < middle), 2, 0), (events.where(F.coalesce(F.col("ts") >= middle, F.lit(True))), 2, 2)):
        stateful.staged(part, "ts", f"{at}/in", parts, first)
        arrived = stateful.arrivals(spark, f"{at}/in", events.schema)
        stateful.run(stateful.quota(arrived, "user_id", "ts", "event_id", 10, 5), f"{at}/out", f"{at}/checkpoint", state_partitions(events))
    return spark.read.parquet(f"{at}/out").select("event_id", "user_id", "period", "used")


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL)
SELECT user_id || '|' || event_type AS seen_key, event_id FROM k WHERE k = 1""")
def q_stream_first_seen(t: Tables) -> DataFrame:
    """The first event of every user and type, from a stream in three runs that remembers keys for a year."""
    events = t("events").select(F.concat_ws("|", "user_id", F.when(F.col("user_id").isNotNull(), F.col("event_type"))).alias("seen_key"), "event_id", "ts").where("contains(seen_key, '|')")
    spark, at = events.sparkSession, folder(events)
    edges = [F.lit(True), F.col("ts") >= "2024-01-10", F.col("ts") >= "2024-01-20", F.lit(False)]
    for k in range(3):
        stateful.staged(events.where(edges[k] & ~edges[k + 1]), "ts", f"{at}/in", 1, k)
        arrived = stateful.arrivals(spark, f"{at}/in", events.schema)
        stateful.run(stateful.first_sights(arrived, "seen_key", "ts", "event_id", 365), f"{at}/out", f"{at}/checkpoint", state_partitions(events))
    return spark.read.parquet(f"{at}/out").select("seen_key", "event_id")


_EVENT = "event_id long, user_id long, event_type string, value double, day date"


def _service(t: Tables) -> DataFrame:
    """Events as a service of pages by day, read by the paged source."""
    events = t("events").select("event_id", "user_id", "event_type", "value", "ts")
    at = folder(events)
    paged.stage(events, "ts", "event_id", at)
    return paged.read(events.sparkSession, at, _EVENT, simple=2000, target=1500)


@query("""SELECT event_id, user_id, event_type, value, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'""")
def q_paged_search(t: Tables) -> DataFrame:
    """A search by date range that only reads slices of these days."""
    found = _service(t).where("day >= DATE '2024-01-05' AND day < DATE '2024-01-13'")
    return found.select("event_id", "user_id", "event_type", "value", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("""SELECT DISTINCT user_id FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND (event_type = 'purchase' OR event_type = 'signup' AND CAST(ts AS DATE) >= DATE '2024-01-10' OR value > 90) ORDER BY 1 LIMIT 500""")
def q_paged_union(t: Tables) -> DataFrame:
    """Distinct users of three searches, the first 500."""
    s = _service(t)
    return paged.union_ids([s.where("event_type = 'purchase'"), s.where("event_type = 'signup' AND day >= DATE '2024-01-10'"), s.where("value > 90")], "user_id", 500)


@query("""WITH m AS (SELECT max(CAST(ts AS DATE)) AS mark FROM events WHERE event_type = 'signup'), i AS (SELECT DISTINCT event_id FROM events, m WHERE CAST(ts AS DATE) >= mark - 1 ORDER BY 1 LIMIT 3000),
n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS k FROM i) SELECT CAST(k // 50 AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM n GROUP BY 1""")
def q_fetch_batches(t: Tables) -> DataFrame:
    """Ids since a day before the high-water mark, in batches of 50."""
    s = _service(t)
    mark = s.where("event_type = 'signup'").agg(F.max("day")).first()[0]
    b = paged.batches(paged.ids_by_mode(s, "event_id", "incremental", mark), "event_id")
    return b.select("batch", F.size("ids").cast("long").alias("n"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


#: Lists of the vector index, and those that a search probes at first.
LISTS, PROBES = 16, 12


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) ** 2)) AS BIGINT) AS distance FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM r WHERE rank <= 10""")
def q_ivf_exact(t: Tables) -> DataFrame:
    """The ten nearest vectors by the index, with the lists that the first probes can't rule out."""
    return _near(t, True)


@query()
def q_ivf_search(t: Tables) -> DataFrame:
    """The ten nearest vectors in the lists probed first; tests measure their recall."""
    return _near(t, False)


def _near(t: Tables, exact: bool) -> DataFrame:
    df = t("embeddings")
    index = vector_lists.build(df, "vec_id", "embedding", LISTS)
    if index is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, distance long")
    found = vector_lists.search(index, df.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, PROBES, exact)
    return found.withColumnRenamed("id", "vec_id")


@query("""SELECT user_id, event_id, event_type, value, ts >= TIMESTAMP '2024-01-25' AS updated FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE user_id IS NOT NULL AND (ts < TIMESTAMP '2024-01-20' OR ts >= TIMESTAMP '2024-01-25'))
WHERE k = 1 AND NOT (user_id IN (SELECT user_id FROM events WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-28' AND user_id IS NOT NULL))""")
def q_keyed_table(t: Tables) -> DataFrame:
    """Users' newest events in a keyed table: a load, an upsert run twice, a deletion of the users of some late events."""
    e = t("events").where("user_id IS NOT NULL").select("user_id", "event_id", "event_type", "value", "ts")
    spark, at = e.sparkSession, folder(e)
    order = [F.desc("ts"), F.desc("event_id")]
    keyed.upsert(spark, at, e.where("ts < '2024-01-20'"), "user_id", "load", order, buckets=16)
    late = e.where("ts >= '2024-01-25'").withColumn("updated", F.lit(True))
    for _ in range(2):
        keyed.upsert(spark, at, late, "user_id", "update", order)
    keyed.rewrite(spark, at, e.where("event_type = 'signup' AND ts >= '2024-01-28'").select("user_id"), "user_id", keyed.removed("user_id"), "delete")
    rows = keyed.read(spark, at)
    return rows.select("user_id", "event_id", "event_type", "value", (F.col("updated") if "updated" in rows.columns else F.lit(None)).eqNullSafe(True).alias("updated"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, ts DESC, event_id DESC) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) WHERE k = 1""")
def q_stream_upgrades(t: Tables) -> DataFrame:
    """A keyed table fed by a stream in two runs, in which a purchase stands for a full text; rebuilt from its deltas."""
    e = t("events").where("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("has_text"))
    spark, at = e.sparkSession, folder(e)
    order = sinks.fullest("has_text", "ts", "event_id")
    for k, part in enumerate((e.where("ts < '2024-01-15'"), e.where("ts >= '2024-01-15'"))):
        stateful.staged(part, "ts", f"{at}/in", 2, 2 * k)
        sinks.into_table(stateful.arrivals(spark, f"{at}/in", e.schema), f"{at}/table", "user_id", f"{at}/checkpoint", "events", order, 8)
    rebuilt = keyed.deltas(spark, f"{at}/table")
    return keyed.newest("user_id", order)(None, rebuilt).select("user_id", "event_id", "event_type")


@query("""WITH b AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE l_suppkey END AS supplier, l_extendedprice AS v FROM lineitem), r AS (SELECT supplier, v, row_number() OVER (PARTITION BY supplier ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY supplier) AS n FROM b)
SELECT supplier, CAST(max(n) AS BIGINT) AS n, max(CASE WHEN k = n // 4 THEN v END) AS p25, max(CASE WHEN k = n // 2 THEN v END) AS median, max(CASE WHEN k = CAST(floor(n * 0.95) AS BIGINT) THEN v END) AS p95 FROM r GROUP BY 1""")
def q_hot_order_stats(t: Tables) -> DataFrame:
    """Order statistics where one group has half of all rows."""
    rows = t("lineitem").select(F.when(F.col("l_suppkey") % 2 == 0, F.lit(0).cast("long")).otherwise(F.col("l_suppkey")).alias("supplier"), F.col("l_extendedprice").alias("v"))
    n = F.col("n")
    return selection.picks(rows, ["supplier"], "v", {"p25": F.floor(n / 4), "median": F.floor(n / 2), "p95": F.floor(n * 0.95)})


_PHRASE = "array_to_string(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')[1:2], ' ')"


@query(f"""WITH q AS (SELECT item_id, {_PHRASE} AS phrase FROM benchmark), d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS a, unnest(range(0, len(w))) AS k, w FROM d), b AS (SELECT doc_id, k, a AS one, a || ' ' || w[k + 2] AS two FROM e)
SELECT item_id, doc_id, CAST(count(*) AS BIGINT) AS n_places, CAST(min(k) AS INTEGER) AS first_place FROM b JOIN q ON phrase = two OR phrase = one GROUP BY 1, 2""")
def q_phrase_search(t: Tables) -> DataFrame:
    """Where the first two words of each benchmark item stand together in documents."""
    return _places(t, postings.same)


@query()
def q_stem_search(t: Tables) -> DataFrame:
    """The same by stems; tests hold it against texts read word by word."""
    return _places(t, stem.stem)


def _places(t: Tables, term: Callable[[str], str]) -> DataFrame:
    index = postings.build(t("documents"), "doc_id", "text", term=term)
    found = postings.search(index, postings.phrases(t("benchmark"), "item_id", "text", term, first=2))
    return found.select(F.col("phrase").alias("item_id"), F.col("key").alias("doc_id"), F.size("places").cast("long").alias("n_places"), F.array_min("places").alias("first_place"))


@query("""WITH g AS (SELECT user_id, list(DISTINCT event_type) AS tags FROM events GROUP BY 1) SELECT user_id, len(list_filter(['purchase', 'SIGNUP'], lambda x: list_contains(tags, lower(x)))) > 0 AS found FROM g""")
def q_tag_exists(t: Tables) -> DataFrame:
    """Users of whose event types some is wanted."""
    users = t("events").groupBy("user_id").agg(F.collect_set("event_type").alias("tags"))  # at most the types there are
    found = postings.tagged_with(users, "tags", ["purchase", "SIGNUP"]).select("user_id", F.lit(True).alias("hit"))
    return users.select("user_id").join(found, "user_id", "left").select("user_id", F.coalesce("hit", F.lit(False)).alias("found"))


_TYPES = ["RCT", "review", "meta-analysis", "cohort", "other", "", "systematic_review", "case-control"]
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{label}'" for p, label in a.RETRO_KINDS) + " WHEN contains(low, 'review') AND NOT regexp_matches(low, 'systematic|meta-?analysis') THEN 'narrative_review' WHEN contains(low, 'editorial') THEN 'editorial' END"
_POINTS = lambda x, table, rest: "CASE " + " ".join(f"WHEN {x} = '{k}' THEN {v}e0" for k, v in table.items()) + f" ELSE {rest} END"


@query(f"""WITH p AS (SELECT doc_id, lower({_list(TITLES)}[doc_id % {len(TITLES)} + 1] || ' ' || {_list(JOURNALS)}[doc_id % {len(JOURNALS)} + 1]) AS low, {_list(_TYPES)}[(doc_id // 2) % {len(_TYPES)} + 1] AS old FROM documents), k AS (SELECT *, {_KIND} AS kind FROM p),
n AS (SELECT *, CASE WHEN kind IN ({", ".join(f"'{x}'" for x in a.REPLACING)}) THEN kind WHEN kind = 'narrative_review' AND replace(old, '-', '_') NOT IN ({", ".join(f"'{x}'" for x in a.PRIMARY)}) THEN kind ELSE old END AS new FROM k), l AS (SELECT *, coalesce(kind, new) AS label FROM n)
SELECT doc_id, new AS study_type, label NOT IN ({", ".join(f"'{x}'" for x in a.NOT_BANKED)}) AS eligible, {_POINTS("label", a.STRENGTH, _POINTS("new", a.STRENGTH, "0.3e0"))} AS strength, {_POINTS("label", a.RETRO_POINTS, _POINTS("new", a.RETRO_POINTS, "3.0e0"))} AS reliability, new <> old AS changed FROM l""")
def q_relabel_store(t: Tables) -> DataFrame:
    """Stored records relabelled by title and journal: only buckets of records that change are rewritten."""
    k = F.col("doc_id")
    p = t("documents").select("doc_id", _deal(TITLES, k).alias("title"), _deal(JOURNALS, k).alias("journal"), _deal(_TYPES, F.floor(k / 2)).alias("study_type"))
    spark, at = p.sparkSession, folder(p)
    keyed.upsert(spark, at, p, "doc_id", "load", buckets=16)
    new = a.relabelled(F.col("title"), F.col("journal"), F.col("study_type"))
    changed = keyed.read(spark, at).withColumn("new", new).where("new.study_type <> study_type").select("doc_id", F.col("new.study_type").alias("study_type"), F.lit("retro-canonical").alias("override_source"))
    keyed.rewrite(spark, at, changed, "doc_id", _relabel, "relabel")
    stored = keyed.read(spark, at)
    r = stored.withColumn("new", a.relabelled(F.col("title"), F.col("journal"), F.col("study_type")))
    source = F.col("override_source") if "override_source" in stored.columns else F.lit(None).cast("string")
    return r.select("doc_id", "study_type", "new.eligible", "new.strength", "new.reliability", source.isNotNull().alias("changed"))


def _relabel(old: DataFrame | None, rows: DataFrame) -> DataFrame:
    """The old rows with the new types, marked."""
    news = rows.select("doc_id", F.col("study_type").alias("_type"), "override_source")
    joined = old.drop("override_source").join(news, "doc_id", "left")
    return joined.select("doc_id", "title", "journal", F.coalesce("_type", "study_type").alias("study_type"), "override_source")
