"""URL filters: host rules first, then a classifier over segmented host and path tokens.

Host labels are split into words by a unigram Viterbi search whose word counts come
from the pages' own text, by grouped aggregation over all pages. A multinomial naive
Bayes model, fitted on the pages that a rule judges, scores the words of host and
path of the others.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm import common as c

# Fixed values of the contract.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Substrings up to this length are looked up whole, longer words by their first characters.
PREFIX = 20
SMOOTHING = 0.5


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        h, slash, rest = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def viterbi(label: str, known: dict[tuple[int, int], float], total: float) -> list[str]:
    """The likeliest split; ``known`` maps (start, length) to a word's log probability.

    An unknown word of n characters has log(10 / total) - n log 10. Of equal splits, the one
    with the shortest last word, and so on to the left.
    """
    ending: dict[int, list[tuple[int, float]]] = {}
    for (start, size), p in known.items():
        ending.setdefault(start + size, []).append((start, p))
    best: list[tuple[float, int]] = [(0.0, 0)]
    unknown = (-math.inf, 0)
    for end in range(1, len(label) + 1):
        unknown = max(unknown, (best[end - 1][0] + (end - 1) * math.log(10), end - 1))
        options = [(unknown[0] - end * math.log(10) + math.log(10 / total), unknown[1])]
        best.append(max(options + [(best[start][0] + p, start) for start, p in ending.get(end, ())]))
    out, end = [], len(label)
    while end:
        out.append(label[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


def segmented(labels: DataFrame, words: DataFrame, total: float) -> DataFrame:
    """``label, words`` of distinct ``label``; ``words`` holds ``word, count``.

    Substrings of up to ``PREFIX`` characters are looked up themselves, longer words by their
    first ``PREFIX`` characters, so rows grow with a label's length, whatever that is.
    """
    at = labels.select("label", F.explode(F.sequence(F.lit(1), F.length("label"))).alias("s"))
    grid = at.select("label", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(PREFIX), F.length("label") - F.col("s") + 1))).alias("n"))
    short = grid.select("label", (F.col("s") - 1).alias("start"), F.col("n").alias("size"), F.expr("substring(label, s, n)").alias("word")).join(words, "word").drop("word")
    more = words.where(F.length("word") > PREFIX).withColumn("head", F.substring("word", 1, PREFIX))
    heads = at.select("label", "s", F.expr(f"substring(label, s, {PREFIX})").alias("head")).where(F.length("head") == PREFIX)
    long = heads.join(more, "head").where(F.expr("substring(label, s, length(word)) = word")).select("label", (F.col("s") - 1).alias("start"), F.length("word").alias("size"), "count")
    known = short.unionByName(long).groupBy("label").agg(F.collect_list(F.struct("start", "size", F.log(F.col("count") / total).alias("p"))).alias("known"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("label").to_pylist(), batch.column("known").to_pylist(), strict=True)
            out = [viterbi(x, {(k["start"], k["size"]): k["p"] for k in known or []}, total) for x, known in rows]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.list_(pa.string()))], names=["label", "words"])

    return labels.join(known, "label", "left").mapInArrow(apply, "label string, words array<string>")


def judge(pages: DataFrame, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, score, host_words`` of every row of ``pages``.

    ``score`` is the classifier's log odds of block, above 0 for block; the verdict is
    the rule's where one fits. If rules judged pages of one verdict only, that is the
    classifier's; if none, it allows. A null url, or one without ``://``, has an empty
    host and path. Null ids and repeated rows are judged like others; no rows, no rows.
    """
    host, path = parts(F.col(url))
    df = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("_row"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    tokens = F.filter(F.split(F.lower("path"), "[^a-z0-9]+"), lambda x: x != "")
    df = c.cut(df.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("tokens", F.transform(tokens, lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("#")).otherwise(x))))

    plain = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(F.lower(plain), "[^a-z0-9]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("count"))
    words = c.cut(words)
    total = float(words.agg(F.sum("count")).first()[0] or 1)
    by_label = c.cut(df.select("host").distinct().select("host", F.posexplode(F.split("host", r"\.")).alias("place", "label")).where("label <> ''"))
    split = c.cut(segmented(by_label.select("label").distinct(), words, total))
    hosts = c.hot_join(by_label, split, "label").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "words"))), lambda x: x["words"])).alias("host_words"))
    df = c.hot_join(df, c.cut(hosts), "host", "left").withColumn("host_words", F.coalesce("host_words", F.array().cast("array<string>")))

    df = c.cut(df)
    each = df.select("_row", "ruled", F.explode(F.concat(F.transform("host_words", lambda x: F.concat(F.lit("h:"), x)), F.transform("tokens", lambda x: F.concat(F.lit("p:"), x)))).alias("token"))
    is_block, is_allow = (F.col("ruled") == "block").cast("long"), (F.col("ruled") == "allow").cast("long")
    counts = c.cut(each.where("ruled IS NOT NULL").groupBy("token").agg(F.sum(is_block).alias("b"), F.sum(is_allow).alias("a")))
    b, a, v = counts.agg(F.sum("b"), F.sum("a"), F.count("*")).first()
    blocked, allowed = df.agg(F.sum(is_block), F.sum(is_allow)).first()
    b, a, blocked, allowed = (float(x or 0) for x in (b, a, blocked, allowed))
    prior = math.log(blocked / allowed) if blocked and allowed else (1.0 if blocked else -1.0)
    log = lambda k, n: F.log((F.col(k) + SMOOTHING) / (n + SMOOTHING * (v + 1)))
    weight = counts.select("token", (log("b", b) - log("a", a) if blocked and allowed else F.lit(0.0)).alias("w"))
    unseen = math.log((a + SMOOTHING * (v + 1)) / (b + SMOOTHING * (v + 1))) if blocked and allowed else 0.0
    scores = c.hot_join(each, c.cut(weight), "token", "left").groupBy("_row").agg(F.sum(F.coalesce("w", F.lit(unseen))).alias("w"))
    out = df.join(scores, "_row", "left").withColumn("score", F.round(F.lit(prior) + F.coalesce("w", F.lit(0.0)), 9))
    verdict = F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", F.array_join("host_words", " ").alias("host_words"))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """The judgement of every page; null ids and repeated rows are judged like others."""
    return judge(c.table(spark, sf_dir, "pages"), RULES)
