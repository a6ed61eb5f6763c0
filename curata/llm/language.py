"""Language identification by Bayesian fusion of evidence.

The text's likelihood comes from a byte-trigram model counted over all labelled
texts. To it are added the likelihood of the language that the markup declares, that
of the address's suffix, and a prior of the host, smoothed towards its domain's and
that towards the whole collection's. Those three are learnt without labels, by
grouped aggregation of the texts' own posteriors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm import common as c
from curata.llm.urls import parts

BUCKETS = 1 << 13
#: Most languages a model may have; more are an error, as each is a column.
LANGUAGES = 256
#: Pseudo-counts of a parent's prior, and of a declaration's or suffix's table.
ALPHA, BETA = 8.0, 1.0
#: Trigrams overlap, so a text's evidence grows with the log of its length past this many.
SCALE = 20.0
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_TAGS = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>")


def _trigrams(texts: pa.Array, markup: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket and row of each text's trigrams of letters and single spaces' worth of anything else."""
    data, offsets = c.utf8(texts)
    if markup is not None and markup.any():
        raw = data.tobytes()
        cleaned = [_TAGS.sub(b" ", raw[s:e]) if m else raw[s:e] for s, e, m in zip(offsets[:-1], offsets[1:], markup, strict=True)]
        data, offsets = np.frombuffer(b"".join(cleaned), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in cleaned])])
    n = len(offsets) - 1
    rows = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    low = _FOLD[data]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32) | (rows[1:] != rows[:-1])
    low, rows = low[keep].astype(np.uint32), rows[keep]
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), n
    same = rows[2:] == rows[:-2]
    code = (low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - 13)
    return code[same].astype(np.int64), rows[2:][same], n


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (language by bucket) from every labelled text of ``docs``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in c.slices(whole, "text"):
                code, rows, n = _trigrams(batch.column("text"))
                names, which = np.unique(np.array(batch.column("lang").to_pylist(), dtype=str), return_inverse=True)
                counts = np.bincount(which[rows] * BUCKETS + code, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for name, x in zip(names.tolist(), counts, strict=True):
                    total[name] = total.get(name, 0) + x
        for name, x in sorted(total.items()):
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(x[at], pa.int64())], names=["lang", "bucket", "n"])

    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = labelled.mapInArrow(apply, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang = c.cut(counts)
    names = sorted(r[0] for r in by_lang.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    table = np.full((max(1, len(names)), BUCKETS), 0.5)
    for name, bucket, n in by_lang.collect():  # at most LANGUAGES * BUCKETS rows
        table[names.index(name), bucket] += n
    return names or ["und"], np.log(table / table.sum(1, keepdims=True))


def _named(prefix: str, n: int) -> list[str]:
    return [f"_{prefix}{k}" for k in range(n)]


def _normal(columns: list[Column]) -> list[Column]:
    top = F.greatest(*columns) if len(columns) > 1 else columns[0]
    weights = [F.exp(x - top) for x in columns]
    total = sum(weights[1:], weights[0])
    return [w / total for w in weights]


def identify(rows: DataFrame, names: list[str], table: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` with ``lang``, ``posterior``, ``text_lang`` and ``declared``.

    ``rows`` holds ``_text``, ``_markup`` (whether it is HTML), ``_declared``, ``_host`` and
    ``_suffix``. Missing evidence (null or empty) says nothing; a row with none, as a null
    text without address, gets the collection's commonest language. Ties go to the first
    language by name. Rows are kept as they are, repeated ones and null ids included.
    """
    n = len(names)
    like, post = _named("l", n), _named("p", n)
    schema = rows.select(*keep, "_declared", "_host", "_suffix").schema
    for x in like:
        schema = schema.add(x, "double")
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in c.slices(whole, "_text"):
                code, row, m = _trigrams(batch.column("_text"), np.asarray(batch.column("_markup").to_numpy(zero_copy_only=False), bool))
                size = np.bincount(row, minlength=m)
                factor = SCALE * np.log1p(size / SCALE) / np.maximum(1, size)
                scores = [np.bincount(row, weights=t[code], minlength=m) * factor for t in sent.value]
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in schema.names[:-n]), *map(pa.array, scores)], names=schema.names)

    df = rows.select(*keep, "_declared", "_host", "_suffix", F.coalesce("_text", F.lit("")).alias("_text"), "_markup").mapInArrow(apply, schema)
    df = c.cut(df.select("*", *[p.alias(x) for p, x in zip(_normal([F.col(x) for x in like]), post, strict=True)]))

    sums = [F.sum(x).alias(x) for x in post]
    whole = [float(x or 0) for x in df.agg(*sums).first()]
    base = [(x + 1) / (sum(whole) + n) for x in whole]
    # The host's domain is its last two labels; both levels come from one grouping by host.
    domain = F.regexp_extract("_host", r"([^.]*\.)?[^.]*$", 0)
    by_host = c.cut(df.where("_host <> ''").groupBy("_host").agg(*sums, F.count("*").alias("_n")).withColumn("_domain", domain))
    by_domain = by_host.groupBy("_domain").agg(*[F.sum(x).alias(f"{x}d") for x in post], F.sum("_n").alias("_nd"))
    prior = by_host.join(by_domain, "_domain").select("_host", *[((F.col(x) + ALPHA * (F.col(f"{x}d") + ALPHA * b) / (F.col("_nd") + ALPHA)) / (F.col("_n") + ALPHA)).alias(f"{x}h") for x, b in zip(post, base, strict=True)])
    df = c.hot_join(df, c.cut(prior), "_host", "left")
    for key in ("_declared", "_suffix"):  # P(value | language), against the value's share
        seen = c.cut(df.where(F.col(key) != "").groupBy(key).agg(*sums))
        totals = [float(x or 0) for x in seen.agg(*sums, F.count("*")).first()]
        values = totals.pop()
        df = df.join(seen.select(key, *[F.log((F.col(x) + BETA) / (t + BETA * (values + 1))).alias(f"{x}{key}") for x, t in zip(post, totals, strict=True)]), key, "left")
    nothing = F.lit(0.0)
    fused = [F.col(x) + F.log(F.coalesce(F.col(f"{p}h"), F.lit(b))) + F.coalesce(F.col(f"{p}_declared"), nothing) + F.coalesce(F.col(f"{p}_suffix"), nothing) for x, p, b in zip(like, post, base, strict=True)]
    df = df.select(*keep, "_declared", *post, *[f.alias(x) for f, x in zip(_normal(fused), _named("f", n), strict=True)])
    first = lambda columns: F.element_at(F.array(*map(F.lit, names)), F.array_position(F.array(*columns), F.array_max(F.array(*columns))).cast("int"))
    return df.select(*keep, first(_named("f", n)).alias("lang"), F.array_max(F.array(*_named("f", n))).alias("posterior"), first(post).alias("text_lang"), F.col("_declared").alias("declared"))


def pages_as_rows(pages: DataFrame) -> DataFrame:
    host, _ = parts(F.col("url"))
    declared = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), F.col("html").alias("_text"), F.lit(True).alias("_markup"),
        F.coalesce(declared, F.lit("")).alias("_declared"), host.alias("_host"), F.regexp_extract(host, r"[^.]*$", 0).alias("_suffix"),
    )


def documents_as_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("text").alias("_text"), F.lit(False).alias("_markup"), F.lit("").alias("_declared"), F.coalesce("source", F.lit("")).alias("_host"), F.lit("").alias("_suffix"))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document (``doc_id``; its source is its host) and every page (``page_id``)."""
    docs = c.table(spark, sf_dir, "documents")
    names, model = train(docs)
    rows = documents_as_rows(docs).unionByName(pages_as_rows(c.table(spark, sf_dir, "pages")))
    return identify(rows, names, model, ["doc_id", "page_id"])
