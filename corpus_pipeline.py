"""Training-corpus pipeline: quality, near duplicates, decontamination, secrets, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet before the next stage reads it. All but the last return the columns of
``documents``. Extra columns of ``docs`` pass through; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm import bitset, bpe, common, decontaminate, jaccard, quality, secrets


def _kept(docs: DataFrame, names: list[str], mark: Callable[[DataFrame], DataFrame], keep: str) -> DataFrame:
    """Rows of ``docs`` that ``keep`` holds for after ``mark``, which adds or replaces columns ``names``; all columns stay as they were."""
    own = {x: common.unused([*docs.columns, *names], f"kept_{k}") for k, x in enumerate(docs.columns) if x.lower() in names}
    marked = mark(docs.withColumnsRenamed(own)).where(keep)
    return marked.select(*[F.col(own.get(x, x)).alias(x) for x in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this stage's labelled rows, does not reject."""
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return _kept(docs, ["score", "predicted"], lambda d: quality.classify(d, model), "predicted = 1")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str, words: int = jaccard.SHINGLE, percent: int = jaccard.PERCENT) -> DataFrame:
    """The document with the smallest id of each near-duplicate group, and one of repeated rows.

    Groups link texts whose shingles of ``words`` words have a Jaccard of ``percent`` or
    more. Documents without words and rows with a null id are in no group and stay.
    """
    by_id = jaccard.near_duplicates(docs, words=words, percent=percent).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("component_id").alias("component_id"), F.count("*").alias("times"))
    marked = common.cut(by_id.where("component_id < doc_id OR times > 1"))
    out = bitset.without(docs, marked.where("component_id < doc_id"), "doc_id")
    repeated = marked.where("component_id >= doc_id").select("doc_id")
    if repeated.isEmpty():
        return out
    again = docs.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return bitset.without(out, repeated, "doc_id").unionByName(again)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``keep_one_of_each`` on shingles of five words, from a similarity of 0.8."""
    return keep_one_of_each(spark, docs, sf_dir, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    items = common.table(spark, sf_dir, "benchmark")
    return _kept(docs, ["_words", "_hits", "_items"], lambda d: decontaminate.occurrences(d, items), "size(_hits) = 0")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; ``n_chars`` follows the text."""
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every document."""
    return bpe.digests(docs, keep=["doc_id"])


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("tokens", tokenize),
]

#: The classifier and the tokenizer are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what the one before kept: token digests of the documents left."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.cut(docs)
    return docs
