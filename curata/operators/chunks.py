"""Texts to windows, lines to sections, chunks to bundles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entities that pages hold often, ampersands last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def windows(df: DataFrame, text: str, size: int, overlap: int, keep: list[str]) -> DataFrame:
    """``keep, start, end, chunk`` of overlapping windows; an empty text has none."""
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / (size - overlap))).cast("int")
    each = df.where(F.length(text) > 0).select(*keep, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("_k"))
    start = F.col("_k") * (size - overlap)
    return each.select(*keep, start.cast("long").alias("start"), F.least(start + size, F.length("_t")).cast("long").alias("end"), F.substring("_t", start + 1, F.lit(size)).alias("chunk"))


def lines(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep, line_no, start, end, line`` of each line, with offsets in the text; a null text has none.

    A task sums the offsets of each text as it cuts it, so nothing is shuffled.
    """
    out = df.select(*keep).schema.add("line_no", "long").add("start", "long").add("end", "long").add("line", "string")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                cut = [None if t is None else t.split("\n") for t in batch.column("_text").to_pylist()]
                rows = np.repeat(np.arange(len(cut)), [len(x or ()) for x in cut])
                found = [line for x in cut if x for line in x]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                first = np.searchsorted(rows, rows)  # each line's first line of its text
                upto = np.cumsum(sizes + 1)
                start = upto - sizes - 1 - (upto - sizes - 1)[first]
                taken = [batch.column(x).take(pa.array(rows)) for x in keep]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(np.arange(len(rows)) - first), pa.array(start), pa.array(start + sizes), pa.array(found, pa.string())], names=out.names)

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(apply, out)


def article_gate(html: Column, tags: list[str], words: list[str], least: int, hits: int) -> tuple[Column, Column]:
    """The plain text of a page, its elements ``tags`` left out, and whether it passes.

    It passes with ``least`` characters or more that hold at least ``hits`` of ``words``.
    """
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", " ")
    for tag in tags:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    text = F.regexp_replace(text, "<[^>]*>", " ")
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    text = F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))
    found = sum((F.lower(text).contains(w).cast("int") for w in words), F.lit(0))
    return text, (F.length(text) >= least) & (found >= hits)


def headers(each: DataFrame, common: list[str], target: str, stop: str, colon: str, longest: int = 140, capitals: float = 0.6) -> DataFrame:
    """``each`` (``lines``) with ``title`` and ``is_stop``: the lines that are headers.

    A candidate has at most ``longest`` characters, and ends in a colon, or starts with a
    number as a word, or is in capitals for the share ``capitals`` of four letters or more,
    or is one of ``common``. It is a header if it fits ``stop`` or ``target`` as a whole,
    or names a conclusion before a colon. Patterns ignore case.
    """
    s = F.col("title")
    letters, upper = F.length(F.regexp_replace(s, r"\P{L}", "")), F.length(F.regexp_replace(s, r"\P{Lu}", ""))
    candidate = s.rlike(f"{colon}$") | s.rlike(r"^[0-9]+\.*( |$)") | ((letters >= 4) & (upper >= capitals * letters)) | F.lower(s).isin(common)
    fits = lambda pattern: s.rlike(rf"(?i)^(?:{pattern})$")
    is_stop = F.when(s.endswith(":") & F.lower(s).contains("conclusion"), False).when(fits(stop), True).when(fits(target), False)
    titled = each.withColumn("title", F.regexp_replace("line", r"^\s+|\s+$", ""))
    return titled.where((F.length(s) > 0) & (F.length(s) <= longest) & candidate).withColumn("is_stop", is_stop).where("is_stop IS NOT NULL")


def sections(headers: DataFrame, key: str, length: str) -> DataFrame:
    """``headers`` (with ``start``) and ``section_end``: the next header's start, or the text's length."""
    return headers.withColumn("section_end", F.coalesce(F.lead("start").over(Window.partitionBy(key).orderBy("start")), F.col(length)))


def bundle(df: DataFrame, keys: list[str], order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """One row per group: texts in order as one, number of parts, length."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), separator)
    return df.groupBy(*keys).agg(joined.alias("text"), F.count("*").alias("n_chunks")).withColumn("char_len", F.length("text").cast("long"))
