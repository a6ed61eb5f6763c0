"""Streams into keyed tables, each micro-batch once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curata.sources import keyed


def into_table(stream: DataFrame, path: str, key: str, checkpoint: str, name: str, order: list[Column], buckets: int = 64) -> StreamingQuery:
    """Merge what is there into the table at ``path`` and stop; the next run resumes from ``checkpoint``.

    The table keeps the number of the last batch of the stream ``name`` in the manifest that the
    batch's rows come with, so a batch that is run again after a failure adds nothing.
    """

    def apply(rows: DataFrame, number: int) -> None:
        keyed.rewrite(rows.sparkSession, path, rows, key, keyed.newest(key, order), f"{name}-{number}", buckets, name, number)

    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def fullest(has_text: str, ts: str, tie: str) -> list[Column]:
    """An order by which a full text comes before an abstract, then the newer row, then the larger ``tie``."""
    return [F.desc(F.coalesce(F.col(has_text), F.lit(False))), F.desc(ts), F.desc(tie)]


def upgraded(table_before: DataFrame, table_after: DataFrame, key: str, has_text: str) -> DataFrame:
    """Keys that had no full text before and have one now."""
    lacking = table_before.where(~F.coalesce(has_text, F.lit(False))).select(key)
    return table_after.where(F.coalesce(has_text, F.lit(False))).join(lacking, key, "left_semi").select(key)
