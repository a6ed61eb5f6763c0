"""Incremental ingestion: high-water marks, deduplication by watermark, appended deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def since(df: DataFrame, ts: str, mark: str, overlap_days: int = 1) -> DataFrame:
    """Rows at or after the mark less an overlap, which deduplication then takes out."""
    return df.where(F.col(ts) >= F.to_timestamp(F.lit(mark)) - F.expr(f"INTERVAL {overlap_days} DAYS"))


def first_seen(stream: DataFrame, ts: str, key: str, delay: str = "1 day") -> DataFrame:
    """A stream with each key once within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def daily_counts(stream: DataFrame, ts: str, kind: str, delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("day"), kind).agg(F.count("*").alias("n"))


def append_deltas(stream: DataFrame, ts: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a table partitioned by day; resumes from its checkpoint."""
    return stream.withColumn("delta_date", F.to_date(ts)).writeStream.format("parquet").partitionBy("delta_date").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
