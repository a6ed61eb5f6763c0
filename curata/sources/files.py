"""JSON-lines sources and sinks, versioned snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one of our own only where unset and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="curata-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: For tables with rows of some MB: Parquet's row groups of about 8 MB, measured after each row, not only after 100.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4"}


def cut(df: DataFrame, large_rows: bool = False) -> DataFrame:
    """``df`` without its lineage, written in the shared folder and read again; with ``large_rows``, in row groups of few rows."""
    path = f"{shared_dir(df.sparkSession)}/curata-{uuid.uuid4().hex}"
    df.write.options(**(LARGE_ROWS if large_rows else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _filesystem(spark, path)
    return fs.exists(where)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """Rows of JSON lines, plain or gzipped. Bad lines are dropped, or an error if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_store(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.json") -> DataFrame:
    """Documents of one file each in nested shard folders."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("multiLine", "true").json(path)


def write_jsonl(df: DataFrame, path: str, compression: str | None = None) -> None:
    df.write.mode("overwrite").option("compression", compression or "none").json(path)


def write_snapshot(df: DataFrame, path: str, run_id: str) -> None:
    """A run's rows as a partition of the table at ``path``; the newest partition is the latest run."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("recursiveFileLookup", "false").parquet(path)
    newest = df.agg(F.max(F.col("run_id").cast("string"))).first()[0]
    return df.where(F.col("run_id").cast("string") == newest)


def expired(runs: DataFrame, keep: int = 8) -> DataFrame:
    """Run ids beyond the newest ``keep``."""
    newest = runs.select("run_id").distinct().orderBy(F.desc("run_id")).limit(keep)
    return runs.select("run_id").distinct().join(newest, "run_id", "left_anti")


def prune(spark: SparkSession, path: str, keep: int = 8) -> list[str]:
    """Delete the partitions of all but the newest ``keep`` runs of the table at ``path``; returns their ids."""
    old = sorted(str(r[0]) for r in expired(spark.read.parquet(path).select(F.col("run_id").cast("string").alias("run_id")), keep).collect())
    for run in old:
        fs, where = _filesystem(spark, f"{path}/run_id={run}")
        fs.delete(where, True)
    return old
