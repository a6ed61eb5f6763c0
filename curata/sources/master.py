"""A master table kept in versions: additions beside what is there, deltas by date, state to resume from.

Each version is a folder; a one-row pointer names the current one and is written last, so a
failed run leaves the version before in place, which also serves as the backup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.sources import files


POINTER = "version long, run_id string, date string, added long, size_before long, size_after long, mark string"


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the current version, or None before the first."""
    if not files.exists(spark, f"{path}/pointer"):
        return None
    return spark.read.parquet(f"{path}/versions/{pointer(spark, path)['version']}")


def pointer(spark: SparkSession, path: str) -> dict:
    """What the newest pointer says: version, run, sizes before and after, high-water mark."""
    return spark.read.schema(POINTER).json(f"{path}/pointer").orderBy(F.desc("version")).first().asDict()


def add(spark: SparkSession, path: str, new: DataFrame, key: str, run_id: str, date: str, mark: str | None = None) -> dict:
    """Add rows of ``new`` whose ``key`` the master lacks, write them as the delta of ``date`` too.

    Of repeated keys in ``new`` one row stays; null keys are left out. Columns that only one
    side has are null on the other. Returns the pointer's row. A ``run_id`` that the pointer
    names already adds nothing, so a run can be repeated after a failure.
    """
    old = current(spark, path)
    state = pointer(spark, path) if old is not None else {"version": 0, "run_id": None, "size_after": 0, "mark": None}
    if state["run_id"] == run_id:
        return state
    fresh = new.where(F.col(key).isNotNull()).dropDuplicates([key])
    if old is not None:
        fresh = fresh.join(old.select(key), key, "left_anti")
    fresh = files.cut(fresh)
    version = state["version"] + 1
    whole = fresh if old is None else old.unionByName(fresh, allowMissingColumns=True)
    whole.write.mode("overwrite").parquet(f"{path}/versions/{version}")
    fresh.write.mode("overwrite").parquet(f"{path}/deltas/delta_date={date}/run={run_id}")
    added = fresh.count()
    row = {"version": version, "run_id": run_id, "date": date, "added": added, "size_before": state["size_after"], "size_after": state["size_after"] + added, "mark": mark or state["mark"]}
    spark.createDataFrame([row], POINTER).coalesce(1).write.mode("append").json(f"{path}/pointer")
    return row


def rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """The deltas that the pointer names as one table: what the master holds, from its history.

    A delta of a run that failed before its pointer was written is not read.
    """
    runs = spark.read.schema(POINTER).json(f"{path}/pointer").select("date", "run_id").distinct().collect()  # one row a run
    return spark.read.option("mergeSchema", "true").parquet(*sorted(f"{path}/deltas/delta_date={r.date}/run={r.run_id}" for r in runs))


def upgrades(master: DataFrame, incoming: DataFrame, key: str, has_text: str) -> DataFrame:
    """Keys that the master holds without a full text and ``incoming`` brings with one."""
    lacking = master.where(~F.coalesce(has_text, F.lit(False))).select(key)
    return incoming.where(F.coalesce(has_text, F.lit(False))).join(lacking, key, "left_semi").select(key).distinct()
