"""Tables by key in hash buckets: a run rewrites only the buckets that its keys fall in.

A run writes the new files of its buckets beside the old ones, then a manifest that names
each bucket's run, under a temporary name that is renamed at the end. Readers take the
newest manifest, so a run that fails before that changes nothing they see, and the files of
the manifest before stay as the backup. The manifest also has the runs that were applied and the last batch
of each stream, so that a repeated run or batch adds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.operators.tables import latest
from curata.sources import files

MANIFEST = "kind string, name string, run string"
Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


def _versions(spark: SparkSession, path: str) -> list[str]:
    if not files.exists(spark, f"{path}/manifest"):
        return []
    fs, where = files._filesystem(spark, f"{path}/manifest")
    return sorted(x.getPath().getName() for x in fs.listStatus(where) if x.getPath().getName().startswith("v"))


def manifest(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """``bucket`` (number to run), ``run`` and ``stream`` (name to last batch) of the newest version; bounded by buckets and runs."""
    out: dict[str, dict[str, str]] = {"bucket": {}, "run": {}, "stream": {}, "option": {}}
    versions = _versions(spark, path)
    if versions:
        for r in spark.read.schema(MANIFEST).json(f"{path}/manifest/{versions[-1]}").collect():
            out[r.kind][r.name] = r.run
    return out


def _commit(spark: SparkSession, path: str, state: dict[str, dict[str, str]]) -> None:
    rows = [(kind, name, run) for kind, held in state.items() for name, run in held.items()]
    temporary = f"{path}/manifest/.writing-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(temporary)
    fs, source = files._filesystem(spark, temporary)
    number = int(_versions(spark, path)[-1][1:]) + 1 if _versions(spark, path) else 1
    _, target = files._filesystem(spark, f"{path}/manifest/v{number:09d}")
    if fs.exists(target) or not fs.rename(source, target):
        raise OSError(f"another run has written version {number} of {path}")


def _paths(path: str, state: dict[str, dict[str, str]], buckets: list[str] | None = None) -> list[str]:
    held = state["bucket"]
    return [f"{path}/data/run={held[b]}/bucket={b}" for b in sorted(held if buckets is None else [b for b in buckets if b in held])]


def _read(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    there = [p for p in paths if files.exists(spark, p)]  # a bucket that lost all rows has no files
    return spark.read.option("mergeSchema", "true").parquet(*there) if there else None


def read(spark: SparkSession, path: str, keys: list[object] | None = None, key: str | None = None) -> DataFrame | None:
    """The table's rows, or those of a few ``keys``, from their buckets only; None before the first run."""
    state = manifest(spark, path)
    if keys is None:
        return _read(spark, _paths(path, state))
    n = int(state["option"]["buckets"])
    kind = dict(_read(spark, _paths(path, state)).dtypes)[key]
    wanted = spark.createDataFrame([(k,) for k in keys], f"k {kind}").select(_bucket(F.col("k"), n).cast("string")).distinct().collect()
    found = _read(spark, _paths(path, state, [r[0] for r in wanted]))
    return None if found is None else found.where(F.col(key).isin(keys))


def _bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def rewrite(spark: SparkSession, path: str, incoming: DataFrame, key: str, merge: Merge, run_id: str, buckets: int = 64, stream: str | None = None, batch: int | None = None) -> bool:
    """Give the buckets of ``incoming``'s keys the rows that ``merge`` makes of their old rows and ``incoming``.

    Null keys are left out. False, and no change, if ``run_id`` was applied before or ``stream`` is past ``batch``.
    The first run fixes the number of ``buckets``; choose it so that a bucket's rows fit a task.
    """
    state = manifest(spark, path)
    if run_id in state["run"] or (stream is not None and int(state["stream"].get(stream, "-1")) >= batch):
        return False
    n = int(state["option"].setdefault("buckets", str(buckets)))
    rows = files.cut(incoming.where(F.col(key).isNotNull()))
    touched = [r[0] for r in rows.select(_bucket(F.col(key), n).cast("string")).distinct().collect()]
    old = _read(spark, _paths(path, state, touched))
    place = f"{run_id}-{uuid.uuid4().hex[:8]}"  # a failed run's files are never taken for another's
    made = merge(old, rows).withColumn("bucket", _bucket(F.col(key), n))
    made.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/run={place}")
    rows.write.parquet(f"{path}/deltas/run={place}")
    state["bucket"] |= dict.fromkeys(touched, place)
    state["run"][run_id] = place
    if stream is not None:
        state["stream"][stream] = str(batch)
    _commit(spark, path, state)
    return True


def newest(key: str, order: list[Column], stamp: str | None = None, at: str | None = None) -> Merge:
    """A merge that keeps, of old and new rows of a key, the first in ``order``; of equals the new one, and one of equal new ones.

    Columns that only one side has are null on the other. ``stamp`` is set to the time ``at`` in new rows.
    """

    def merge(old: DataFrame | None, rows: DataFrame) -> DataFrame:
        new = rows.withColumn("_new", F.lit(1))
        if stamp is not None:
            new = new.withColumn(stamp, F.to_timestamp(F.lit(at)))
        both = new if old is None else old.withColumn("_new", F.lit(0)).unionByName(new, allowMissingColumns=True)
        return latest(both, [key], [*order, F.desc("_new")]).drop("_new")

    return merge


def patched(key: str, columns: list[str]) -> Merge:
    """A merge that sets ``columns`` of old rows where the new row of the key has a value, and adds no rows; new keys are unique."""

    def merge(old: DataFrame | None, rows: DataFrame) -> DataFrame:
        if old is None:
            return rows.limit(0)
        news = rows.select(key, *[F.col(x).alias(f"_{x}") for x in columns])
        return old.join(news, key, "left").select(*[F.coalesce(f"_{x}", x).alias(x) if x in columns else F.col(x) for x in old.columns])

    return merge


def removed(key: str) -> Merge:
    """A merge that drops the old rows of the new keys."""
    return lambda old, rows: rows.limit(0) if old is None else old.join(rows.select(key).distinct(), key, "left_anti")


def upsert(spark: SparkSession, path: str, incoming: DataFrame, key: str, run_id: str, order: list[Column] | None = None, **more: object) -> bool:
    """Add rows, or put them in place of the same key's (see ``newest`` and ``rewrite``)."""
    return rewrite(spark, path, incoming, key, newest(key, order or [F.desc("_new")]), run_id, **more)


def deltas(spark: SparkSession, path: str) -> DataFrame | None:
    """What the applied runs brought, with ``run``; runs that failed are not in it."""
    applied = manifest(spark, path)["run"]
    parts = [spark.read.parquet(f"{path}/deltas/run={place}").withColumn("run", F.lit(run)) for run, place in sorted(applied.items())]
    out = None
    for p in parts:  # one part a run
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def prune(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the files of runs that none of the newest ``keep`` manifests names, and older manifests; returns the runs' folders."""
    versions = _versions(spark, path)
    named: set[str] = set()
    for v in versions[-keep:]:
        named |= {f"run={r.run}" for r in spark.read.schema(MANIFEST).json(f"{path}/manifest/{v}").where("kind = 'bucket'").select("run").distinct().collect()}
    fs, where = files._filesystem(spark, f"{path}/data")
    gone = sorted(x.getPath().getName() for x in fs.listStatus(where) if x.getPath().getName() not in named)
    for folder in [*(f"{path}/data/{g}" for g in gone), *(f"{path}/manifest/{v}" for v in versions[:-keep])]:
        fs.delete(files._filesystem(spark, folder)[1], True)
    return gone
