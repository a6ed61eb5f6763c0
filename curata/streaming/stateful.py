"""Keyed state over streams: quotas that reset, and keys seen before.

State lives in the engine's state store and in the checkpoint, so a stream that was stopped,
or lost executors, goes on where it was. Rows of one micro-batch are taken by time; rows of a
later batch count after those of earlier ones. The session must use the RocksDB state store
(``PROVIDER``), which needs no executor's memory for state.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

DAY = 86_400_000_000  # microseconds
_MICROS = "micros_"


class Quota(StatefulProcessor):
    """The first ``limit`` uses of each period; a use more than ``days`` after a period's start begins the next.

    A user's state is one row: start and number of the period, uses in it.
    """

    def __init__(self, user: str, ts: str, key: str, limit: int, days: int):
        self.user, self.ts, self.key, self.limit, self.length = user, ts, key, limit, days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("period", "start long, period int, used int")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        start, period, used = self.state.get() or (None, 0, 0)
        for r in sorted(rows, key=lambda r: (r[self.ts], r[self.key])):
            if start is None or r[self.ts] > start + self.length:
                start, period, used = r[self.ts], period + 1, 0
            used += 1
            if used <= self.limit:
                yield Row(**{self.key: r[self.key], self.user: key[0], "period": period, "used": used})
        self.state.update((start, period, used))

    def close(self) -> None:
        pass


class Seen(StatefulProcessor):
    """Each key's first row; a key is forgotten ``days`` after its last sight, by event-time timer."""

    def __init__(self, ts: str, columns: list[str], order: str, days: int):
        self.ts, self.columns, self.order, self.keep = ts, columns, order, days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("until", "until long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        # A call to the state store is the cost of a key, so there are few: a known key's timer stays, and is set anew when it rings early.
        known = self.state.get()
        ordered = sorted(rows, key=lambda r: (r[self.ts], r[self.order]))
        until = ordered[-1][self.ts] + self.keep
        if not known:
            yield Row(**{c: ordered[0][c] for c in self.columns})
            self.handle.registerTimer(until // 1000 + 1)
        if not known or until > known[0]:
            self.state.update((until,))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        known = self.state.get()
        if known and known[0] // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        elif known:
            self.handle.registerTimer(known[0] // 1000 + 1)
        return iter([])

    def close(self) -> None:
        pass


def quota(stream: DataFrame, user: str, ts: str, key: str, limit: int, days: int = 30) -> DataFrame:
    """``key, user, period, used`` of the uses that are allowed; rows with a null user or time aren't.

    A user's rows of one micro-batch are held together in a task, so batches should be bounded.
    """
    known = stream.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).select(user, key, F.unix_micros(F.col(ts).cast("timestamp")).alias(_MICROS))
    kinds = dict(known.dtypes)
    out = f"{key} {kinds[key]}, {user} {kinds[user]}, period int, used int"
    return known.groupBy(user).transformWithState(Quota(user, _MICROS, key, limit, days), out, "Append", "None")


def first_sights(stream: DataFrame, key: str, ts: str, order: str, days: int, delay: str = "1 day") -> DataFrame:
    """The first row of each ``key``, which is not null; later ones are dropped within ``days`` of the last sight.

    State is bounded by the keys of that time: timers of event time clear it as the watermark,
    ``delay`` behind the newest row, passes. Ties in time go to the smaller ``order``.
    """
    known = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    schema = ", ".join(f"`{n}` {t}" for n, t in known.dtypes)
    timed = known.withColumn(_MICROS, F.unix_micros(F.col(ts).cast("timestamp")))
    return timed.groupBy(key).transformWithState(Seen(_MICROS, known.columns, order, days), schema, "Append", "EventTime")


def run(stream: DataFrame, path: str, checkpoint: str, partitions: int | None = None) -> StreamingQuery:
    """Append what is there to the table at ``path``, and stop; the next run resumes from ``checkpoint``.

    The first run fixes the number of state ``partitions``, the session's of shuffles by default.
    """
    spark = stream.sparkSession
    wanted = dict([PROVIDER, ("spark.sql.shuffle.partitions", str(partitions or spark.conf.get("spark.sql.shuffle.partitions")))])
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return query


def staged(df: DataFrame, ts: str, folder: str, parts: int, first: int = 0) -> None:
    """Write ``df`` as ``parts`` arrivals in order of time, a file each, for a stream to read one by one."""
    when = F.col(ts).cast("timestamp").cast("double")
    edges = df.select(F.percentile_approx(when, [k / parts for k in range(1, parts)] or [0.5], 1000)).first()[0] or []
    at = F.lit(0)
    for edge in edges[: parts - 1]:
        at = at + (when > edge).cast("int")
    for k in range(parts):
        df.where(F.coalesce(at, F.lit(0)) == k).coalesce(1).write.mode("append").parquet(f"{folder}/arrival={first + k:03d}")


def arrivals(spark: SparkSession, folder: str, schema: object) -> DataFrame:
    """The stream of staged arrivals, one a micro-batch, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
