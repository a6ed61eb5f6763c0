"""A paged search service as a data source: pages of JSON by day, read in planned slices.

The service knows for each day how many hits it has and in how many pages; a page is asked
for by day and number. The reader turns filters on the day into a range of days, and that
into slices: pages in turn while all hits are below ``simple``, else days of about
``target`` hits, cut again where they hold more, ``depth`` times at most; days that
still hold more are cut by pages. So no request is for much more than ``target`` hits, and
days out of the range are not looked at. A task makes one request, or several in turn
where there are more than ``TASKS``; it holds a file's rows at a time.

A file holds pages of a day in a row: that of its folder's number, and others, whose rows
have their own in ``PAGE``.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyarrow import json as arrow_json
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

from curata.sources.files import cut

SIMPLE, TARGET, DEPTH = 9_999, 8_000, 3
#: Tasks of a read, at most, and rows that a file of several pages holds.
TASKS, FILE_ROWS = 192, 20_000
PAGE = "_page"
_CONTROL = re.compile("[\x00-\x1f\x7f-\x9f]")
DAY = timedelta(days=1)


def stage(df: DataFrame, ts: str, key: str, folder: str, page_rows: int = 200) -> None:
    """Write ``df`` as the service's pages of about ``page_rows`` rows, and its hits by day.

    Rows are dealt to a day's pages by a hash of ``key``; rows without a time are in no page. Pages of about
    ``FILE_ROWS`` rows are written together, so that files don't grow in number with pages.
    """
    dated = df.where(F.col(ts).isNotNull()).withColumn("day", F.to_date(ts))
    hits = dated.groupBy("day").agg(F.count("*").alias("hits")).withColumn("pages", F.ceil(F.col("hits") / page_rows).cast("int"))
    paged = dated.join(F.broadcast(hits.select("day", "pages")), "day")  # one row a day
    together = max(1, FILE_ROWS // page_rows)
    paged = paged.withColumn(PAGE, F.pmod(F.xxhash64(F.col(key)), F.col("pages")).cast("int")).drop("pages").withColumn("page", (F.floor(F.col(PAGE) / together) * together).cast("int"))
    paged.repartition("day", "page").write.partitionBy("day", "page").json(f"{folder}/pages")
    hits.coalesce(1).write.json(f"{folder}/hits")


@dataclass
class Slice(InputPartition):
    """Days and, in the last of them, a range of pages: (day, first page, end)."""

    parts: list[tuple[date, int, int]]


def _open(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return arrow_fs.FileSystem.from_uri(folder)
    return arrow_fs.LocalFileSystem(), folder


def _texts(files: arrow_fs.FileSystem, folder: str, tries: int = 3) -> Iterator[bytes]:
    """A folder's JSON files; a read that fails is tried again."""
    selector = arrow_fs.FileSelector(folder, allow_not_found=True)
    for info in sorted((x for x in files.get_file_info(selector) if x.base_name.endswith(".json")), key=lambda x: x.path):
        for left in reversed(range(tries)):
            try:
                with files.open_input_stream(info.path) as f:
                    text = f.read()
                break
            except OSError:
                if not left:
                    raise
        yield text


def _parsed(text: bytes) -> Iterator[dict]:
    """The rows of a file; control characters are dropped where a line is no JSON."""
    for line in text.decode().split("\n"):
        if line.strip():
            try:
                yield json.loads(line)
            except ValueError:
                yield json.loads(_CONTROL.sub("", line))


def _lines(files: arrow_fs.FileSystem, folder: str) -> Iterator[dict]:
    for text in _texts(files, folder):
        yield from _parsed(text)


def _table(text: bytes, schema: pa.Schema) -> pa.Table:
    """A file's rows; those that Arrow's reader refuses are read line by line."""
    try:
        return arrow_json.read_json(pa.BufferReader(text), arrow_json.ReadOptions(block_size=max(1 << 20, len(text) + 1)), arrow_json.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore"))
    except pa.ArrowInvalid:
        number = {f.name for f in schema if pa.types.is_floating(f.type)}
        rows = [{n: float(r[n]) if n in number and r.get(n) is not None else r.get(n) for n in schema.names} for r in _parsed(text)]
        return pa.Table.from_pylist(rows, schema=schema)


def _numbers(files: arrow_fs.FileSystem, folder: str) -> list[int]:
    """The first pages of a day's files, in order."""
    found = files.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True))
    return sorted(int(x.base_name.removeprefix("page=")) for x in found if x.base_name.startswith("page="))


def together(found: list[Slice], tasks: int) -> list[Slice]:
    """Slices in turn put together, ``tasks`` at most; pages that follow one another become one part."""
    if len(found) <= tasks:
        return found
    out = []
    for k in range(tasks):
        parts: list[tuple[date, int, int]] = []
        for day, first, end in (p for s in found[k * len(found) // tasks : (k + 1) * len(found) // tasks] for p in s.parts):
            if parts and parts[-1][0] == day and parts[-1][2] == first:
                parts[-1] = (day, parts[-1][1], end)
            else:
                parts.append((day, first, end))
        out.append(Slice(parts))
    return out


def slices(hits: dict[date, tuple[int, int]], low: date, high: date, simple: int = SIMPLE, target: int = TARGET, depth: int = DEPTH) -> list[Slice]:
    """Partitions for the days from ``low`` to ``high``: by pages if there are few hits, else by days."""
    days = sorted(d for d in hits if low <= d <= high)
    total = sum(hits[d][0] for d in days)

    def by_pages(some: list[date]) -> list[Slice]:
        out: list[Slice] = []
        held, size = [], 0
        for d in some:
            n, pages = hits[d]
            step = max(1, math.ceil(pages * target / max(n, 1)))
            for first in range(0, pages, step):
                part = (d, first, min(first + step, pages))
                rows = n * (part[2] - first) // max(pages, 1)
                if held and size + rows > target:
                    out.append(Slice(held))
                    held, size = [], 0
                held.append(part)
                size += rows
        return [*out, *([Slice(held)] if held else [])]

    def by_days(first: date, last: date, level: int) -> list[Slice]:
        some = [d for d in days if first <= d <= last]
        n = sum(hits[d][0] for d in some)
        if not some:
            return []
        if n <= target:
            return [Slice([(d, 0, hits[d][1]) for d in some])]
        if level >= depth or first == last:
            return by_pages(some)
        length = max(1, math.ceil(((last - first).days + 1) / math.ceil(n / target)))
        out, at = [], first
        while at <= last:
            end = min(at + (length - 1) * DAY, last)
            out += by_days(at, end, level + 1)
            at = end + DAY
        return out

    return by_pages(days) if total < simple else by_days(days[0], days[-1], 0)


class PagedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.options = schema, options
        self.low, self.high = date.min, date.max

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            of_day = getattr(f, "attribute", None) == ("day",)
            value = getattr(f, "value", None)
            if of_day and isinstance(f, EqualTo) and value is not None:
                self.low, self.high = max(self.low, value), min(self.high, value)
            elif of_day and isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, value)
            elif of_day and isinstance(f, GreaterThan):
                self.low = max(self.low, value + DAY)
            elif of_day and isinstance(f, LessThanOrEqual):
                self.high = min(self.high, value)
            elif of_day and isinstance(f, LessThan):
                self.high = min(self.high, value - DAY)
            else:
                yield f

    def partitions(self) -> list[Slice]:
        files, folder = _open(self.options["path"])
        hits = {date.fromisoformat(r["day"]): (r["hits"], r["pages"]) for r in _lines(files, f"{folder}/hits")}
        limits = {k: int(self.options[k]) for k in ("simple", "target", "depth") if k in self.options}
        return together(slices(hits, self.low, self.high, **limits), TASKS) or [Slice([])]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        files, folder = _open(self.options["path"])
        schema = to_arrow_schema(self.schema)
        plain = pa.schema([pa.field(f.name, pa.string() if pa.types.is_temporal(f.type) else f.type) for f in schema if f.name != "day"] + [pa.field(PAGE, pa.int32())])
        for day, first, end in partition.parts:
            at = f"{folder}/pages/day={day}"
            numbers = _numbers(files, at)
            least = max((n for n in numbers if n <= first), default=first)
            for page in (n for n in numbers if least <= n < end):
                for text in _texts(files, f"{at}/page={page}"):
                    table = _table(text, plain)
                    own = pc.fill_null(table.column(PAGE), page)
                    table = table.filter(pc.and_(pc.greater_equal(own, first), pc.less(own, end)))
                    days = pa.chunked_array([pa.array([day] * table.num_rows, pa.date32())])
                    columns = [(days if f.name == "day" else table.column(f.name)).cast(f.type) for f in schema]
                    yield from pa.Table.from_arrays(columns, schema=schema).combine_chunks().to_batches()


class PagedSource(DataSource):
    """``spark.read.format("paged").schema(...).option("path", folder)``; the schema has a date column ``day``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: T.StructType) -> PagedReader:
        return PagedReader(schema, self.options)


def read(spark: SparkSession, folder: str, schema: T.StructType | str, **options: int) -> DataFrame:
    """The rows of a service's pages; filters on ``day`` reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    reader = spark.read.format("paged").schema(schema)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.option("path", folder).load()


def union_ids(searches: list[DataFrame], key: str, cap: int | None = None) -> DataFrame:
    """Distinct keys of all searches, the smallest ``cap`` of them (all, if None)."""
    out = searches[0].select(key)
    for s in searches[1:]:
        out = out.union(s.select(key))
    out = out.where(F.col(key).isNotNull()).distinct()
    return out if cap is None else out.orderBy(key).limit(cap)


def ids_by_mode(rows: DataFrame, key: str, mode: str, mark: date | None = None, since: date = date(1990, 1, 1), cap: int = 3000) -> DataFrame:
    """Keys to fetch: all ``since`` a date at first, later those from a day before ``mark`` on, ``cap`` at most."""
    if mode == "bootstrap" or mark is None:
        return union_ids([rows.where(F.col("day") >= F.lit(since))], key)
    return union_ids([rows.where(F.col("day") >= F.lit(mark - DAY))], key, cap)


def batches(ids: DataFrame, key: str, size: int = 50) -> DataFrame:
    """``batch, ids``: sorted keys in lists of ``size``, as a service takes them.

    Keys are numbered within ranges that Spark deals out, and a range's first number is the
    count of the ranges before, so no task sees all keys.
    """
    ranged = cut(ids.select(key).distinct().repartitionByRange(key).select(key, F.spark_partition_id().alias("_part")))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("before"))  # one row a range
    at = ranged.withColumn("_place", place).join(F.broadcast(before), "_part").select(key, (F.col("before") + F.col("_place")).alias("_at"))
    return at.groupBy(F.floor(F.col("_at") / size).alias("batch")).agg(F.array_sort(F.collect_list(key)).alias("ids"))
