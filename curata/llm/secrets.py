"""Secret scans with DataFrame functions only.

Base kinds are regular expressions; positions in code points come from splitting a
text at its matches and summing the lengths of pieces and matches. The method adds
spans of kind ``entropy``: a candidate is a run of ``CANDIDATE`` characters, or what
base spans leave of it, of at least ``WINDOW`` characters. A window of ``WINDOW``
characters slides over each of its character classes' alphabets; its Shannon
entropy comes from counts that change with the character that enters and the one
that leaves. Windows at or above the class's limit, merged, are a span, unless an
allow-list pattern fits the candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm import common as c

# Fixed values of the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: kind, pattern, group whose length counts, least length, quick test that any kept match passes
BASE = [
    ("assign", ASSIGN, 2, 6, r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    ("access", ACCESS, 0, 20, r"AKIA[A-Z0-9]{16}"),
    ("hex", HEX, 0, 24, r"[0-9a-f]{24}"),
]

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: A quick test, once a run: a candidate of interest mixes digits and letters within one run.
MIXED = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20}"
#: Character classes: alphabet of the whole candidate, least bits per character in a window.
CLASSES = [("hex", r"^[0-9a-fA-F]+$", 3.0), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.7)]
#: Allow list: canonical UUIDs, dates and versions, paths of plain words, placeholders, counting runs.
ALLOW = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9=/_+-]+$",
    r"^[A-Za-z/_=+-]*+[0-9]{0,4}$",
    r"(?i)example|sample|placeholder|dummy|xxxx|changeme|your[-_]?",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
]
_SPANS = "array<struct<start:bigint,end:bigint,kind:string>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def _positions(text: Column, pattern: str, group: int, least: int, kind: str) -> Column:
    """Spans of the leftmost non-overlapping matches whose ``group`` has ``least`` characters."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(whole, F.length).alias("len"), F.transform(sized, F.length).alias("size"))
    start = F.struct(F.lit(0).cast("long").alias("at"), _none().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["len"], F.lit(0))
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["size"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def _term(k: Column) -> Column:
    """k log2 k, zero at 0."""
    return F.when(k > 1, k * F.log2(k.cast("double"))).otherwise(F.lit(0.0))


def _hot_windows(run: Column, limit: float) -> Column:
    """Merged [start, end) of the windows of ``run`` (characters) whose entropy reaches ``limit``.

    ``sum`` holds the sum of k log2 k over the window's character counts. A step takes
    out the leaving character (count k: -f(k) + f(k-1)) and puts in the entering one
    (count k: -f(k-1) + f(k)); the counts are those in the window, of fixed width.
    """
    size = F.size(run)
    acc = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(a: Column, i: Column) -> Column:
        inner = F.slice(run, F.greatest(i - WINDOW + 1, F.lit(1)), F.least(i, F.lit(WINDOW)) - 1)
        enter = F.element_at(run, i)
        leave = F.element_at(run, F.greatest(i - WINDOW, F.lit(1)))
        inside = F.size(F.filter(inner, lambda x: x == enter))
        left = F.size(F.filter(inner, lambda x: x == leave))
        total = a["sum"] + _term(inside + 1) - _term(inside) - F.when(i > WINDOW, _term(left + 1) - _term(left)).otherwise(0.0)
        hot = (i >= WINDOW) & (F.lit(WINDOW).cast("double") * (F.log2(F.lit(float(WINDOW))) - limit) >= total - 1e-9)
        last = F.element_at(a["out"], -1)
        joins = (F.size(a["out"]) > 0) & (last["e"] >= i - WINDOW)
        begin = F.when(joins, last["s"]).otherwise(i - WINDOW)
        kept = F.when(joins, F.slice(a["out"], 1, F.greatest(F.size(a["out"]) - 1, F.lit(0)))).otherwise(a["out"])
        out = F.when(hot, F.concat(kept, F.array(F.struct(begin.alias("s"), i.alias("e"))))).otherwise(a["out"])
        return F.struct(total.alias("sum"), out.alias("out"))

    return F.when(size >= WINDOW, F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), acc, step, lambda a: a["out"])).otherwise(acc["out"])


def _entropy_spans(text: Column, taken: Column) -> Column:
    runs = _positions(text, CANDIDATE, 0, WINDOW, "entropy")
    piece = lambda s, e: F.when(e - s >= WINDOW, F.array(F.struct(s.alias("start"), e.alias("end"), F.lit("entropy").alias("kind")))).otherwise(_none())

    def pieces(r: Column) -> Column:
        """What the base spans, which come by start, leave of a run."""
        over = F.filter(taken, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
        step = lambda a, b: F.struct(F.greatest(a["at"], b["end"]).alias("at"), F.concat(a["out"], piece(a["at"], b["start"])).alias("out"))
        return F.aggregate(over, F.struct(r["start"].alias("at"), _none().alias("out")), step, lambda a: F.concat(a["out"], piece(a["at"], r["end"])))

    runs = F.when(F.size(taken) > 0, F.flatten(F.transform(runs, pieces))).otherwise(runs)

    def once(x: Column, f) -> Column:
        """``f`` of a value that is computed once, however often ``f`` reads it."""
        return F.element_at(F.transform(F.array(x), f), 1)

    def judged(r: Column) -> Column:
        return once(F.substring(text, (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int")), lambda s: weighed(r, s))

    def weighed(r: Column, s: Column) -> Column:
        allowed = F.lit(False)
        for pattern in ALLOW:
            allowed = allowed | s.rlike(pattern)
        windows = F.array().cast("array<struct<s:int,e:int>>")
        for _, alphabet, limit in reversed(CLASSES):
            windows = F.when(s.rlike(alphabet), once(F.split(s, ""), lambda run: _hot_windows(run, limit))).otherwise(windows)
        found = F.transform(windows, lambda w: F.struct((r["start"] + w["s"]).alias("start"), (r["start"] + w["e"]).alias("end"), F.lit("entropy").alias("kind")))
        return F.when(allowed | ~s.rlike("[0-9]") | ~s.rlike("[A-Za-z]"), _none()).otherwise(found)

    return F.flatten(F.transform(runs, judged))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed (assign, access, hex, entropy)."""
    rank = lambda x: F.array_position(F.array(*[F.lit(k) for k, *_ in BASE], F.lit("entropy")), x["kind"])
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all, if None) with ``_base`` and ``_spans``: arrays of (start, end, kind).

    Positions are code points, end exclusive. ``_base`` holds the three base kinds,
    ``_spans`` these and the ``entropy`` spans, both by start and kind. Null and empty
    texts have none. Rows are kept as they are, repeated ones and null ids included;
    columns of the two names are replaced.
    """
    keep = [x for x in (docs.columns if keep is None else keep) if x.lower() not in ("_base", "_spans")]
    plain, more = c.unused([*keep, "_base", "_spans"], "_text"), c.unused([*keep, "_base", "_spans"], "_more")
    t = F.col(plain)
    df = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(plain))
    df = df.withColumn("_base", _ordered(F.concat(*[F.when(t.rlike(quick), _positions(t, p, g, least, kind)).otherwise(_none()) for kind, p, g, least, quick in BASE])))
    df = df.withColumn(more, F.when(t.rlike(MIXED), _entropy_spans(t, F.col("_base"))).otherwise(_none()))
    return df.withColumn("_spans", F.when(F.size(more) > 0, _ordered(F.concat("_base", more))).otherwise(F.col("_base"))).drop(more, plain)


def digest(df: DataFrame) -> DataFrame:
    """``find``'s result with counts, ``base_sha256`` and ``spans`` in place of its two arrays."""
    count = lambda k: F.size(F.filter("_base", lambda x: x["kind"] == k)).cast("long")
    return df.select(
        *[x for x in df.columns if x not in ("_base", "_spans")],
        *[count(k).alias(f"n_{k}") for k, *_ in BASE],
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.col("_spans")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span of ``find`` replaced by ``mark`` (overlapping spans as one); null stays null.

    All columns stay, whatever their names.
    """
    base, spans = c.unused(docs.columns, "base_spans"), c.unused(docs.columns, "all_spans")
    names = {x: c.unused(docs.columns, f"kept_{k}") for k, x in enumerate(docs.columns) if x.lower() in ("_base", "_spans")}
    found = find(docs.withColumnsRenamed(names), text).withColumnsRenamed({"_base": base, "_spans": spans}).withColumnsRenamed({v: k for k, v in names.items()})
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(F.col(text), (a["at"] + 1).cast("int"), F.greatest(x["start"] - a["at"], F.lit(0)).cast("int"))
        fresh = x["end"] > a["at"]
        piece = F.when(x["start"] >= a["at"], F.concat(gap, F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(fresh, F.concat(a["out"], piece)).otherwise(a["out"]).alias("out"))

    tail = lambda a: F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), F.length(text)))
    cleaned = F.when(F.size(spans) > 0, F.aggregate(spans, state, step, tail)).otherwise(F.col(text))
    return found.withColumn(text, cleaned).select(*docs.columns)


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document; a null text counts as empty, ids and repeated rows stay as they are."""
    return digest(find(c.table(spark, sf_dir, "documents"), keep=["doc_id"]))
