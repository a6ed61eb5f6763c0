"""Papers to chunks: the abstract first, then the body by its headers.

Texts are normalised by built-in functions; a task then walks each text's lines once and
cuts its sections into windows, so nothing is shuffled and a task holds one batch of texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.functions import articles as a
from curata.functions import text as tx

# Sizes and overlaps of windows in characters, and how much longer than one an abstract may stay whole.
SIZE, OVERLAP, ABSTRACT_SIZE, ABSTRACT_OVERLAP, WHOLE = 2400, 200, 1400, 150, 1.25
LONGEST, CAPITALS = 140, 0.6
# Fixed values of a structured abstract: where it must begin, how far it may reach, and its parts.
TOP, REACH = 1000, 20000
PARTS = ["Background", "Methods", "Results", "Conclusions?"]
_HEADING = [(re.compile(p), label) for p, label in a.HEADINGS]
_PART = [re.compile(rf"(?mi)^\s*{p}\s*:?$") for p in PARTS]
_ABSTRACT = [re.compile(rf"(?m)^\s*{p}\s*:?$") for p in ("Abstract", "ABSTRACT")]
_INTRODUCTION = re.compile(r"(?mi)^\s*(?:\d+\.?\s*)?INTRODUCTION\s*:?\s*$")


@dataclass(frozen=True)
class Headers:
    """What is a header: patterns of sections and of their ends, colons, and common bare headers."""

    target: str
    stop: str
    colon: str
    common: tuple[str, ...]

    def kind(self, line: str) -> bool | None:
        """True for the header of a part that is left out, False for a section's, None for other lines."""
        s = line.strip()
        if not s or len(s) > LONGEST or not self._candidate(s):
            return None
        if s.endswith(":") and "conclusion" in s.lower():
            return False
        if re.fullmatch(self.stop, s, re.IGNORECASE):
            return True
        return False if re.fullmatch(self.target, s, re.IGNORECASE) else None

    def _candidate(self, s: str) -> bool:
        letters = sum(map(str.isalpha, s))
        return bool(
            re.search(f"{self.colon}$", s)
            or s.split(" ", 1)[0].rstrip(".").isdigit()
            or (letters >= 4 and sum(map(str.isupper, s)) >= CAPITALS * letters)
            or s.lower() in self.common
        )

    def of(self, text: str) -> list[tuple[str, int, int, bool]]:
        """Title, start, end (with its newline) and whether it ends a part, for each header."""
        out, at = [], 0
        for line in text.split("\n"):
            end = min(at + len(line) + 1, len(text))
            if (kind := self.kind(line)) is not None:
                out.append((line.strip(), at, end, kind))
            at += len(line) + 1
        return out


def canonical(title: str) -> str:
    low = title.lower()
    return next((label for p, label in _HEADING if p.search(low)), "other")


def windows(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of ``size`` that overlap; the last one ends with the text; none for an empty one."""
    out, at = [], 0
    while at < n:
        out.append((at, min(at + size, n)))
        if at + size >= n:
            break
        at += max(size - overlap, 1)
    return out


def structured_abstract(text: str) -> tuple[int, int] | None:
    """From an abstract's header near the top to the next introduction, if two or more of its parts are in between."""
    begin = next((m for p in _ABSTRACT if (m := p.search(text[:TOP]))), None)
    if begin is None:
        return None
    end = _INTRODUCTION.search(text, begin.start() + 1, min(len(text), begin.start() + REACH))
    if end is None or sum(bool(p.search(text[begin.start() : end.start()])) for p in _PART) < 2:
        return None
    return begin.start(), end.start()


Chunk = tuple[str, str, int, int, str]


def _cut(body: str, title: str, label: str, size: int, overlap: int) -> list[Chunk]:
    return [(title, label, s, e, body[s:e]) for s, e in windows(len(body), size, overlap)]


def _abstract_chunks(text: str) -> list[Chunk]:
    whole = len(text) <= ABSTRACT_SIZE * WHOLE
    return _cut(text, "Abstract", "abstract", len(text) if whole else ABSTRACT_SIZE, 0 if whole else ABSTRACT_OVERLAP)


def chunks_of(abstract: str, body: str, only_abstract: bool, headers: Headers) -> list[Chunk]:
    """Title, section, start and end within the section, and text of each chunk of a paper."""
    out = _abstract_chunks(abstract)
    if only_abstract or not body or (abstract and abstract.strip() == body.strip()):
        return out
    region = structured_abstract(body)
    bare = body
    if region:
        first, last = region
        if not abstract:
            out += _abstract_chunks(body[first:last])
        bare = body[:first] + "\n" * (last - first) + body[last:]
    found = headers.of(bare)
    for k, (title, _, start, ends_part) in enumerate(found):
        stop = found[k + 1][1] if k + 1 < len(found) else len(body)
        label = canonical(title)
        if not ends_part and body[start:stop].strip() and label != "abstract":
            out += _cut(body[start:stop], title, label, SIZE, OVERLAP)
    if not found:
        rest = (body if not region else body[: region[0]] + body[region[1] :]).strip()
        out += _cut(rest, "Body", "other", SIZE, OVERLAP)
    return out


def chunked(df: DataFrame, key: str, abstract: str, body: str, only_abstract: str, headers: Headers) -> DataFrame:
    """``key, place, section, section_norm, start, end, text, doc_kind, eligible``: the chunks of each paper in order.

    Abstract and body are normalised and lose their citation marks first; nulls are empty, and a paper without
    either has no chunks. Lines end with newlines only. Papers without methods and results are
    narrative reviews if they have an abstract, introduction or discussion and three chunks; those without
    results aren't eligible. A null ``only_abstract`` is false.
    """
    clean = lambda c: tx.without_citations(tx.normalized(F.col(c)))
    kind = dict(df.dtypes)[key]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                rows, out = [], []
                for row, (x, y, only) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "o")), strict=True)):
                    found = chunks_of(x, y, bool(only), headers)
                    labels = {c[1] for c in found}
                    review = not labels & {"methods", "results"} and bool(labels & {"abstract", "introduction", "discussion"}) and len(found) >= 3
                    out += [(place, *c, "narrative_review" if review else None, "results" in labels) for place, c in enumerate(found)]
                    rows += [row] * len(found)
                columns = [pa.array([c[k] for c in out], t) for k, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64())), *columns], names=["key", "place", "section", "section_norm", "start", "end", "text", "doc_kind", "eligible"])

    made = df.select(F.col(key).alias("key"), clean(abstract).alias("a"), clean(body).alias("b"), F.col(only_abstract).alias("o"))
    schema = f"key {kind}, place int, section string, section_norm string, start long, end long, text string, doc_kind string, eligible boolean"
    return made.mapInArrow(apply, schema).withColumnRenamed("key", key)
