"""Row-wise text expressions: normalising, tagging, extraction, keys. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """Unix newlines, at most two in a row, runs of blanks as one, trimmed; null is empty."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(x, r"[ \t]+", " "))


def without_citations(text: Column) -> Column:
    """Bracketed number groups such as [1, 2-4] removed."""
    return F.regexp_replace(text, r"\s*\[\d+(?:\s*[,-]\s*\d+)*\]", "")


def tags(text: Column, families: dict[str, list[str]]) -> Column:
    """Sorted labels of which any pattern is found."""
    found = [F.when(text.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(label)) for label, patterns in sorted(families.items())]
    return F.array_compact(F.array(*found))


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None) -> Column:
    """The label of the first rule whose pattern is found."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def all_numbers(text: Column, pattern: str) -> Column:
    """Integers in group 1 of every match; null for more digits than a long holds."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.try_cast("bigint"))


def largest_number(text: Column, patterns: list[str]) -> Column:
    """The largest integer that any pattern's group 1 gives, null without a match."""
    return F.array_max(F.concat(*[all_numbers(text, p) for p in patterns]))


def largest_in(text: Column, pattern: str) -> Column:
    """The largest integer, as its only digits, of what a pattern matches; null without a match. One pass over the text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_max(F.transform(found, lambda x: F.regexp_extract(x, r"\d+", 0).try_cast("bigint")))


def bracket(value: Column, limits: list[tuple[float, object]], default: object) -> Column:
    """The result of the first limit that ``value`` reaches (limits from high to low)."""
    out = F.lit(default)
    for limit, result in reversed(limits):
        out = F.when(value >= limit, F.lit(result)).otherwise(out)
    return out


def normalized_doi(doi: Column) -> Column:
    x = F.regexp_replace(F.lower(F.trim(doi)), r"^https?://(dx\.)?doi\.org/", "")
    return F.replace(x, F.lit("%2f"), F.lit("/"))


def document_key(pmid: Column, doi: Column, *identity: Column) -> Column:
    """pmid, else doi, else a digest of the identity columns."""
    some = lambda x: F.when(F.trim(x) != "", x)
    digest = F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in identity])), 1, 16)
    return F.coalesce(F.concat(F.lit("pmid_"), some(pmid)), F.concat(F.lit("doi_"), some(doi)), F.concat(F.lit("hash_"), digest))


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a non-empty literal."""
    return F.when(F.length(term) > 0, ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def grade_step(grade: Column, steps: Column) -> Column:
    """``steps`` down the ladder A B C D F, not past F."""
    return F.element_at(F.array(*map(F.lit, "ABCDF")), F.least(F.array_position(F.array(*map(F.lit, "ABCDF")), grade).cast("int") + steps, F.lit(5)))
