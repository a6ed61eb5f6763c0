"""Tags from dictionaries of patterns: one pass of an automaton over a text, then its few candidates.

Each pattern has strings of which one is in all that it matches. All strings of a dictionary
go into one automaton, so that a text is read once whatever the number of patterns, and
only the patterns whose strings it holds are tried, at exact positions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from re import _constants as sre
from re import _parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _best(found: list[frozenset[str] | None]) -> frozenset[str] | None:
    """The set whose shortest string is longest, of fewest strings."""
    return max((x for x in found if x), key=lambda x: (min(map(len, x)), -len(x)), default=None)


def _needed(parsed: _parser.SubPattern) -> frozenset[str] | None:
    found: list[frozenset[str] | None] = []
    run = ""
    for kind, value in parsed:
        if kind is sre.LITERAL:
            run += chr(value)
            continue
        if kind is sre.AT:
            continue
        found.append(frozenset([run]) if run else None)
        run = ""
        if kind is sre.SUBPATTERN:
            found.append(_needed(value[-1]))
        elif kind is sre.BRANCH:
            each = [_needed(x) for x in value[1]]
            found.append(frozenset().union(*each) if all(each) else None)
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
            found.append(_needed(value[2]))
    found.append(frozenset([run]) if run else None)
    return _best(found)


def folded(text: str) -> str:
    """Lower case, with the letters that patterns without case take for s and i."""
    return text.lower().replace("ſ", "s").replace("ı", "i")


def needed(pattern: str) -> frozenset[str] | None:
    """Lower-case strings of which any match, case ignored, holds one; None if none can be told."""
    found = _needed(_parser.parse(pattern, re.IGNORECASE))
    return None if found is None else frozenset(map(folded, found))


class Dictionary:
    """Labels with patterns, case ignored, and the automaton of the strings that the patterns need."""

    def __init__(self, table: dict[str, list[str]]):
        self.patterns = [(label, re.compile(p, re.IGNORECASE)) for label, group in table.items() for p in group]
        self.always, by_string = [], {}
        for k, (_, p) in enumerate(self.patterns):
            strings = needed(p.pattern)
            if strings is None:
                self.always.append(k)
            for s in strings or ():
                by_string.setdefault(s, set()).add(k)
        self.machine = ahocorasick.Automaton()
        for s, held in by_string.items():
            self.machine.add_word(s, held)
        if by_string:
            self.machine.make_automaton()

    def candidates(self, text: str) -> list[int]:
        """Numbers, in order, of the patterns that may match."""
        found = set(self.always)
        if len(self.machine):
            for _, held in self.machine.iter(folded(text)):
                found |= held
        return sorted(found)


def tags_of(text: str, is_trial: bool, d: Dictionary, context: list[str], reach: int) -> list[str]:
    """Labels of which a pattern's first match is near a word of ``context``, or that match in a trial; sorted."""
    t, out = text.lower(), set()
    for k in d.candidates(t):
        label, pattern = d.patterns[k]
        if label not in out and (m := pattern.search(t)):
            if is_trial or any(w in t[max(0, m.start() - reach) : m.end() + reach] for w in context):
                out.add(label)
    return sorted(out)


def goal_of(text: str, d: Dictionary, metric: re.Pattern, preferred: list[tuple[str, str]], cues: list[str], reach: int) -> str:
    """The first preferred goal of which a match stands near a word of ``metric``; else by ``cues``, else general."""
    low = text.lower()
    joined = re.sub(r"\W+", " ", low)
    near: set[str] = set()
    for k in d.candidates(joined):
        label, pattern = d.patterns[k]
        if label not in near and any(metric.search(joined[max(0, m.start() - reach) : m.end() + reach]) for m in pattern.finditer(joined)):
            near.add(label)
    for goal, shown in preferred:
        if goal in near:
            return shown
    return "performance" if any(c in low for c in cues) else "general"


def labels_of(text: str, d: Dictionary) -> list[str]:
    """Labels of which any pattern is found, in the dictionary's order."""
    out: dict[str, None] = {}
    for k in d.candidates(text):
        label, pattern = d.patterns[k]
        if label not in out and pattern.search(text):
            out[label] = None
    return list(out)


def _mapped(df: DataFrame, columns: list[str], name: str, kind: str, of: Callable[..., object]) -> DataFrame:
    """``df`` with ``name`` from ``of``, which takes the values of ``columns``; a column of that name is replaced."""
    keep = [x for x in df.columns if x.lower() != name.lower()]
    schema = df.select(*keep).withColumn(name, F.lit(None).cast(kind)).schema
    arrow = {"string": pa.string(), "array<string>": pa.list_(pa.string())}[kind]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([of(*v) for v in values], arrow)], names=schema.names)

    return df.mapInArrow(apply, schema)


def tagged(df: DataFrame, text: str, is_trial: str, table: dict[str, list[str]], context: list[str], reach: int = 100, name: str = "tags") -> DataFrame:
    """``df`` with the sorted tags of each text; a null text has none, a null ``is_trial`` is false.

    Of each pattern only the first match counts: within ``reach`` characters of it a word of
    ``context`` must stand, unless the row is a trial.
    """
    d = Dictionary(table)
    return _mapped(df, [text, is_trial], name, "array<string>", lambda t, trial: tags_of(t or "", bool(trial), d, context, reach))


def window_goals(df: DataFrame, text: str, table: dict[str, list[str]], metric: str, preferred: list[tuple[str, str]], cues: list[str], reach: int = 60, name: str = "goal") -> DataFrame:
    """``df`` with the goal of each text: ties go by the order of ``preferred``; a null text is general.

    Runs of other characters than letters, digits and underscores are one space before patterns are tried.
    """
    d, near = Dictionary(table), re.compile(metric, re.IGNORECASE)
    return _mapped(df, [text], name, "string", lambda t: goal_of(t or "", d, near, preferred, cues, reach))


def found(df: DataFrame, text: str, tables: dict[str, dict[str, list[str]]], name: str = "found") -> DataFrame:
    """``df`` with ``table|label`` of every label, in order of tables and labels, of which a pattern is found; a null text has none.

    All tables are looked up in one pass over the text.
    """
    d = Dictionary({f"{t}|{label}": patterns for t, table in tables.items() for label, patterns in table.items()})
    return _mapped(df, [text], name, "array<string>", lambda t: labels_of(t or "", d))


def of_table(found: Column, table: str) -> Column:
    """The labels of one table among ``found``."""
    prefix = f"{table}|"
    return F.transform(F.filter(found, lambda x: x.startswith(prefix)), lambda x: F.substring(x, len(prefix) + 1, 1000))
