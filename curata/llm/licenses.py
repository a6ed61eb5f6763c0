"""License scans by a generalised suffix automaton of template words.

The templates are license notices and texts, and short phrases. ``Machine`` is the smallest
automaton of all their runs of words, with suffix links resolved into a dense table of
transitions. Streaming a text through it gives, at each word, the length of the longest
run of template words that ends there, and so its matching statistics. Runs that can't be
carried on are matches; matches in the same order in text and template, and near each
other in both, are chained into spans, and a span counts where its matches cover enough of
the template. A phrase has an occurrence wherever the run that ends at a word has it as
its last words.

Tasks stream texts in lanes of bounded length side by side, each starting so many words
early that its statistics are those of the whole text.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm import common as c

# The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Widely used license notices and texts, by label.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version.",
    ),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

#: Words of the shortest match that is chained, the most words between chained matches, and the least covered share.
MATCH, GAP, COVER = 3, 12, 0.7
#: A template of fewer words counts that much less in a score.
RELEVANT = 18
LANE = 512


def words(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """All words of the texts, A-Z lower-cased, and the row of each."""
    data, offsets = c.utf8(texts)
    low = c.LOWER[data]
    is_word = c.ALNUM_WORD[low]
    starts, ends, rows = c.spans(is_word, offsets)
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(low[is_word])), rows


@dataclass
class Template:
    label: str
    size: int
    is_phrase: bool


@dataclass
class _State:
    length: int
    link: int
    next: dict[int, int] = field(default_factory=dict)
    #: Last words, as (template, index), of the state's runs.
    ends: set[tuple[int, int]] = field(default_factory=set)


class Machine:
    """The automaton of ``templates`` (label, text) and ``phrases`` (text to label).

    ``target`` and ``base`` are by state and word: the state that a word leads to, and the
    length of run that is left before the word is added; -1 for the base where the run goes on whole.
    """

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        split = lambda t: words(pa.array([t]))[0].to_pylist()
        given = [(label, split(t), False) for label, t in templates] + [(label, split(t), True) for t, label in phrases.items()]
        given = [x for x in given if x[1]]
        self.templates = [Template(label, len(w), p) for label, w, p in given]
        self.vocabulary = pa.array(sorted({x for _, w, _ in given for x in w}), pa.string())
        number = {x: k for k, x in enumerate(self.vocabulary.to_pylist())}
        self.longest = max((t.size for t in self.templates), default=0)
        states = [_State(0, -1)]
        last_of = []
        for t, (_, run, _) in enumerate(given):
            last = 0
            for i, x in enumerate(run):
                last = self._extend(states, last, number[x])
                states[last].ends.add((t, i))
            last_of.append(last)
        order = sorted(range(1, len(states)), key=lambda s: -states[s].length)
        for s in order:
            states[states[s].link].ends |= states[s].ends
        width = len(number)
        self.target = np.zeros((len(states), width), np.int32)
        self.base = np.zeros((len(states), width), np.int32)
        self.base[0] = 0
        for s in sorted(range(len(states)), key=lambda s: states[s].length):
            if s:
                up = states[s].link
                self.target[s] = self.target[up]
                self.base[s] = np.where(self.base[up] < 0, states[up].length, self.base[up])
            for x, to in states[s].next.items():
                self.target[s, x] = to
                self.base[s, x] = -1
        self.ends = [sorted(s.ends) if s.length >= MATCH else [] for s in states]
        #: By state and phrase: whether runs of the state that are as long as the phrase end in it.
        whole = [k for k, x in enumerate(self.templates) if x.is_phrase]
        self.phrases = np.array([self.templates[k].size for k in whole], np.int64)
        self.phrase_labels = [self.templates[k].label for k in whole]
        self.has = np.zeros((len(states), len(whole)), bool)
        self.has[[last_of[k] for k in whole], range(len(whole))] = True
        for s in sorted(range(1, len(states)), key=lambda s: states[s].length):
            self.has[s] |= self.has[states[s].link]

    @staticmethod
    def _extend(states: list[_State], last: int, x: int) -> int:
        """Add word ``x`` after ``last``, and return the state of the whole run so far."""
        found = states[last].next.get(x)
        if found is not None and states[found].length == states[last].length + 1:
            return found

        def copied(p: int, of: int) -> int:
            states.append(_State(states[p].length + 1, states[of].link, dict(states[of].next)))
            new = len(states) - 1
            states[of].link = new
            while p >= 0 and states[p].next.get(x) == of:
                states[p].next[x] = new
                p = states[p].link
            return new

        if found is not None:
            return copied(last, found)
        states.append(_State(states[last].length + 1, 0))
        new, p = len(states) - 1, last
        while p >= 0 and x not in states[p].next:
            states[p].next[x] = new
            p = states[p].link
        if p >= 0:
            q = states[p].next[x]
            states[new].link = q if states[q].length == states[p].length + 1 else copied(p, q)
        return new

    def statistics(self, numbers: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and length of the longest template run that ends at each word.

        ``numbers`` are vocabulary numbers, -1 for other words; ``fresh`` marks first words of texts.
        """
        state = np.zeros(len(numbers), np.int32)
        length = np.zeros(len(numbers), np.int32)
        known = numbers >= 0
        firsts = np.flatnonzero(known & (fresh | ~np.append(False, known[:-1])))
        if not len(firsts):
            return state, length
        stops = np.append(np.flatnonzero(~known | fresh), len(numbers))
        lasts = stops[np.searchsorted(stops, firsts, "right")]
        lanes = -(-(lasts - firsts) // LANE)
        of = np.repeat(np.arange(len(firsts)), lanes)
        part = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        own = firsts[of] + part * LANE
        at = np.maximum(firsts[of], own - self.longest)
        stop = np.minimum(own + LANE, lasts[of])
        s, n = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
        while len(at):
            x = numbers[at]
            base = self.base[s, x]
            to = self.target[s, x]
            n = np.where(to > 0, np.where(base < 0, n, base) + 1, 0).astype(np.int32)
            s = to
            mine = at >= own
            state[at[mine]], length[at[mine]] = s[mine], n[mine]
            at = at + 1
            live = at < stop
            if not live.all():
                at, stop, own, s, n = at[live], stop[live], own[live], s[live], n[live]
        return state, length


@dataclass
class Span:
    """Words ``start`` to ``end`` (exclusive) of a text that hold ``covered`` words of a template."""

    start: int
    end: int
    template: int
    covered: int


def chains(machine: Machine, matches: list[tuple[int, int, int]]) -> list[Span]:
    """Spans of templates that chains of a text's matches (start, length, state) cover enough of.

    A chain's matches rise in text and template, with at most ``GAP`` words between them in each;
    overlaps count once. Of overlapping spans of a template the one that covers more is kept.
    """
    by_template: dict[int, list[tuple[int, int, int]]] = {}
    for start, length, state in matches:
        for t, end in machine.ends[state]:
            if not machine.templates[t].is_phrase and end + 1 >= length:
                by_template.setdefault(t, []).append((start, end + 1 - length, length))
    out = []
    for t, anchors in sorted(by_template.items()):
        size = machine.templates[t].size
        anchors.sort()
        best: list[tuple[int, int]] = []  # covered words and first word of the best chain that ends in each anchor
        for k, (i, j, n) in enumerate(anchors):
            covered, first = n, i
            for p in range(k - 1, -1, -1):
                i0, j0, n0 = anchors[p]
                if i - i0 > GAP + size:  # no match is longer than its template
                    break
                if not (i0 < i and j0 < j and i - (i0 + n0) <= GAP and j - (j0 + n0) <= GAP):
                    continue
                more = best[p][0] + n - max(0, i0 + n0 - i, j0 + n0 - j)
                if more > covered and i0 + n0 < i + n and j0 + n0 < j + n:
                    covered, first = more, best[p][1]
            best.append((covered, first))
        found = [Span(first, i + n, t, min(covered, size)) for (i, j, n), (covered, first) in zip(anchors, best, strict=True) if covered >= COVER * size]
        kept: list[tuple[int, int]] = []  # by start, without overlaps
        for span in sorted(found, key=lambda s: (-s.covered, s.end - s.start, s.start)):
            k = bisect(kept, (span.start, span.end))
            if (k == 0 or kept[k - 1][1] <= span.start) and (k == len(kept) or span.end <= kept[k][0]):
                kept.insert(k, (span.start, span.end))
                out.append(span)
    return sorted(out, key=lambda s: (s.start, s.end, s.template))


def score(machine: Machine, spans: list[Span], places: int) -> float:
    """How well the best span or phrase shows a license: its covered share, less for short templates."""
    relevance = [s.covered / machine.templates[s.template].size * min(1.0, machine.templates[s.template].size / RELEVANT) for s in spans]
    if places:
        relevance.append(min(1.0, int(machine.phrases.min()) / RELEVANT))
    return max(relevance, default=0.0)


SCHEMA = "struct<n_words:bigint,places:array<struct<start:bigint,end:bigint,label:string>>,spans:array<struct<start:bigint,end:bigint,label:string,template:int,covered:bigint>>,score:double>"


def scan(texts: pa.Array, machine: Machine) -> list[tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str, int, int]], float]]:
    """For each text: words, places of phrases, template spans and score."""
    found, rows = words(texts)
    count = c.row_counts(rows, len(texts))
    first = np.cumsum(count) - count
    numbers = np.asarray(pc.index_in(found, value_set=machine.vocabulary).fill_null(-1)) if len(found) else np.zeros(0, np.int32)
    fresh = np.zeros(len(numbers), bool)
    fresh[first[count > 0]] = True
    state, length = machine.statistics(numbers, fresh)
    places: dict[int, list[tuple[int, int, str]]] = {}
    for k, size in enumerate(machine.phrases.tolist()):
        for at in np.flatnonzero(machine.has[state, k] & (length >= size)).tolist():
            own = int(rows[at])
            end = at - int(first[own]) + 1
            places.setdefault(own, []).append((end - size, end, machine.phrase_labels[k]))
    longer = np.append(length[1:] == length[:-1] + 1, [False] * (len(length) > 0)) & ~np.append(fresh[1:], [True] * (len(fresh) > 0))
    matches: dict[int, list[tuple[int, int, int]]] = {}
    for at in np.flatnonzero((length >= MATCH) & ~longer).tolist():
        own, n = int(rows[at]), int(length[at])
        matches.setdefault(own, []).append((at - int(first[own]) - n + 1, n, int(state[at])))
    out = []
    for row in range(len(texts)):
        spans = chains(machine, matches[row]) if row in matches else []
        at = sorted(places.get(row, []))
        out.append((int(count[row]), at, [(s.start, s.end, machine.templates[s.template].label, s.template, s.covered) for s in spans], score(machine, spans, len(at))))
    return out


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """``keep`` columns of ``docs`` (all, if None) with the struct ``licenses`` of what each text holds.

    Its fields: ``n_words``; ``places`` of phrases and ``spans`` of templates, in words, end
    exclusive, with labels; ``score`` from 0 to 1. Null and empty texts hold nothing. A column named
    ``licenses`` is replaced. The templates are small and travel with the code.
    """
    keep = [x for x in (docs.columns if keep is None else keep) if x.lower() != "licenses"]
    plain = c.unused([*keep, "licenses"], "_text")
    machine = Machine(templates, phrases)
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    place = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])
    span = pa.struct([*place, pa.field("template", pa.int32()), pa.field("covered", pa.int64())])
    kind = pa.struct([("n_words", pa.int64()), ("places", pa.list_(place)), ("spans", pa.list_(span)), ("score", pa.float64())])
    named = lambda fields, of: dict(zip(fields.names, of, strict=True))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.slices(batch, plain):
                found = [{"n_words": n, "places": [named(place, p) for p in at], "spans": [named(span, s) for s in spans], "score": x} for n, at, spans, x in scan(part.column(plain), sent.value)]
                yield pa.RecordBatch.from_arrays([*[part.column(x) for x in keep], pa.array(found, kind)], names=[*keep, "licenses"])

    df = docs.select(*keep, F.col(text).alias(plain))
    return df.mapInArrow(apply, df.select(*keep, F.lit(None).cast(SCHEMA).alias("licenses")).schema)


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    """Places of the base phrases and license labels of every document; null texts have no words or labels."""
    found = find(c.table(spark, sf_dir, "documents"), keep=["doc_id"])
    starts = F.col("licenses.places.start")
    base = F.array_sort(F.array_distinct("licenses.places.label"))
    every = F.array_sort(F.array_union(F.col("licenses.places.label"), F.col("licenses.spans.label")))
    return found.select(
        "doc_id",
        "licenses.n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        "licenses.score",
    )
