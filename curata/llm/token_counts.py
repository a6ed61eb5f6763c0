"""Token counts by compiled finite-state transducers.

Splitting: the word tokenizer's pattern is a deterministic transducer over ten
character classes and seven states. A text is cut in chunks; a chunk's state map
(for each state before it, the state after it) comes from running all states at
once, and the maps of all chunks compose through a parallel prefix scan. With the
state before each chunk known, a second run emits where pieces start.

Counting: the merges compile to an automaton whose transitions carry the number of
tokens (see ``automaton``). The distinct pieces of up to ``FLUSH_BYTES`` of text are read
side by side, long ones in chunks; a text's count is a difference of the prefix sums of
its pieces' counts. Merge replay only counts words whose chunks do not come together.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import normalizers

from curata.llm import common as c
from curata.llm import pieces as pc
from curata.llm.automaton import Automaton
from curata.llm.replay import replay

VOCABULARY = "word_bpe_49k.json"
FLUSH_BYTES = 6 << 20
CHUNK = 128
# States: fresh, in letters, in others, after a quote that began a piece, after its r, v and l.
FRESH, IN_L, IN_O, QUOTE, Q_R, Q_V, Q_L = range(7)
STATES = 8
# Classes: white space, letter, number, other, quote, s t m d, r, v, l, e.
SP, L, N, O, Q, S, R, V, LL, E = range(10)  # noqa: E741
#: Output bits: a piece starts here; a piece started one character before.
HERE, BACK = 1, 2


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """Tables of next states and outputs, indexed by class * STATES + state."""
    go, out = np.zeros((10, STATES), np.uint8), np.zeros((10, STATES), np.uint8)

    def usual(state: int, k: int) -> tuple[int, int]:
        if k == SP:
            return FRESH, 0
        if k == N:
            return FRESH, HERE
        if k == O:
            return IN_O, 0 if state == IN_O else HERE
        if k == Q:
            return (IN_O, 0) if state == IN_O else (QUOTE, HERE)
        return IN_L, 0 if state == IN_L else HERE

    for k in range(10):
        for state in (FRESH, IN_L, IN_O):
            go[k, state], out[k, state] = usual(state, k)
        if k in (S, R, V, LL):
            go[k, QUOTE] = {S: FRESH, R: Q_R, V: Q_V, LL: Q_L}[k]
        elif k in (O, Q):
            go[k, QUOTE] = IN_O
        else:
            go[k, QUOTE], out[k, QUOTE] = usual(IN_O, k)
        for state, last in ((Q_R, E), (Q_V, E), (Q_L, LL)):
            if k != last:
                go[k, state], out[k, state] = usual(IN_L, k)
                out[k, state] |= BACK
    return go.reshape(-1), out.reshape(-1)


GO, OUT = compile_splitter()


@functools.cache
def char_classes() -> np.ndarray:
    t = np.array([O, L, N, SP], np.uint8)[pc.classes()]
    for chars, k in (("'", Q), ("stmd", S), ("r", R), ("v", V), ("l", LL), ("e", E)):
        for x in chars:
            t[ord(x)] = k
    return t * STATES


def piece_starts(classes: np.ndarray) -> np.ndarray:
    """Where pieces start; the text must end in white space and begins fresh."""
    n = len(classes)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, SP * STATES, np.uint8)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1))
    for k in steps:
        maps = GO[k[:, None] + maps]
    width = 1
    while width < chunks:  # maps[i] becomes the composition of maps 0 to i
        maps[width:] = np.take_along_axis(maps[width:], maps[:-width].astype(np.int64), 1)
        width *= 2
    state = np.concatenate([[FRESH], maps[:-1, FRESH]]).astype(np.uint8)
    emitted = np.empty((CHUNK, chunks), np.uint8)
    for t, k in enumerate(steps):
        at = k + state
        emitted[t] = OUT[at]
        state = GO[at]
    emitted = emitted.T.reshape(-1)[:n]
    starts = (emitted & HERE).astype(bool)
    starts[:-1] |= (emitted[1:] & BACK).astype(bool)
    return starts


class Words:
    """The vocabulary and merges of a word tokenizer's file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        vocab, suffix = d["model"]["vocab"], d["model"]["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in d["model"]["merges"]]
        self.special = [t["content"] for t in d["added_tokens"]]
        # Bytes as printable characters: themselves where printable, else from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        chars = [chr(b) if b in printable else chr(next(rest)) for b in range(256)]
        self.inner = np.array([vocab[x] for x in chars], np.int32)
        self.last = np.array([vocab[x + suffix] for x in chars], np.int32)
        pairs = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in reversed(list(enumerate(merges)))}
        self.automaton = Automaton(pairs, np.concatenate([self.inner, self.last]))

    def count(self, found: list[str]) -> np.ndarray:
        raw = [p.encode("utf-8", "replace") for p in found]
        sizes = np.array([len(x) for x in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        end = np.cumsum(sizes) - 1
        symbols[end] = self.last[data[end]]
        counts, bad = self.automaton.counts(symbols, sizes)
        if bad.any():
            counts[bad] = replay(symbols[np.repeat(bad, sizes)], sizes[bad], self.automaton.table)[1]
        return counts


@functools.cache
def words(path: str) -> Words:
    """Read once a Python worker."""
    return Words(path)


@functools.cache
def _newer() -> dict[int, str]:
    """Lower case of letters that Python's tables don't know yet, by the library's."""
    lower = normalizers.Lowercase().normalize_str
    return {i: lower(chr(i)) for i in np.flatnonzero(pc.classes() == pc.LETTER).tolist() if unicodedata.category(chr(i)) == "Cn"}


def normal(text: str) -> str:
    """NFC, then each character in lower case; white space needs no folding, as pieces hold none."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").translate(_newer())
    return text.lower()


def count(docs: DataFrame, text: str = "text", keep: list[str] | None = None, limit: int = 2048, path: str | None = None) -> DataFrame:
    """``keep`` columns (all, if None) with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``n_tokens`` is what the tokenizers library gives for the whole text without
    begin and end tokens; a special token's string inside a text is that one token.
    Null and empty texts have no bytes and no tokens. Rows are kept as they are; columns
    of the three names are replaced.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    keep = [x for x in docs.columns if x not in ("n_bytes", "n_tokens", "over_limit")] if keep is None else keep
    plain, table = c.unused(keep, "_text"), pc.packed()
    schema = docs.select(*keep).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def flush(index: pc.PieceIndex, runs: list, w: Words) -> Iterator[pa.RecordBatch]:
        arcs = w.count(index.pieces)
        for batch, size, special, numbers, cuts in runs:
            total = np.concatenate([[0], np.cumsum(arcs[numbers])])
            tokens = total[cuts[1:]] - total[cuts[:-1]] + special
            new = [pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pc.unpack(table)
        w = words(path)
        special = re.compile("|".join(map(re.escape, w.special)) or "(?!)")
        index, runs, waiting = pc.PieceIndex(), [], 0
        for whole in batches:
            for batch in c.slices(whole, plain):
                size = np.diff(c.utf8(batch.column(plain))[1])
                texts = ["" if t is None else t for t in batch.column(plain).to_pylist()]
                extra = np.zeros(len(texts), np.int64)
                for k, t in enumerate(texts):
                    if "<|" in t:
                        texts[k], extra[k] = special.subn(" ", t)
                texts = [normal(t) + "\n" for t in texts]
                joined = "".join(texts)
                cps = pc.points(joined)
                starts = piece_starts(char_classes()[cps])
                stop = np.flatnonzero(starts | (pc.classes()[cps] == pc.SPACE))
                first = np.flatnonzero(starts)
                ends = stop[np.searchsorted(stop, first) + 1]
                cuts = np.searchsorted(first, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
                runs.append((batch.select(keep), size, extra, index.add(joined, cps, first, ends), cuts))
                waiting += int(size.sum())
                if waiting >= FLUSH_BYTES:
                    yield from flush(index, runs, w)
                    index, runs, waiting = pc.PieceIndex(), [], 0
        if runs:
            yield from flush(index, runs, w)

    return docs.select(*keep, F.col(text).alias(plain)).mapInArrow(apply, schema)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every document; a null text counts as empty, ids and repeated rows stay as they are."""
    return count(c.table(spark, sf_dir, "documents"), keep=["doc_id"])
