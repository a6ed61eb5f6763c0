"""Character classes and the index of distinct pieces that both tokenizers use."""

from __future__ import annotations

import functools
import sys
import zlib

import numpy as np
from tokenizers import Regex, pre_tokenizers

from curata.llm import common as c

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Unicode's White_Space property.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


#: Letters and numbers lie below this code point.
TOP = 0x40000
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point, by the pattern engine's own tables: letters, numbers, white space, anything else."""
    if not _classes:
        t = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        every = [i for i in range(TOP) if not 0xD800 <= i < 0xE000]
        text, place = "".join(map(chr, every)), np.array(every)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for _, (start, end) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
                t[place[start:end]] = kind
        t[WHITE_SPACE] = SPACE
        _classes.append(t)
    return _classes[0]


def packed() -> bytes:
    """``classes`` as the driver sends it to tasks, which need not work it out again."""
    return zlib.compress(classes()[:TOP].tobytes())


def unpack(raw: bytes) -> None:
    if not _classes:
        t = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        t[:TOP] = np.frombuffer(zlib.decompress(raw), np.uint8)
        _classes.append(t)


@functools.cache
def _values() -> np.ndarray:
    return c.mix(np.arange(1, sys.maxunicode + 2, dtype=c.U64) * c.U64(0x2545F4914F6CDD1D))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PieceIndex:
    """Numbers the distinct pieces of many texts, by a 64-bit hash of their code points."""

    def __init__(self) -> None:
        self.number: dict[int, int] = {}
        self.pieces: list[str] = []

    def add(self, text: str, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes = c.span_hashes(cps, starts, ends, _values())
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        unique, get = unique.tolist(), self.number.get
        at = np.array([get(h, -1) for h in unique], np.int64)
        new = np.flatnonzero(at < 0)
        where = first[new]
        at[new] = np.arange(len(self.pieces), len(self.pieces) + len(new))
        self.number.update((unique[k], n) for k, n in zip(new.tolist(), at[new].tolist(), strict=True))
        self.pieces.extend(text[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True))
        return at[inverse].astype(np.int32)
