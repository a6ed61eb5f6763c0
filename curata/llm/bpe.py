"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Texts are split by the pattern of the public rank files, as vector operations on
code points; the distinct pieces of up to ``FLUSH_BYTES`` of text are merged
together (see ``replay``), and each text's ids are those of its pieces in order.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.llm import common as c
from curata.llm import pieces as pc
from curata.llm.replay import PairTable, replay

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
FLUSH_BYTES = 3 << 20
#: A worker remembers the ids of up to ``MEMO`` merged pieces of up to ``MEMO_BYTES`` bytes; then it starts anew.
MEMO, MEMO_BYTES = 1 << 19, 64


class Memo:
    """Ids of merged pieces by the pieces' hashes, in arrays; who takes them compares their bytes."""

    def __init__(self) -> None:
        self.hashes, self.begins, self.sizes, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.sizes[at]
        return self.flat[np.repeat(self.begins[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())], size

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        if len(self.hashes) + len(hashes) > MEMO:
            self.__init__()
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.begins = np.insert(self.begins, at, (np.cumsum(sizes) - sizes + len(self.flat))[order])
        self.sizes = np.insert(self.sizes, at, sizes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])


class Vocabulary:
    """A rank file: byte strings and the ids that are their ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ids.values()) + 1
        by_id = [b""] * size
        for token, k in self.ids.items():
            by_id[k] = token
        self.lengths = np.array([len(t) for t in by_id])
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        text = [str(k).encode() + b"," for k in range(size)]
        self.text_lengths = np.array([len(t) for t in text])
        self.text_begins = np.cumsum(self.text_lengths) - self.text_lengths
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.first = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, k in self.ids.items():
            for i in range(1, len(token)):
                a, b = self.ids.get(token[:i]), self.ids.get(token[i:])
                if a is not None and b is not None:
                    pairs[a, b] = (k, k)
        self.table = PairTable(pairs)
        self.memo = Memo()


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """Read once a Python worker."""
    return Vocabulary(path)


def split(cps: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Starts of the pieces of texts that follow one another; ``rows`` are the texts' starts.

    Equal to finding all matches of the rank files' pattern: contractions; runs of
    letters, numbers or other characters, each with one space before it; white space,
    of which the last character is left to stand alone if something follows.
    """
    n = len(cps)
    kind = pc.classes()[cps]
    first = np.zeros(n + 1, bool)
    first[rows[rows < n]] = first[n] = True
    last = first[1:]
    before = np.concatenate([[pc.SPACE], kind[:-1]])
    after = np.concatenate([kind[1:], [pc.SPACE]])
    first = first[:n]
    blank = np.concatenate([[False], cps[:-1] == 0x20]) & ~first
    space = kind == pc.SPACE
    start = np.where(space, (before != pc.SPACE) | (~last & (after != pc.SPACE)), np.where(before == pc.SPACE, ~blank, kind != before)) | first
    quote = np.flatnonzero(cps == 0x27)
    if len(quote):
        ok = first[quote] | (before[quote] == pc.LETTER) | (before[quote] == pc.NUMBER) | ((before[quote] == pc.SPACE) & ~blank[quote])
        quote = quote[ok & ~last[quote]]
        if len(quote):
            one = cps[quote + 1]
            two = np.where(last[quote + 1], 0, cps[np.minimum(quote + 2, n - 1)])
            size = np.where(np.isin(one, [0x73, 0x74, 0x6D, 0x64]), 2, 0)
            pair = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
            size = np.where(pair, 3, size)
            quote, size = quote[size > 0], size[size > 0]
            start[quote + 1] = False
            start[quote[size == 3] + 2] = False
            end = quote + size
            start[end[end < n]] = True
    return np.flatnonzero(start)


def _ragged(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The entries ``ids`` of a ragged table in a row, and the length of each."""
    size = lengths[ids]
    at = np.repeat(begins[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return flat[at].tobytes(), size


def _put(out: np.ndarray, begins: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
    out[np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))] = ids


def encode_pieces(index: pc.PieceIndex, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces of an index in a row, and the number of ids of each."""
    raw = [p.encode("utf-8", "replace") for p in index.pieces]
    whole = np.array([v.ids.get(p, -1) for p in raw], np.int32)
    rest = np.flatnonzero(whole < 0)
    length = np.array([len(raw[k]) for k in rest.tolist()], np.int64)
    hashes = np.fromiter((h & 0xFFFFFFFFFFFFFFFF for h in index.number), np.uint64, len(raw))[rest]
    at = v.memo.find(hashes)
    known = np.flatnonzero(at >= 0)
    known_ids, known_sizes = v.memo.take(at[known])
    same = np.array_equal(np.bincount(np.repeat(np.arange(len(known)), known_sizes), weights=v.lengths[known_ids], minlength=len(known)).astype(np.int64), length[known])
    if not same or _ragged(v.bytes, v.begins, v.lengths, known_ids)[0] != b"".join([raw[k] for k in rest[known].tolist()]):
        known, known_ids, known_sizes = known[:0], known_ids[:0], known_sizes[:0]
    new = np.ones(len(rest), bool)
    new[known] = False
    fresh = np.flatnonzero(new)
    ids, sizes = replay(v.first[np.frombuffer(b"".join([raw[k] for k in rest[fresh].tolist()]), np.uint8)], length[fresh], v.table)
    short = length[fresh] <= MEMO_BYTES
    v.memo.add(hashes[fresh][short], ids[np.repeat(short, sizes)], sizes[short])
    count = np.ones(len(raw), np.int64)
    count[rest[known]], count[rest[fresh]] = known_sizes, sizes
    begin = np.cumsum(count) - count
    out = np.empty(count.sum(), np.int32)
    out[begin[whole >= 0]] = whole[whole >= 0]
    _put(out, begin[rest[known]], known_ids, known_sizes)
    _put(out, begin[rest[fresh]], ids, sizes)
    return out, count


class _Pending:
    """Texts that wait until the pieces of all of them are merged."""

    def __init__(self) -> None:
        self.index, self.runs, self.bytes = pc.PieceIndex(), [], 0

    def add(self, batch: pa.RecordBatch, texts: list[str], size: int) -> None:
        joined = "".join(texts)
        cps = pc.points(joined)
        ends = np.cumsum([len(t) for t in texts])
        starts = split(cps, np.concatenate([[0], ends[:-1]])) if len(cps) else np.zeros(0, np.int64)
        numbers = self.index.add(joined, cps, starts, np.append(starts[1:], len(cps))) if len(cps) else np.zeros(0, np.int32)
        self.runs.append((batch, numbers, np.searchsorted(starts, np.concatenate([[0], ends]))))
        self.bytes += size


def _flush(pending: _Pending, v: Vocabulary, keep: list[str], with_ids: bool) -> Iterator[pa.RecordBatch]:
    ids, count = encode_pieces(pending.index, v)
    pending.index = None
    begin = np.cumsum(count) - count
    if not with_ids:
        text, size = _ragged(v.text, v.text_begins, v.text_lengths, ids)
        ends = np.concatenate([[0], np.cumsum(size)])
        marks = [text[a:b] for a, b in zip(ends[begin], ends[begin + count], strict=True)]
        data, size = _ragged(v.bytes, v.begins, v.lengths, ids)
        ends = np.concatenate([[0], np.cumsum(size)])
        plain = [data[a:b] for a, b in zip(ends[begin], ends[begin + count], strict=True)]
        del text, data, ends, size
        sha = lambda x: hashlib.sha256(x).hexdigest()
    for batch, numbers, cuts in pending.runs:
        total = np.concatenate([[0], np.cumsum(count[numbers])])
        columns = {k: batch.column(k) for k in keep}
        if with_ids:
            at = np.repeat(begin[numbers] - total[:-1], count[numbers]) + np.arange(total[-1])
            columns["ids"] = pa.ListArray.from_arrays(pa.array(total[cuts], pa.int32()), pa.array(ids[at], pa.int32()))
        else:
            of = numbers.tolist()
            rows = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            columns["n_tokens"] = pa.array(total[cuts[1:]] - total[cuts[:-1]], pa.int64())
            columns["ids_sha256"] = pa.array([sha(b"".join([marks[k] for k in of[a:b]])[:-1]) for a, b in rows], pa.string())
            columns["decoded_sha256"] = pa.array([sha(b"".join([plain[k] for k in of[a:b]])) for a, b in rows], pa.string())
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _run(docs: DataFrame, text: str, keep: list[str], path: str, with_ids: bool) -> DataFrame:
    schema, plain, table = docs.select(*keep).schema, c.unused(keep, "_text"), pc.packed()
    schema = schema.add("ids", T.ArrayType(T.IntegerType())) if with_ids else schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pc.unpack(table)
        v, pending = vocabulary(path), _Pending()
        for whole in batches:
            for batch in c.slices(whole, plain):
                texts = ["" if t is None else t for t in batch.column(plain).to_pylist()]
                pending.add(batch.select(keep), texts, int(c.utf8(batch.column(plain))[1][-1]))
                if pending.bytes >= FLUSH_BYTES:
                    yield from _flush(pending, v, keep, with_ids)
                    pending = _Pending()
                    c.release()
        if pending.runs:
            yield from _flush(pending, v, keep, with_ids)
        pending = None
        c.release()

    return docs.select(*keep, F.col(text).alias(plain)).mapInArrow(apply, schema)


def encode(docs: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """``keep`` columns (all, if None) with ``ids``: each whole text's token ids.

    Null and empty texts have no ids; rows, repeated ones and null ids included, are
    kept as they are. Special strings are ordinary text. ``path``: the rank file.
    """
    keep = [x for x in docs.columns if x != "ids"] if keep is None else keep
    return _run(docs, text, keep, path or public_tokenizers.path(VOCABULARY), True)


def decode(df: DataFrame, ids: str = "ids", to: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with ``to``: the bytes of each id list (null: null; unknown ids: an error)."""
    path = path or public_tokenizers.path(VOCABULARY)
    schema = df.drop(to).schema.add(to, "binary")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            out = [None if x is None else _ragged(v.bytes, v.begins, v.lengths, np.array(x, np.int64))[0] for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in schema.names[:-1]), pa.array(out, pa.binary())], names=schema.names)

    return df.mapInArrow(apply, schema)


def digests(docs: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Encode and decode each text; ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of the results.

    They follow the ``keep`` columns (all, if None; columns of the three names are replaced).
    """
    keep = [x for x in docs.columns if x not in ("n_tokens", "ids_sha256", "decoded_sha256")] if keep is None else keep
    return _run(docs, text, keep, path or public_tokenizers.path(VOCABULARY), False)


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes, as digests, of every document; a null text counts as empty."""
    return digests(c.table(spark, sf_dir, "documents"), keep=["doc_id"])
