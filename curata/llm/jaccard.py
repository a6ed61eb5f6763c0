"""N-gram Jaccard join over size-banded tiles with hashed bitmap signatures.

Sets are the distinct word shingles of a text, as 64-bit hashes. Words a shingle and
least similarity are parameters. Two sets of sizes a <= b with a Jaccard of p per cent
or more differ in at most (a + b) (100 - p) / (100 + p) elements. Sizes fall into bands; a band cuts the hash space into more segments than its pairs can
have differing elements, so linked sets agree in a whole segment, and a set's keys
are the hashes of its segments (those of its own band and, where its size reaches
it, of the next). A key's first holder names a
tile: the sets that share any key with it. Keys travel packed, 4 bytes each and a
reference to their set.

A set's bitmap holds the parity of its elements by hash; the count of bits in which
two bitmaps differ is at most the number of differing elements, which bounds the
overlap from above. A tile first only gets bitmaps, and falls into the parts that
pairs within the bound connect; only the sets of such parts travel whole. Within a
part, pairs that pass the bound are compared exactly, as sorted arrays. A part links
its members by a search that leaves out members reached already, and yields a spanning
forest, not all pairs. A part of more than ``TILE`` members is dealt out: first as
blocks beside the part's smallest set, then the members that this did not join to it
against all others, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm import bitset
from curata.llm import common as c
from curata.llm.graph import components

#: op1's contract: words a shingle; linked: 100 * intersection >= 90 * union.
SHINGLE, PERCENT = 3, 90
BAND = 1.45
#: Members of an exact tile; sets of a tile whose bitmaps are compared; keys a task holds at a time.
TILE, SKETCH_TILE, FLUSH_KEYS = 256, 2048, 1 << 20
_VALUES = c.byte_values(1)
U64 = c.U64


@lru_cache
def bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the size bands, number of segments, and empty segments that are passed over.

    Different sets below the second start are never linked. A linked set's size is in
    the same band or the next.
    """
    if not 0 < percent < 100:
        raise ValueError("percent must be from 1 to 99")
    starts, growth = [1, max(2, -(-100 // (100 - percent)))], max(BAND, 100 / percent)
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, int(np.ceil(starts[-1] * growth))))
    s = np.array(starts, np.int64)
    differ = 2 * (s[1:] - 1) * (100 - percent) // (100 + percent)
    k = differ + 1
    spare = 1 + np.ceil(6 * k * np.exp(-0.9 * s[:-1] / (k + 1))).astype(np.int64)
    return s, k + spare, spare


def shingle_sets(texts: pa.Array, words_each: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted, in a row; rows' sizes and begins."""
    data, offsets = c.utf8(texts)
    low = c.LOWER[data]
    starts, ends, rows = c.spans(c.SPACE_WORD[low], offsets)
    words = c.span_hashes(low, starts, ends, _VALUES)
    n = len(offsets) - 1
    count = c.row_counts(rows, n)
    left = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(count, words_each)
    at = np.flatnonzero(left + size[rows] <= count[rows])
    h = np.full(len(at), 0, U64)
    for k in range(words_each):
        more = k < size[rows[at]]
        h[more] = c.mix(h[more] * U64(0xD6E8FEB86659FD93) + words[at[more] + k] + U64(k + 1))
    h &= U64(0x7FFFFFFFFFFFFFFF)
    of = rows[at]
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]) if len(h) else np.zeros(0, bool)
    h, of = h[fresh], of[fresh]
    sizes = c.row_counts(of, n)
    return h, sizes, np.cumsum(sizes) - sizes


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def set_ids(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; two of n different sets agree with odds of n * n / 2**65."""
    return c.mix(_sums(c.mix(h ^ U64(0x5851F42D4C957F2D)), sizes) ^ c.mix(sizes.astype(U64)))


def segment_keys(h: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all sets in order of row, and the number of each row's keys.

    Of two sets that agree in a segment only as both are empty there, nothing is
    learnt. There are ``spare`` segments more than needed, so a set with no more empty
    segments than that leaves them out; any other also gives the keys of empty ones.
    """
    starts, segments, spare = bands(percent)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    band = np.searchsorted(starts, sizes, "right") - 1
    place, value = c.mix(h ^ U64(0x14057B7EF767814F)) >> U64(32), c.mix(h + U64(0x632BE59BD9B4E019))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for step in (0, 1):
        config = band + step
        emits = (config >= 1) & (sizes > 0)
        if step:
            emits &= sizes * 100 // percent >= starts[np.minimum(config, len(starts) - 1)]
        k = np.where(emits, segments[config], 0)
        base = np.cumsum(k) - k
        sums, counts = np.zeros(k.sum(), U64), np.zeros(k.sum(), np.int64)
        some = emits[rows]
        at = base[rows[some]] + ((place[some] * k[rows[some]].astype(U64)) >> U64(32)).astype(np.int64)
        np.add.at(sums, at, value[some])
        counts += np.bincount(at, minlength=len(counts))
        row = np.repeat(np.arange(len(sizes)), k)
        segment = np.arange(len(row)) - base[row]
        empty = np.bincount(row[counts == 0], minlength=len(sizes))
        keep = (counts > 0) | (empty > spare[config])[row]
        key = c.mix(sums ^ c.mix((config[row].astype(U64) << U64(40)) + segment.astype(U64)))
        found.append((row[keep], key[keep]))
    row = np.concatenate([f[0] for f in found])
    key = np.concatenate([f[1] for f in found])
    order = np.argsort(row, kind="stable")
    return key[order], np.bincount(row, minlength=len(sizes))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.view(np.int64)))


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def bitmaps(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set's parity bitmap, in a row as bytes, and its width in bits: 64, doubled to the set's size."""
    width = 64 << np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1) / 64))).astype(np.int64)
    base = np.cumsum(width) - width
    at = np.repeat(base, sizes) + (h & np.repeat(width - 1, sizes).astype(U64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(width.sum())) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little"), width


def _described(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n, h, bits``: size, set id and bitmap of every row."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in c.slices(whole, "text"):
                h, sizes, _ = shingle_sets(batch.column("text"), words)
                bits, width = bitmaps(h, sizes)
                ends = pa.py_buffer(np.concatenate([[0], np.cumsum(width // 8)]).astype(np.int32))
                maps = pa.Array.from_buffers(pa.binary(), len(sizes), [None, ends, pa.py_buffer(bits)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), _signed(set_ids(h, sizes)), maps], names=["doc_id", "n", "h", "bits"])

    return docs.mapInArrow(apply, "doc_id long, n long, h long, bits binary")


def _key_blocks(docs: DataFrame, words: int, percent: int, log_buckets: int) -> DataFrame:
    """``bucket, task, made, marks, of, sets``: keys by their leading bits, packed.

    Of a key only 32 further bits travel (``marks``), with the number of its set (``of``) in
    the block's list ``sets``. Keys that agree by chance cost a comparison and change no result.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            key, of = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
            bucket = (key >> U64(64 - log_buckets)).astype(np.int64) if log_buckets else np.zeros(len(key), np.int64)
            order = np.argsort(bucket, kind="stable")
            key, of, bucket = key[order], of[order], bucket[order]
            cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(key)]])
            marks, number, sets = [], [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                new = np.concatenate([[True], of[s + 1 : e] != of[s : e - 1]])
                marks.append(key[s:e].astype(np.uint32).tobytes())
                number.append((np.cumsum(new) - 1).astype(np.uint32 if new.sum() > 1 << 16 else np.uint16).tobytes())
                sets.append(of[s:e][new].tobytes())
            n = len(cuts) - 1
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array([task] * n, pa.int64()), pa.array([made] * n, pa.int64()), pa.array(marks, pa.binary()), pa.array(number, pa.binary()), pa.array(sets, pa.binary())], names=["bucket", "task", "made", "marks", "of", "sets"])

        for whole in batches:
            for batch in c.slices(whole, "text"):
                h, sizes, _ = shingle_sets(batch.column("text"), words)
                key, count = segment_keys(h, sizes, percent)
                waiting.append((key, np.repeat(set_ids(h, sizes).view(np.int64), count)))
                held += len(key)
                if held >= FLUSH_KEYS:
                    yield flush()
                    waiting.clear()
                    held, made = 0, made + 1
        if held:
            yield flush()
        waiting.clear()
        c.release()

    return docs.select("text").mapInArrow(apply, "bucket long, task long, made long, marks binary, of binary, sets binary")


def _anchored(blocks: DataFrame, partitions: int) -> DataFrame:
    """``h, a``: the sets that hold a key which other sets hold, each with the key's first holder.

    A bucket's blocks pass one after the other; of each key only its first holder is
    kept, so a key that very many sets hold needs no more room than any other.
    """
    ordered = blocks.repartition(partitions, "bucket").sortWithinPartitions("bucket", "task", "made")

    def merged(first: tuple[np.ndarray, np.ndarray], waiting: list[tuple[np.ndarray, np.ndarray]]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        mark, h = (np.concatenate([first[k], *(w[k] for w in waiting)]) for k in (0, 1))
        order = np.argsort(mark, kind="stable")
        mark, h = mark[order], h[order]
        new = np.concatenate([[True], mark[1:] != mark[:-1]])
        a = h[np.flatnonzero(new)[np.cumsum(new) - 1]]
        pairs = np.unique(np.stack([h[h != a], a[h != a]], 1), axis=0)
        return (mark[new], h[new]), pairs

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        first, waiting, held, now = none, [], 0, None

        def out(pairs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["h", "a"])

        for batch in batches:
            bucket = batch.column("bucket").to_pylist()
            for k, b in enumerate(bucket):
                if b != now or held >= FLUSH_KEYS:
                    if waiting:
                        first, pairs = merged(first, waiting)
                        yield out(pairs)
                    waiting, held = [], 0
                    if b != now:
                        first, now = none, b
                mark = np.frombuffer(batch.column("marks")[k].as_buffer(), np.uint32).copy()
                sets = np.frombuffer(batch.column("sets")[k].as_buffer(), np.int64)
                of = batch.column("of")[k].as_buffer()
                waiting.append((mark, sets[np.frombuffer(of, np.uint16 if of.size == 2 * len(mark) else np.uint32)]))
                held += len(mark)
        if waiting:
            yield out(merged(first, waiting)[1])

    return ordered.mapInArrow(apply, "h long, a long").distinct()


def _folded(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps folded to ``width`` bits, as 64-bit words: parities of a narrower hash."""
    out = np.empty((len(bits), width // 64), U64)
    for k, raw in enumerate(bits):
        x = np.frombuffer(raw, U64)
        out[k] = np.bitwise_xor.reduce(x.reshape(-1, width // 64), 0)
    return out


def _close(sizes: np.ndarray, size: int, differ: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs the bound lets pass, from sizes and numbers of differing bits."""
    both = sizes + size
    return (np.minimum(sizes, size) * 100 >= percent * np.maximum(sizes, size)) & ((100 + percent) * (both - differ) >= 2 * percent * both)


def possible(sizes: np.ndarray, bits: list[bytes], percent: int) -> np.ndarray:
    """The part of each member, by its first member, of the graph of pairs that the bitmaps' bound lets pass."""
    n, root = len(sizes), np.arange(len(sizes))
    width = np.array([8 * len(x) for x in bits])

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    for w in np.unique(width):
        members = np.flatnonzero(width >= w)
        folded, own = _folded([bits[k] for k in members], int(w)), sizes[members]
        rest = np.ones(len(members), bool)
        for start in np.flatnonzero(width[members] == w):
            queue = [int(start)] if rest[start] else []
            rest[start] = False
            while queue:
                x = queue.pop()
                # Wider sets compare among themselves at their own width.
                y = np.flatnonzero(rest if width[members[x]] == w else rest & (width[members] == w))
                y = y[_close(own[y], own[x], np.bitwise_count(folded[y] ^ folded[x]).sum(1, dtype=np.int64), percent)]
                rest[y] = False
                for k in y.tolist():
                    p, q = find(int(members[x])), find(int(members[k]))
                    root[max(p, q)] = min(p, q)
                    queue.append(k)
    return np.array([find(k) for k in range(n)], np.int64)


def _parts(places: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``g, h, a``: the parts of two or more sets of each tile ``t1, t2, t3``, with a name and the smallest set of each."""
    names = ["t1", "t2", "t3"]
    rows = places.join(sets.select("h", "n", "bits"), "h").select(*names, "h", "n", "bits").repartition(*names).sortWithinPartitions(*names, "h")

    def solve(hs: list[int], ns: list[int], bits: list[bytes]) -> tuple[np.ndarray, ...]:
        h = np.array(hs, np.int64)
        part = possible(np.array(ns, np.int64), bits, percent)
        size = np.bincount(part, minlength=len(part))
        # Tiles that hold the same members give one part.
        name = np.zeros(len(part), U64)
        np.add.at(name, part, c.mix(h.view(U64)))
        keep = size[part] > 1
        return name[part][keep].view(np.int64), h[keep], h[part][keep]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, hs, ns, bits = None, [], [], []
        for batch in batches:
            out = []
            columns = (batch.column(x).to_pylist() for x in (*names, "h", "n", "bits"))
            for *mark, h, n, b in zip(*columns, strict=True):
                if mark != tile:
                    out.append(solve(hs, ns, bits))
                    tile, hs, ns, bits = mark, [], [], []
                hs.append(h)
                ns.append(n)
                bits.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out] or [np.zeros(0, np.int64)])) for k in range(3)], names=["g", "h", "a"])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in solve(hs, ns, bits)], names=["g", "h", "a"])

    return rows.mapInArrow(apply, "g long, h long, a long").distinct()


def _groups(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``g, h, a``: groups of sets that may be linked, each set's group and the group's smallest set.

    The sets of a tile (those with one first holder, and it) fall into the parts that
    their bitmaps allow; parts of one set go. A tile of more than ``SKETCH_TILE`` sets is
    dealt in blocks, each pair of which is a tile; what connects across them is one group.
    """
    zero = F.lit(0).cast("long")
    count = pairs.groupBy("a").agg(F.count("*").alias("members")).select("a", F.ceil(2 * F.col("members") / SKETCH_TILE).cast("long").alias("blocks"))
    placed = pairs.join(count, "a")
    placed = placed.select("h", "a", "blocks").unionByName(count.select(F.col("a").alias("h"), "a", "blocks"))
    small = placed.where("blocks <= 2").select("h", F.col("a").alias("t1"), zero.alias("t2"), zero.alias("t3"))
    found = _parts(small, sets, percent)
    large = placed.where("blocks > 2")
    if large.isEmpty():
        return found
    own = _block("h", "blocks")
    large = large.select("h", F.col("a").alias("t1"), own.alias("b"), _all_blocks(F.col("blocks")).alias("other"))
    edges = _parts(large.select("h", "t1", F.least("b", "other").alias("t2"), F.greatest("b", "other").alias("t3")), sets, percent)
    whole = components(edges.select(F.col("h").alias("u"), F.col("a").alias("v")))
    return found.unionByName(whole.select(F.col("root").alias("g"), F.col("node").alias("h"), F.col("root").alias("a")))


def _with_sets(docs: DataFrame, nodes: DataFrame, places: DataFrame, words: int) -> DataFrame:
    """``places`` (by ``h``) with ``s``, the sorted set, from the texts of the ids ``rep`` of ``nodes`` (``h, rep, times``)."""
    bits = docs.sparkSession.sparkContext.broadcast(bitset.collected(nodes, "rep"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(pa.array(bitset.holds(bits.value, np.asarray(whole.column("slot")))))
            for batch in c.slices(whole, "text"):
                h, sizes, _ = shingle_sets(batch.column("text"), words)
                yield pa.RecordBatch.from_arrays([_signed(set_ids(h, sizes)), batch.column("doc_id"), _lists(h, sizes)], names=["h", "rep", "s"])

    source = bitset.with_slot(docs.where("doc_id IS NOT NULL"), "doc_id", "slot")
    sets = source.mapInArrow(apply, "h long, rep long, s array<long>")
    if not nodes.where("times > 1").isEmpty():  # a row that repeats gives its set once
        sets = sets.dropDuplicates(["h"])
    placed = c.cut(places.join(nodes.select("h", "rep"), "h"))
    return sets.join(placed, ["h", "rep"]).drop("rep")


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmaps, as 64-bit words, of as many bits as the largest set has elements (64 at least)."""
    bits = 64
    while bits < max(len(s) for s in sets):
        bits *= 2
    out = np.zeros((len(sets), bits // 64), U64)
    for k, s in enumerate(sets):
        at = s.view(U64) & U64(bits - 1)
        odd = np.bincount(at.astype(np.int64), minlength=bits) & 1
        out[k] = np.packbits(odd.astype(np.uint8), bitorder="little").view(U64)
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """The exact test on two sorted arrays of distinct elements."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def forest(sets: list[np.ndarray], group: np.ndarray | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among ``sets``.

    ``group``: members of group 0 are compared with those of group 1 only.
    """
    bits, sizes = _bitmaps(sets), np.array([len(s) for s in sets], np.int64)
    rest = np.ones(len(sets), bool)
    edges: list[tuple[int, int]] = []
    for root in range(len(sets)):
        queue = [root] if rest[root] else []
        rest[root] = False
        while queue:
            x = queue.pop()
            y = np.flatnonzero(rest if group is None else rest & (group != group[x]))
            both = sizes[y] + sizes[x]
            y = y[np.minimum(sizes[y], sizes[x]) * 100 >= percent * np.maximum(sizes[y], sizes[x])]
            both = sizes[y] + sizes[x]
            differ = np.bitwise_count(bits[y] ^ bits[x]).sum(1, dtype=np.int64)
            for k in y[(100 + percent) * (both - differ) >= 2 * percent * both]:
                if linked(sets[x], sets[k], percent):
                    edges.append((x, int(k)))
                    rest[k] = False
                    queue.append(int(k))
    return edges


def _tiles(rows: DataFrame, percent: int, sided: bool = False) -> DataFrame:
    """Edges ``u, v`` of the tiles ``t1, t2, t3``; rows hold ``h, s`` and, if ``sided``, ``side``."""
    names = ["t1", "t2", "t3"]
    ordered = rows.select(*names, *(["side"] if sided else []), "h", "s").repartition(*names).sortWithinPartitions(*names)

    def solve(ids: list[int], sets: list[np.ndarray], sides: list[int]) -> list[tuple[int, int]]:
        """Each connected member with the smallest id of its part, so that what meets later are stars."""
        found = forest(sets, np.array(sides) if sided else None, percent) if len(sets) > 1 else []
        root = list(range(len(ids)))
        for x, y in found:
            root[y] = root[x]
        least = dict.fromkeys(root)
        for k, r in enumerate(root):
            least[r] = ids[k] if least[r] is None else min(least[r], ids[k])
        return [(ids[k], least[r]) for k, r in enumerate(root) if ids[k] != least[r]]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, ids, sets, sides = None, [], [], []
        for batch in batches:
            edges: list[tuple[int, int]] = []
            marks = list(zip(*(batch.column(x).to_pylist() for x in names), strict=True))
            flat, off = np.asarray(batch.column("s").flatten()), np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(batch.column("s"))))])
            h, side = batch.column("h").to_pylist(), batch.column("side").to_pylist() if sided else None
            for k, mark in enumerate(marks):
                if mark != tile:
                    edges += solve(ids, sets, sides)
                    tile, ids, sets, sides = mark, [], [], []
                ids.append(h[k])
                sets.append(flat[off[k] : off[k + 1]].copy())
                sides.append(side[k] if sided else 0)
            yield pa.RecordBatch.from_pydict({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})
        edges = solve(ids, sets, sides)
        yield pa.RecordBatch.from_pydict({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})

    return ordered.mapInArrow(apply, "u long, v long")


def _block(h: str, blocks: str) -> F.Column:
    return F.pmod(F.xxhash64(h, F.lit(5)), F.col(blocks))


def _all_blocks(blocks: F.Column) -> F.Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    ``n_shingles`` is the number of distinct shingles of ``words`` words (fewer words
    are one shingle; none for a null or empty text). Texts of a Jaccard similarity of
    ``percent`` or more are linked. ``component_id`` is the smallest
    doc_id reachable by links, the row's own included; rows without words link with
    nothing. Rows with a null doc_id link with nothing and have a null component.
    Repeated rows are answered each; rows that share a doc_id but not the text are
    judged by their own text. No rows give no rows.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = c.cut(_described(docs, words))
    usable = known.where("doc_id IS NOT NULL AND n > 0")
    by_row = usable.groupBy("h", "doc_id").agg(F.count("*").alias("times"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    least = F.min_by(F.struct("times", "n", "bits"), "doc_id")
    sets = c.cut(by_row.groupBy("h").agg(F.min("doc_id").alias("rep"), least.alias("x")).select("h", "rep", "x.*"))
    elements = sets.agg(F.sum("n")).first()[0] or 0
    log_buckets = max(0, int(np.ceil(np.log2(1 + 4 * elements * (100 - percent) / (100 + percent) / FLUSH_KEYS))))
    partitions = max(1 << max(0, log_buckets - 1), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = c.cut(_anchored(_key_blocks(docs.where("doc_id IS NOT NULL"), words, percent, log_buckets), partitions))
    placed = c.cut(_groups(pairs, sets, percent))
    member = placed.groupBy("g").agg(F.min("a").alias("a"), F.count("*").alias("members")).select("g", "a", F.ceil((F.col("members") - 1) / TILE).cast("long").alias("blocks"))
    member = c.cut(member)
    nodes = c.cut(sets.select("h", "rep", "times").join(placed.select("h").distinct(), "h", "left_semi"))
    inner = placed.where("h <> a").join(member.select("g", "blocks"), "g")
    places = inner.select("h", F.col("g").alias("t1"), _block("h", "blocks").alias("t2")).unionByName(member.select(F.col("a").alias("h"), F.col("g").alias("t1"), _all_blocks(F.col("blocks")).alias("t2")))
    roots = components(_tiles(_with_sets(docs, nodes, places.withColumn("t3", F.lit(-1).cast("long")), words), percent))
    large = member.where("blocks > 1")
    if not large.isEmpty():
        stars = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        roots = components(stars.unionByName(_across(docs, placed.select("g", "h").join(large, "g"), nodes, roots, words, percent)))
    linked = roots.join(sets.select("h", "rep"), roots["node"] == sets["h"]).select("h", "root", "rep")
    least = linked.groupBy("root").agg(F.min("rep").alias("component"))
    classes = sets.select("h", "rep").join(linked.join(least, "root").select("h", "component"), "h", "left").select("h", F.coalesce("component", "rep").alias("component_id"))
    out = known.select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("h")).alias("h")).join(classes, "h", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _across(docs: DataFrame, placed: DataFrame, nodes: DataFrame, roots: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges of large groups (``g, h, a, blocks``) between members that blocks kept apart.

    Pairs that have one root need none. So members whose root is not the group's main
    one (that of its smallest set) meet all members of the other blocks.
    """
    root_of = nodes.select("h").join(roots, F.col("h") == F.col("node"), "left").select("h", F.coalesce("root", "h").alias("root"))
    known = placed.join(root_of, "h").join(root_of.select(F.col("h").alias("a"), F.col("root").alias("main")), "a")
    known = c.cut(known.select("g", "h", "blocks", (F.col("root") != F.col("main")).alias("apart"), _block("h", "blocks").alias("b")))
    apart = known.where("apart")
    if apart.isEmpty():
        return docs.sparkSession.createDataFrame([], "u long, v long")
    blocks = apart.select("g", F.col("b").alias("t2")).distinct()
    one = apart.select("h", F.col("g").alias("t1"), F.col("b").alias("t2"), _all_blocks(F.col("blocks")).alias("t3"), F.lit(0).alias("side")).where("t2 <> t3")
    two = known.join(blocks, "g").where("b <> t2").select("h", F.col("g").alias("t1"), "t2", F.col("b").alias("t3"), F.lit(1).alias("side"))
    needed = c.cut(nodes.join(known.select("h").distinct(), "h", "left_semi"))
    return _tiles(_with_sets(docs, needed, one.unionByName(two), words), percent, sided=True)


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Set size and smallest linked id of every document; null texts have no shingles, null ids are linked with nothing, repeated rows are answered each."""
    return near_duplicates(c.table(spark, sf_dir, "documents"), words=SHINGLE, percent=PERCENT)
