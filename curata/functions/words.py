"""Words of Arrow text columns: runs of a-z and 0-9 of the lower-cased text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACED = np.full(256, ord(" "), np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _SPACED[_c] = _c


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of ``texts`` (strings) in a row, and the row of each. Null texts have none."""
    low = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    low = pa.concat_arrays([low, pa.array([], pa.large_string())])  # offsets and bytes of its own
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)
    spaced = pa.LargeStringArray.from_buffers(len(low), pa.py_buffer(offsets), pa.py_buffer(_SPACED[data]))
    lists = pc.ascii_split_whitespace(spaced)
    flat = lists.flatten()
    rows = np.repeat(np.arange(len(low)), np.asarray(pc.list_value_length(lists)))
    full = pc.not_equal(flat, "")
    return flat.filter(full), rows[np.asarray(full)]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs of about ``size`` bytes of ``column``; a longer text is a run with its forerunners."""
    waiting, held = [], 0
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        first = 0
        while first < batch.num_rows:
            ends = held + np.cumsum(sizes[first:])
            n = min(int(np.searchsorted(ends, size)) + 1, len(ends))
            waiting.append(batch.slice(first, n))
            held, first = int(ends[n - 1]), first + n
            if held >= size:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting, held = [], 0
    if waiting and sum(x.num_rows for x in waiting):
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
