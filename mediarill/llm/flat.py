"""Texts of an Arrow column as flat bytes, and back."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and where each begins (one more, the end); nulls are empty."""
    column = pc.fill_null(column.cast(pa.string()), "")
    n = len(column)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int32, n + 1, column.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def text_array(texts: Sequence[bytes]) -> pa.Array:
    """A string column of UTF-8 texts, taken as they are."""
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(texts))])


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before, first = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if before and before + size > most:
            yield batch.slice(first, k - first)
            before, first = 0, k
        before += size
    if batch.num_rows:
        yield batch.slice(first)
