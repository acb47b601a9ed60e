"""Arrow string columns as numpy code-point arrays, and back.

Both directions work on whole record batches: one decode or encode per batch, no per-row string calls.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def to_codepoints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all rows end to end, row offsets with one more entry than rows). A null row has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    _, offsets_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64)[column.offset : column.offset + n + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = memoryview(data_buffer)[lo:hi] if hi > lo else memoryview(b"")
    raw = np.frombuffer(data, np.uint8)
    offsets = offsets - lo
    if len(raw) == 0 or raw.max() < 128:
        return raw.astype(np.uint32), offsets
    cps = np.frombuffer(bytes(data).decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=starts[1:])
    return cps, starts[offsets]


def from_codepoints(cps: np.ndarray, offsets: np.ndarray, null_mask: np.ndarray | None = None) -> pa.Array:
    """The reverse of to_codepoints. null_mask: true where a row is null."""
    cps = np.ascontiguousarray(cps, dtype=np.uint32)
    data = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (cps > 0x7F).astype(np.int64) + (cps > 0x7FF) + (cps > 0xFFFF)
    ends = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(width, out=ends[1:])
    byte_offsets = ends[offsets].astype(np.int64)
    out = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(byte_offsets.tobytes()), pa.py_buffer(data))
    if null_mask is not None and null_mask.any():
        out = pa.array(np.where(null_mask, None, np.array(out.to_pylist(), dtype=object)), pa.large_string())
    return out.cast(pa.string())


def slices(batch: pa.RecordBatch, column: str, limit: int = 2_000_000):
    """The batch in consecutive parts of about `limit` code points or bytes of the column each, so arrays made from a part
    stay small whatever the batch holds. A single longer row is a part of its own."""
    col = batch.column(column).cast(pa.large_string())
    n = len(col)
    if n == 0:
        return
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(ends, ends[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield batch.slice(lo, hi - lo)
        lo = hi
