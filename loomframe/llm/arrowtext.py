"""Byte-level views of Arrow string columns, shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one step of a kernel works on; bounds a worker's memory.
SLICE_BYTES = 16 << 20


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (length n + 1, from 0) of a string column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) and not pa.types.is_large_binary(col.type) else b"")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if off is not None and len(col) else np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES, alone: int | None = None) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each of about `most` bytes of text; a text longer than that, or than `alone`, stands alone."""
    n = batch.num_rows
    if not n:
        return
    _, off = string_buffers(batch.column(batch.schema.get_field_index(text)))
    long = np.append(np.flatnonzero(np.diff(off) > (alone or most)), n)
    begin = 0
    while begin < n:
        end = int(np.searchsorted(off, off[begin] + most, "right")) - 1
        end = min(n, max(begin + 1, end))
        next_long = int(long[np.searchsorted(long, begin)])
        end = begin + 1 if next_long == begin else min(end, next_long)
        yield batch.slice(begin, end - begin)
        begin = end


def white_pieces(raw: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Consecutive parts of UTF-8 of about `most` bytes, each but the first beginning with ASCII white space after something else."""
    begin, n = 0, len(raw)
    while n - begin > most:
        cut = -1
        for low, high in ((begin + most // 2, begin + most), (begin + most, n)):
            at, step = low, most // 2
            while cut < 0 and at < high:  # looked for in steps, so that no copy is longer than one
                part = raw[at - 1 : min(at + step, high)]
                white = (part == 0x20) | (part == 0x0A)
                found = np.flatnonzero(white[1:] & ~white[:-1])
                if len(found):
                    cut = at + int(found[-1] if high == begin + most else found[0])
                at += step
        if cut < 0:
            break
        yield raw[begin:cut]
        begin = cut
    yield raw[begin:]


def string_array(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A string array over existing bytes, without a copy of the bytes."""
    return pa.Array.from_buffers(kind or pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def spans_gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of ranges start .. start + length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    ends = np.cumsum(lengths)
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    step[ends[:-1]] = starts[1:] - (starts[:-1] + lengths[:-1]) + 1
    return np.cumsum(step)
