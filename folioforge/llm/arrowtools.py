"""Arrow columns to and from flat NumPy buffers, and whole numbers in few bytes."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa


def squeezed(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Whole numbers by byte planes, compressed."""
    kind = np.dtype(kind)
    planes = np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def restored(data: bytes, k: int, kind: str = "<u4") -> np.ndarray:
    """The k numbers that squeezed() got."""
    kind = np.dtype(kind)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=kind.itemsize * k, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, k).T).view(kind).reshape(-1)


def binary_column(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column over one buffer."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def bytes_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and each row's length."""
    parts, lengths = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        chunk = chunk.cast(pa.large_binary())
        offsets = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        if len(chunk) and offsets[-1] > offsets[0]:
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
        lengths.append(np.diff(offsets) if len(chunk) else np.zeros(0, np.int64))
    return np.concatenate(parts), np.concatenate(lengths)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from starts[i] on, lengths[i] of them, for one i after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def released() -> None:
    """Gives back memory that this process holds without using it, as a worker that is used again keeps what its former tasks freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)
