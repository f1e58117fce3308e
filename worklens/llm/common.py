"""Helpers shared by the corpus operators: shared storage and batch iteration."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import functions as F

from ..plans.state import settle as stash

__all__ = ["remainder", "resident", "slices", "spread", "squeezed", "stash", "text_bytes", "vacate"]

_resident: dict = {}


def text_bytes(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string or binary column as one byte array and n+1 offsets; null counts as empty."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.binary())
    arr = arr.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds about `most_bytes` of `column` (one longer row stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most_bytes, prepend=0)) if len(sizes) else []
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def remainder(id_col: str, m: int):
    """crc32 of the id as text, modulo m."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(m))


def squeezed(values: np.ndarray) -> bytes:
    """An array's bytes, compressed, for packed columns that travel."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def spread(parts: list[bytes], kind) -> list[np.ndarray]:
    """The arrays behind squeezed() columns."""
    return [np.frombuffer(zstandard.ZstdDecompressor().decompress(p), kind) for p in parts]


def resident(key, make):
    """An object that a Python worker keeps between tasks. A worker keeps one at a time: it serves one operator after another."""
    if key not in _resident:
        vacate()
        _resident[key] = make()
    return _resident[key]


def vacate() -> None:
    """Let go of what an earlier operator kept in this worker, and give freed memory back: workers outlive a stage, and so does what they hold."""
    if _resident:
        _resident.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
