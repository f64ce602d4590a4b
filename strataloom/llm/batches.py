"""Vectorised text primitives shared by the operators of this subpackage.

Text columns arrive from Spark as Arrow arrays.  The helpers here look at the
raw UTF-8 buffer of such an array with numpy, so that finding and hashing the
words of a whole batch costs a few array passes and no Python loop per word.

Words are maximal runs of bytes other than ``\\x20`` and ``\\x09``-``\\x0D``; all
six are ASCII, so cutting UTF-8 at them never splits a character.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds the numpy scratch memory of a task.
CHUNK_BYTES = 1 << 18

#: This process's C library; some have no malloc_trim.
_LIBC = ctypes.CDLL(None)

#: What an operator keeps in this worker between its tasks; it goes when another operator's texts come.
RESIDENT: dict[Any, Any] = {}

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_K = np.uint64(0x9E3779B97F4A7C15)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and its row offsets (nulls: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str | int = "text", limit: int = CHUNK_BYTES, *, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes of text each (one row at least); ``RESIDENT`` goes first, unless it is the caller's to ``keep``."""
    if RESIDENT and not keep:
        RESIDENT.clear()
        gc.collect()
        give_back()
    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
    give_back()


def give_back() -> None:
    """Return freed memory to the machine: workers live on between stages and share an executor's memory with each other."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim is not None:
        trim(0)


class Words:
    """Words of the rows of one text buffer.

    ``start``/``end`` are byte positions, ``first`` has for each row the index
    of its first word (one more entry than rows), ``row`` each word's row.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        inside = ~IS_SPACE[raw]
        before = np.zeros(len(raw) + 1, dtype=bool)
        before[1:] = inside
        before[offsets] = False  # a row starts a word afresh
        self.start = np.flatnonzero(inside & ~before[:-1])
        after = np.zeros(len(raw) + 1, dtype=bool)
        after[: len(raw)] = inside
        after[offsets] = False
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes, A-Z lower-cased on demand."""
        return hash_spans(LOWER[self.raw] if lower else self.raw, self.start, self.end)


def eight(raw: np.ndarray) -> np.ndarray:
    """A view whose item i holds the eight bytes from i on (zeros after the end)."""
    padded = np.zeros(len(raw) + 8, dtype=np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded.tobytes(), strides=(1,))


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``raw[start:end]``, eight bytes at a time for all spans at once."""
    lanes = eight(raw)
    size = end - start
    out = mix(size.astype(np.uint64) * _K + np.uint64(1))
    live = np.flatnonzero(size > 0)
    at = 0
    while len(live):
        left = size[live] - at
        lane = lanes[start[live] + at]
        short = left < 8
        if short.any():
            bits = (8 * left[short]).astype(np.uint64)
            lane[short] &= (np.uint64(1) << bits) - np.uint64(1)
        out[live] = mix((out[live] ^ lane) * _K)
        live = live[left > 8]
        at += 8
    return out


def per_row(n_rows: int, rows: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Sums (or counts) of items by row."""
    return np.bincount(rows, weights=weights, minlength=n_rows)[:n_rows]
