"""Words of Arrow text batches as 64-bit hashes, computed with numpy over whole buffers.

A word is a run of bytes outside ``\\x20\\x09-\\x0D``, which UTF-8 never uses inside a character, so
the pattern ``[^\\x20\\x09-\\x0D]+`` on characters and on bytes finds the same words. Two words
are taken as equal when their 64-bit hashes are (a random polynomial of a random byte table).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CHUNK = 1 << 18
U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(29)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(32)
    return h


@lru_cache(maxsize=4)
def _tables(seed: int) -> tuple[np.ndarray, int, int]:
    rng = np.random.default_rng(1000 + seed)
    base = int(rng.integers(0, 1 << 63, dtype=np.uint64)) | 1
    return rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1), base, pow(base, -1, 1 << 64)


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    have = 1
    while have < n:  # doubling: base^(have + i) = base^have * base^i
        more = min(have, n - have)
        out[have : have + more] = out[:more] * U(pow(base, have, 1 << 64))
        have += more
    return out


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, or of binary values, and their offsets; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_large_binary(col.type) else "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = offs[:-1] < offs[1:]
    at = offs[:-1][full]
    first[at] = word[at]
    at = offs[1:][full] - 1
    last[at] = word[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, worked out over pieces of about CHUNK bytes."""
    table, base, inverse = _tables(seed)
    out, i, n = np.empty(len(starts), U), 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        size = max(CHUNK, 1 << (hi - lo).bit_length()) + 1
        sums = np.zeros(hi - lo + 1, U)
        np.cumsum(table[data[lo:hi]] * _powers(base, size)[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * _powers(inverse, size)[s] + (e - s).astype(U)
        i = j
    return mix(out)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows within each text, and the windows' offsets by text. A text with
    fewer than k words has its whole sequence as its one window; one without words has none."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=at[1:])
    odd = [U(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(k)]
    if len(h) >= k:
        every = h[: len(h) - k + 1] * odd[0]
        for i in range(1, k):
            every += h[i : len(h) - k + 1 + i] * odd[i]
        starts = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
        out = every[np.minimum(starts, len(every) - 1)]
    else:
        out = np.zeros(at[-1], U)
    for r in np.flatnonzero((n > 0) & (n < k)):
        out[at[r]] = U(n[r]) + (h[first[r] : first[r + 1]] * np.array(odd[: n[r]], U)).sum(dtype=U)
    return mix(out), at


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` text bytes; one longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = buffer_of(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j
    release()


def release() -> None:
    """Give the allocators' free memory back: workers stay for other tasks, and so would their peaks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def binary(rows: np.ndarray) -> pa.Array:
    """A 2-d array as one binary value a row."""
    rows = np.ascontiguousarray(rows)
    width = rows.strides[0] if rows.ndim == 2 and len(rows) else 1
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int64) * width), pa.py_buffer(rows)])


def spans(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Slices of a flat array, cut at ``offs``, as binary values."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(np.asarray(offs, np.int64) * values.itemsize), pa.py_buffer(values)])
