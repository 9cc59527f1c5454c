"""Words of many texts at once, on the UTF-8 bytes of an Arrow string column.

The byte buffer of a column is split into words with lookup tables and 64-bit
word hashes are taken from running sums, so no Python object is made per word.
Every helper works on chunks of a bounded number of bytes; a chunk holds whole
texts only (a text longer than the bound is a chunk of its own).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 512_000


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _TRIM = _LIBC.malloc_trim
except (OSError, AttributeError):  # another C library: nothing to set
    _LIBC = _TRIM = None


def _bounded_heap() -> None:
    """Let the C library hand large freed arrays back to the system, and Arrow
    take its buffers from it, so that the Python workers of an executor do not
    keep the sum of their peaks."""
    if _LIBC is not None:
        _LIBC.mallopt(-3, 1 << 20)   # M_MMAP_THRESHOLD
        _LIBC.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD
        _LIBC.mallopt(-8, 2)         # M_ARENA_MAX
        pa.set_memory_pool(pa.system_memory_pool())


def release() -> None:
    """Give free memory back; called after each batch of texts."""
    if _TRIM is not None:
        _TRIM(0)


_bounded_heap()
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (shift-multiply)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


# a random 64-bit value per byte, made by rule
_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, b in enumerate((_BASE, _INV)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POW[k] = np.cumprod(p, dtype=np.uint64)
    out = _POW[0][:n], _POW[1][:n]
    if n > CHUNK_BYTES + 1:  # do not hold the tables of one very long text
        _POW[0], _POW[1] = _POW[0][:CHUNK_BYTES + 1].copy(), _POW[1][:CHUNK_BYTES + 1].copy()
    return out


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, stop, bytes, offsets) of consecutive texts, at most ``limit``
    bytes unless a single text is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j
    release()


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray,
          cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of word bytes, never
    across texts or ``cut`` positions, and the number of words per text.
    ``is_word`` is a table of 256 flags."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    w = np.zeros(n + 2, bool)
    w[1:-1] = is_word[data]
    brk = np.zeros(n + 1, bool)
    brk[offsets] = True
    if cut is not None:
        brk[cut] = True
    starts = np.flatnonzero(w[1:-1] & (~w[:-2] | brk[:-1]))
    ends = np.flatnonzero(w[1:-1] & (~w[2:] | brk[1:])) + 1
    per = np.diff(np.searchsorted(starts, offsets, side="left"))
    return starts, ends, per


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range."""
    n = len(data)
    pw, inv = _powers(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * pw[:n], out=run[1:], dtype=np.uint64)
    h = (run[ends] - run[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """256 flags, true inside the inclusive byte ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a:b + 1] = True
    return out


NOT_SPACE = ~table((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
