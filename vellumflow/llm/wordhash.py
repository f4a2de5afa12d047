"""Vectorised word splitting and hashing of Arrow string columns.

A word is a maximal run of bytes that are not white space (0x20, 0x09-0x0D); UTF-8 keeps multi-byte characters whole because all
separators are ASCII. Hashes are 64-bit; two different words or word sequences agree with probability 2**-64 each.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Lower case, with a space for every ASCII character that is neither letter nor digit.
PLAIN = _LOWER.copy()
PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes of text, or of one longer row: bounds the memory of the vectorised steps."""
    _, offsets = text_buffer(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, len(column))
        yield i, j
        i = j


#: What a worker keeps between its tasks, by key; only the last one to ask keeps anything.
KEPT: dict = {}


def kept_for(key, make):
    """What this worker keeps under that key, made if it is not there; all else that it kept goes."""
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = make()
    return KEPT[key]


def release_memory(but=None) -> None:
    """Gives what a finished task of this worker no longer uses back to the system, as the worker lives on; what is kept under another key goes too."""
    if but not in KEPT:
        KEPT.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Words:
    """The words of some rows: row (of each word, from 0), start and end (byte positions in data), first (each row's first word; one more entry at the end)."""

    def __init__(self, column: pa.Array, lower: bool = False, bytes_map: np.ndarray | None = None):
        data, offsets = text_buffer(column)
        lo, hi = int(offsets[0]), int(offsets[-1])
        self.data = np.concatenate([data[lo:hi], np.zeros(8, np.uint8)])
        if lower or bytes_map is not None:
            self.data = (_LOWER if bytes_map is None else bytes_map)[self.data]
        n, bounds = hi - lo, offsets - lo
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~_IS_SPACE[self.data[:n]]
        starts, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
        cut = bounds[(bounds > 0) & (bounds < n)]
        cut = cut[inside[cut] & inside[cut + 1]]
        starts[cut] = True
        ends[cut] = True
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, bounds)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self.bounds = bounds

    def hashes(self, seed: int = 0) -> np.ndarray:
        """Hashes of the words; those of two seeds make 128 bits."""
        length = self.end - self.start
        out = mix(length.astype(np.uint64) + np.uint64(int(_STEP) * (2 * seed + 1) % 2**64))
        wide = np.lib.stride_tricks.as_strided(self.data[:8].view(np.uint64), shape=(max(1, len(self.data) - 7),), strides=(1,)) if len(self.data) >= 8 else None
        left, at, todo = length, self.start, None
        while True:
            took = _TAIL[np.minimum(left, 8)]
            if todo is None:
                out = mix((out ^ (wide[at] & took)) * _M2 + _STEP)
            else:
                out[todo] = mix((out[todo] ^ (wide[at] & took)) * _M2 + _STEP)
            more = left > 8
            if not more.any():
                return out
            todo = np.flatnonzero(more) if todo is None else todo[more]
            left, at = left[more] - 8, at[more] + 8


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words (across rows too: the caller drops those that cross)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * _M1 + words[j : j + m]
    return mix(out + np.uint64(n))


def run_starts(w: Words, n: int) -> np.ndarray:
    """Which words start a run of n words of their row; as long as grams()."""
    m = max(0, len(w.row) - n + 1)
    return w.row[:m] == w.row[n - 1 : n - 1 + m]


def as_list(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and each row's count."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))
