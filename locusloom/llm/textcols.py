"""Vectorised words and shingles of Arrow string columns, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20  # bytes hashed at a time: bounds the memory besides one word's
_rng = np.random.Generator(np.random.PCG64(20260101))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z is lower-cased
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE, 1 << (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        grow = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)]))
        _powers[size] = grow(_BASE), grow(_INVERSE)
    return _powers[size]


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and each row's offsets in them; nulls are empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, each word's start and end in them, and where each row's words begin (rows + 1 offsets).

    Words are runs of bytes other than blanks (x20, x09-x0D).
    """
    data, offsets = string_bytes(column)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts = np.flatnonzero(inside & ~before[: len(data)])
    ends = np.flatnonzero(inside & ~after[: len(data)]) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans in order, after A-Z is lower-cased."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + SLICE, "right")))
        b = ends[j - 1]
        power, inverse = _tables(int(b - a))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data[a:b]] * power[: b - a])])
        s = starts[i:j] - a
        out[i:j] = (sums[ends[i:j] - a] - sums[s]) * inverse[s]
        i = j
    return mix(out)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each row's begin among them (rows + 1 offsets)."""
    data, starts, ends, at = word_spans(column)
    return span_hashes(data, starts, ends), at


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each row's distinct shingles as sorted hashes; fewer words than ``width`` make one shingle."""
    words, at = word_hashes(column)
    salts = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    for a, b in zip(at[:-1], at[1:], strict=True):
        n = int(b - a)
        if n == 0:
            yield words[:0]
            continue
        k = min(width, n)
        h = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            h += mix(words[a + i : b - k + 1 + i] * salts[i])
        yield np.unique(mix(h))
