"""Vectorised hashing of texts: numpy over the bytes of whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE_INV = U(pow(int(BASE), -1, 1 << 64))
CHUNK = 1 << 20
_POW: dict[int, np.ndarray] = {}

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space of the word rule: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that close inputs get far outputs."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE (or its inverse) to the powers 0..n-1, modulo 2**64."""
    have = _POW.get(inverse)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        steps = np.full(size, BASE_INV if inverse else BASE, U)
        steps[0] = U(1)
        have = np.multiply.accumulate(steps)
        if size > 4 * CHUNK:
            return have[:n]
        _POW[inverse] = have
    return have[:n]


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.large_binary()
    column = column.cast(pa.large_string()).cast(large) if pa.types.is_string(column.type) else column.cast(large)
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``size`` bytes: first, last, bytes, offsets."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with which the hash of data[s:e] is (S[e] - S[s]) * BASE**(e - 1)."""
    s = np.empty(len(data) + 1, U)
    s[0] = 0
    np.cumsum((data.astype(U) + U(1)) * powers(len(data), True), out=s[1:])
    return s


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[starts:ends]; equal bytes give equal hashes anywhere."""
    p = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * p[np.maximum(ends - 1, 0)] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and of each document its first word's index."""
    inside = ~sep[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[firsts] = inside[firsts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[lasts] = inside[lasts]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def shingle_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    x = words[:m].copy()
    for k in range(1, n):
        x = x * U(0xC2B2AE3D27D4EB4F) + words[k : k + m]
    return mix(x)
