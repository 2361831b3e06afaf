"""Vectorised words and hashes of Arrow text columns.

Texts are worked on as bytes in blocks of about a megabyte, so memory stays
bounded however long a batch is. A longer text is a block of its own; what is
kept of it grows with its words, while hashes are made a megabyte at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
MAX_DOCS = 1 << 15

_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240131)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
MULTIPLIERS = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that end a word: ASCII white space, or all ASCII but digits and lower-case letters.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:128] = True
NON_ALNUM[48:58] = False
NON_ALNUM[97:123] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 2**64)
        for k, b in enumerate((_BASE, inverse)):
            steps = np.full(m, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of consecutive rows of about ``size`` bytes."""
    raw, at = texts_of(column)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + MAX_DOCS)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


@dataclass
class Words:
    """Words of a block: their document in the block, byte range and hash."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each document: index of its first word; one more at the end


def words(raw: np.ndarray, at: np.ndarray, ends: np.ndarray = SPACE, lower: bool = True) -> Words:
    """The words of the texts ``raw[at[i]:at[i + 1]]``; no word spans two texts."""
    data = LOWER[raw] if lower else raw
    n = len(data)
    inside = np.zeros(n + 1, bool)
    np.logical_not(ends[data], out=inside[:n])
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    stops = np.zeros(n + 1, bool)
    stops[1:] = inside[:n] & ~inside[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    both = cut[inside[cut] & inside[cut - 1]]
    begins[both] = True
    stops[both] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(stops)
    first = np.searchsorted(start, at).astype(np.int64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(doc, start, end, span_hash(data, start, end), first)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans in order that don't overlap, the same wherever a span stands; about a block of them at a time."""
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, base + BLOCK_BYTES, "right")))
        part = data[base : int(end[j - 1])]
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[:-1], dtype=np.uint64, out=total[1:])
        a, b = start[i:j] - base, end[i:j] - base
        out[i:j] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive values, one for each start (len - k + 1 of them)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out += h[j : j + m] * MULTIPLIERS[j]
    return mix(out + np.uint64(k))


def gram_starts(first: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Word indexes at which k words of one document begin."""
    i = np.arange(max(0, len(doc) - k + 1))
    return i[doc[i] == doc[i + k - 1]]


def hash_of(text: str, ends: np.ndarray = SPACE) -> np.ndarray:
    """The word hashes of one text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]), ends).hash
