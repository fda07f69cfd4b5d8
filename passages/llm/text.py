"""Vectorised words and word n-grams over Arrow string columns.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII characters of the lowered
text (``[0-9a-z_\\x80-\\U0010ffff]+``). Words are never built as Python strings: a rolling hash over the
UTF-8 buffer gives each word a 64-bit value in a few passes of NumPy. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What separates words, for engines with regular expressions (Java, RE2).
NONWORD = r"[^0-9a-z_\x{80}-\x{10ffff}]+"
SLICE_BYTES = 1 << 20

_CLASS = np.zeros(256, bool)
_CLASS[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True
_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[~_CLASS] = 0
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = 0xD6E8FEB86659FD93
_pow: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls as far as a slice needs them, worked out anew beyond."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 2)
        step = np.full(size, base, np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if size == SLICE_BYTES + 2:
            _pow[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words(NamedTuple):
    """Words of consecutive rows: ``hashes[bounds[i]:bounds[i + 1]]`` are row i's; starts and ends are byte places in ``data``."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    rows: np.ndarray


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (from 0) of a string array without nulls."""
    big = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    off = np.frombuffer(arr.buffers()[1], np.int64 if big else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8)[off[0] : off[-1]] if arr.buffers()[2] is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return data, off - off[0]


def filled(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string array with empty texts for nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.large_string()), "")


def row_slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most so many bytes each, or of one row."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, to
        at = to


def words(arr: pa.Array, lower: bool = True) -> Words:
    """Hash the words of an array of texts without nulls: of a small one at once, of a single long text in runs of whole words."""
    if lower:
        arr = pc.utf8_lower(arr)
    data, off = buffers(arr)
    if len(data) <= SLICE_BYTES or len(off) != 2:
        return _words(data, off)
    parts, at = [], 0
    while at < len(data):
        to = min(len(data), at + SLICE_BYTES)
        while to < len(data):  # a cut before a character that is in no word
            gap = np.flatnonzero(~_CLASS[data[to : to + SLICE_BYTES]])
            if len(gap):
                to += int(gap[0])
                break
            to = min(len(data), to + SLICE_BYTES)
        w = _words(data[at:to], np.array([0, to - at]))
        parts.append((w.hashes, w.starts + at, w.ends + at))
        at = to
    h, starts, ends = (np.concatenate(x) for x in zip(*parts))
    return Words(h, np.array([0, len(h)]), starts, ends, data, off)


def _words(data: np.ndarray, off: np.ndarray) -> Words:
    is_word = _CLASS[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = is_word[:-1], is_word[1:]
    inner = off[(off > 0) & (off < len(data))]
    before[inner], after[inner - 1] = False, False
    starts, ends = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(int(_P), len(data)), out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * powers(int(_P_INV), len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
    return Words(h, np.searchsorted(starts, off), starts, ends, data, off)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """The rows of a batch in small runs, with their words."""
    text = filled(batch.column(column))
    _, off = buffers(text)
    for a, b in row_slices(off):
        yield batch.slice(a, b - a), words(text.slice(a, b - a))


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a row and each row's bounds; a row of 1 to n-1 words has one gram, of all its words."""
    size = np.diff(w.bounds)
    counts = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(w.bounds[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    h = np.concatenate([w.hashes, np.zeros(n, np.uint64)])
    out = np.zeros(len(first), np.uint64)
    for j in range(n):
        out *= np.uint64(_Q)
        out += h[first + j]
    if len(short := np.flatnonzero((size < n) & (size > 0))):
        for r in short:
            v = 0
            for x in w.hashes[w.bounds[r] : w.bounds[r + 1]]:
                v = (v * _Q + int(x)) % (1 << 64)
            out[bounds[r]] = v
    return mix(out), bounds


def window_hashes(w: Words, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of word ranges [lo, hi) of ``w.hashes``."""
    sums = np.zeros(len(w.hashes) + 1, np.uint64)
    np.cumsum(w.hashes * powers(_Q, len(w.hashes)), out=sums[1:])
    inv = powers(pow(_Q, -1, 1 << 64), len(w.hashes) + 1)
    return mix((sums[hi] - sums[lo]) * inv[lo] + (hi - lo).astype(np.uint64))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
