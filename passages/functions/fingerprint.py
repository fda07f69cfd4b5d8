"""Tokens, k-gram hashes and winnowing over Arrow string columns.

A token is what is left of a white-space-parted word once characters other than letters, digits and
underscores are deleted. Tokens are hashed by a 64-bit FNV-1a variant over UTF-8, reduced modulo 2**31 - 1;
k consecutive hashes are the digits of a polynomial in ``base``; the least k-gram hash of each window (the rightmost of equals) is
a fingerprint. All of it works on whole batches: the UTF-8 buffer is classified byte by byte, equal tokens are hashed once,
and window minima come from doubling, so cost is a few passes whatever the window.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from passages.functions.unicode_classes import PUNCTUATION, SPACES
from passages.params import MODULUS, IndexParams
from passages.storage import text_batches

FNV_START = 1469598103934665603
FNV_PRIME = 1099511628211
SLICE = 1 << 19
_DROP, _WORD, _SPACE = 0, 1, 2


class Tokens(NamedTuple):
    """Tokens of consecutive rows: row i has ``bounds[i]:bounds[i + 1]``; starts and ends are places in ``data``, the bytes without dropped characters."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point, as Python's \\w and isspace have them."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    chars = [chr(c) for c in range(sys.maxunicode + 1)]
    word = re.compile(r"\w")
    out[[i for i, c in enumerate(chars) if word.match(c)]] = _WORD
    out[[i for i, c in enumerate(chars) if c.isspace()]] = _SPACE
    return out


@functools.cache
def _ascii() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for c in range(128):
        out[c] = _SPACE if chr(c).isspace() else _WORD if re.match(r"\w", chr(c)) else _DROP
    return out


_kept: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _kept or len(_kept[base]) < n:
        step = np.full(max(n, SLICE + 1), base, np.uint64)
        step[0] = 1
        _kept[base] = np.multiply.accumulate(step)
    return _kept[base][:n]


def as_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.empty(0, np.uint8)
    return data, off - off[0]


def classify(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    if not len(data) or data.max() < 128:
        return _ascii()[data]
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    b = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    b0, b1, b2, b3 = (b[at + i] for i in range(4))
    code = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, (b0 & 31) << 6 | b1 & 63, np.where(b0 < 0xF0, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63)))
    return _classes()[code][np.cumsum(lead) - 1]


def tokenize(arr: pa.Array, punctuation: bool = False) -> Tokens:
    """Tokens of a large_string array without nulls."""
    data, off = as_buffers(arr)
    cls = classify(data)
    if punctuation:
        cls = np.where(cls == _DROP, _WORD, cls)
    keep = cls != _DROP
    place = np.concatenate([[0], np.cumsum(keep)])
    data, cls, off = data[keep], cls[keep], place[off]
    word = cls == _WORD
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    inner = off[(off > 0) & (off < len(data))]
    before[inner], after[inner - 1] = False, False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return Tokens(data, starts, ends, np.searchsorted(starts, off))


def token_hashes(t: Tokens) -> np.ndarray:
    """FNV-1a modulo 2**64, then modulo 2**31 - 1, of each token; equal tokens are hashed once."""
    n = len(t.starts)
    if not n:
        return np.empty(0, np.int64)
    size = t.ends - t.starts
    # a cheap key to find equal tokens: a polynomial over the bytes
    p = 0x9E3779B97F4A7C15
    power, inverse = _powers(p, len(t.data) + 1), _powers(pow(p, -1, 1 << 64), len(t.data) + 1)
    mixed = (t.data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * power[: len(t.data)])])
    key = (sums[t.ends] - sums[t.starts]) * inverse[t.starts] * np.uint64(p) + size.astype(np.uint64)
    code, unique = pd.factorize(key)
    some = np.empty(len(unique), np.int64)
    some[code[::-1]] = np.arange(n)[::-1]
    order = np.argsort(-size[some], kind="stable")
    start, length = t.starts[some][order], size[some][order]
    h = np.full(len(some), FNV_START, np.uint64)
    live = len(some)
    for j in range(int(length[0])):
        live = int(np.searchsorted(-length[:live], -j, "left"))
        h[:live] = (h[:live] ^ t.data[start[:live] + j]) * np.uint64(FNV_PRIME)
    out = np.empty(len(some), np.int64)
    out[order] = (h % np.uint64(MODULUS)).astype(np.int64)
    return out[code]


def kgram_hashes(h: np.ndarray, length: int, base: int) -> np.ndarray:
    """Polynomial hash of each run of ``length`` token hashes (runs across rows included; callers drop them)."""
    n = len(h) - length + 1
    if n <= 0 or length <= 0:
        return np.empty(0, np.int64)
    out = np.zeros(n, np.int64)
    for j in range(length):
        out += h[j : j + n] * pow(base, length - j, MODULUS) % MODULUS
    return out % MODULUS


def fingerprints(arr: pa.Array, p: IndexParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, fingerprint) of all rows, in order."""
    t = tokenize(arr, p.punctuation)
    g = kgram_hashes(token_hashes(t), p.length, p.base)
    last = np.repeat(t.bounds[1:], np.diff(t.bounds))  # end of each token's row
    starts = len(g) - p.window_size + 1
    if starts <= 0 or p.window_size <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)
    if p.window_size == 1:
        at = np.flatnonzero(np.arange(len(g)) + p.length <= last[: len(g)])
    else:
        bits = max(1, int(len(g)).bit_length())
        if bits > 32:
            raise ValueError("a text of over 2**32 tokens")
        low = (1 << bits) - 1
        key = g << bits | (low - np.arange(len(g)))
        m, have = key, 1
        while have * 2 <= p.window_size:
            m = np.minimum(m[:-have], m[have:])
            have *= 2
        m = np.minimum(m[:starts], m[p.window_size - have : p.window_size - have + starts])
        whole = np.arange(starts) + p.window_size + p.length - 1 <= last[:starts]
        at = np.unique(low - (m[whole] & low))
    row = np.searchsorted(t.bounds, at, "right") - 1
    return row, (at - t.bounds[row]).astype(np.int32), g[at]


def batches(arr: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most so many bytes, or of one row."""
    off = as_buffers(arr)[1]
    at, n = 0, len(arr)
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, to
        at = to


def texts(col: pa.Array) -> pa.Array:
    return pc.fill_null(col.cast(pa.large_string()), "")


def fingerprint_rows(docs: DataFrame, p: IndexParams = IndexParams(), id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id_col, pos, fp) for every fingerprint; null texts have none."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            text = texts(b.column(1))
            for x, y in batches(text):
                row, pos, fp = fingerprints(text.slice(x, y - x), p)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + x)), pa.array(pos), pa.array(fp)], [id_col, "pos", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return text_batches(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, pos int, fp long")


# -- the same as expressions -------------------------------------------------


def tokens_column(text: str | Column, punctuation: bool = False) -> Column:
    """Array of tokens."""
    c = F.col(text) if isinstance(text, str) else text
    c = F.coalesce(c, F.lit(""))
    if not punctuation:
        c = F.regexp_replace(c, PUNCTUATION, "")
    return F.filter(F.split(c, SPACES), lambda t: t != "")


def token_rows(docs: DataFrame, id_col: str = "id", text_col: str = "text", punctuation: bool = False) -> DataFrame:
    """(id_col, pos, token)"""
    return docs.select(id_col, F.posexplode(tokens_column(text_col, punctuation)).alias("pos", "token"))


def hash_rows(docs: DataFrame, p: IndexParams = IndexParams(), id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id_col, pos, token_hash)"""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            text = texts(b.column(1))
            for x, y in batches(text):
                t = tokenize(text.slice(x, y - x), p.punctuation)
                row = np.repeat(np.arange(y - x), np.diff(t.bounds))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + x)), pa.array((np.arange(len(row)) - t.bounds[row]).astype(np.int32)), pa.array(token_hashes(t))], [id_col, "pos", "token_hash"])

    kind = docs.schema[id_col].dataType.simpleString()
    return text_batches(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, pos int, token_hash long")


def offset_rows(docs: DataFrame, id_col: str = "id", text_col: str = "text", punctuation: bool = False) -> DataFrame:
    """(id_col, pos, start, end): character spans of tokens, from the first to behind the last word character of each."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            text = texts(b.column(1))
            for x, y in batches(text):
                part = text.slice(x, y - x)
                data, off = as_buffers(part)
                cls = classify(data)
                kept = np.flatnonzero(cls != _DROP) if not punctuation else np.arange(len(data))
                char = np.cumsum((data & 0xC0) != 0x80)  # characters up to each byte
                before = np.concatenate([[0], char])[off[:-1]]
                t = tokenize(part, punctuation)
                row = np.repeat(np.arange(y - x), np.diff(t.bounds))
                start, end = char[kept[t.starts]] - 1 - before[row], char[kept[t.ends - 1]] - before[row]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + x)), pa.array((np.arange(len(row)) - t.bounds[row]).astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], [id_col, "pos", "start", "end"])

    kind = docs.schema[id_col].dataType.simpleString()
    return text_batches(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, pos int, start int, end int")


def token_offsets(document: str, punctuation: bool = False) -> list[tuple[int, int]]:
    """Character spans of one text's tokens, from the first to behind the last word character of each; one for each token of the tokenizer."""
    out = []
    for m in re.finditer(r"\S+", document.translate(_SEPARATORS)):
        a, b = m.span()
        if not punctuation:
            word = [i for i in range(a, b) if document[i] == "_" or document[i].isalnum()]
            if not word:
                continue
            a, b = word[0], word[-1] + 1
        out.append((a, b))
    return out


#: re's \s is str.isspace, but for these it is spelled out.
_SEPARATORS = {c: " " for c in (0x1C, 0x1D, 0x1E, 0x1F, 0x85)}
