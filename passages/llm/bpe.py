"""Byte-pair encoding of whole Arrow columns with a public vocabulary.

Encoding a text is splitting it by the tokenizer's pattern and encoding each piece. Pieces repeat far more
than texts do, so the split is done in NumPy over the UTF-8 buffer and only pieces that a worker has not
yet met go through the library. Rows with characters whose class the byte tables don't know (anything but
ASCII and the letters U+00C0 to U+00FF) are encoded by the library outright; the ids are always the same.

The library's pattern engine gives up on very long runs of white space, so a long text goes to it in parts. White space after
anything else always starts a piece, so a text may be cut there; the white space of a long run that the pattern
takes for one piece (all of it at the text's end, else all but the last) is encoded as such.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from passages.llm.text import SLICE_BYTES, buffers, mix, powers, row_slices

#: Where the public vocabularies lie on the machines; another place is given as the operators' ``vocabulary``.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers.
KEEP = 200_000

#: Characters of a text that the library gets at once, at least; runs of white space longer than RUN are encoded apart.
PART, RUN = 1 << 16, 256
#: White space as the pattern engine has it (Python's has four control characters more).
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CUT = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])")
_LONG = re.compile(f"[{_WHITE}]{{{RUN},}}")

_L, _N, _O, _S = 1, 2, 3, 4
_CLASS = np.full(256, _O, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _L
_CLASS[48:58] = _N
_CLASS[[9, 10, 11, 12, 13, 32]] = _S
_TABLE = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0xA24BAED4963EE407
_P_INV = pow(_P, -1, 1 << 64)


def split(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte places at which the pattern's pieces start, for rows of ASCII and Latin-1 letters."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    cls = _CLASS[data]
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    cut[1:n] = cls[1:] != cls[:-1]
    row = np.zeros(n + 1, bool)
    row[off] = True
    cut |= row
    # the last white space before a piece goes with it if it is a space, and stands alone otherwise
    at = np.flatnonzero(cut[1:n] & ~row[1:n] & (cls[1:] != _S) & (cls[:-1] == _S)) + 1
    cut[at - 1] = True
    spaced = at[data[at - 1] == 32]
    cut[spaced] = False
    # contractions: an apostrophe that starts a piece, with letters after it
    q = np.flatnonzero(data == 39)
    if len(q):
        q = q[cut[q] & (q + 1 < n)]
        q = q[cut[q + 1] & ~row[q + 1] & (cls[q + 1] == _L)]
        pad = np.concatenate([data, np.zeros(3, np.uint8)])
        for p in q:
            a, b = chr(pad[p + 1]), chr(pad[p + 2]) if not row[p + 2] else ""
            k = 1 if a in "stmd" else 2 if a + b in ("re", "ve", "ll") else 0
            if k:
                cut[p + 1] = False
                cut[p + 1 + k] = True
    return np.flatnonzero(cut[:n])


def cuts(text: str, least: int) -> Iterator[str]:
    """Parts of at least so many characters (but the last) whose encodings are the text's one after another."""
    at = 0
    while len(text) - at > least and (m := _CUT.search(text, at + least)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class Encoder:
    def __init__(self, path: str = DEFAULT_VOCABULARY):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._reset()

    def _reset(self):
        self.known = pd.Index(np.empty(0, np.uint64))
        self.sizes = np.empty(0, np.int32)
        self.first = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)

    def _pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each piece's place among the known ones; new ones are encoded first."""
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * powers(_P, len(data)), out=sums[1:])
        h = mix((sums[ends] - sums[starts]) * powers(_P_INV, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
        codes, unique = pd.factorize(h)
        at = self.known.get_indexer(unique)
        if len(new := np.flatnonzero(at < 0)):
            some = np.full(len(unique), -1)
            some[codes[::-1]] = np.arange(len(codes))[::-1]
            raw = data.tobytes()
            out = [self.bpe._encode_single_piece(raw[a:b]) if b - a > 1 else self.bpe.encode_ordinary(raw[a:b].decode()) if raw[a] < 128 else [] for a, b in zip(starts[some[new]].tolist(), ends[some[new]].tolist())]
            size = np.fromiter(map(len, out), np.int32, len(out))
            flat = np.fromiter((i for x in out for i in x), np.int32, int(size.sum()))
            at[new] = len(self.known) + np.arange(len(new))
            self.known = self.known.append(pd.Index(unique[new]))
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
            self.sizes, self.ids = np.concatenate([self.sizes, size]), np.concatenate([self.ids, flat])
        return at[codes]

    def whole(self, text: str) -> list[int]:
        """The ids of a text of any length and characters."""
        if len(text) <= RUN:
            return self.bpe.encode_ordinary(text)
        out, at = [], 0
        for m in _LONG.finditer(text):
            a, b = m.start(), m.end() - (m.end() < len(text))
            out += self._parts(text[at:a])
            out += self.bpe._encode_single_piece(text[a:b].encode())
            at = b
        return out + self._parts(text[at:])

    def _parts(self, text: str) -> list[int]:
        return [i for t in cuts(text, PART) for i in self.bpe.encode_ordinary(t)]

    def encode(self, arr: pa.Array, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of each text (no nulls) and, if asked for, all ids in one run."""
        data, off = buffers(arr)
        n = len(off) - 1
        if n == 0:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        odd = ((data >= 0x80) & (data < 0xC3)) | (data > 0xC3)  # of these only the second bytes of two are known
        lead = np.zeros(len(data), bool)
        lead[1:] = data[:-1] == 0xC3
        bad = (odd & ~(lead & (data < 0xC0))) | (lead & ((data == 0x97) | (data == 0xB7)))
        slow = np.add.reduceat(np.append(bad, False).astype(np.int64), np.minimum(off[:-1], len(bad))) > 0
        slow &= np.diff(off) > 0
        counts, parts = np.zeros(n, np.int64), []
        at = 0
        while at < n:
            to = at + 1
            while to < n and slow[to] == slow[at]:
                to += 1
            if slow[at]:
                for r in range(at, to):
                    t = self.whole(arr[r].as_py())
                    counts[r] = len(t)
                    parts.append(np.array(t, np.int32))
            else:
                d, o = data[off[at] : off[to]], off[at : to + 1] - off[at]
                starts = split(d, o)
                if len(starts):
                    piece = self._pieces(d, starts, np.append(starts[1:], len(d)))
                    size = self.sizes[piece]
                    sums = np.concatenate([[0], np.cumsum(size)])
                    counts[at:to] = np.diff(sums[np.searchsorted(starts, o)])
                    if ids:
                        parts.append(self.ids[np.repeat(self.first[piece] - sums[:-1], size) + np.arange(sums[-1])])
            at = to
        return counts, np.concatenate(parts) if ids and parts else np.empty(0, np.int32)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker and vocabulary."""
    return Encoder(path)


def encoded(arr: pa.Array, path: str, ids: bool = True):
    """(first row, end row, counts, ids) for small runs of rows."""
    e = encoder(path)
    off = buffers(arr)[1]
    for a, b in row_slices(off):
        if off[b] - off[a] <= 2 * SLICE_BYTES:
            yield a, b, *e.encode(arr.slice(a, b - a), ids)
        else:  # one long text, in parts
            got = [e.encode(pa.array([t], pa.large_string()), ids) for t in cuts(arr[a].as_py(), SLICE_BYTES)]
            yield a, b, np.array([sum(int(n[0]) for n, _ in got)]), np.concatenate([i for _, i in got])
        if len(e.known) > KEEP or len(e.ids) > 4 * KEEP:
            e._reset()
