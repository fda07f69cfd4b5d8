"""Local alignment of character sequences with costs that forgive spacing, dashes, case and punctuation.

The dynamic program runs along anti-diagonals in NumPy: cells of one diagonal don't depend on each other. Texts whose combined length reaches
``one_pass`` are scored first without traceback, and only a window before the best end is aligned again.
"""

from __future__ import annotations

import difflib
import html
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

DASHES, STOPS, SYMBOLS = "-—–", ".,!?;:", "@#$%^&*()_+=/\\|<>"
REGION = "struct<start1: int, end1: int, start2: int, end2: int, score: double>"


@dataclass(frozen=True)
class AlignParams:
    one_pass: int = 1000
    min_region: int = 10
    match: float = 1.0


@dataclass
class Alignment:
    text1: str
    text2: str
    regions: list[dict] = field(default_factory=list)
    #: Whether the pass over the window scored as the pass over the whole texts did.
    agrees: bool = True

    def score(self) -> float:
        return max((r["score"] for r in self.regions), default=0.0)

    def html(self) -> str:
        """Regions side by side, equal runs green and others red."""
        out = []
        for r in self.regions:
            a, b = self.text1[r["start1"] : r["end1"]], self.text2[r["start2"] : r["end2"]]
            cells = [[], []]
            for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
                colour = "#cfc" if op == "equal" else "#fcc"
                for cell, part in zip(cells, (a[i:j], b[k:m])):
                    cell.append(f'<span style="background:{colour}">{html.escape(part)}</span>' if part else "")
            out.append(f"<tr><td>{''.join(cells[0])}</td><td>{''.join(cells[1])}</td><td>{r['score']:.1f}</td></tr>")
        return f"<table>{''.join(out)}</table>"


def gap_cost(c: str) -> float:
    for chars, cost in ((" \t\n\r", 0.1), (DASHES, 0.2), (STOPS, 0.3), (SYMBOLS, 0.5)):
        if c in chars:
            return cost
    return 1.0


def substitution_cost(a: str, b: str) -> float:
    if a == b:
        return 0.0
    if a.isspace() and b.isspace():
        return 0.1
    if a in DASHES and b in DASHES or a.lower() == b.lower():
        return 0.2
    if a in STOPS and b in STOPS:
        return 0.3
    return 0.5 if a in SYMBOLS and b in SYMBOLS else 1.0


def _encode(a: str, b: str):
    points = np.frombuffer((a + b).encode("utf-32le", "surrogatepass"), np.uint32)
    alphabet, codes = np.unique(points, return_inverse=True)
    chars = [chr(c) for c in alphabet]
    gaps = np.array([gap_cost(c) for c in chars], np.float32)
    table = np.array([[substitution_cost(x, y) for y in chars] for x in chars], np.float32).reshape(len(chars), len(chars))
    return codes[: len(a)], codes[len(a) :], gaps, table


def _sweep(s: np.ndarray, t: np.ndarray, match: float, gaps: np.ndarray, table: np.ndarray, trace: bool):
    """Best score and its first end in row order; with ``trace`` also the direction of every cell (0 stop, 1 diagonal, 2 up, 3 left)."""
    n, m = len(s), len(t)
    h0, h1, h2 = (np.zeros(n + 1, np.float32) for _ in range(3))  # diagonals d-2, d-1, d, by row
    moves = np.zeros((n + 1, m + 1), np.uint8) if trace else None
    best, bi, bj = 0.0, 0, 0
    gs = gaps[s].astype(np.float32) if n else np.empty(0, np.float32)
    gt = gaps[t].astype(np.float32) if m else np.empty(0, np.float32)
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        i = np.arange(lo, hi + 1)
        j = d - i
        a, b = s[i - 1], t[j - 1]
        corner = h0[lo - 1 : hi]
        diag = np.where(a == b, corner.astype(np.float64) + match, (corner - table[a, b]).astype(np.float64))
        left = (h1[lo : hi + 1] - gt[j - 1]).astype(np.float64)
        up = (h1[lo - 1 : hi] - gs[i - 1]).astype(np.float64)
        score = np.maximum(np.maximum(diag, 0), np.maximum(left, up))
        h2[:] = 0
        h2[lo : hi + 1] = score
        k = int(score.argmax())
        top = float(score[k])
        if top > best or top == best and best > 0 and (lo + k, d - lo - k) < (bi, bj):
            best, bi, bj = top, lo + k, d - lo - k
        if trace:
            moves[i, j] = np.where(score == 0, 0, np.where(score == diag, 1, np.where(score == up, 2, 3)))
        h0, h1, h2 = h1, h2, h0
    return best, bi, bj, moves


#: Cells of a diagonal that are worked on at a time, all pairs of a group together, and characters of a group, each pair counted as its longest.
CELLS, CHARS = 1 << 14, 1 << 22


def _groups(width: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
    """Places of pairs by length, in groups within CELLS and CHARS, or of one pair."""
    order, a = np.argsort(length, kind="stable"), 0
    while a < len(order):
        b, wide = a + 1, width[order[a]]
        while b < len(order) and (b + 1 - a) * max(wide, width[order[b]]) <= CELLS and (b + 1 - a) * length[order[b]] <= CHARS:
            wide = max(wide, width[order[b]])
            b += 1
        yield order[a:b]
        a = b


def best_scores(pairs: list[tuple[str, str]], p: AlignParams = AlignParams(), least: float = 0.0) -> list[tuple[float, int, int]]:
    """Best score of each pair and its first end in row order, as ``_sweep`` gives them, many pairs at a time. Scores under ``least`` may come out lower: an
    alignment that passes k columns to one side of the main diagonal leaves k characters out, so cells too far out for such a score aren't looked at."""
    out = [(0.0, 0, 0)] * len(pairs)
    some = [i for i, (a, b) in enumerate(pairs) if a and b]
    if not some:
        return out
    # an alignment on diagonal k (column less row) scores at most min(n, m - k) for k > 0 and min(m, n + k) for k < 0; sums of rounded costs may be off by far less than 1
    n, m = (np.array([len(pairs[i][j]) for i in some]) for j in (0, 1))
    need = max(0.0, (least - 1) / p.match)
    right, left = np.maximum(np.minimum(m, m - need).astype(np.int64), 0), np.maximum(np.minimum(n, n - need).astype(np.int64), 0)
    width = np.minimum(np.minimum(n, m), (left + right) // 2 + 1)
    for g in _groups(width, n + m):
        for i, r in zip(g, _sweep_many([pairs[some[i]] for i in g], p.match, left[g], right[g])):
            out[some[i]] = r
    return out


def _sweep_many(pairs: list[tuple[str, str]], match: float, left: np.ndarray, right: np.ndarray) -> list[tuple[float, int, int]]:
    """``_sweep`` of several pairs along the same anti-diagonals, within ``left`` and ``right`` columns of the main diagonal."""
    points = np.frombuffer("".join(a + b for a, b in pairs).encode("utf-32le", "surrogatepass"), np.uint32)
    alphabet, codes = np.unique(points, return_inverse=True)
    chars = [chr(c) for c in alphabet]
    size, pad = len(chars), len(chars)
    gaps = np.array([*map(gap_cost, chars), 0], np.float32)
    # of equal characters the cost is the (negative) match; those past an end are never met with a score above 0
    table = np.full((size + 1, size + 1), np.inf, np.float32)
    table[:size, :size] = [[substitution_cost(x, y) for y in chars] for x in chars]
    table[np.arange(size), np.arange(size)] = -match
    table = table.ravel()
    k = len(pairs)
    n, m = (np.array([len(x[j]) for x in pairs]) for j in (0, 1))
    top, wide = int(n.max()), int(m.max())
    s, t = np.full((k, top + 1), pad, np.int64), np.full((k, wide + 1), pad, np.int64)
    at = 0
    for i in range(k):
        s[i, 1 : n[i] + 1] = codes[at : at + n[i]]
        t[i, 1 : m[i] + 1] = codes[at + n[i] : at + n[i] + m[i]]
        at += n[i] + m[i]
    gs, gt, s = gaps[s], gaps[t], s * (size + 1)
    gt, t = np.ascontiguousarray(gt[:, ::-1]), np.ascontiguousarray(t[:, ::-1])  # column j is at wide - j: along a diagonal both go up
    h0, h1, h2 = (np.zeros((k, top + 1), np.float32) for _ in range(3))
    best, bi, bj = np.zeros(k), np.zeros(k, np.int64), np.zeros(k, np.int64)
    low_side, high_side = int(right.max()), int(left.max())
    for d in range(2, int((n + m).max()) + 1):
        lo, hi = max(1, d - wide, (d - low_side + 1) // 2), min(top, d - 1, (d + high_side) // 2)
        if lo > hi:
            h2[:] = 0
            h0, h1, h2 = h1, h2, h0
            continue
        x, y = wide - d + lo, wide - d + hi + 1
        cost = table[s[:, lo : hi + 1] + t[:, x:y]]
        score = h0[:, lo - 1 : hi] - cost
        np.maximum(score, h1[:, lo : hi + 1] - gt[:, x:y], out=score)
        np.maximum(score, h1[:, lo - 1 : hi] - gs[:, lo : hi + 1], out=score)
        np.maximum(score, 0, out=score)
        # cells past a pair's end are of no score
        if hi > n.min():
            score[np.arange(lo, hi + 1) > n[:, None]] = 0
        if d - lo > m.min():
            score[d - np.arange(lo, hi + 1) > m[:, None]] = 0
        h2[:, max(0, lo - 1)] = 0
        h2[:, min(top, hi + 1)] = 0
        h2[:, lo : hi + 1] = score
        high = score.max(1)
        rows = np.flatnonzero((high >= best.astype(np.float32)) & (high > 0))
        if len(rows):
            # of the cells that are highest once rounded, the score before that: a match adds to its corner without being rounded, other moves are
            i, w = np.nonzero(score[rows] == high[rows, None])
            i = rows[i]
            v = np.maximum(h1[i, lo + w] - gt[i, x + w], h1[i, lo - 1 + w] - gs[i, lo + w]).astype(np.float64)
            c = cost[i, w]
            v = np.maximum(v, np.where(c < 0, h0[i, lo - 1 + w].astype(np.float64) + match, h0[i, lo - 1 + w] - c))
            if len(i) > len(rows):
                order = np.lexsort((w, -v, i))
                i, w, v = i[order], w[order], v[order]
                first = np.concatenate([[True], i[1:] != i[:-1]])
                i, w, v = i[first], w[first], v[first]
            r = lo + w
            better = (v > best[i]) | (v == best[i]) & ((r < bi[i]) | (r == bi[i]) & (d - r < bj[i]))
            i, r = i[better], r[better]
            best[i], bi[i], bj[i] = v[better], r, d - r
        h0, h1, h2 = h1, h2, h0
    return list(zip(best.tolist(), bi.tolist(), bj.tolist()))


def _single(s, t, match, gaps, table):
    best, i, j, moves = _sweep(s, t, match, gaps, table, True)
    a, b = i, j
    while a > 0 and b > 0 and (move := moves[a, b]):
        a, b = a - (move != 3), b - (move != 2)
    return best, a, i, b, j


def align(text1: str, text2: str, p: AlignParams = AlignParams()) -> Alignment:
    """The best region of two texts, if it has a positive score and is long enough on both sides."""
    return align_many([(text1, text2)], p)[0]


def align_many(pairs: list[tuple[str, str]], p: AlignParams = AlignParams()) -> list[Alignment]:
    """``align`` of several pairs; long ones are scored together."""
    out = [Alignment(a, b) for a, b in pairs]
    long = [i for i, (a, b) in enumerate(pairs) if a and b and len(a) + len(b) >= p.one_pass]
    ends = dict(zip(long, best_scores([pairs[i] for i in long], p)))
    for i, (a, b) in enumerate(pairs):
        if a and b:
            _region(out[i], ends.get(i), p)
    return out


def _region(out: Alignment, end: tuple[float, int, int] | None, p: AlignParams) -> None:
    """The region of two texts that ends at a known end, or where a pass with traceback says."""
    if end is None:
        best, a, b, c, d = _single(*_coded(out.text1, out.text2, p))
    else:
        best, b, d = end
        reach = int(best * 10 // p.match)
        x, y = max(0, b - reach), max(0, d - reach)
        again, a, b, c, d = _single(*_coded(out.text1[x:b], out.text2[y:d], p)) if best > 0 else (best, 0, 0, 0, 0)
        out.agrees = again == best  # sums of rounded costs may differ by where they start
        a, b, c, d = a + x, b + x, c + y, d + y
    if best > 0 and b - a >= p.min_region and d - c >= p.min_region:
        out.regions.append({"start1": a, "end1": b, "start2": c, "end2": d, "score": float(best)})


def _coded(a: str, b: str, p: AlignParams):
    s, t, gaps, table = _encode(a, b)
    return s, t, p.match, gaps, table


def align_all(text1: str, text2: str, p: AlignParams = AlignParams()) -> Alignment:
    """All regions: the best one, then those before and after it, and so on."""
    out, todo = Alignment(text1, text2), [(0, len(text1), 0, len(text2))]
    while todo:
        a, b, c, d = todo.pop()
        for r in align(text1[a:b], text2[c:d], p).regions:
            x = {"start1": r["start1"] + a, "end1": r["end1"] + a, "start2": r["start2"] + c, "end2": r["end2"] + c, "score": r["score"]}
            out.regions.append(x)
            todo += [(x["end1"], b, x["end2"], d), (a, x["start1"], c, x["start2"])]
    return out


def largest_region_score(text1: str, text2: str, p: AlignParams = AlignParams()) -> float:
    return region_scores([(text1, text2)], p)[0]


def region_scores(pairs: list[tuple[str, str]], p: AlignParams = AlignParams(), least: float = 0.0) -> list[float]:
    """Score of the best region of each pair; scores under ``least`` may come out lower. A region that scores more than ``min_region`` matches
    has as many characters on both sides, so only others need to be traced."""
    scores = [s for s, _, _ in best_scores(pairs, p, least)]
    weak = [i for i, s in enumerate(scores) if s >= least and s < (p.min_region + 1) * p.match]
    for i, a in zip(weak, align_many([pairs[i] for i in weak], p)):
        scores[i] = a.score()
    return scores


def align_pairs(pairs: DataFrame, p: AlignParams = AlignParams(), all_regions: bool = False, text1: str = "text1", text2: str = "text2", tasks: int | None = None) -> DataFrame:
    """``pairs`` with ``regions``. Pairs are dealt out evenly first: each is costly, and a few rows would sit in one task."""

    def go(batches: Iterable[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            both = [(x or "", y or "") for x, y in zip(a, b)]
            yield pd.Series([r.regions for r in ([align_all(x, y, p) for x, y in both] if all_regions else align_many(both, p))])

    # else a filter on the regions, as an explode brings one, would align every pair before it is dealt out, and once more after
    udf = F.pandas_udf(_typed(go), f"array<{REGION}>").asNondeterministic()
    n = tasks or int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n).withColumn("regions", udf(text1, text2))


def _typed(go):
    go.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return go
