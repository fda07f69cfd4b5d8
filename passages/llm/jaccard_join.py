"""N-gram Jaccard join: every link between texts whose sets of word n-grams have a Jaccard similarity of at least ``least``.

The join is exact: a set follows its own rarest grams into buckets, and two sets at the threshold can't but meet in one of them.

1. Texts of one sequence of words are one node, however many rows have them; the nodes are what is joined.
2. All grams are put in one order: those that a sample of ``SAMPLE`` texts doesn't show often, by hash, then the others by how often it shows them. The order decides
   how many candidates there are, never which links are found. Two sets x and y at the threshold share o = ceil(least / (1 + least) * (x + y)) grams, so one
   of the first x - o + 1 of x is among the first y - o + 1 of y (prefix filter).
3. A text's prefix is dealt to parts by gram. In a part, sets of one gram meet if their sizes and the gram's places allow the threshold. No bucket is capped; within one, sets are taken
   by size, so that each meets only those of sizes it can match. Meetings are counted over all parts: with prefixes longer by l - 1, two sets at the threshold meet l times at least (see ``required``),
   and pairs that meet less often go before anything is joined to them.
4. Bits of parity of the sets (2 to 4 a gram) bound the difference of the two sets of a pair from below; pairs beyond what the threshold allows go.
5. The others are compared on their whole sets, in blocks, so that sets of one group travel once a block and not once a pair.
6. Links make groups (connected components, by alternating star contraction).

A group of m near copies has up to m(m-1)/2 pairs, so the result is a row a document: with its group, the group's size, the number of documents that it is linked to, and the most similar one.
Pairs of different texts are all compared, so that none is missed; only copies of one text aren't expanded.

Defined results: null and empty texts (no words) have no set and join nothing; texts of fewer than n words have one gram, of all their
words; exact copies have similarity 1; repeated rows of an id count once; different texts under one id are all joined, and the id is in one group with
whatever any of them is linked to; documents linked to no other have no row; ties go to the least id; rows with a null id are left out; texts of any length are read whole; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from passages.llm.sieve import passes, sieve, without
from passages.llm.storage import checkpoint, stored, text_batches
from passages.llm.text import Words, grams, mix, signed, slices, window_hashes

N = 3
LEAST = 0.5
CHUNK = 4_000
#: Texts that the order of grams is taken from, how often they must show a gram for it to come late, and how many such grams are told apart.
SAMPLE = 20_000
OFTEN = 3
HOT = 1 << 18
#: Least bits of parity a set; postings held before they are dealt, and in a part; rows of one text from which on only its first id's are read.
BITS = 64
HELD = 1 << 20
COPIES = 64
#: Of ``solve``, which the join no longer uses.
MARGIN = 0.12
SKETCH = 128
LEAF = 48
MISS = 0.02


def _sets(w: Words, n: int, hot: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows that have words, their distinct grams in the common order, and each one's bounds. A gram is 58 bits of its hash below 6 of how often a sample shows it."""
    g, b = grams(w, n)
    key = g >> np.uint64(6)
    if hot is not None and len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], g), len(hot[0]) - 1)
        key |= np.where(hot[0][at] == g, hot[1][at], np.uint64(0)) << np.uint64(58)
    live = np.flatnonzero(np.diff(b))
    first = np.ones(len(key), bool)
    for lo, hi in zip(b[live].tolist(), b[live + 1].tolist()):
        key[lo:hi].sort()
    first[1:] = key[1:] != key[:-1]
    first[b[live]] = True
    upto = np.concatenate([[0], np.cumsum(first)])
    return live, key[first], np.concatenate([[0], np.cumsum(upto[b[live + 1]] - upto[b[live]])])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return text_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).filter("doc_id IS NOT NULL"))


def _blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Runs of an array, as binary values."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def _values(col: pa.Array | pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column end to end, and each one's bytes."""
    parts = col.to_pylist()
    return np.frombuffer(b"".join(parts), dtype), np.array([len(p) for p in parts], np.int64)


def texts(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, copy, size, bits): ``copy`` is the hash of the words in order, ``size`` the number of distinct grams, ``bits`` their parity by hash, a power of two of bits."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in slices(batch, "t"):
                live, key, b = _sets(w, n)
                if not len(live):
                    continue
                copy = window_hashes(w, w.bounds[live], w.bounds[live + 1])
                size = np.diff(b)
                wide = np.maximum(BITS, 1 << np.ceil(np.log2(2 * size)).astype(np.int64))
                cuts = np.concatenate([[0], np.cumsum(wide)])
                at = np.repeat(cuts[:-1], size) + (key & np.repeat(wide - 1, size).astype(np.uint64)).astype(np.int64)
                bits = np.packbits((np.bincount(at, minlength=cuts[-1]) & 1).astype(bool))
                yield pa.record_batch({"doc_id": part.column(0).take(pa.array(live)), "copy": pa.array(signed(copy)), "size": pa.array(size.astype(np.int64)), "bits": _blobs(bits, cuts // 8)})

    return _rows(docs, id_col, text_col).mapInArrow(make, "doc_id long, copy long, size long, bits binary")


def hot_grams(docs: DataFrame, n: int, id_col: str, text_col: str, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Grams that a sample of texts shows often, and 1 to 63 for how often, on a logarithmic scale."""
    rows = _rows(docs, id_col, text_col)
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, w in slices(batch, "t"):
                g, b = grams(w, n)
                row = np.repeat(np.arange(len(b) - 1), np.diff(b))
                order = np.lexsort((row, g))
                g, row = g[order], row[order]
                first = np.ones(len(g), bool)
                first[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
                u, c = np.unique(g[first], return_counts=True)
                yield pa.record_batch({"gram": pa.array(signed(u)), "c": pa.array(c.astype(np.int64))})

    got = rows.mapInArrow(make, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")).filter(F.col("c") >= OFTEN).orderBy(F.desc("c"), "gram").limit(HOT).toArrow()
    g, c = got.column("gram").to_numpy().view(np.uint64), got.column("c").to_numpy()
    order = np.argsort(g)
    return g[order], np.minimum(63, (4 * np.log2(np.maximum(c[order], 1))).astype(np.int64)).astype(np.uint64)


def needed(sizes: np.ndarray, least: float) -> np.ndarray:
    """Grams that two sets of so many in all must share."""
    return np.ceil(sizes * (least / (1 + least)) - 1e-6).astype(np.int64)


def required(less: np.ndarray, more: np.ndarray, least: float) -> np.ndarray:
    """Meetings l that two sets of so many grams have if they are at the threshold, among the first x - o + l and y - o + l of them, where o is what they must share: the prefix that ends first in
    the common order leaves out o - l of the shared grams at most, and the other one has all before that. The more, the fewer pairs are left, but the longer the prefixes: about a sixteenth of the
    lesser set, and no more than the prefixes that are dealt allow."""
    return np.minimum(1 + less // 16, needed(less + more, least) - np.ceil(more * least - 1e-6).astype(np.int64) + 1)


_FIELDS = ("gram", "copy", "place", "size")


def postings(docs: DataFrame, n: int, id_col: str, text_col: str, least: float, hot: tuple, often: tuple, parts: int) -> DataFrame:
    """(part, gram, copy, place, size): prefixes, dealt by gram, as runs of 32-bit values. ``copy`` is cut to 32 bits, which can only add candidates.
    ``place`` and ``size`` are laid out byte by byte, for they compress so."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, often))

    def deal(held: list) -> Iterator[pa.RecordBatch]:
        key, *rest = (np.concatenate(x) for x in zip(*held))
        part = (key >> np.uint64(32)) % np.uint64(parts)
        gram = key.astype(np.uint32)
        order = np.lexsort((gram, part))
        part = part[order].astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
        cols = [x[order] for x in (gram, *rest)]
        planes = [[x[a:b].view(np.uint8).reshape(-1, 4).T.tobytes() for a, b in zip(cuts[:-1], cuts[1:])] for x in cols[2:]]
        yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), *[_blobs(x, cuts) for x in cols[:2]], *[pa.array(x, pa.binary()) for x in planes]], ["part", *_FIELDS])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, (copies, firsts) = shared.value
        held, count = [], 0
        for batch in batches:
            for part, w in slices(batch, "t"):
                live, key, b = _sets(w, n, hot)
                if not len(live):
                    continue
                copy = window_hashes(w, w.bounds[live], w.bounds[live + 1])
                size = np.diff(b)
                row = np.repeat(np.arange(len(live)), size)
                place = np.arange(len(key)) - b[:-1][row]
                wanted = place <= (size - np.ceil(size * least - 1e-6))[row]
                if len(copies):
                    at = np.minimum(np.searchsorted(copies, signed(copy)), len(copies) - 1)
                    wanted &= ((copies[at] != signed(copy)) | (firsts[at] == part.column(0).to_numpy()[live]))[row]
                held.append((key[wanted], copy[row[wanted]].astype(np.uint32), place[wanted].astype(np.uint32), size[row[wanted]].astype(np.uint32)))
                count += int(wanted.sum())
                if count >= HELD:
                    yield from deal(held)
                    held, count = [], 0
        if count:
            yield from deal(held)

    return _rows(docs, id_col, text_col).mapInArrow(make, "part long, gram binary, copy binary, place binary, size binary")


def tallies(gram: np.ndarray, copy: np.ndarray, place: np.ndarray, size: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Meetings among the postings of a part: pairs as two 32-bit copies in 64 bits, the lesser one above, how often they met, and how often they must have over all parts. A pair may come again."""
    order = np.argsort(gram, kind="stable")
    new = np.concatenate([[True], np.diff(gram[order]) != 0, [True]])
    order = order[~(new[1:] & new[:-1])]  # grams of one posting match nothing
    order = order[np.lexsort((place[order], copy[order], size[order], gram[order]))]
    fields = [x[order] for x in (gram, copy, place, size)]
    if len(order):  # texts that several rows have
        again = np.logical_and.reduce([x[1:] == x[:-1] for x in fields])
        fields = [x[np.concatenate([[True], ~again])] for x in fields]
    gram, copy, place, size = fields[0], fields[1].astype(np.uint64), fields[2].astype(np.int64), fields[3].astype(np.int64)
    ends = np.searchsorted(gram, gram, "right")
    found, needs, count, k = [], [], 0, 0

    def counted() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs, need = np.concatenate(found), np.concatenate(needs)
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        return pairs[starts], np.diff(np.append(starts, len(pairs))), np.minimum.reduceat(need[order], starts)

    at = np.flatnonzero(place <= size - needed(2 * size, least) + size // 16)  # as the smaller set of a pair
    while len(at):
        k += 1
        at = at[at + k < ends[at]]
        at = at[size[at] >= np.ceil(size[at + k] * least - 1e-6)]  # sizes ascend in a bucket: later ones don't match either
        to = at + k
        need = required(size[at], size[to], least)
        beyond = needed(size[at] + size[to], least) - need
        good = (place[at] < size[at] - beyond) & (place[to] < size[to] - beyond)
        x, y = copy[at[good]], copy[to[good]]
        found.append(np.minimum(x, y) << np.uint64(32) | np.maximum(x, y))
        needs.append(np.where(x == y, 1, need[good]))  # texts whose copies collide may have been taken for one
        count += len(x)
        if count >= HELD:
            yield counted()
            found, needs, count = [], [], 0
    if count:
        yield counted()


def candidates(rows: DataFrame, least: float) -> DataFrame:
    """(x, y), distinct, of ``postings``: the pairs that meet often enough."""

    def solve_part(held: list) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        cols = [_values(t.column(f), "<u4")[0] for f in _FIELDS[:2]]
        for f in _FIELDS[2:]:
            cols.append(np.concatenate([np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(4, -1).T).view("<u4").ravel() for p in t.column(f).to_pylist()]))
        for pairs, met, need in tallies(*cols, least):
            for lo in range(0, len(pairs), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                yield pa.record_batch({"pair": pa.array(signed(pairs[part])), "met": pa.array(met[part].astype(np.int64)), "need": pa.array(need[part].astype(np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            part = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b > a:
                    if held and part[a] != last:
                        yield from solve_part(held)
                        held = []
                    held.append(batch.slice(a, b - a))
                    last = part[a]
        if held:
            yield from solve_part(held)

    met = rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, "pair long, met long, need long").groupBy("pair").agg(F.sum("met").alias("met"), F.min("need").alias("need"))
    return met.filter("met >= need").select(F.shiftrightunsigned("pair", 32).alias("x"), F.expr("pair & 4294967295").alias("y"))


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of parities as if they had been taken over ``width`` words."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def bounded(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """(a, b) of the candidates that sizes and bits of parity don't rule out: sets differ in at least as many grams as their parities differ in bits."""
    x = reps.select(F.expr("copy & 4294967295").alias("x"), F.col("copy").alias("a"), F.col("size").alias("sa"), F.col("bits").alias("ba"))
    y = reps.select(F.expr("copy & 4294967295").alias("y"), F.col("copy").alias("b"), F.col("size").alias("sb"), F.col("bits").alias("bb"))
    both = pairs.join(x, "x").join(y, "y").filter("x <> y OR a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("sa") + F.col("sb")).alias("s"), "ba", "bb")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(2).to_numpy()
            ends = [_values(batch.column(i), "<u8") for i in (3, 4)]
            wide = [n // 8 for _, n in ends]
            starts = [np.cumsum(n) - n for n in wide]
            apart = np.zeros(len(s), np.int64)
            for both in np.unique(np.stack(wide, 1), axis=0):
                at = np.flatnonzero((wide[0] == both[0]) & (wide[1] == both[1]))
                for i in range(0, len(at), 1024):
                    p = at[i : i + 1024]
                    x, y = (_folded(v[f[p][:, None] + np.arange(n)], int(both.min())) for (v, _), f, n in zip(ends, starts, both))
                    apart[p] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(apart <= s - 2 * needed(s, least)))

    return both.mapInArrow(pick, "a long, b long")


def gram_sets(docs: DataFrame, n: int, id_col: str, text_col: str, sieves: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(copy, grams), one row a copy: distinct grams as 64-bit values, of the rows whose ids pass the first sieve and whose copies pass the second."""
    shared = docs.sparkSession.sparkContext.broadcast(sieves)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, copies = shared.value
        for batch in batches:
            batch = batch.filter(pa.array(passes(ids, batch.column("doc_id").to_numpy())))
            for _, w in slices(batch, "t"):
                live, key, b = _sets(w, n)
                copy = window_hashes(w, w.bounds[live], w.bounds[live + 1])
                good = passes(copies, copy)
                size = np.diff(b)
                yield pa.record_batch({"copy": pa.array(signed(copy[good])), "grams": _blobs(key[np.repeat(good, size)], np.concatenate([[0], np.cumsum(size[good])]))})

    return _rows(docs, id_col, text_col).mapInArrow(make, "copy long, grams binary").dropDuplicates(["copy"])


def shared_counts(own: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values the sets a[i] and b[i] share. Sets are rows of bits, of 16,384 values at a time, in the order in which sets bring them."""
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    _, first, value, many = np.unique(np.concatenate(own), return_index=True, return_inverse=True, return_counts=True)
    rank = np.full(len(first), -1)
    several = np.flatnonzero(many > 1)
    rank[several[np.argsort(first[several])]] = np.arange(len(several))
    value = rank[value]
    row, value = row[value >= 0], value[value >= 0]
    order = np.argsort(value, kind="stable")
    row, value = row[order], value[order]
    c, width = np.zeros(len(a), np.int64), 1 << 14
    for lo in range(0, len(several), width):
        s, e = np.searchsorted(value, [lo, lo + width])
        here = np.unique(row[s:e])
        place = np.full(len(own), -1)
        place[here] = np.arange(len(here))
        bits = np.zeros((len(here), width // 64), np.uint64)
        v = (value[s:e] - lo).astype(np.uint64)
        np.bitwise_or.at(bits, (place[row[s:e]], (v >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (v & np.uint64(63)))
        bits = bits[:, : (min(width, len(several) - lo) + 63) // 64]
        both = np.flatnonzero((place[a] >= 0) & (place[b] >= 0))
        for i in range(0, len(both), 4096):
            p = both[i : i + 4096]
            c[p] += np.bitwise_count(bits[place[a[p]]] & bits[place[b[p]]]).sum(1, dtype=np.int64)
    return c


def verified(links: DataFrame, reps: DataFrame, sets: DataFrame, least: float, chunk: int) -> DataFrame:
    """(a, b, jaccard) of the pairs whose sets are similar enough. A set goes with the least it is paired with, so that most pairs of a group are of one block; blocks of more than about
    ``chunk`` sets are cut, and each cut is compared with each."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).join(reps.select(F.col("copy").alias("a"), "size"), "a")
    cuts = label.groupBy("label").agg(F.ceil(F.sum("size") / (256 * chunk)).alias("cuts"))
    block = stored(label.join(cuts, "label").select("a", "size", F.xxhash64("label", F.pmod(F.xxhash64("a"), "cuts")).alias("block")))
    placed = stored(links.join(block.select("a", F.col("block").alias("p")), "a").join(block.select(F.col("a").alias("b"), F.col("block").alias("q")), "b").select("a", "b", F.xxhash64(F.least("p", "q"), F.greatest("p", "q")).alias("key")))
    sent = placed.select(F.col("a").alias("copy"), "key").unionByName(placed.select(F.col("b").alias("copy"), "key")).distinct()
    sent = stored(sent.join(block.select(F.col("a").alias("copy"), "size", "block"), "copy"))
    total = sent.agg(F.sum("size")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("key"), F.lit(max(1, math.ceil(total / (1 << 20)))))
    left = sent.select("copy", bucket.alias("bucket"), "block").distinct().join(sets, "copy")
    right = placed.select("a", "b", bucket.alias("bucket"))

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        a, b = y.column("a").to_numpy(), y.column("b").to_numpy()
        if not len(a):
            return pa.table({"a": pa.array(a), "b": pa.array(b), "jaccard": pa.array(np.empty(0))})
        x = x.select(["copy", "block", "grams"]).sort_by([("block", "ascending"), ("copy", "ascending")])
        copy = x.column("copy").to_numpy()
        at = np.concatenate([[0], np.flatnonzero(np.diff(np.sort(copy))) + 1]) if len(copy) else np.empty(0, np.int64)
        by = np.argsort(copy, kind="stable")[at]
        own = [np.frombuffer(g, np.uint64) for g in x.column("grams").to_pylist()]
        ia, ib = (by[np.searchsorted(copy[by], v)] for v in (a, b))
        size = np.array([len(g) for g in own])
        c = shared_counts(own, ia, ib)
        jaccard = c / (size[ia] + size[ib] - c)
        good = jaccard >= least
        return pa.table({"a": pa.array(a[good]), "b": pa.array(b[good]), "jaccard": pa.array(jaccard[good])})

    return left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(compare, "a long, b long, jaccard double")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, group_id) of all ends of (a, b): the least id that can be reached. Alternating large-star and small-star steps; each round's edges are checkpointed."""
    e = checkpoint(edges.select("a", "b").filter("a <> b").distinct())
    last = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: link larger neighbours to the least of one's neighbours and oneself
        m = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = both.join(m, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # small star: link smaller neighbours and oneself to the least of them
        down = e.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("l"))
        m = down.groupBy("n").agg(F.min("l").alias("m"))
        e = down.join(m, "n").select(F.col("m").alias("a"), F.col("l").alias("b")).unionByName(m.select(F.col("m").alias("a"), F.col("n").alias("b"))).filter("a <> b").distinct()
        e = checkpoint(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return e.select(F.col("b").alias("doc_id"), F.col("a").alias("group_id")).unionByName(e.select(F.col("a").alias("doc_id"), F.col("a").alias("group_id")).distinct())


def link_counts(own: DataFrame, both: DataFrame, several: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copy, links) for documents of one text and (doc_id, links) for those of ``several``: how many other documents they are linked to, by ``both`` directions of all links or by having one text.
    Copies count by their number and are never expanded; a document that is linked by several of its texts counts once."""
    single = own.join(several.select("doc_id").distinct(), "doc_id", "left_anti").groupBy("copy").agg(F.count("*").alias("w"))
    texts_of = several.select(F.col("doc_id").alias("other"), F.col("copy").alias("b"))
    to = both.select("a", "b").unionByName(own.select(F.col("copy").alias("a"), F.col("copy").alias("b")).distinct())
    ones = to.join(single.withColumnRenamed("copy", "b"), "b").select("a", "w")
    many = to.join(texts_of, "b").select("a", "other").distinct().select("a", F.lit(1).cast("long").alias("w"))
    by_copy = ones.unionByName(many).groupBy(F.col("a").alias("copy")).agg((F.sum("w") - 1).alias("links"))
    reach = several.withColumnRenamed("copy", "a").join(to, "a").select("doc_id", "b").distinct()
    ones = reach.join(single.withColumnRenamed("copy", "b"), "b").select("doc_id", "w")
    many = reach.join(texts_of, "b").filter("doc_id <> other").select("doc_id", "other").distinct().select("doc_id", F.lit(1).cast("long").alias("w"))
    return by_copy, ones.unionByName(many).groupBy("doc_id").agg(F.sum("w").alias("links"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, least: float = LEAST, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, group_id, group_size, links, partner_id, jaccard): a row for each document that has a near copy; ``group_id`` is the least id of
    its group and ``group_size`` the documents in it; ``links`` is how many other documents are similar enough to it. ``partner_id`` is one with the same text, if there is any, or else
    the most similar one (the least id that has it)."""
    sk = stored(texts(docs, n, id_col, text_col))
    own = stored(sk.select("doc_id", "copy").distinct())
    reps = stored(sk.groupBy("copy").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("rows"), F.first("size").alias("size"), F.first("bits").alias("bits")))
    count, total = reps.agg(F.sum("rows"), F.sum("size")).first()
    often = reps.filter(F.col("rows") >= COPIES).select("copy", "first").orderBy("copy").toArrow()
    hot = hot_grams(docs, n, id_col, text_col, SAMPLE / max(count or 0, 1))
    dealt = postings(docs, n, id_col, text_col, least, hot, tuple(often.column(c).to_numpy() for c in ("copy", "first")), max(1, math.ceil((total or 0) * (1 - least) / HELD)))
    links = stored(bounded(stored(candidates(dealt, least)), reps, least))
    ends = stored(links.select(F.col("a").alias("copy")).unionByName(links.select(F.col("b").alias("copy"))).distinct().join(reps.select("copy", "first"), "copy"))
    count = ends.count()
    # texts aren't shuffled: the scan drops most rows that no link needs and the joins drop the rest
    sets = gram_sets(docs, n, id_col, text_col, (sieve(ends.select("first"), count), sieve(ends.select("copy"), count)))
    edges = stored(verified(links, reps, sets, least, chunk))
    several = stored(own.join(own.groupBy("doc_id").agg(F.count("*").alias("texts")).filter("texts > 1").select("doc_id"), "doc_id"))
    same = several.join(several.groupBy("doc_id").agg(F.min("copy").alias("a")), "doc_id").select("a", F.col("copy").alias("b"))
    groups = components(edges.select("a", "b").unionByName(same)).withColumnRenamed("doc_id", "copy")
    # the best verified link of each text, and what shares its words exactly
    first = ends.select(F.col("copy").alias("b"), "first")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard"))
    best = both.join(first, "b").groupBy(F.col("a").alias("copy")).agg(F.max(F.struct("jaccard", (-F.col("first")).alias("minus"))).alias("best"))
    by_copy, by_doc = link_counts(own, both, several)
    live = reps.select("copy", "first", "last").join(groups, "copy", "left").join(best, "copy", "left").filter("group_id IS NOT NULL OR first <> last").join(by_copy, "copy", "left")
    live = live.select("copy", F.coalesce("group_id", "copy").alias("node"), "first", "last", "best", "links")
    twin = F.when(F.col("first") == F.col("last"), F.lit(None)).when(F.col("doc_id") == F.col("first"), F.col("last")).otherwise(F.col("first"))
    near = F.when(twin.isNotNull(), F.struct(F.lit(1.0).alias("jaccard"), (-twin).alias("minus"))).otherwise(F.col("best"))
    rows = own.join(live, "copy").select("doc_id", "node", near.alias("near"), "links").groupBy("doc_id", "node").agg(F.max("near").alias("near"), F.max("links").alias("links"))
    rows = stored(rows.join(by_doc.withColumnRenamed("links", "of_all"), "doc_id", "left").withColumn("links", F.coalesce("of_all", "links")).drop("of_all"))
    sizes = rows.groupBy("node").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    return rows.join(sizes, "node").select("doc_id", "group_id", "group_size", "links", (-F.col("near.minus")).alias("partner_id"), F.col("near.jaccard").alias("jaccard"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents without those that are near copies of a kept one: each group keeps its least id; all columns stay."""
    return without(docs, stored(near_copies(docs, id_col, **how).filter("doc_id <> group_id").select("doc_id")), id_col)


def oracle(n: int = N, least: float = LEAST) -> str:
    """(doc_id, group_id, group_size, links) by brute force over ``documents``: all pairs of rows with a shared gram, then the closure over their ids."""
    return rf"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
d AS (SELECT r, doc_id, list_filter(regexp_split_to_array(lower(text), '[^0-9a-z_\x{{80}}-\x{{10ffff}}]+'), lambda w: w <> '') AS w FROM t),
g AS (SELECT DISTINCT r, doc_id, unnest(list_transform(range(1, greatest(len(w) - {n} + 1, 1) + 1), lambda k: array_to_string(w[k:k + {n - 1}], ' '))) AS gram FROM d WHERE len(w) > 0),
size AS (SELECT r, count(*) AS s FROM g GROUP BY r),
c AS (SELECT x.r AS p, y.r AS q, any_value(x.doc_id) AS a, any_value(y.doc_id) AS b, count(*) AS c FROM g x JOIN g y ON x.gram = y.gram AND x.r < y.r GROUP BY x.r, y.r),
e AS (SELECT DISTINCT a, b FROM c JOIN size u ON u.r = p JOIN size v ON v.r = q WHERE a <> b AND c.c / (u.s + v.s - c.c) >= {least}),
pairs AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk AS (SELECT DISTINCT a AS doc_id, a AS node FROM pairs UNION SELECT walk.doc_id, pairs.b FROM walk JOIN pairs ON pairs.a = walk.node)
SELECT w.doc_id, min(w.node) AS group_id, count(*) AS group_size, any_value(l.links) AS links
FROM walk w JOIN (SELECT a, count(*) AS links FROM pairs GROUP BY a) l ON l.a = w.doc_id GROUP BY w.doc_id"""


# Only tests use the following: what is left of the chosen-path join by sketches that this module had before, which missed links, and meetings in a single part.


def runs_for(least: float, recall: float, path: int) -> int:
    """Runs after which a pair at the threshold has shared a path, and the splits of its bucket, with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - least**path * (1 - MISS)))


def split_tokens(least: float, depth: int) -> int:
    """Tokens to split on at a depth, so that a pair at the threshold shares none of them with probability MISS / 2 ** (depth + 1) at most: MISS over all depths."""
    return min(SKETCH, math.ceil(math.log(MISS / 2 ** (depth + 1)) / math.log(1 - least)))


def solve(ids: np.ndarray, sk: np.ndarray, least: float, rng: np.random.Generator, depth: int = 0) -> tuple[list, np.ndarray]:
    """Links (a, b, estimate) within one bucket, and the ids that were not absorbed by a link; ``depth`` counts the splits so far."""
    sure, maybe = math.ceil(min(0.98, least + MARGIN) * SKETCH), math.ceil((least - MARGIN) * SKETCH)
    links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    left = []
    stack = [(np.argsort(mix(ids.view(np.uint64)), kind="stable"), depth)]
    while stack:
        at, depth = stack.pop()
        rows, misses = sk[at], 0
        while len(at) > 1:
            pivot, rest = at[0], at[1:]
            same = np.count_nonzero(rows[1:] == rows[0], axis=1)
            near = same >= maybe
            if near.any():
                links.append((np.full(int(near.sum()), ids[pivot]), ids[rest[near]], same[near] / SKETCH))
            took = same >= sure
            left.append(pivot)
            at, rows = (rest[~took], rows[1:][~took]) if took.any() else (rest, rows[1:])
            misses = 0 if took.sum() * 8 >= len(rest) else misses + 1
            if misses == 8 and len(at) > LEAF:
                # no common core: split on more sampled tokens, if that leaves fewer pairs to compare than there are; else go on by brute force
                parts = []
                for c in rng.choice(SKETCH, split_tokens(least, depth), replace=False):
                    v = rows[:, c]
                    order = np.argsort(v, kind="stable")
                    parts += np.split(order, np.flatnonzero(np.diff(v[order])) + 1)
                if sum(len(p) ** 2 for p in parts) * 2 < len(at) ** 2:
                    stack += [(at[np.sort(p)], depth + 1) for p in parts if len(p) > 1]
                    left.append(at)
                    at = at[:0]
        left.append(at)
    return links, np.unique(ids[np.concatenate([np.atleast_1d(x) for x in left]).astype(np.int64)]) if left else ids


def meet(gram: np.ndarray, before: np.ndarray, copy: np.ndarray, place: np.ndarray, size: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """Pairs that meet often enough where one part has all postings; ``before`` plays no part."""
    got = [np.concatenate(x) for x in zip(*tallies(gram, copy, place, size, least))]
    if got:
        pairs, at = np.unique(got[0], return_inverse=True)
        need = np.full(len(pairs), np.iinfo(np.int64).max)
        np.minimum.at(need, at, got[2])
        yield pairs[np.bincount(at, got[1]) >= need]
