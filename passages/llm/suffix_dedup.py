"""Suffix-array dedup: passages of at least ``least`` words that occur more than once.

The corpus's suffixes are never sorted as a whole. Winnowing first picks anchors: in every run of ``least`` words
some window of ``least - k + 1`` consecutive k-grams lies, and its smallest k-gram hash is an anchor, the same one in every
copy of the run. So each repeated run holds an anchor that occurs more than once, and all its copies lie within
the contexts of that anchor's occurrences. This leaves one row in about ``least / 4`` words, and then:

1. Anchors that occur once (counted with map-side partial sums) are dropped: no repeated run holds them. A Bloom filter of the others does so in a scan;
   what it lets through besides is an anchor of one context, which comes to nothing below.
2. Contexts (the words within reach of a run that holds the anchor) that occur more than once are repeated as a whole, so all their
   words are marked; one of each such group stands for it below. Counts and the one that stands are aggregated before they are shuffled and joined back, so a passage
   that a third of all rows share gathers in no task.
3. Where an anchor has several different contexts, a second scan of the texts (which are never shuffled) picks the places that stand for them, again by a filter, and these contexts' words are gathered, anchor by anchor, into blocks. A block's Burrows-Wheeler
   transform is expanded breadth-first by backward extension: after step l the intervals are the words' runs of length l, so a
   boundary that appears in step l + 1 has the common prefix l: prefixes are derived by increasing value, up to ``least``, where it stops. Intervals that
   are left hold runs of ``least`` equal words, repeated if they come from more than one place.
4. An anchor with more different contexts than a block holds (``hot_contexts``) isn't gathered: its contexts' runs of ``least`` words that hold the anchor, of
   which each has ``least - k + 1`` at most, are counted by hash in one aggregation instead, which gives the same passages.
5. Marked runs of a document are merged into maximal passages.

Each step is exact (up to 64-bit hashes) and has no cap.

Defined results: words are those of ``passages.llm.text``; null and empty texts, and those under ``least`` words, give no row; a passage repeated within one
document counts, and so does one of repeated rows; rows with a null id are left out; different texts under one id are both searched and reported under it; texts of any length are searched whole;
an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from passages.llm.sieve import passes, sieve
from passages.llm.storage import stored, text_batches
from passages.llm.text import Words, mix, signed, slices, window_hashes

LEAST = 50
BLOCK_WORDS = 400_000
HOT_CONTEXTS = 5_000


def _kgrams(w: Words, k: int) -> np.ndarray:
    """Hashes of the k-gram that starts at each word (those that cross rows are meaningless)."""
    n = len(w.hashes)
    lo = np.arange(max(0, n - k + 1))
    return window_hashes(w, lo, lo + k)


def anchors_of(w: Words, least: int, step: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place among ``w.hashes``, k-gram hash) of all anchors."""
    k = least // 2
    wide = least - k + 1
    g = _kgrams(w, k)
    starts = len(g) - wide + 1
    if starts <= 0:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    low, end = np.uint64((1 << 24) - 1), np.repeat(w.bounds[1:], np.diff(w.bounds))[:starts]
    parts = []
    for x in range(0, starts, step):  # windows in runs, so that places fit into the key's low bits
        part = g[x : x + step + wide - 1]
        here = len(part) - wide + 1
        key = (part & ~low) | (low - np.arange(len(part), dtype=np.uint64))
        # minimum over windows of ``wide``, by doubling
        m, have = key, 1
        while have * 2 <= wide:
            m = np.minimum(m[:-have], m[have:])
            have *= 2
        m = np.minimum(m[:here], m[wide - have : wide - have + here])
        m = m[np.arange(x, x + here) + least <= end[x : x + here]]
        parts.append(np.unique((low - (m & low)).astype(np.int64)) + x)
    at = np.unique(np.concatenate(parts))
    row = np.searchsorted(w.bounds, at, "right") - 1
    return row, at, g[at]


ANCHORS = "doc_id long, anchor long, context long, lo int, hi int"


def _spots(w: Words, least: int) -> tuple[np.ndarray, ...]:
    """Of all anchors: row, k-gram hash, context hash, and the context's words [first, last) among ``w.hashes``."""
    row, at, g = anchors_of(w, least)
    first, last = np.maximum(w.bounds[row], at - (least - least // 2)), np.minimum(w.bounds[row + 1], at + least)
    # the anchor's place in its context is part of the context
    return row, g, window_hashes(w, first, last) ^ (at - first).astype(np.uint64), first, last


def _place(doc: np.ndarray, lo: np.ndarray, context: np.ndarray) -> np.ndarray:
    """A hash of a context where it stands."""
    return mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lo.astype(np.uint64)) ^ context.view(np.uint64)


def anchors(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, anchor, context, lo, hi): the context is the words [lo, hi) of the document."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in slices(batch, "t"):
                row, g, c, first, last = _spots(w, least)
                base = w.bounds[row]
                yield pa.record_batch({"doc_id": part.column(0).take(pa.array(row)), "anchor": pa.array(signed(g)), "context": pa.array(signed(c)), "lo": pa.array((first - base).astype(np.int32)), "hi": pa.array((last - base).astype(np.int32))})

    return _texts(docs, id_col, text_col).mapInArrow(pick, ANCHORS)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return text_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).filter("doc_id IS NOT NULL"))


def _live(every: DataFrame, repeated_anchors: np.ndarray) -> DataFrame:
    """The anchors that pass, with ``place``."""
    shared = every.sparkSession.sparkContext.broadcast(repeated_anchors)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(passes(shared.value, b.column("anchor").to_numpy())))
            place = _place(*(b.column(c).to_numpy() for c in ("doc_id", "lo", "context")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(signed(place))], [*b.schema.names, "place"])

    return every.mapInArrow(drop, f"{ANCHORS}, place long")


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of integers by prefix doubling; sentinels in the text must be unique."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank[order] = new
        k *= 2
        if new[-1] == n - 1 or k >= n:
            return order


def expand(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it, in suffix order, up to ``least`` (the first has 0): by breadth-first backward extension, which
    gives all prefixes of 0, then all of 1, and so on."""
    n = len(text)
    bwt = text[order - 1]
    # LF: where the suffix goes when it is extended to the left by its BWT word; ``back`` is its inverse
    back = np.argsort(bwt, kind="stable")
    head = bwt[back]
    word = np.concatenate([[True], head[1:] != head[:-1]])
    prefix = np.full(n, least, np.int32)
    interval = np.zeros(n, np.int64)
    for step in range(least):
        prev = interval[back]
        edge = word.copy()
        edge[1:] |= prev[1:] != prev[:-1]
        prefix[edge & (prefix > step)] = step
        interval = np.cumsum(edge) - 1
        if interval[-1] == n - 1:
            break
    return prefix


def repeats_in(tokens: np.ndarray, lengths: np.ndarray, doc: np.ndarray, lo: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts one after another (``lengths`` words each) from document ``doc`` at word ``lo``: (context, offset) of all runs of ``least`` words that occur at more than one place."""
    n_ctx = len(lengths)
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths - 1
    text = np.empty(int(ends[-1]), np.int64)
    body = np.ones(len(text), bool)
    body[ends - 1] = False
    codes = np.unique(tokens, return_inverse=True)[1]
    text[body] = codes + n_ctx
    text[~body] = np.arange(n_ctx)
    ctx = np.repeat(np.arange(n_ctx), lengths + 1)
    off = np.arange(len(text)) - starts[ctx]
    order = suffix_order(text)
    interval = np.cumsum(expand(text, order, least) < least) - 1
    size = np.bincount(interval)
    c, o = ctx[order], off[order]
    keep = (size[interval] > 1) & (o + least <= lengths[c])
    c, o, iv = c[keep], o[keep], interval[keep]
    if not len(c):
        return c, o
    # more than one place: not all of one document and word (contexts of neighbouring anchors overlap)
    place = doc[c].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (lo[c] + o).astype(np.uint64)
    cut = np.concatenate([[0], np.flatnonzero(iv[1:] != iv[:-1]) + 1])
    several = np.minimum.reduceat(place, cut) != np.maximum.reduceat(place, cut)
    good = np.repeat(several, np.diff(np.append(cut, len(iv))))
    return c[good], o[good]


def _flat(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words one after another, and how many each context has."""
    offs = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
    tokens = np.frombuffer(raw.buffers()[2], np.uint8)[offs[0] : offs[-1]].view("<u4") if len(raw) and offs[-1] > offs[0] else np.empty(0, np.uint32)
    return tokens, np.diff(offs).astype(np.int64) // 4


def _blocks(least: int, block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(parts):
            t = pa.Table.from_batches(parts)
            flat = [_flat(c) for c in t.column("words").chunks]
            tokens, lengths = np.concatenate([x for x, _ in flat]), np.concatenate([x for _, x in flat])
            doc, lo = t.column("doc_id").to_numpy(), t.column("lo").to_numpy().astype(np.int64)
            c, o = repeats_in(tokens, lengths, doc, lo, least)
            at = lo[c] + o
            # touching runs of one context become one
            order = np.lexsort([at, c])
            c, at = c[order], at[order]
            if len(c):
                new = np.concatenate([[True], (c[1:] != c[:-1]) | (at[1:] > at[:-1] + least)])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(c)) - 1
                yield pa.record_batch({"doc_id": pa.array(doc[c[first]]), "lo": pa.array(at[first].astype(np.int32)), "hi": pa.array((at[last] + least).astype(np.int32))})

        held, size, last = [], 0, None
        for b in batches:
            a = b.column("anchor").to_numpy()
            edges = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)]
            at = 0
            words = np.cumsum(np.diff(np.frombuffer(b.column("words").buffers()[1], np.int32)[b.column("words").offset : b.column("words").offset + len(a) + 1]) // 4) if len(a) else np.empty(0)
            for x, y in zip(edges[:-1], edges[1:]):
                if x == y:
                    continue
                fresh = a[x] != last
                if fresh and size + (words[x - 1] - (words[at - 1] if at else 0) if x > at else 0) >= block_words:
                    if x > at:
                        held.append(b.slice(at, x - at))
                    yield from solve(held)
                    held, size, at = [], 0, x
                last = a[x]
            if len(a) > at:
                held.append(b.slice(at))
                size += int(words[-1] - (words[at - 1] if at else 0))
        if held:
            yield from solve(held)

    return run


def _contexts(docs: DataFrame, places: np.ndarray, hot: np.ndarray | None, least: int, id_col: str, text_col: str, runs: bool = False) -> DataFrame:
    """(doc_id, anchor, lo, words), words as 32-bit values, of the contexts whose places pass, without those of hot anchors; or with ``runs`` of these alone
    (doc_id, run, lo), the hash of each run of ``least`` words in a context."""
    shared = docs.sparkSession.sparkContext.broadcast((places, hot))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, hot = shared.value
        for batch in batches:
            for part, w in slices(batch, "t"):
                row, g, c, first, last = _spots(w, least)
                doc, lo = part.column("doc_id").to_numpy()[row], first - w.bounds[row]
                ours = passes(want, _place(doc, lo, c))
                if hot is not None:
                    ours &= passes(hot, g) == runs
                doc, lo, g, first, last = (x[ours] for x in (doc, lo, g, first, last))
                size = last - first
                if runs:
                    count = np.maximum(size - least + 1, 0)
                    each = np.repeat(np.arange(len(doc)), count)
                    step = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                    run = window_hashes(w, first[each] + step, first[each] + step + least)
                    yield pa.record_batch({"doc_id": pa.array(doc[each]), "run": pa.array(signed(run)), "lo": pa.array((lo[each] + step).astype(np.int32))})
                    continue
                ends = np.cumsum(size)
                take = np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
                small = (w.hashes[take] >> np.uint64(32)).astype("<u4")
                offs = np.concatenate([[0], ends * 4]).astype(np.int32)
                words = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offs), pa.py_buffer(small.tobytes())])
                yield pa.record_batch({"doc_id": pa.array(doc), "anchor": pa.array(signed(g)), "lo": pa.array(lo.astype(np.int32)), "words": words})

    return _texts(docs, id_col, text_col).mapInArrow(cut, "doc_id long, run long, lo int" if runs else "doc_id long, anchor long, lo int, words binary")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, block_words: int = BLOCK_WORDS, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): maximal passages made of runs of ``least`` words that occur more than once in the corpus."""
    if least < 4:
        raise ValueError("least must be 4 or more")
    every = stored(anchors(docs, least, id_col, text_col))
    again = stored(every.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
    live = stored(_live(every, sieve(again, again.count())))
    # equal contexts have equal anchors, so the context alone is the key
    per = stored(live.groupBy("context").agg(F.count("*").alias("n"), F.min("place").alias("place"), F.min("anchor").alias("anchor")))
    whole = live.select("context", "doc_id", "lo", "hi").join(per.filter("n > 1").select("context"), "context", "left_semi").select("doc_id", "lo", "hi")
    several = stored(per.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"))
    places = stored(per.join(several.select("anchor"), "anchor").select("place"))
    hot = several.filter(F.col("n") > hot_contexts).select("anchor")
    n_hot = hot.count()
    marks, hot_sieve = sieve(places, places.count()), sieve(hot, n_hot) if n_hot else None
    blocks = _contexts(docs, marks, hot_sieve, least, id_col, text_col).repartition("anchor").sortWithinPartitions("anchor")
    marked = whole.unionByName(blocks.mapInArrow(_blocks(least, block_words), "doc_id long, lo int, hi int"))
    if n_hot:
        runs = stored(_contexts(docs, marks, hot_sieve, least, id_col, text_col, runs=True))
        place = F.xxhash64("doc_id", "lo")
        often = runs.groupBy("run").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("run")
        marked = marked.unionByName(runs.join(often, "run", "left_semi").select("doc_id", "lo", (F.col("lo") + least).alias("hi")))
    w = Window.partitionBy("doc_id").orderBy("lo", "hi")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    islands = marked.select("*", F.max("hi").over(before).alias("reach")).select("*", F.sum(F.when(F.col("lo") <= F.col("reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))
    out = islands.groupBy("doc_id", "island").agg(F.min("lo").alias("start_word"), F.max("hi").alias("end_word"))
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def oracle(least: int = LEAST) -> str:
    """The same passages by counting every run of ``least`` words."""
    return rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^0-9a-z_\x{{80}}-\x{{10ffff}}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
r AS (SELECT doc_id, pos, md5(array_to_string(w[pos:pos + {least - 1}], ' ')) AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - {least} + 2)) AS pos FROM d WHERE len(w) >= {least})),
m AS (SELECT doc_id, pos - 1 AS lo FROM r WHERE run IN (SELECT run FROM r GROUP BY run HAVING count(*) > 1)),
i AS (SELECT *, sum(CASE WHEN lo <= prev + {least} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY lo) AS island FROM (SELECT *, lag(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS prev FROM m))
SELECT doc_id, CAST(min(lo) AS INTEGER) AS start_word, CAST(max(lo) + {least} AS INTEGER) AS end_word, CAST(max(lo) + {least} - min(lo) AS INTEGER) AS n_words FROM i GROUP BY doc_id, island"""
