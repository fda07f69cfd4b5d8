"""Benchmark decontamination: a prefix-filtered set join with windows of the item's size.

An item is the set of its word n-grams (an item of fewer words is one gram of all of them). A document is
contaminated by an item if some window of as many consecutive grams as the item has contains at least ``least`` of the item's distinct
grams.

1. One scan of the corpus keeps the places of grams that some item has (hash join with the benchmark's grams: a
   broadcast while they number under ``broadcast_keys``, a shuffle join beyond). Everything later works on this table.
2. Document frequencies over the whole corpus order each item's grams by rarity. An item of g grams that needs c
   of them must share one of its g - c + 1 rarest: only these prefixes are joined, so common grams make no pairs.
3. Bounds, before an item's other grams are joined. Length: a document of fewer than c grams can't hold c of them. Positions: a window that
   reaches c holds a prefix gram and is no longer than the item, so only places less than an item's length from a place of the
   prefix are joined: the join's key has the place's block (of an item's length) besides the document and the item.
4. The places that are left are verified exactly, over every window that starts at a shared gram (the best window does): sorted, then swept in whole batches.

Defined results: null and empty texts match nothing, as do items without words; rows are told apart whatever their ids: texts of one id are
each held against the items, and a pair of ids has one row, for its best window; so are items, and rows without an id are reported with null; ties between
windows go to the first; texts of any length are read whole; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from passages.llm.sieve import without
from passages.llm.storage import checkpoint, stored, text_batches
from passages.llm.text import grams, signed, slices

N = 5
LEAST = 0.6
BROADCAST_KEYS = 4_000_000


def item_grams(benchmark: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, item, size, gram, at): ``item`` numbers the rows; ``size`` is the words in a gram, n or fewer for short items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in slices(batch, "t"):
                g, bounds = grams(w, n)
                row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                size = np.minimum(np.diff(w.bounds), n)[row]
                yield pa.record_batch({"item_id": part.column(0).take(pa.array(row)), "item": part.column("item").take(pa.array(row)), "size": pa.array(size.astype(np.int32)), "gram": pa.array(signed(_tag(g, size, n))), "at": pa.array((np.arange(len(g)) - bounds[row]).astype(np.int32))})

    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.monotonically_increasing_id().alias("item"), F.col(text_col).alias("t"))
    return text_batches(rows).mapInArrow(cut, "item_id long, item long, size int, gram long, at int")


def _tag(g: np.ndarray, size: np.ndarray | int, n: int) -> np.ndarray:
    """Grams of different sizes never meet."""
    return g ^ (np.asarray(size, np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _doc_grams(docs: DataFrame, n: int, sizes: list[int], id_col: str, text_col: str, keys: np.ndarray | None) -> DataFrame:
    """(doc_id, doc, words, gram, pos) of all grams of the sizes asked for; with ``keys``, only of those. ``doc`` numbers the rows."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = shared.value
        if want is not None:
            sieve = np.zeros(1 << 22, bool)
            sieve[(want & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for batch in batches:
            for part, w in slices(batch, "t"):
                length = np.diff(w.bounds)
                for size in sizes:
                    g, bounds = grams(w, size)
                    g = _tag(g, size, n)
                    at = np.arange(len(g)) if want is None else np.flatnonzero(sieve[(g & np.uint64((1 << 22) - 1)).astype(np.int64)])
                    if want is not None and len(at):
                        place = np.minimum(np.searchsorted(want, g[at]), len(want) - 1)
                        at = at[want[place] == g[at]]
                    row = np.searchsorted(bounds, at, "right") - 1
                    good = length[row] >= size
                    at, row = at[good], row[good]
                    if len(at):
                        yield pa.record_batch({"doc_id": part.column(0).take(pa.array(row)), "doc": part.column("doc").take(pa.array(row)), "words": pa.array(length[row]), "gram": pa.array(signed(g[at])), "pos": pa.array((at - bounds[row]).astype(np.int32))})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("doc"), F.col(text_col).alias("t"))
    return text_batches(rows).mapInArrow(cut, "doc_id long, doc long, words long, gram long, pos int")


def best_windows(key: np.ndarray, pos: np.ndarray, gram: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, distinct grams) of each key's best window. Places are sorted by key and position; windows are ``width`` long and start at
    a place. A place counts for the starts from behind its gram's last place, and from where a window first reaches it, up to itself."""
    n = len(key)
    at = np.arange(n)
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    first = np.repeat(cut, np.diff(np.append(cut, n)))
    # the last place of the same gram in the same key
    order = np.lexsort([at, gram, first])
    same = np.zeros(n, bool)
    same[1:] = (gram[order][1:] == gram[order][:-1]) & (first[order][1:] == first[order][:-1])
    before = np.full(n, -1)
    before[order[1:]] = np.where(same[1:], order[:-1], -1)
    # positions made increasing over keys, so that one search serves all
    span = int(pos.max()) + int(width.max()) + 2
    line = pos + np.cumsum(key != np.concatenate([key[:1], key[:-1]])) * span
    lo = np.maximum(np.maximum(before + 1, first), np.searchsorted(line, line - width, "right"))
    counts = np.cumsum(np.bincount(lo, minlength=n + 1) - np.bincount(at + 1, minlength=n + 1))[:n]
    best = np.maximum.reduceat(counts, cut)
    top = np.flatnonzero(counts == np.repeat(best, np.diff(np.append(cut, n))))
    return top[np.searchsorted(top, cut)], best


WINDOWS = "doc_id long, item_id long, shared int, n_distinct int, start_word int, end_word int"


def _sweep(least: float):
    """Sorted places to the windows that suffice; a pair's places are held until the next pair begins, or a gap of a window's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: pa.Table):
            doc, item, pos, gram, m, g, size = (t.column(c).to_numpy().astype(np.int64) for c in ("doc", "item", "pos", "gram", "n_grams", "n_distinct", "size"))
            key = np.cumsum(starts(doc, item, pos, m))
            at, best = best_windows(key, pos, gram, m)
            good = best >= least * g[at] - 1e-9
            at, best = at[good], best[good]
            if len(at):
                yield pa.record_batch({"doc_id": t.column("doc_id").take(pa.array(at)).combine_chunks(), "item_id": t.column("item_id").take(pa.array(at)).combine_chunks(), "shared": pa.array(best.astype(np.int32)), "n_distinct": pa.array(g[at].astype(np.int32)), "start_word": pa.array(pos[at].astype(np.int32)), "end_word": pa.array((pos[at] + m[at] + size[at] - 1).astype(np.int32))})

        def starts(doc, item, pos, m):
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (pos[1:] - pos[:-1] >= m[1:])
            return new

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            cut = np.flatnonzero(starts(*(t.column(c).to_numpy().astype(np.int64) for c in ("doc", "item", "pos", "n_grams"))))
            if cut[-1] > 0:
                yield from out(t.slice(0, int(cut[-1])))
                t = t.slice(int(cut[-1]))
            held = t
        if held is not None:
            yield from out(held)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = N, least: float = LEAST, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(doc_id, item_id, shared, n_distinct, containment, start_word, end_word) for every document and item with a window of containment >= ``least``."""
    items = checkpoint(item_grams(benchmark, n, item_col, item_text_col))
    stats = items.groupBy("item").agg(F.max("item_id").alias("item_id"), F.max("size").alias("size"), (F.max("at") + 1).alias("n_grams"), F.countDistinct("gram").alias("n_distinct"))
    stats = stats.withColumn("need", F.ceil(F.col("n_distinct") * least - 1e-9).cast("int"))
    keys = items.select("gram").distinct()
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect()) or [n]
    if keys.count() <= broadcast_keys:
        want = np.sort(keys.toArrow().column("gram").to_numpy().view(np.uint64))
        matches = _doc_grams(docs, n, sizes, id_col, text_col, want)
    else:
        matches = _doc_grams(docs, n, sizes, id_col, text_col, None).join(keys, "gram")
    matches = checkpoint(matches)
    df = matches.select("gram", "doc").distinct().groupBy("gram").agg(F.count("*").alias("df"))
    mine = items.select("item", "gram").distinct().join(stats, "item").join(df, "gram")  # grams that the corpus lacks can't be shared
    absent = F.col("n_distinct") - F.count("*").over(Window.partitionBy("item"))
    # rarity order: grams that the corpus lacks come first, then by document frequency
    ranked = mine.withColumn("rank", absent + F.row_number().over(Window.partitionBy("item").orderBy("df", "gram")) - 1)
    # an item of which the corpus lacks too many grams goes as a whole, as no prefix of it is left
    prefix = ranked.filter(F.col("rank") <= F.col("n_distinct") - F.col("need"))
    block = F.floor(F.col("pos") / F.col("n_grams"))
    near = matches.join(prefix.select("gram", "item", "size", "n_grams", "need"), "gram").filter(F.col("words") - F.col("size") + 1 >= F.col("need"))
    near = near.select("doc", "item", block.alias("block")).distinct().select("doc", "item", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block")).distinct()
    full = matches.join(ranked.select("gram", "item", "item_id", "size", "n_grams", "n_distinct"), "gram").withColumn("block", block).join(near, ["doc", "item", "block"])
    places = full.select("doc", "item", "pos", "gram", "doc_id", "item_id", "size", "n_grams", "n_distinct").repartition("doc", "item").sortWithinPartitions("doc", "item", "pos")
    found = places.mapInArrow(_sweep(least), WINDOWS)
    # of rows and items of one id, and of stretches of one document, the best window, and the first of equals
    best = F.max(F.struct((F.col("shared") / F.col("n_distinct")).alias("c"), "shared", (-F.col("start_word")).alias("at"), "end_word", "n_distinct")).alias("b")
    out = found.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", F.col("b.shared").alias("shared"), F.col("b.n_distinct").alias("n_distinct"), F.col("b.c").alias("containment"), (-F.col("b.at")).alias("start_word"), F.col("b.end_word").alias("end_word"))


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that no item contaminates, with all their columns; rows without id can't be told apart and stay."""
    id_col = how.get("id_col", "doc_id")
    bad = contaminated(docs, benchmark, **how).select("doc_id").filter("doc_id IS NOT NULL").distinct()
    return without(docs, stored(bad), id_col)


def oracle(n: int = N, least: float = LEAST) -> str:
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^0-9a-z_\x{80}-\x{10ffff}]+'), lambda w: w <> '')"
    return rf"""
WITH i AS (SELECT row_number() OVER () AS item, item_id, {words} AS w FROM benchmark), ig AS (SELECT item, item_id, least({n}, len(w)) AS size, w FROM i WHERE len(w) > 0),
g AS (SELECT item, item_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda k: array_to_string(w[k:k + size - 1], ' '))) AS gram FROM ig),
st AS (SELECT item, item_id, size, count(*) AS m, count(DISTINCT gram) AS nd FROM g GROUP BY ALL), ug AS (SELECT DISTINCT item, size, gram FROM g), sizes AS (SELECT DISTINCT size FROM g),
d AS (SELECT row_number() OVER () AS doc, doc_id, {words} AS w FROM documents),
p AS (SELECT doc, doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos, w FROM d, sizes WHERE len(w) >= size),
dg AS (SELECT doc, doc_id, size, pos - 1 AS pos, array_to_string(w[pos:pos + size - 1], ' ') AS gram FROM p),
h AS (SELECT DISTINCT doc, doc_id, item, pos, gram FROM dg JOIN ug USING (size, gram)),
win AS (SELECT a.doc, a.doc_id, a.item, a.pos, count(DISTINCT b.gram) AS shared FROM (SELECT DISTINCT doc, doc_id, item, pos FROM h) a JOIN st USING (item) JOIN h b ON b.doc = a.doc AND b.item = a.item AND b.pos >= a.pos AND b.pos < a.pos + st.m GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / nd DESC, shared DESC, pos, m + size DESC) AS rn FROM win JOIN st USING (item))
SELECT doc_id, item_id, CAST(shared AS INTEGER) AS shared, CAST(nd AS INTEGER) AS n_distinct, shared / nd AS containment, CAST(pos AS INTEGER) AS start_word, CAST(pos + m + size - 1 AS INTEGER) AS end_word
FROM best WHERE rn = 1 AND shared / nd >= {least}"""
