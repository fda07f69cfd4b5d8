"""URL filters: a cascade of Bloom filters over a corpus's complete key universe.

Level 1 holds the listed keys, level 2 the universe's other keys that level 1 takes for listed, level 3 the
listed keys that level 2 takes for such, and so on until a level errs on no key. A key's membership is then
exact for every key of the universe, though the filters take a few bits a key and no key is kept or joined.

The universe is cut into shards by key hash and each shard's cascade is built in one task from 16-byte hashes,
so a level needs no job of its own. Looking up broadcasts the filters while they are under ``broadcast_bytes``
(measured, not assumed); beyond that, the shards' filters travel to the rows of the same shard in one shuffle.

Defined results: a null or empty URL has the key '' and is listed only if the list has it; repeated rows are
answered one by one; repeated list entries count once; keys on the list that the universe lacks have no effect on the answers
for the universe; an empty list lists nothing, as does one of which the universe has no key; a URL of any length is a key; empty tables give empty results; other columns, whatever their names, are ignored,
and those that are asked for come out under their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from passages.llm.storage import text_batches
from passages.llm.text import mix

SHARD_KEYS = 1 << 20
BROADCAST_BYTES = 64 << 20


def key(url: str | Column = "url") -> Column:
    """The key of a URL: host without 'www.' and path, in lower case, without scheme, query, fragment and final slash."""
    c = F.lower(F.trim(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))))
    c = F.regexp_replace(c, r"^[a-z][a-z0-9+.-]*://", "")
    c = F.regexp_replace(c, r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(c, r"^www\.", ""), r"/+$", "")


KEY_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(url, ''))), '^[a-z][a-z0-9+.-]*://', ''), '[?#].*$', ''), '^www\.', ''), '/+$', '')"


def _hashes(k: Column) -> list[Column]:
    return [F.xxhash64(k).alias("h1"), F.xxhash64(F.concat(F.lit("~"), k)).alias("h2")]


def _shard(n: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.col("h2"), 20), F.lit(n)).cast("int").alias("shard")


def _places(h1: np.ndarray, h2: np.ndarray, level: int, k: int, m: int) -> np.ndarray:
    """k bit places a key; each level has hashes of its own."""
    a = mix(h1.view(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    b = mix(h2.view(np.uint64) ^ np.uint64((level + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(k, dtype=np.uint64)) % np.uint64(m)


class Bloom:
    def __init__(self, level: int, k: int, m: int, bits: np.ndarray):
        self.level, self.k, self.m, self.bits = level, k, m, bits

    @classmethod
    def of(cls, level: int, h1: np.ndarray, h2: np.ndarray, rate: float) -> Bloom:
        m = max(64, int(np.ceil(-len(h1) * np.log(rate) / np.log(2) ** 2)))
        k = max(1, round(-np.log2(rate)))
        on = np.zeros(m, bool)
        on[_places(h1, h2, level, k, m).ravel()] = True
        return cls(level, k, m, np.packbits(on))

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        p = _places(h1, h2, self.level, self.k, self.m)
        return ((self.bits[p >> np.uint64(3)] >> (np.uint8(7) - (p & np.uint64(7)).astype(np.uint8))) & 1).all(1)


def cascade(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[Bloom]:
    """The levels for one shard's distinct keys."""
    ins, outs, levels = np.flatnonzero(listed), np.flatnonzero(~listed), []
    while len(ins):
        level = len(levels)
        rate = min(0.5, max(1e-6, len(ins) * 0.5**0.5 / max(1, len(outs)))) if level == 0 else 0.5
        f = Bloom.of(level, h1[ins], h2[ins], rate)
        levels.append(f)
        ins, outs = outs[f.has(h1[outs], h2[outs])] if len(outs) else outs, ins
    return levels


def answer(levels: list[Bloom], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which keys of the universe are listed: a key is decided by the first level that denies it, or by the last one."""
    out, at = np.zeros(len(h1), bool), np.arange(len(h1))
    for i, f in enumerate(levels):
        yes = f.has(h1[at], h2[at])
        out[at[~yes]] = i % 2 == 1
        at = at[yes]
    out[at] = len(levels) % 2 == 1
    return out


#: ``shards`` is the number that the universe was cut into, on every row: shards without listed keys have no row.
FILTERS = "shards int, shard int, level int, k int, m long, bits binary"


def build(universe: DataFrame, listed: DataFrame, shards: int | None = None) -> DataFrame:
    """The filters (shards, shard, level, k, m, bits) for a universe and a list, each a DataFrame of one column ``key``."""
    marked = universe.select("key", F.lit(0).alias("on"), F.lit(1).alias("here")).unionByName(listed.select("key", F.lit(1).alias("on"), F.lit(0).alias("here")))
    marked = marked.select(F.coalesce("key", F.lit("")).alias("key"), "on", "here").select(*_hashes(F.col("key")), "on", "here")
    if shards is None:
        n = universe.select(F.approx_count_distinct("key")).first()[0]
        shards = max(1, -(-n // SHARD_KEYS))
    keys = marked.groupBy("h1", "h2").agg(F.max("on").alias("on"), F.max("here").alias("here")).filter("here = 1").select("h1", "h2", "on", _shard(shards))

    def make(t: pa.Table) -> pa.Table:
        h1, h2, on = (t.column(c).to_numpy() for c in ("h1", "h2", "on"))
        levels = cascade(h1, h2, on == 1)
        shard = t.column("shard")[0].as_py() if len(t) else 0
        return pa.table({"shards": pa.array([shards] * len(levels), pa.int32()), "shard": pa.array([shard] * len(levels), pa.int32()), "level": pa.array([f.level for f in levels], pa.int32()), "k": pa.array([f.k for f in levels], pa.int32()), "m": pa.array([f.m for f in levels], pa.int64()), "bits": pa.array([f.bits.tobytes() for f in levels], pa.binary())})

    return keys.groupBy("shard").applyInArrow(make, FILTERS)


def _bloom(r) -> Bloom:
    return Bloom(r["level"], r["k"], r["m"], np.frombuffer(r["bits"], np.uint8))


def apply(rows: DataFrame, filters: DataFrame, cols: list[str], broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` has ``cols`` and ``key``; gives ``cols`` and ``listed``. ``filters`` should be a stored table: it is measured, then read again."""
    kinds = [rows.schema[c].dataType.simpleString() for c in cols]
    about = filters.agg(F.sum(F.length("bits")).alias("size"), F.max("shards").alias("shards")).first()
    size, shards = about["size"] or 0, about["shards"] or 1
    # inside, the caller's columns go by their places
    keyed = rows.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(cols)], *_hashes(F.coalesce("key", F.lit(""))))
    own = keyed.columns[: len(cols)]
    keyed = keyed.select("*", _shard(shards))
    out_schema = ", ".join([*(f"{c} {k}" for c, k in zip(own, kinds)), "listed boolean"])
    named = lambda out: out.toDF(*cols, "listed")
    if size <= broadcast_bytes:
        by: dict[int, list] = {}
        for r in filters.orderBy("shard", "level").collect():
            by.setdefault(r["shard"], []).append(_bloom(r))
        shared = rows.sparkSession.sparkContext.broadcast(by)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h1, h2, s = (b.column(c).to_numpy() for c in ("h1", "h2", "shard"))
                listed = np.zeros(len(s), bool)
                for shard in np.unique(s):
                    at = np.flatnonzero(s == shard)
                    listed[at] = answer(shared.value.get(int(shard), []), h1[at], h2[at])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(listed)], [*own, "listed"])

        return named(text_batches(keyed).mapInArrow(look, out_schema))
    # each shard's filters go with its rows; a shard is dealt to parts by its share of the rows, so a hot key fills no task and the filters are copied once a part
    total = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = keyed.groupBy("shard").agg(F.count("*").alias("n"))
    deal = counts.select("shard", F.ceil(F.col("n") * total / F.sum("n").over(Window.partitionBy())).cast("int").alias("parts"))
    dealt = keyed.withColumn("turn", F.monotonically_increasing_id()).join(deal, "shard").withColumn("part", F.pmod(F.xxhash64("turn"), "parts").cast("int"))
    mixed = dealt.select(*own, "h1", "h2", "shard", "part", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("long").alias("m"), F.lit(None).cast("binary").alias("bits"))
    copies = filters.drop("shards").join(deal, "shard").select("shard", "level", "k", "m", "bits", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    mixed = mixed.unionByName(copies, allowMissingColumns=True)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, levels = None, []
        for b in batches:
            kind, s, p = (b.column(c).to_numpy() for c in ("kind", "shard", "part"))
            edges = np.concatenate([[0], np.flatnonzero((s[1:] != s[:-1]) | (p[1:] != p[:-1]) | (kind[1:] != kind[:-1])) + 1, [len(s)]])
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if a == z:
                    continue
                part = b.slice(a, z - a)
                if (s[a], p[a]) != now:
                    now, levels = (s[a], p[a]), []
                if kind[a] == 0:
                    levels += [_bloom(r) for r in part.select(["level", "k", "m", "bits"]).to_pylist()]
                else:
                    h1, h2 = (part.column(c).to_numpy() for c in ("h1", "h2"))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(answer(levels, h1, h2))], [*own, "listed"])

    return named(text_batches(mixed.repartition("shard", "part")).sortWithinPartitions("shard", "part", "kind", "level").mapInArrow(meet, out_schema))
