"""Bloom filters of 64-bit keys that scans carry to drop most rows they don't need, before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from passages.llm.storage import text_batches
from passages.llm.text import mix

SIEVE_BITS = 1 << 28


def sieve(keys: DataFrame, count: int) -> np.ndarray:
    """A filter of a table of one long column, as 64-bit words: two places and 16 bits a key, and at most SIEVE_BITS (32 MB to broadcast); for more keys than
    that is made for it lets more through, so whoever uses it must bear rows that it lets through without need."""
    bits = min(SIEVE_BITS, 1 << max(16, (16 * count - 1).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _places(b.column(0).to_numpy(), bits).ravel()
            yield pa.record_batch({"word": pa.array(at >> 6), "bit": pa.array(np.int64(1) << (at & 63))})

    words = np.zeros(bits >> 6, np.int64)
    got = keys.mapInArrow(place, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return words


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    h = mix(keys.view(np.uint64) + np.uint64(0x51ED270B))
    return (np.stack([h, h >> np.uint64(32)]) & np.uint64(bits - 1)).astype(np.int64)


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are in the filter, or may be."""
    at = _places(keys, len(words) << 6)
    return (words[at >> 6] >> (at & 63) & 1).all(0)


def without(docs: DataFrame, drop: DataFrame, id_col: str) -> DataFrame:
    """The documents whose ids (as longs) aren't among those of ``drop``, a stored table of one column; rows with a null id stay, and so do all columns. Texts aren't shuffled: rows
    that the filter of ``drop`` rules out stay without a join, and only the others (those to drop, and a few that it errs on) are joined."""
    words = docs.sparkSession.sparkContext.broadcast(sieve(drop, drop.count()))
    names = [f"_{i}" for i in range(len(docs.columns))]
    keyed = text_batches(docs.select(F.col(f"`{id_col}`").cast("long").alias("_key"), *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)]))

    def part(wanted: bool) -> DataFrame:
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0)
                maybe = passes(words.value, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)) & ~ids.is_null().to_numpy(zero_copy_only=False)
                yield b.filter(pa.array(maybe == wanted))

        return keyed.mapInArrow(pick, keyed.schema)

    kept = part(False).unionByName(part(True).join(drop.toDF("_key"), "_key", "left_anti").select(keyed.columns))
    return kept.select(names).toDF(*docs.columns)
