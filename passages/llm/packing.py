"""Packing: power-of-two decomposition.

Each document's token ids are cut into pieces whose lengths are the powers of two in the binary form of its
length, longest first (a document longer than ``longest`` starts with as many pieces of that length as fit).
Pieces of one length form a bucket; batches are drawn from one bucket at a time, so no sequence needs padding
and none crosses documents. Everything happens where the text is read: there is no shuffle, and ids of a run
of documents go out as slices of one buffer.

Defined results: a null or empty text gives no piece; repeated rows give their pieces again; a null id is kept; a text of any length and
characters is packed whole (long ones are encoded in parts and their pieces go out in several batches); an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from passages.llm.bpe import DEFAULT_VOCABULARY, encoded
from passages.llm.storage import text_batches
from passages.llm.text import filled

LONGEST = 8192
SCHEMA = "doc_id long, bucket int, piece int, start long, tokens array<int>"


def decompose(sizes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (as places in ``sizes``) and lengths of all pieces, in order."""
    bits = longest.bit_length() - 1
    counts = np.empty((len(sizes), bits + 1), np.int64)
    counts[:, 0] = sizes >> bits
    for j in range(1, bits + 1):
        counts[:, j] = sizes >> (bits - j) & 1
    row = np.repeat(np.arange(len(sizes)), counts.sum(1))
    return row, np.repeat(np.tile(1 << np.arange(bits, -1, -1), len(sizes)), counts.ravel())


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, longest: int = LONGEST, batch_tokens: int = 1 << 22) -> DataFrame:
    """(doc_id, bucket, piece, start, tokens): pieces numbered from 0 in each document; ``start`` is the first token's place and ``bucket`` the length."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = filled(batch.column(1))
            for a, b, sizes, ids in encoded(text, vocabulary):
                row, length = decompose(sizes, longest)
                ends = np.cumsum(length)
                first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a))])
                doc_start = np.cumsum(sizes) - sizes
                x = 0
                while x < len(row):  # list offsets are 32-bit: as many pieces as have at most so many tokens
                    done = int(ends[x] - length[x])
                    y = max(x + 1, int(np.searchsorted(ends, done + batch_tokens, "right")))
                    r = row[x:y]
                    yield pa.record_batch(
                        {
                            "doc_id": batch.column(0).slice(a, b - a).take(pa.array(r)),
                            "bucket": pa.array(length[x:y].astype(np.int32)),
                            "piece": pa.array((np.arange(x, y) - first[r]).astype(np.int32)),
                            "start": pa.array(ends[x:y] - length[x:y] - doc_start[r]),
                            "tokens": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends[x:y] - done]).astype(np.int32)), pa.array(ids[done : int(ends[y - 1])])),
                        }
                    )
                    x = y

    return text_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))).mapInArrow(cut, SCHEMA)


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder for each bucket, so that a loader reads equal lengths only."""
    packed.write.partitionBy("bucket").mode("overwrite").parquet(path)
