"""Token counts: the exact histogram of encoded lengths and what follows from it.

Documents are encoded where they are read and only (length, documents) pairs leave a task, so the shuffle
grows with the number of distinct lengths and not with the corpus. Running sums over the histogram then
answer totals, quantiles and the tokens that remain under any context limit without a further scan. The
running sums are two-level (blocks of lengths, then lengths in a block), so no task sorts all lengths.

Defined results: a null or empty text has length 0 and counts as a document; every row counts, repeated
rows too; a text of any length and characters is counted whole; an empty table gives an empty histogram; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from passages.llm.bpe import DEFAULT_VOCABULARY, encoded
from passages.llm.storage import stored, text_batches
from passages.llm.text import filled

BLOCK = 1024


def lengths(docs: DataFrame, text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(length, docs) for each encoded length, exact."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for _, _, sizes, _ in encoded(filled(batch.column(0)), vocabulary, ids=False):
                for k, n in zip(*(x.tolist() for x in np.unique(sizes, return_counts=True))):
                    seen[k] = seen.get(k, 0) + n
        yield pa.record_batch({"length": pa.array(list(seen), pa.int64()), "docs": pa.array(list(seen.values()), pa.int64())})

    return text_batches(docs.select(F.col(text_col).alias("t"))).mapInArrow(count, "length long, docs long").groupBy("length").agg(F.sum("docs").alias("docs"))


def histogram(docs: DataFrame, text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``sums`` of the documents' lengths, which are stored first: the sums use them twice."""
    return sums(stored(lengths(docs, text_col, vocabulary)))


def sums(hist: DataFrame) -> DataFrame:
    """One row for each length L that occurs: documents of that length, documents and tokens up to L, documents and tokens beyond
    it, tokens that stay when every document is cut at L, the share of documents up to L, and the totals."""
    h = hist.withColumn("block", (F.col("length") / BLOCK).cast("long")).withColumn("tokens", F.col("length") * F.col("docs"))
    inner = Window.partitionBy("block").orderBy("length")
    blocks = h.groupBy("block").agg(F.sum("docs").alias("bd"), F.sum("tokens").alias("bt"))
    over = Window.orderBy("block")  # blocks are few: the longest length over BLOCK
    every = Window.partitionBy()
    blocks = blocks.select("block", (F.sum("bd").over(over) - F.col("bd")).alias("bd"), (F.sum("bt").over(over) - F.col("bt")).alias("bt"), F.sum("bd").over(every).alias("total_docs"), F.sum("bt").over(every).alias("total_tokens"))
    out = h.select("*", F.sum("docs").over(inner).alias("d"), F.sum("tokens").over(inner).alias("t")).join(blocks, "block")
    out = out.withColumn("docs_up_to", F.col("d") + F.col("bd")).withColumn("tokens_up_to", F.col("t") + F.col("bt"))
    return out.select(
        "length",
        "docs",
        "docs_up_to",
        "tokens_up_to",
        (F.col("total_docs") - F.col("docs_up_to")).alias("docs_beyond"),
        (F.col("total_tokens") - F.col("tokens_up_to")).alias("tokens_beyond"),
        (F.col("tokens_up_to") + F.col("length") * (F.col("total_docs") - F.col("docs_up_to"))).alias("tokens_cut"),
        (F.col("docs_up_to") / F.col("total_docs")).alias("share_up_to"),
        "total_docs",
        "total_tokens",
    )


def at_limits(table: DataFrame, limits: Iterable[int]) -> DataFrame:
    """(limit, docs_cut, tokens_kept): documents longer than each limit, and tokens left when all are cut there. Any limit, whether it occurs as a length or not."""
    spark = table.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "limit long")
    j = table.crossJoin(F.broadcast(asked))
    low = F.col("length") <= F.col("limit")
    return j.groupBy("limit").agg(F.sum(F.when(~low, F.col("docs")).otherwise(0)).alias("docs_cut"), F.sum(F.when(low, F.col("length") * F.col("docs")).otherwise(F.col("limit") * F.col("docs"))).alias("tokens_kept"))


def quantiles(table: DataFrame, shares: Iterable[float]) -> DataFrame:
    """(share, length): the least length that so great a share of the documents doesn't exceed."""
    spark = table.sparkSession
    asked = spark.createDataFrame([(float(x),) for x in shares], "share double")
    return table.crossJoin(F.broadcast(asked)).filter(F.col("docs_up_to") >= F.col("share") * F.col("total_docs")).groupBy("share").agg(F.min("length").alias("length"))
