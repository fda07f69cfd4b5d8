"""Incremental indexing: a stream of documents appended to a postings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from passages.operators.index import build_postings, parts_for, placed
from passages.params import IndexParams


def distinct_documents(docs: DataFrame, id_col: str = "id", time_col: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each id once within the watermark."""
    return docs.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])


def index_stream(docs: DataFrame, path: str, checkpoint: str, params: IndexParams = IndexParams(), id_col: str = "id", text_col: str = "text", once: bool = False) -> StreamingQuery:
    """Append each batch's postings under ``path``/postings; fingerprinting keeps no state. A batch that is run again replaces its own folder, so retries don't double postings.
    ``finish`` (of ``passages.operators.index``) then makes an index of them that ``read_index`` opens; it may be run again as batches come in."""

    def append(batch: DataFrame, number: int) -> None:
        # a batch's plan doesn't say how large it is; its text is some two to four times what its files are
        size = batch.agg(F.sum(F.octet_length(text_col)).alias("size")).first()["size"] or 0
        placed(build_postings(batch, params, id_col, text_col), params, parts_for(batch, size // 2)).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")

    writer = docs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
