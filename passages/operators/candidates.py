"""Looking query fingerprints up in an index, and ranking documents by what they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from passages.functions.fingerprint import fingerprint_rows
from passages.operators.index import PAIR_BYTES, parts_for
from passages.params import IndexParams


def query_fingerprints(queries: DataFrame, params: IndexParams, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, pos, fp): every k-gram of every query text."""
    return fingerprint_rows(queries.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("text")), params.for_queries(), "query_id", "text")


def lookup(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, doc_id, fp, pos): postings of each query's distinct fingerprints."""
    return queries.select("query_id", "fp").distinct().join(postings, "fp").select("query_id", "doc_id", "fp", "pos")


def match_counts(queries: DataFrame, postings: DataFrame, mode: str = "distinct") -> DataFrame:
    """(query_id, doc_id, n_shared): distinct shared fingerprints, or with mode 'bag' every pair of a query's k-gram and a posting."""
    if mode == "bag":
        # both sides are counted before they meet, the index's only for fingerprints that some query has: repeated ones multiply instead of joining row by row
        q = queries.groupBy("query_id", "fp").agg(F.count("*").alias("nq"))
        d = postings.join(queries.select("fp").distinct(), "fp", "left_semi").groupBy("doc_id", "fp").agg(F.count("*").alias("nd"))
        return q.join(d, "fp").groupBy("query_id", "doc_id").agg(F.sum(F.col("nq") * F.col("nd")).alias("n_shared"))
    if mode != "distinct":
        raise ValueError(f"mode must be 'distinct' or 'bag', got {mode!r}")
    # both sides are made distinct before they meet, so that pairs need only be counted; all of a query's go to one task, where they are counted and ranked
    wanted = queries.select("query_id", "fp").repartition("fp").distinct()
    there = postings.join(queries.select("fp").distinct(), "fp").select("doc_id", "fp").distinct()
    pairs = wanted.join(there, "fp").select("query_id", "doc_id")
    return _counts(pairs.repartition(parts_for(queries, each=PAIR_BYTES), "query_id"))


def shared(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, doc_id, fp), distinct."""
    return lookup(queries, postings).select("query_id", "doc_id", "fp").distinct()


def _counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("query_id", "doc_id").agg(F.count("*").alias("n_shared"))


def candidates(queries: DataFrame, postings: DataFrame, min_fingerprints: int = 5, top_k: int = 50, mode: str = "distinct") -> DataFrame:
    """(query_id, doc_id, n_shared, rank): the top_k documents of each query that share enough, ties by document id."""
    n = match_counts(queries, postings, mode).filter(F.col("n_shared") >= min_fingerprints)
    w = Window.partitionBy("query_id").orderBy(F.desc("n_shared"), "doc_id")
    return n.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)


def closest(queries: DataFrame, postings: DataFrame, min_fingerprints: int = 5, top_k: int = 5) -> DataFrame:
    """(query_id, doc_id) in rank order within each query."""
    return candidates(queries, postings, min_fingerprints, top_k).orderBy("query_id", "rank").select("query_id", "doc_id")


def shared_positions(queries: DataFrame, postings: DataFrame, cands: DataFrame) -> DataFrame:
    """(query_id, doc_id, fp, positions): where each candidate has a shared fingerprint."""
    return lookup(queries, postings).join(cands.select("query_id", "doc_id"), ["query_id", "doc_id"]).groupBy("query_id", "doc_id", "fp").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def shared_points(queries: DataFrame, postings: DataFrame, cands: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank, fp, pos_query, pos_doc, pos_offset): all pairs of places at which a query and a candidate share a fingerprint.
    Postings are met by fingerprint first, as the index is sorted, and only then by candidate."""
    q = queries.select("query_id", "fp", F.col("pos").alias("pos_query"))
    hits = lookup(queries, postings).join(cands.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"])
    hits = hits.withColumnRenamed("pos", "pos_doc").join(q, ["query_id", "fp"])
    return hits.select("query_id", "doc_id", "rank", "fp", "pos_query", "pos_doc", (F.col("pos_doc") - F.col("pos_query")).alias("pos_offset"))
