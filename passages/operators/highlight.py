"""From shared points to character spans of the query text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from passages.functions.fingerprint import offset_rows

MODES = {"cc_largest": ("clustering", "largest"), "cc_all": ("clustering", "all"), "jaccard": ("jaccard", "largest")}


def cluster_order(points: DataFrame) -> DataFrame:
    """(query_id, doc_id, cluster_id, n_unique, place): clusters by distinct fingerprints, ties by first query position."""
    per = points.filter("cluster_id >= 0").groupBy("query_id", "doc_id", "cluster_id").agg(F.countDistinct("fp").alias("n_unique"), F.min("pos_query").alias("_first"))
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("n_unique"), "_first", "cluster_id")
    return per.withColumn("place", F.row_number().over(w) - 1).drop("_first")


def highlight(points: DataFrame, queries: DataFrame, length: int, mode: str = "cc_all") -> DataFrame:
    """(query_id, doc_id, place, start, end): the spans of one of MODES."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, got {mode!r}")
    return spans(positions(points, *MODES[mode]), queries, length)


def positions(points: DataFrame, method: str = "clustering", which: str = "largest") -> DataFrame:
    """(query_id, doc_id, place, pos_query), distinct: positions to highlight by cluster place."""
    if method not in ("clustering", "jaccard"):
        raise ValueError(f"unknown highlighting method {method!r}")
    if which not in ("largest", "all"):
        raise ValueError(f"unknown choice of clusters {which!r}")
    if method == "jaccard":
        return points.select("query_id", "doc_id", F.lit(0).alias("place"), "pos_query").distinct()
    order = cluster_order(points)
    if which == "largest":
        order = order.filter("place = 0")
    return points.join(order.select("query_id", "doc_id", "cluster_id", "place"), ["query_id", "doc_id", "cluster_id"]).select("query_id", "doc_id", "place", "pos_query").distinct()


def merge_intervals(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end): overlapping or touching intervals become one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.select(*keys, start, end, F.when(F.col(start) <= reach, 0).otherwise(1).alias("_new"))
    islands = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def spans(pos: DataFrame, queries: DataFrame, length: int, by_cluster: bool = True) -> DataFrame:
    """(query_id, doc_id[, place], start, end) of merged character spans; ``queries`` has query_id and text, a position covers ``length`` tokens (fewer at the text's end)."""
    w = Window.partitionBy("query_id").orderBy("pos").rowsBetween(0, length - 1)
    covers = offset_rows(queries, "query_id").select("query_id", F.col("pos").alias("pos_query"), "start", F.max("end").over(w).alias("end"))
    keys = ["query_id", "doc_id", *(["place"] if by_cluster else [])]
    return merge_intervals(pos.join(covers, ["query_id", "pos_query"]).select(*keys, "start", "end").distinct(), keys)


def coverage(pos: DataFrame, queries: DataFrame, length: int) -> DataFrame:
    """(query_id, doc_id, matched_chars, coverage_pct): characters under the union of all clusters' spans."""
    m = spans(pos, queries, length, by_cluster=False).groupBy("query_id", "doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("matched_chars"))
    size = queries.select("query_id", F.length("text").alias("_len"))
    return m.join(size, "query_id").select("query_id", "doc_id", "matched_chars", F.when(F.col("_len") > 0, F.bround(100 * F.col("matched_chars") / F.col("_len"), 1)).otherwise(0.0).alias("coverage_pct"))
