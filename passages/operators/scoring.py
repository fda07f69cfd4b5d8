"""Containment scores: shared fingerprints, rarity-weighted sums, chains, and probabilities."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from passages.functions.normal import normal_cdf
from passages.operators.candidates import candidates, query_fingerprints, shared, shared_points
from passages.operators.cluster import cluster_fingerprints, cluster_points
from passages.operators.index import Index, index_stats
from passages.params import CHARS_PER_WORD, ScoreParams


def rarity(index: Index, queries: DataFrame | None = None) -> DataFrame:
    """(fp, rarity): 1 - df / documents; only of the queries' fingerprints if they are given, as a join that keeps its left side would sort all of them."""
    stats = index.stats if queries is None else index.stats.join(queries.select("fp").distinct(), "fp", "left_semi")
    return stats.crossJoin(F.broadcast(index.num_documents())).select("fp", (1 - F.col("df") / F.col("num_documents")).alias("rarity"))


def weights(index: Index, rarity_weighted: bool, queries: DataFrame) -> DataFrame | None:
    """(fp, weight) of the queries' fingerprints, rarities over their index-wide mean; None stands for weight 1 throughout."""
    if not rarity_weighted:
        return None
    mean = index_stats(index).select("mean_weight")
    return rarity(index, queries).crossJoin(F.broadcast(mean)).select("fp", (F.col("rarity") / F.col("mean_weight")).alias("weight"))


def _shared(queries: DataFrame, index: Index, cands: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank, fp), distinct."""
    return shared(queries, index.postings).join(cands.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"])


def score_shared(queries: DataFrame, index: Index, p: ScoreParams = ScoreParams(), rarity_weighted: bool = False) -> DataFrame:
    """(query_id, doc_id, rank, raw_score): summed weights of the distinct shared fingerprints."""
    cands = candidates(queries, index.postings, p.min_fingerprints, p.top_k)
    w = weights(index, rarity_weighted, queries)
    if w is None:
        return cands.select("query_id", "doc_id", "rank", F.col("n_shared").cast("double").alias("raw_score"))
    joined = _shared(queries, index, cands).join(w, "fp", "left")
    return joined.groupBy("query_id", "doc_id", "rank").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("raw_score"))


def count_scores(queries: DataFrame, index: Index, p: ScoreParams = ScoreParams(), cands: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, rank, num_shared, rarity_sum): unnormalised rarities."""
    cands = cands if cands is not None else candidates(queries, index.postings, p.min_fingerprints, p.top_k)
    joined = _shared(queries, index, cands).join(rarity(index, queries), "fp", "left")
    return joined.groupBy("query_id", "doc_id", "rank").agg(F.count("*").alias("num_shared"), F.sum(F.coalesce("rarity", F.lit(0.0))).alias("rarity_sum"))


def chains(queries: DataFrame, index: Index, p: ScoreParams = ScoreParams()) -> tuple[DataFrame, DataFrame]:
    """Candidates, and their shared points with cluster numbers."""
    cands = candidates(queries, index.postings, p.min_fingerprints, p.top_k)
    return cands, cluster_points(shared_points(queries, index.postings, cands), p)


def score_chains(queries: DataFrame, index: Index, p: ScoreParams = ScoreParams(), rarity_weighted: bool = False) -> DataFrame:
    """(query_id, doc_id, rank, raw_score): the best cluster's summed weights of distinct fingerprints; 0 without a cluster."""
    return score_both(queries, index, p, rarity_weighted).select("query_id", "doc_id", "rank", F.col("chain").alias("raw_score"))


def score_both(queries: DataFrame, index: Index, p: ScoreParams = ScoreParams(), rarity_weighted: bool = False) -> DataFrame:
    """(query_id, doc_id, rank, shared, chain): the number of shared fingerprints with the score by chains, from one search for candidates."""
    distinct = cluster_fingerprints(queries, index, candidates(queries, index.postings, p.min_fingerprints, p.top_k), p)
    w = weights(index, rarity_weighted, queries)
    weighted = distinct.withColumn("weight", F.lit(1.0)) if w is None else distinct.join(w, "fp", "left").fillna(0.0, ["weight"])
    pair = ["query_id", "doc_id", "rank", "n_shared"]
    best = weighted.groupBy(*pair, "cluster_id").agg(F.sum(F.when(F.col("cluster_id") >= 0, F.col("weight")).otherwise(0.0)).alias("s")).groupBy(*pair).agg(F.max(F.when(F.col("cluster_id") >= 0, F.col("s"))).alias("s"))
    return best.select("query_id", "doc_id", "rank", F.col("n_shared").cast("double").alias("shared"), F.coalesce("s", F.lit(0.0)).alias("chain"))


def cluster_metrics(queries: DataFrame, index: Index, p: ScoreParams = ScoreParams()) -> DataFrame:
    """(query_id, doc_id, rank, num_shared, rarity_sum, num_in_largest, rarity_in_rarest): the last two may be of different clusters."""
    cands = candidates(queries, index.postings, p.min_fingerprints, p.top_k)
    distinct = cluster_fingerprints(queries, index, cands, p).filter("cluster_id >= 0").join(rarity(index, queries), "fp", "left")
    per = distinct.groupBy("query_id", "doc_id", "cluster_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("rarity", F.lit(0.0))).alias("r"))
    best = per.groupBy("query_id", "doc_id").agg(F.max("n").alias("num_in_largest"), F.max("r").alias("rarity_in_rarest"))
    return count_scores(queries, index, p, cands).join(best, ["query_id", "doc_id"], "left").fillna({"num_in_largest": 0, "rarity_in_rarest": 0.0})


def with_probability(scores: DataFrame, window_size: int, min_fragment_length: float = 1000.0, score_col: str = "raw_score") -> DataFrame:
    """``scores`` with ``probability`` that the shared passage is longer than the fragment: the normal approximation of a Poisson count."""
    n0 = min_fragment_length / (window_size * CHARS_PER_WORD)
    return scores.withColumn("probability", normal_cdf((F.col(score_col) - n0) / math.sqrt(n0)))


def detect(texts: DataFrame, index: Index, p: ScoreParams = ScoreParams(), detector: str = "chain", rarity_weighted: bool = False, metadata: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, rank, raw_score, probability, short_query[, metadata]) in one call, of texts (query_id, text); ``short_query`` says that the text is
    shorter than the fragment that the probability is about."""
    if detector not in DETECTORS:
        raise ValueError(f"detector must be one of {', '.join(DETECTORS)}, got {detector!r}")
    scores = DETECTORS[detector](query_fingerprints(texts, index.params), index, p, rarity_weighted)
    out = with_probability(scores, index.params.window_size, p.min_fragment_length)
    out = out.join(texts.select("query_id", (F.length("text") < p.min_fragment_length).alias("short_query")), "query_id")
    return out if metadata is None else out.join(metadata, "doc_id", "left")


#: Scores by name.
DETECTORS = {"shared": score_shared, "chain": score_chains}


def ndjson(rows: DataFrame) -> DataFrame:
    """(line): each row as JSON; ``toLocalIterator`` then streams them as they are ready."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def best_of(*scores: DataFrame) -> DataFrame:
    """(query_id, doc_id, best): the best raw score of each pair over several scorings, positive ones only."""
    every = scores[0].select("query_id", "doc_id", "raw_score")
    for s in scores[1:]:
        every = every.unionByName(s.select("query_id", "doc_id", "raw_score"))
    return every.groupBy("query_id", "doc_id").agg(F.max("raw_score").alias("best")).filter("best > 0")


def ranking(scores: DataFrame, limit: int = 5, scale: float = 8.0) -> DataFrame:
    """(query_id, place, doc_id, score, score_normalized): each query's best documents by rounded score, ties by rank."""
    from pyspark.sql import Window

    rounded = scores.withColumn("score", F.bround("raw_score", 0).cast("long"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return rounded.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).select("query_id", "place", "doc_id", "score", F.bround(F.col("score") / scale, 2).alias("score_normalized"))
