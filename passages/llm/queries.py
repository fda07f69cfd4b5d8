"""Queries over the driver's tables, each over its whole table, and the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from passages.llm import decontamination, jaccard_join, license_scan, packing, pii, quality_classifier, quality_rules, suffix_dedup, token_counts, url_filters
from passages.llm.storage import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_copies(_table(spark, sf_dir, "documents")).select("doc_id", "group_id", "group_size", "links")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated(_table(spark, sf_dir, "documents"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(_table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no block list; in its place, keys whose MD5 begins with 0 or 1 (an eighth) are listed."""
    rows = _table(spark, sf_dir, "pages").select("page_id", "url").withColumn("key", url_filters.key())
    universe = rows.select("key").distinct()
    listed = universe.filter(F.md5(F.col("key")) < "2")
    filters = stored(url_filters.build(universe, listed))
    return url_filters.apply(rows, filters, ["page_id", "url"])


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no URL; ``source`` and ``lang`` stand in for host and path, so the posteriors are of a language within a source."""
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_benchmark_decontamination, op3_pii, op4_suffix_array_dedup, op5_license_scans, op6_quality_rules, op7_token_counts, op8_url_filters, op9_packing, op10_quality_classifier)}
#: Left out are 3, 7 and 9 (models and tokenizers) and 10 (a fitted model); tests hold them against brute force, round trips or held-out labels.
ORACLE_SQL = {
    "op1_ngram_jaccard_join": jaccard_join.oracle(),
    "op2_benchmark_decontamination": decontamination.oracle(),
    "op4_suffix_array_dedup": suffix_dedup.oracle(),
    "op5_license_scans": license_scan.oracle(),
    "op6_quality_rules": quality_rules.oracle(),
    "op8_url_filters": f"SELECT page_id, url, md5({url_filters.KEY_SQL}) < '2' AS listed FROM pages",
}
