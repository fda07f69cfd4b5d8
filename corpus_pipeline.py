"""The corpus pipeline: quality rules, near copies, benchmark decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last give the
columns of the documents they got, whatever further ones there are. ``run`` writes each stage's result as Parquet under ``spark.checkpoint.dir`` and reads it again for the next.

Each stage takes nulls in any column, texts of any length, repeated rows and ids, and empty tables; what it does with them is said with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from passages.llm import decontamination, jaccard_join, packing, pii, quality_rules
from passages.llm.storage import ready


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go. Null and empty texts have no words and go; rows are judged one by one, so repeated ones go or stay together;
    a null id, language or source plays no part; an empty table stays empty."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the least id, so ties don't arise. Rows of one id are one document and stay or go together (repeated
    rows are not told apart); rows with a null id can't be and stay; null and empty texts are copies of nothing and stay; an empty table stays empty."""
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go: all rows of an id of which one does. Null and empty texts hold nothing and stay, as do rows with a null id;
    items without words match nothing; an empty table, of either kind, changes nothing."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text. Every row stays, repeated ones alike; a null text stays null, with a null ``n_chars``, and an empty one empty;
    a null id plays no part; an empty table stays empty."""
    out = pii.redact(docs)
    return out.select(*[F.length("text").cast(out.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in out.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of power-of-two lengths (doc_id, bucket, piece, start, tokens). Null and empty texts have none; repeated rows give theirs again; a null id is kept;
    an empty table gives none."""
    return packing.pieces(docs)


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontaminate), ("pii", private), ("packing", pack)]
#: Fitted models and a tokenizer aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
