"""The inverted index: three Parquet tables, postings(fp, doc_id, pos) sorted by fp, docs(doc_id), and stats(fp, df, n), with a one-row meta table.

Fingerprints are minima of windows, so small ones are frequent: how they are distributed follows from the window's size alone, and postings are
cut into ranges of equal weight by that formula, without a sampling pass over the texts.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from passages.functions.fingerprint import fingerprint_rows
from passages.params import MODULUS, IndexParams

#: Bytes of the files behind a table of postings that one task gets to sort.
PART_BYTES = 16 << 20
#: Bytes of the files behind a table of queries whose pairs with documents one task gets.
PAIR_BYTES = 2 << 20


@dataclass(frozen=True)
class Index:
    """Postings with what was measured over them; all lazily read."""

    params: IndexParams
    postings: DataFrame
    docs: DataFrame
    stats: DataFrame

    def num_documents(self) -> DataFrame:
        """One row: documents with at least one posting."""
        return self.docs.agg(F.count("*").alias("num_documents"))


def build_postings(docs: DataFrame, params: IndexParams = IndexParams(), id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, fp): stateless, so the plan is a scan and one Arrow step."""
    return fingerprint_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), params, "doc_id", "text")


def parts_for(df: DataFrame, size: int | None = None, each: int | None = None) -> int:
    """Tasks to sort postings in: as many as the session has shuffle partitions, and more for larger inputs, so that what a task holds doesn't grow with them. ``size`` is in
    bytes; where it isn't given it is that of the files that the plan reads, if it reads files."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if size is None:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
        if size >= 1 << 60:  # what Spark says of tables that it knows nothing about
            return least
    return max(least, -(-size // (each or PART_BYTES)))


def fingerprint_stats(postings: DataFrame) -> DataFrame:
    """(fp, df, n): documents and postings of each fingerprint. Sorted postings are counted as they pass, so that no task keeps a table of fingerprints."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last fingerprint so far, which may go on in the next batch: itself, its documents and postings, its last document
        fp, df, n, doc = None, 0, 0, None
        for b in it:
            if not b.num_rows:
                continue
            f, ids = b.column(0).to_numpy(), b.column(1)
            if fp is not None and fp != f[0]:
                yield _stats([fp], [df], [n])
            goes_on = fp is not None and fp == f[0]
            same = pc.fill_null(pc.equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False) | (ids[1:].is_null().to_numpy(zero_copy_only=False) & ids[:-1].is_null().to_numpy(zero_copy_only=False))
            first = np.concatenate([[True], f[1:] != f[:-1]])
            new = first.copy()
            new[1:] |= ~same
            at = np.flatnonzero(first)
            dfs, ns = np.add.reduceat(new.astype(np.int64), at), np.diff(np.append(at, len(f)))
            if goes_on:
                dfs[0] += df - (doc == ids[0].as_py())
                ns[0] += n
            yield _stats(f[at[:-1]], dfs[:-1], ns[:-1])
            fp, df, n, doc = int(f[-1]), int(dfs[-1]), int(ns[-1]), ids[-1].as_py()
        if fp is not None:
            yield _stats([fp], [df], [n])

    placed = postings.select("fp", "doc_id").repartition(parts_for(postings), "fp").sortWithinPartitions("fp", "doc_id")
    return placed.mapInArrow(run, "fp long, df long, n long")


def _stats(fp, df, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (fp, df, n)], ["fp", "df", "n"])


def in_memory(docs: DataFrame, params: IndexParams = IndexParams(), id_col: str = "id", text_col: str = "text") -> Index:
    """An index that isn't stored; cache its postings if it is used repeatedly."""
    return of_postings(build_postings(docs, params, id_col, text_col), params)


def of_postings(postings: DataFrame, params: IndexParams) -> Index:
    return Index(params, postings, postings.select("doc_id").distinct(), fingerprint_stats(postings))


def index_stats(index: Index) -> DataFrame:
    """One row: num_documents, num_fingerprints, num_postings, mean_weight = 1 - mean postings per fingerprint / documents (null unless positive)."""
    s = index.stats.agg(F.count("*").alias("num_fingerprints"), F.sum("n").alias("num_postings"))
    mean = 1 - F.col("num_postings") / F.col("num_fingerprints") / F.col("num_documents")
    return s.crossJoin(index.num_documents()).select("num_documents", "num_fingerprints", "num_postings", F.when(mean > 0, mean).alias("mean_weight"))


def unique_ids(docs: DataFrame, id_col: str = "id") -> DataFrame:
    """``docs``, after a look at its ids alone: a repeated one is an error."""
    if again := duplicate_ids(docs.select(id_col), id_col).take(1):
        raise ValueError(f"repeated document id: {again[0][0]}")
    return docs


def duplicate_ids(docs: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, n) of ids that occur more than once."""
    return docs.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1")


def part_of(fp: str | Column, window_size: int, parts: int) -> Column:
    """The range of a fingerprint among so many of equal weight. A k-gram whose hash is at share u of all values is the least of some window
    of w with probability (1 + (w - 1) u)(1 - u)^(w - 1); its integral cuts the ranges."""
    v = 1 - (F.col(fp) if isinstance(fp, str) else fp) / MODULUS
    w = max(1, window_size)
    mass = 1 - ((w + 1) * F.pow(v, w) - (w - 1) * F.pow(v, w + 1)) / 2
    return F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor(mass * parts))).cast("int")


def placed(postings: DataFrame, params: IndexParams, partitions: int | None = None) -> DataFrame:
    """(fp, doc_id, pos) in files of one range of fingerprints each, sorted: row-group statistics then stand in for a search tree."""
    parts = partitions or parts_for(postings)
    cols = postings.select("fp", "doc_id", "pos")
    return cols.repartitionById(parts, part_of("fp", params.window_size, parts)).sortWithinPartitions("fp", "doc_id", "pos")


def write_index(postings: DataFrame, path: str, params: IndexParams, partitions: int | None = None) -> None:
    placed(postings, params, partitions).write.mode("overwrite").parquet(f"{path}/postings")
    finish(postings.sparkSession, path, params)


def finish(spark: SparkSession, path: str, params: IndexParams) -> None:
    """The tables that follow from the stored postings."""
    stored = spark.read.parquet(f"{path}/postings").select("fp", "doc_id", "pos")
    # each document has a fingerprint in its first window, so its other postings needn't be looked at
    stored.filter(F.col("pos") < max(1, params.window_size)).select("doc_id").distinct().write.mode("overwrite").parquet(f"{path}/docs")
    fingerprint_stats(stored).write.mode("overwrite").parquet(f"{path}/stats")
    meta = spark.createDataFrame([(json.dumps(params.as_dict()),)], "params string")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_params(spark: SparkSession, path: str) -> IndexParams:
    return IndexParams(**json.loads(spark.read.parquet(f"{path}/meta").first()["params"]))


def read_index(spark: SparkSession, path: str) -> Index:
    read = lambda t: spark.read.parquet(f"{path}/{t}")
    return Index(read_params(spark, path), read("postings").select("fp", "doc_id", "pos"), read("docs"), read("stats"))


def index_dirs(spark: SparkSession, folder: str) -> list[str]:
    """The indexes in a folder, by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    inside = [str(x.getPath()) for x in fs.listStatus(path) if x.isDirectory()]
    return sorted(p for p in inside if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p}/meta")))


def merge_folder(spark: SparkSession, folder: str, out: str, partitions: int | None = None) -> None:
    """``merge_indexes`` of all that a folder holds."""
    merge_indexes(spark, index_dirs(spark, folder), out, partitions)


def merge_indexes(spark: SparkSession, paths: list[str], out: str, partitions: int | None = None) -> None:
    """One index of several with equal parameters and no document in common."""
    if not paths:
        raise ValueError("no indexes to merge")
    params = {read_params(spark, p) for p in paths}
    if len(params) > 1:
        raise ValueError(f"indexes differ in their parameters: {sorted(map(str, params))}")
    ids = None
    for p in paths:
        d = spark.read.parquet(f"{p}/docs")
        ids = d if ids is None else ids.unionByName(d)
    if clash := duplicate_ids(ids, "doc_id").take(1):
        raise ValueError(f"document {clash[0]['doc_id']!r} is in more than one index")
    every = None
    for p in paths:
        d = spark.read.parquet(f"{p}/postings")
        every = d if every is None else every.unionByName(d)
    write_index(every, out, params.pop(), partitions)


def nested_postings(postings: DataFrame) -> DataFrame:
    """(fingerprint, postings: array of (doc_id string, position)), each array in order."""
    entry = F.struct(F.col("doc_id").cast("string").alias("doc_id"), F.col("pos").alias("position"))
    return postings.groupBy(F.col("fp").alias("fingerprint")).agg(F.sort_array(F.collect_list(entry)).alias("postings"))


def write_json_index(postings: DataFrame, path: str, params: IndexParams = IndexParams()) -> None:
    """Gzipped JSON lines, sorted by fingerprint in each file, and a file with the header: parameters and the number of fingerprints."""
    lines, parts = nested_postings(postings), parts_for(postings)
    lines.repartitionById(parts, part_of("fingerprint", params.window_size, parts)).sortWithinPartitions("fingerprint").write.mode("overwrite").option("compression", "gzip").json(f"{path}/lines")
    p = params
    count = postings.sparkSession.read.text(f"{path}/lines").agg(F.count("*").alias("num_fingerprints"))
    head = count.select(*[F.lit(v).alias(k) for k, v in p.as_dict().items()], "num_fingerprints")
    head.coalesce(1).write.mode("overwrite").option("compression", "gzip").json(f"{path}/header")


def read_json_header(spark: SparkSession, path: str) -> DataFrame:
    """One row: length, window_size, base, punctuation, num_fingerprints; no posting is read."""
    return spark.read.schema("length int, window_size int, base int, punctuation boolean, num_fingerprints long").json(f"{path}/header")


def read_json_index(spark: SparkSession, path: str) -> DataFrame:
    """Postings from JSON lines; broken ones are skipped."""
    rows = spark.read.schema("fingerprint long, postings array<struct<doc_id: string, position: int>>").option("mode", "DROPMALFORMED").json(f"{path}/lines")
    return rows.filter("fingerprint IS NOT NULL").select(F.col("fingerprint").alias("fp"), F.inline("postings")).select("doc_id", F.col("position").alias("pos"), "fp")


class IndexManager:
    """Open indexes of a session by path, the last used ones first; what is beyond ``most`` is let go."""

    def __init__(self, spark: SparkSession, most: int = 1):
        self.spark, self.most, self._open = spark, most, OrderedDict()

    def open(self, path: str) -> Index:
        """The stored index, with its document count read once."""
        if path not in self._open:
            index = read_index(self.spark, path)
            self._open[path] = replace(index, docs=index.docs.cache())
        self._open.move_to_end(path)
        while len(self._open) > self.most:
            self._open.popitem(last=False)[1].docs.unpersist()
        return self._open[path]

    def of(self, docs: DataFrame, path: str, params: IndexParams = IndexParams(), id_col: str = "id", text_col: str = "text") -> Index:
        """The index at the path, built of ``docs`` if there is none."""
        meta = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
        if not meta.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(meta):
            write_index(build_postings(docs, params, id_col, text_col), path, params)
        return self.open(path)

    def close(self) -> None:
        while self._open:
            self._open.popitem()[1].docs.unpersist()

    def __len__(self) -> int:
        return len(self._open)
