"""Command line: ``index``, ``merge`` and ``detect``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession, functions as F

from passages.operators import index as ix, scoring
from passages.operators.candidates import query_fingerprints
from passages.params import METHODS, IndexParams, ScoreParams
from passages.sources import corpus


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="passages", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("index", help="build an index of a corpus file")
    a.add_argument("corpus")
    a.add_argument("out")
    a.add_argument("--length", type=int, default=5)
    a.add_argument("--window-size", type=int, default=6)
    a.add_argument("--min-length", type=int, default=2000)
    a.add_argument("--max-length", type=int, default=100_000)
    a.add_argument("--stop-after", type=int)
    a.add_argument("--partitions", type=int)
    a = sub.add_parser("merge", help="merge indexes")
    a.add_argument("indexes", nargs="+")
    a.add_argument("--out", required=True)
    a = sub.add_parser("detect", help="score a text against an index")
    a.add_argument("index")
    text = a.add_mutually_exclusive_group(required=True)
    text.add_argument("--text")
    text.add_argument("--text-file", help="- for standard input")
    a.add_argument("--detector", choices=("shared", "chain"), default="chain")
    a.add_argument("--method", choices=METHODS, default="rectangle")
    a.add_argument("--rarity-weighted", action="store_true")
    a.add_argument("--top-k", type=int, default=50)
    a.add_argument("--min-fingerprints", type=int, default=5)
    a.add_argument("--position-threshold", type=int, default=30)
    a.add_argument("--offset-threshold", type=int, default=30)
    a.add_argument("--distance-threshold", type=float, default=30)
    a.add_argument("--min-cluster-size", type=int, default=5)
    a.add_argument("--min-fragment-length", type=float, default=1000)
    a.add_argument("--top-n", type=int, default=10, help="0 for all")
    a.add_argument("--output", choices=("text", "json"), default="text")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("passages").getOrCreate()
    if args.command == "index":
        params = IndexParams(args.length, args.window_size)
        docs = corpus.stream(spark, args.corpus, args.min_length, 0, args.max_length, args.stop_after)
        ix.write_index(ix.build_postings(ix.unique_ids(docs.select("id", "text")), params), args.out, params, args.partitions)
    elif args.command == "merge":
        ix.merge_indexes(spark, args.indexes, args.out)
    else:
        text = args.text if args.text is not None else sys.stdin.read() if args.text_file == "-" else open(args.text_file, encoding="utf-8").read()
        index = ix.read_index(spark, args.index)
        p = ScoreParams(args.min_fingerprints, args.top_k, args.method, args.position_threshold, args.offset_threshold, args.distance_threshold, args.min_cluster_size, args.min_fragment_length)
        if len(text) < p.min_fragment_length:
            print("warning: the text is shorter than the fragment length", file=sys.stderr)
        q = query_fingerprints(spark.createDataFrame([(0, text)], "query_id int, text string"), index.params)
        score = scoring.score_chains if args.detector == "chain" else scoring.score_shared
        rows = scoring.with_probability(score(q, index, p, args.rarity_weighted), index.params.window_size, p.min_fragment_length).orderBy(F.desc("probability"), "rank")
        rows = (rows.limit(args.top_n) if args.top_n else rows).select("doc_id", "raw_score", "probability").collect()
        if args.output == "json":
            print(json.dumps({str(r["doc_id"]): r["probability"] for r in rows}, ensure_ascii=False), file=out)
        else:
            for r in rows:
                print(f"{r['doc_id']}\t{r['raw_score']:g}\t{r['probability']:.4f}", file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
