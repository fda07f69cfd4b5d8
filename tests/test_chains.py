"""Queries that SQL can't answer in good time, against a plain model on small tables."""

import collections
import random

import numpy as np
import pytest

from passages.operators.perturb import shuffle_word_blocks
from passages.params import IndexParams
from passages.plans import queries as Q
from tests.test_cluster import brute
from tests.test_fingerprint import model


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(8)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randrange(60))
    docs = [" ".join(word() for _ in range(600)) for _ in range(6)]
    docs.append(docs[0][:1000] + " " + docs[1][:1500])
    docs.append("same " * 60 + docs[2][:2200])
    docs += ["short text", None]
    d = str(tmp_path_factory.mktemp("chains"))
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    items = [docs[0][:900], docs[3][200:800], "nothing of the kind is anywhere in here"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, items


def scores(queries, docs):
    """{(query, document): (shared, chain)}"""
    p = IndexParams()
    post = {i: model(t or "", p) for i, t in enumerate(docs)}
    out = {}
    for q, text in queries.items():
        mine = model(text, p.for_queries())
        fps = {f for _, f in mine}
        for i, rows in post.items():
            shared = fps & {f for _, f in rows}
            if len(shared) < 5:
                continue
            at = collections.defaultdict(list)
            for pos, f in rows:
                at[f].append(pos)
            pts = sorted((pos, k - pos, f) for pos, f in mine for k in at.get(f, ()))
            x, y = (np.array([t[j] for t in pts]) for j in (0, 1))
            label = brute(x, y, "rectangle", 30, 30, 30)
            best = [len({pts[k][2] for k in np.flatnonzero(label == c)}) for c in set(label.tolist()) if (label == c).sum() >= 5]
            out[q, i] = (float(len(shared)), float(max(best, default=0)))
    return out


def test_self(spark, tables):
    d, docs, _ = tables
    queries = {i: t for i, t in enumerate(docs) if t and len(t) >= 2000}
    got = {(r["query_id"], r["doc_id"]): r["raw_score"] for r in Q.QUERIES["chain_scores_self"](spark, d).collect()}
    assert got == {k: c for k, (_, c) in scores(queries, docs).items()}


def test_reversed(spark, tables):
    d, docs, _ = tables
    blocks = lambda t: " ".join(" ".join(t.split()[i : i + 20]) for i in reversed(range(0, len(t.split()), 20)))
    queries = {i: blocks(t) for i, t in enumerate(docs) if t and len(t) >= 2000}
    got = {(r["query_id"], r["doc_id"]): (r["shared"], r["chain"]) for r in Q.QUERIES["chain_scores_reversed"](spark, d).collect()}
    assert got == scores(queries, docs)


def test_shuffled(spark, tables):
    d, docs, items = tables
    got = {(r["query_id"], r["doc_id"]): (r["shared"], r["chain"]) for r in Q.QUERIES["shuffled_scores"](spark, d).collect()}
    assert got == scores({i: shuffle_word_blocks(t, 20, 0) for i, t in enumerate(items)}, docs)


def test_alignments(spark, tables):
    from passages.operators.align import align

    d, docs, items = tables
    got = {(r["query_id"], r["doc_id"]): (r["start1"], r["end1"], r["start2"], r["end2"], r["score"]) for r in Q.QUERIES["align_regions"](spark, d).collect()}
    pairs = scores(dict(enumerate(items)), docs)
    assert got == {(q, i): tuple(align(items[q], docs[i]).regions[0].values()) for q, i in pairs}
    assert got[0, 0][4] == 900.0
