import numpy as np
import pytest

from passages.operators.cluster import components, number
from passages.params import METHODS, ScoreParams


def brute(x, y, m, p, o, d):
    dx, dy = abs(x[:, None] - x[None]), abs(y[:, None] - y[None])
    near = {"rectangle": (dx <= p) & (dy <= o), "chebyshev": np.maximum(dx, dy) <= d, "cityblock": dx + dy <= d, "euclidean": dx * dx + dy * dy <= d * d}[m]
    label = np.arange(len(x))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(x))])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("method", METHODS)
def test_brute_force(method):
    r = np.random.default_rng(0)
    for _ in range(80):
        n, span = r.integers(1, 120), int(r.choice([20, 100, 400]))
        pts = np.unique(np.stack([r.integers(0, span, n), r.integers(-span, span, n)], 1), axis=0)
        p, o, d = map(int, r.integers(1, 31, 3))
        assert (components(pts[:, 0], pts[:, 1], method, p, o, d, hold=50) == brute(pts[:, 0], pts[:, 1], method, p, o, d)).all()


def test_box_methods_agree():
    r = np.random.default_rng(1)
    pts = np.unique(np.stack([r.integers(0, 300, 200), r.integers(-300, 300, 200)], 1), axis=0)
    assert (components(pts[:, 0], pts[:, 1], "rectangle", 20, 20, 1) == components(pts[:, 0], pts[:, 1], "chebyshev", 1, 1, 20)).all()


def test_thresholds_are_inclusive():
    x = np.array([0, 30, 61])
    y = np.array([0, 0, 0])
    assert components(x, y, "rectangle", 30, 30, 30).tolist() == [0, 0, 2]
    assert number(np.array([0, 0, 0, 0, 4, 4, 4, 4, 4]), 5).tolist() == [-1] * 4 + [0] * 5


def test_params():
    with pytest.raises(ValueError):
        ScoreParams(method="nearest")
    p = ScoreParams().edited(position_threshold="500", offset_threshold="x", min_cluster_size=0, other=3)
    assert (p.position_threshold, p.offset_threshold, p.min_cluster_size) == (200, 30, 1)


@pytest.mark.parametrize("method", METHODS)
def test_fingerprints_of_clusters(spark, method):
    """Clusters found from lists of places are those found from points, in groups that are sparse, dense, or go on over many batches."""
    from passages.operators import candidates as cand, cluster, index as ix

    rng = np.random.default_rng(3)
    words = lambda n, most: " ".join(f"w{i}" for i in rng.integers(0, most, n))
    base = words(400, 10_000)
    texts = [base, f"{words(50, 9)} {base} {words(90, 3)}", " ".join(base.split()[::-1]), "x " * 700, f"{'x ' * 90}{base}", words(300, 4), " ".join(base.split()[200:] + base.split()[:200])]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    p = ScoreParams(method=method, position_threshold=9, offset_threshold=5, distance_threshold=11)
    index = ix.in_memory(docs)
    q = cand.query_fingerprints(docs.withColumnRenamed("id", "query_id"), index.params)
    cands = cand.candidates(q, index.postings)
    points = cluster.cluster_points(cand.shared_points(q, index.postings, cands), p).select("query_id", "doc_id", "cluster_id", "fp").distinct().collect()
    want = {tuple(r) for r in points if r["cluster_id"] >= 0}
    own = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("50", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = [tuple(r) for r in cluster.cluster_fingerprints(q, index, cands, p).select("query_id", "doc_id", "cluster_id", "fp").collect()]
            assert len(got) == len(set(got)) and {r for r in got if r[2] >= 0} == want
            assert {r[:2] for r in got} == {r[:2] for r in cands.select("query_id", "doc_id").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", own)


def test_no_points_in_the_plan(spark, sf):
    """Chains of all documents don't shuffle a row for each point: every row to sweep has lists of places."""
    from passages.plans import queries as Q

    plan = Q.QUERIES["chain_scores_self"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "collect_list" in plan
