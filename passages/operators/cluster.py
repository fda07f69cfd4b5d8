"""Chains: single-linkage clusters of shared points.

Spark has no connected components, so each (query, document) group's points go through one sweep: points sorted by query position are compared
with those that follow within the threshold (array shifts, not a matrix), and the edges are contracted by pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from passages.operators.index import PAIR_BYTES, parts_for
from passages.params import ScoreParams


def _contract(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after the ends of all edges (u, v) share the lesser one."""
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
    return label


def components(x: np.ndarray, y: np.ndarray, method: str, position: float, offset: float, distance: float, hold: int = 1 << 20) -> np.ndarray:
    """Label of each point (the least place of its component); points are distinct and sorted by x.

    Columns of equal x are swept from left to right. Of each row only the last point matters to what follows: it is the nearest. For the two box-shaped methods, points
    of the last ``position`` columns whose rows are close are all near one another, so a new point is linked to its neighbours among those rows only;
    for the others, to every row within reach. Links are contracted whenever ``hold`` of them have come together, so dense groups cost no more memory than sparse ones.
    """
    n = len(x)
    label = np.arange(n)
    if n < 2:
        return label
    box = method in ("rectangle", "chebyshev")
    reach = position if method == "rectangle" else distance
    side = int(offset if method == "rectangle" else distance)
    row = y - y.min() + side
    rows = int(row.max()) + side + 1
    last_x, last_id = np.full(rows, np.iinfo(np.int64).min // 2), np.zeros(rows, np.int64)
    dy = np.arange(-side, side + 1)
    cuts = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [n]])
    us, vs, held = [], [], 0
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        here, r, at = x[a], row[a:b], np.arange(a, b)
        same = last_x[r] >= here - reach
        us.append(at[same])
        vs.append(last_id[r[same]])
        last_x[r], last_id[r] = here, at
        if box:
            first = max(0, int(r.min()) - side)
            live = np.flatnonzero(last_x[first : int(r.max()) + side + 1] >= here - reach) + first
            k = np.searchsorted(live, r)
            for step in (-1, 1):
                ok = (k + step >= 0) & (k + step < len(live))
                other = live[k[ok] + step]
                ok2 = np.abs(other - r[ok]) <= side
                us.append(at[ok][ok2])
                vs.append(last_id[other[ok2]])
        else:
            other = r[:, None] + dy[None, :]
            dx = here - last_x[other]
            far = np.abs(dy)[None, :]
            near = dx + far <= distance if method == "cityblock" else (dx <= distance) & (np.minimum(dx, 1 << 30) ** 2 + far**2 <= distance * distance)
            i, j = np.nonzero(near & (dx >= 0))
            us.append(at[i])
            vs.append(last_id[other[i, j]])
        held += sum(map(len, us[-3:]))
        if held > hold:
            label = _contract(label, np.concatenate(us), np.concatenate(vs))
            us, vs, held = [], [], 0
    return _contract(label, np.concatenate(us), np.concatenate(vs)) if us else label


def number(label: np.ndarray, least: int) -> np.ndarray:
    """Clusters of at least ``least`` points numbered from 0 in order of their first points; -1 for the rest."""
    size = np.bincount(label, minlength=len(label))
    good = np.flatnonzero(size >= least)
    out = np.full(len(label), -1, np.int32)
    keep = size[label] >= least
    out[keep] = np.searchsorted(good, label[keep])
    return out


def cluster_points(points: DataFrame, p: ScoreParams = ScoreParams()) -> DataFrame:
    """``points`` with ``cluster_id``."""
    names = points.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema) + ", cluster_id int"
    method, position, offset, distance, least = p.method, p.position_threshold, p.offset_threshold, p.distance_threshold, p.min_cluster_size

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos_query", "pos_doc"], kind="stable")
        label = components(pdf["pos_query"].to_numpy().astype(np.int64), pdf["pos_offset"].to_numpy().astype(np.int64), method, position, offset, distance)
        return pdf[names].assign(cluster_id=number(label, least))

    # groups of fewer points than a cluster needs never reach Python
    sized = points.withColumn("_n", F.count("*").over(_by()))
    small = sized.filter(F.col("_n") < least).drop("_n").withColumn("cluster_id", F.lit(-1).cast("int"))
    return sized.filter(F.col("_n") >= least).drop("_n").groupBy("query_id", "doc_id").applyInPandas(run, schema).unionByName(small)


#: Points that are worked on at a time; a pair of more is worked on alone. Points within reach of one another, up to which pairs of points are compared one by one.
POINTS, NEAR = 1 << 18, 64


def _labels(group: np.ndarray, x: np.ndarray, y: np.ndarray, p: ScoreParams) -> np.ndarray:
    """``components`` of several groups at once, of points sorted by group and x: labels are places among all points. Where few points are near one another they are
    compared with the next one, the next but one and so on, all groups together; other groups are swept one by one."""
    reach = int(p.position_threshold if p.method == "rectangle" else p.distance_threshold)
    at = group * (int(x.max()) + reach + 1) + x
    follow = np.searchsorted(at, at + reach, "right") - np.arange(len(at)) - 1
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    dense = np.maximum.reduceat(follow, first) > NEAR
    label = np.arange(len(at))
    i, us, vs, held = np.flatnonzero(~np.repeat(dense, np.diff(np.append(first, len(at))))), [], [], 0
    for k in range(1, NEAR + 1):
        i = i[follow[i] >= k]
        if not len(i):
            break
        dx, dy = at[i + k] - at[i], np.abs(y[i + k] - y[i])
        if p.method == "rectangle":
            near = dy <= p.offset_threshold
        elif p.method == "chebyshev":
            near = dy <= p.distance_threshold
        elif p.method == "cityblock":
            near = dx + dy <= p.distance_threshold
        else:
            near = dx**2 + dy**2 <= p.distance_threshold**2
        us.append(i[near])
        vs.append(i[near] + k)
        held += len(us[-1])
        if held > 1 << 20:
            label = _contract(label, np.concatenate(us), np.concatenate(vs))
            us, vs, held = [], [], 0
    if us:
        label = _contract(label, np.concatenate(us), np.concatenate(vs))
    for a, b in zip(first[dense].tolist(), np.append(first, len(at))[1:][dense].tolist()):
        label[a:b] = a + components(x[a:b], y[a:b], p.method, p.position_threshold, p.offset_threshold, p.distance_threshold)
    return label


def _runs(count: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of groups of at most POINTS points together, or of one group."""
    end, a = np.cumsum(count), 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + POINTS, "right")))
        yield a, b
        a = b


def _clustered(t: pa.Table, p: ScoreParams) -> Iterator[pa.RecordBatch]:
    """Of whole groups of rows (query_id, doc_id, rank, n_shared, fp, pos_query: list, pos_doc: list), the distinct fingerprints of each cluster."""
    t = t.combine_chunks()
    new = np.concatenate([[True], _changes(t)])
    first = np.flatnonzero(new)
    (q, nq), (d, nd) = (_lists(t.column(c).chunk(0)) for c in ("pos_query", "pos_doc"))
    q0, d0, group = np.cumsum(nq) - nq, np.cumsum(nd) - nd, np.cumsum(new) - 1
    ends = np.append(first, t.num_rows)
    for a, b in _runs(np.add.reduceat(nq * nd, first)):
        lo, hi = ends[a], ends[b]
        count = nq[lo:hi] * nd[lo:hi]
        row = np.repeat(np.arange(lo, hi), count)
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        x = q[q0[row] + k // nd[row]].astype(np.int64)
        at = d[d0[row] + k % nd[row]].astype(np.int64)
        order = np.lexsort((at, x, group[row]))
        row, x, at = row[order], x[order], at[order]
        label = _labels(group[row] - a, x, at - x, p)
        size = np.bincount(label, minlength=len(label))
        good = np.flatnonzero(size >= p.min_cluster_size)
        keep = size[label] >= p.min_cluster_size
        # clusters of a group are numbered in order of their first points
        cluster = np.searchsorted(good, label[keep]) - np.searchsorted(group[row[good]], group[row[keep]])
        most = int(cluster.max()) + 1 if len(cluster) else 1
        got = np.unique(row[keep] * most + cluster)
        none = np.setdiff1d(first[a:b], first[group[got // most]])
        rows, numbers = np.concatenate([got // most, none]), np.concatenate([got % most, np.full(len(none), -1)])
        part = t.take(pa.array(rows)).select(["query_id", "doc_id", "rank", "n_shared", "fp"]).append_column("cluster_id", pa.array(numbers.astype(np.int32)))
        yield from part.to_batches(max_chunksize=1 << 16)


def _changes(t: pa.Table) -> np.ndarray:
    """Whether each row but the first is of another group than the one before."""
    cols = [t.column(c).chunk(0) for c in ("query_id", "doc_id")]
    return np.logical_or(*(pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in cols))


def _lists(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return a.flatten().to_numpy(), pc.list_value_length(a).to_numpy().astype(np.int64)


def cluster_fingerprints(queries: DataFrame, index, cands: DataFrame, p: ScoreParams = ScoreParams()) -> DataFrame:
    """(query_id, doc_id, rank, n_shared, cluster_id, fp): the distinct fingerprints of each cluster of each candidate; one row with cluster -1 and any fingerprint where a candidate has
    no cluster. Places stay in lists till they are swept, so that what moves is linear in the texts where points, of texts that repeat themselves, aren't."""
    places = lambda rows, key, name: rows.groupBy(key, "fp").agg(F.collect_list("pos").alias(name))
    # inner joins with distinct fingerprints, so that a small side of queries can be sent to the index
    q = places(queries.join(index.stats.select("fp"), "fp"), "query_id", "pos_query")
    d = places(index.postings.join(queries.select("fp").distinct(), "fp"), "doc_id", "pos_doc")
    rows = cands.select("query_id", "doc_id", "rank", "n_shared").join(q, "query_id").join(d, ["doc_id", "fp"]).select("query_id", "doc_id", "rank", "n_shared", "fp", "pos_query", "pos_doc")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:5]) + ", cluster_id int"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in it:
            held.append(b)
            t = pa.Table.from_batches(held).combine_chunks()
            cut = np.flatnonzero(_changes(t)) + 1 if t.num_rows > 1 else ()
            if len(cut):  # the last group may go on
                yield from _clustered(t.slice(0, cut[-1]), p)
                held = t.slice(cut[-1]).to_batches()
        if sum(b.num_rows for b in held):
            yield from _clustered(pa.Table.from_batches(held), p)

    return rows.repartition(parts_for(queries, each=PAIR_BYTES), "query_id").sortWithinPartitions("query_id", "doc_id", "fp").mapInArrow(run, schema)


def _by():
    from pyspark.sql import Window

    return Window.partitionBy("query_id", "doc_id")
