"""Quality classifier: document evidence joined with host- and path-level posteriors by hierarchical empirical Bayes.

1. A logistic model over hashed words and a few shape features is fitted on labelled documents (at most
   ``fit_rows`` of them, taken by hash of the id; the only bounded step).
2. Every document gets the model's log odds.
3. Hosts and paths pool the evidence of *all* their documents: a grouped aggregation sums the documents' probabilities
   (the label where there is one), a Beta prior for hosts comes from the spread of host means by the method of moments,
   a second one for paths around their host; so a site with few documents stays near its host and the global rate.
4. A document's posterior log odds are its own plus the shift of its path's rate against the global one. The rate is that of the path's other documents
   (and so is its host's, around which it is shrunk), so no document's evidence counts twice.

Hosts and paths are joined back as aggregated tables (a broadcast while Spark measures them as small, a shuffle join
otherwise); texts are never shuffled.

Defined results: null and empty texts are scored by the intercept and the shape of an empty text; a null host or path is a group of its own; a repeated row counts
again, and repeated labels of an id are averaged; without labels of both kinds the model is neutral (log odds 0); texts of any length are read whole; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from passages.llm.storage import checkpoint, text_batches
from passages.llm.text import Words, slices

BUCKETS = 1 << 15
FIT_ROWS = 20_000
N_SHAPE = 8


def shape(w: Words) -> np.ndarray:
    """Per row: shares of symbols, exclamation marks, repeated neighbours and line ends; log length; distinct share; mean word length; whether the text is empty."""
    off, n = w.rows, len(w.rows) - 1
    size, words = np.maximum(np.diff(off), 1), np.maximum(np.diff(w.bounds), 1)

    def share(mask):
        s = np.concatenate([[0], np.cumsum(mask)])
        return s[off[1:]] - s[off[:-1]]

    d = w.data
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in "#$%&*|<>{}[]^~=_+\\/@"]] = True
    rep = np.zeros(len(w.hashes), bool)
    rep[1:] = w.hashes[1:] == w.hashes[:-1]
    rep[w.bounds[:-1][w.bounds[:-1] < len(rep)]] = False
    reps = np.concatenate([[0], np.cumsum(rep)])
    row = np.repeat(np.arange(n), np.diff(w.bounds))
    order = np.lexsort([w.hashes, row])
    hs, rs = w.hashes[order], row[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    distinct = np.bincount(rs[new], minlength=n)
    chars = share(np.ones(len(d), np.int64))
    return np.stack([share(symbol[d]) / size * 10, share(d == 33) / words, (reps[w.bounds[1:]] - reps[w.bounds[:-1]]) / words, share(d == 10) / words, np.log1p(words) / 8, distinct / words, chars / words / 10, (chars == 0).astype(float)], 1)


def score_rows(w: Words, weights: np.ndarray) -> np.ndarray:
    """Log odds of each row: bias, shape features, mean weight of the words."""
    n = len(w.rows) - 1
    f = weights[N_SHAPE + 1 :][(w.hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]
    s = np.concatenate([[0], np.cumsum(f)])
    mean = (s[w.bounds[1:]] - s[w.bounds[:-1]]) / np.maximum(np.diff(w.bounds), 1) * 10
    return weights[0] + shape(w) @ weights[1 : N_SHAPE + 1] + mean if n else np.empty(0)


class Examples(NamedTuple):
    """Labelled rows: shape features, and in CSR form the buckets of their words with weights."""

    shape: np.ndarray
    bounds: np.ndarray
    buckets: np.ndarray
    values: np.ndarray


def examples(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, Examples]]:
    for part, w in slices(batch, column):
        n = len(w.rows) - 1
        key = np.repeat(np.arange(n), np.diff(w.bounds)) * BUCKETS + (w.hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
        k, c = np.unique(key, return_counts=True)
        row = k // BUCKETS
        yield part, Examples(shape(w).astype(np.float32), np.searchsorted(row, np.arange(n + 1)), (k % BUCKETS).astype(np.int16), (c / np.maximum(np.diff(w.bounds), 1)[row] * 10).astype(np.float32))


def fit(x: Examples, y: np.ndarray, rounds: int = 100, l2: float = 1e-3, close: float = 1e-4, memory: int = 8) -> np.ndarray:
    """Logistic regression by L-BFGS, until the gradient is ``close`` to 0 against its start or after ``rounds``; all weights 0 without labels of both kinds."""
    weights = np.zeros(1 + N_SHAPE + BUCKETS)
    n = len(y)
    if len(set(y.tolist())) < 2:
        return weights
    size = np.diff(x.bounds)
    penalty = np.full(len(weights), l2)  # words, of which there are thousands, are held back; the few shape features are not
    penalty[: N_SHAPE + 1] = l2 / 1000

    def look(w: np.ndarray) -> tuple[float, np.ndarray]:
        product = w[N_SHAPE + 1 :].astype(np.float32)[x.buckets]
        product *= x.values
        sums = np.concatenate([[0.0], np.cumsum(product, dtype=np.float64)])
        z = w[0] + x.shape @ w[1 : N_SHAPE + 1] + sums[x.bounds[1:]] - sums[x.bounds[:-1]]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        del sums
        product[:] = np.repeat(g.astype(np.float32), size)
        product *= x.values
        loss = float((np.logaddexp(0, z) - y * z).mean() + (penalty * w * w).sum() / 2)
        return loss, np.concatenate([[g.sum()], x.shape.T @ g, np.bincount(x.buckets, product, minlength=BUCKETS)]) + penalty * w

    loss, grad = look(weights)
    start, past = np.linalg.norm(grad), []
    for _ in range(rounds):
        if np.linalg.norm(grad) <= close * start:
            break
        d, alphas = -grad, []
        for s, u, r in reversed(past):
            alphas.append(r * (s @ d))
            d = d - alphas[-1] * u
        if past:
            s, u, r = past[-1]
            d = d / (r * (u @ u))
        for (s, u, r), a in zip(past, reversed(alphas)):
            d = d + s * (a - r * (u @ d))
        slope, step = grad @ d, 1.0 if past else 1 / max(1e-12, np.linalg.norm(grad))
        while True:
            new, ahead = look(weights + step * d)
            if new <= loss + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        if new >= loss:
            break
        s, u = step * d, ahead - grad
        weights, loss, grad = weights + s, new, ahead
        if s @ u > 1e-12:
            past = [*past[1 - memory :], (s, u, 1 / (s @ u))]
    return weights


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Weights; texts become features where they are read, and only those of the sample reach the driver."""
    lab = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("double").alias("y")).filter("y IS NOT NULL AND i IS NOT NULL").groupBy("i").agg(F.avg("y").alias("y"))
    some = lab.orderBy(F.xxhash64("i"), "i").limit(fit_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in examples(batch, "t"):
                cut = lambda a: pa.array([a[i:j].tobytes() for i, j in zip(x.bounds[:-1].tolist(), x.bounds[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("i"), part.column("y"), pa.array([r.tobytes() for r in x.shape], pa.binary()), cut(x.buckets), cut(x.values)], ["i", "y", "shape", "buckets", "words"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(some), "i")
    t = text_batches(rows).mapInArrow(features, f"i {docs.schema[id_col].dataType.simpleString()}, y double, shape binary, buckets binary, words binary").toArrow()
    if not len(t):
        return np.zeros(1 + N_SHAPE + BUCKETS)
    t = t.take(np.lexsort([t.column("y").to_numpy(), t.column("i").to_numpy()]))
    whole = lambda name, kind: np.frombuffer(b"".join(t.column(name).to_pylist()), kind)
    size = np.array([len(b) // 2 for b in t.column("buckets").to_pylist()])
    x = Examples(whole("shape", np.float32).reshape(-1, N_SHAPE), np.concatenate([[0], np.cumsum(size)]), whole("buckets", np.int16), whole("words", np.float32))
    y = (t.column("y").to_numpy() >= 0.5).astype(float)
    del t
    return fit(x, y)


def evidence(docs: DataFrame, weights: np.ndarray, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """(doc_id, host, path, z)"""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(np.clip(score_rows(w, shared.value), -30, 30))], ["doc_id", "host", "path", "z"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("t")).transform(text_batches).mapInArrow(score, "doc_id long, host string, path string, z double")


def posteriors(ev: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(doc_id, host, path, p_doc, p_host, p_path, n_path, p_quality, keep) from (doc_id, host, path, z)."""
    lab = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    p = (1 / (1 + F.exp(-F.col("z")))).alias("p")
    seen = ev.join(lab, "doc_id", "left").select("doc_id", "host", "path", "z", F.coalesce("y", p).alias("e"))
    paths = seen.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("e").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.count("*").alias("hk"))
    eps = 1e-6

    def strength(rows: DataFrame, n: str, s: str, centre) -> DataFrame:
        # moments: the spread of means beyond what chance gives; strength = m(1-m)/tau2 - 1
        r = rows.select(F.col(n).alias("n"), (F.col(s) / F.col(n)).alias("m"), centre.alias("c"))
        a = r.agg(F.sum(F.col("n") * (F.col("m") - F.col("c")) ** 2).alias("ss"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("c") * (1 - F.col("c"))).alias("v"))
        v = F.col("v") / F.col("n")
        tau = F.greatest(F.lit(eps), (F.col("ss") - (F.col("k") - 1) * v) / F.greatest(F.lit(1.0), F.col("n") - F.col("n2") / F.col("n")))
        return a.select(F.least(F.lit(1e6), F.greatest(F.lit(1.0), v / tau - 1)).alias("strength"))

    g = hosts.agg(F.sum("hn").alias("gn"), F.sum("hs").alias("gs")).select(((F.col("gs") + 1) / (F.col("gn") + 2)).alias("g"))
    one = g.crossJoin(strength(hosts.crossJoin(g), "hn", "hs", F.col("g")).withColumnRenamed("strength", "kh"))
    host = hosts.crossJoin(one).select("host", "hn", "hs", "g", "kh", ((F.col("hs") + F.col("kh") * F.col("g")) / (F.col("hn") + F.col("kh"))).alias("p_host"))
    both = paths.join(host, paths["host"].eqNullSafe(host["host"])).drop(host["host"])
    kp = strength(both, "n", "s", F.col("p_host")).withColumnRenamed("strength", "kp")
    path = both.crossJoin(kp).withColumn("p_path", (F.col("s") + F.col("kp") * F.col("p_host")) / (F.col("n") + F.col("kp")))
    path = path.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "n", "s", "hn", "hs", "g", "kh", "kp", "p_host", "p_path")
    logit = lambda c: F.log(c / (1 - c))
    clip = lambda c: F.least(F.lit(1 - eps), F.greatest(F.lit(eps), c))
    out = seen.join(path, seen["host"].eqNullSafe(path["_h"]) & seen["path"].eqNullSafe(path["_p"]))
    others_host = (F.col("hs") - F.col("e") + F.col("kh") * F.col("g")) / (F.col("hn") - 1 + F.col("kh"))
    others = (F.col("s") - F.col("e") + F.col("kp") * others_host) / (F.col("n") - 1 + F.col("kp"))
    z = F.col("z") + logit(clip(others)) - logit(clip(F.col("g")))
    q = 1 / (1 + F.exp(-z))
    return out.select("doc_id", "host", "path", p.alias("p_doc"), "p_host", "p_path", F.col("n").alias("n_path"), q.alias("p_quality"), (q >= 0.5).alias("keep"))


def posteriors_sql(evidence: str, labels: str, id_col: str = "doc_id", label_col: str = "quality") -> str:
    """``posteriors`` in SQL, over a table of evidence and one of labels."""
    eps = 1e-6
    logit = lambda c: f"ln(least({1 - eps!r}, greatest({eps!r}, {c})) / (1 - least({1 - eps!r}, greatest({eps!r}, {c}))))"
    strength = lambda n, m, c, t: f"(SELECT least(1e6, greatest(1, v / greatest({eps!r}, (ss - (k - 1) * v) / greatest(1, n - n2 / n)) - 1)) FROM (SELECT sum({n} * ({m} - {c}) ** 2) AS ss, sum({n}) AS n, sum({n} * {n}) AS n2, count(*) AS k, sum({n} * {c} * (1 - {c})) / sum({n}) AS v FROM {t}))"
    return f"""
WITH lab AS (SELECT {id_col} AS doc_id, avg({label_col}) AS y FROM {labels} WHERE {label_col} IS NOT NULL AND {id_col} IS NOT NULL GROUP BY 1),
seen AS (SELECT e.*, 1 / (1 + exp(-z)) AS p, coalesce(y, 1 / (1 + exp(-z))) AS e FROM {evidence} e LEFT JOIN lab USING (doc_id)),
paths AS (SELECT host, path, count(*)::DOUBLE AS n, sum(e) AS s FROM seen GROUP BY 1, 2),
hosts AS (SELECT host, sum(n) AS hn, sum(s) AS hs FROM paths GROUP BY 1),
gl AS (SELECT (sum(hs) + 1) / (sum(hn) + 2) AS g FROM hosts),
h1 AS (SELECT hosts.*, g FROM hosts, gl),
h2 AS (SELECT *, {strength("hn", "hs / hn", "g", "h1")} AS kh FROM h1),
h3 AS (SELECT *, (hs + kh * g) / (hn + kh) AS p_host FROM h2),
p1 AS (SELECT paths.*, hn, hs, g, kh, p_host FROM paths JOIN h3 ON paths.host IS NOT DISTINCT FROM h3.host),
p2 AS (SELECT *, {strength("n", "s / n", "p_host", "p1")} AS kp FROM p1),
o AS (SELECT doc_id, seen.host, seen.path, p AS p_doc, p_host, (s + kp * p_host) / (n + kp) AS p_path, n AS n_path, z, g, (s - e + kp * (hs - e + kh * g) / (hn - 1 + kh)) / (n - 1 + kp) AS others
 FROM seen JOIN p2 ON seen.host IS NOT DISTINCT FROM p2.host AND seen.path IS NOT DISTINCT FROM p2.path)
SELECT doc_id, host, path, p_doc, p_host, p_path, CAST(n_path AS BIGINT) AS n_path, 1 / (1 + exp(-(z + {logit("others")} - {logit("g")}))) AS p_quality FROM o"""


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    weights = train(docs, labels, id_col, text_col, label_col, fit_rows)
    ev = checkpoint(evidence(docs, weights, id_col, text_col, host_col, path_col))  # used by the sums and by the rows
    return posteriors(ev, labels, id_col, label_col)
