import random

import numpy as np
import pytest

from passages.operators import align as al


def model(a, b, match=1.0):
    """Row by row, single precision rows, double precision comparisons."""
    n, m = len(a), len(b)
    h = np.zeros((n + 1, m + 1), np.float32)
    tb = np.zeros((n + 1, m + 1), int)
    best, bi, bj = 0.0, 0, 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if a[i - 1] == b[j - 1]:
                diag = float(h[i - 1, j - 1]) + match
            else:
                diag = float(h[i - 1, j - 1] - np.float32(al.substitution_cost(a[i - 1], b[j - 1])))
            left, up = float(h[i, j - 1] - np.float32(al.gap_cost(b[j - 1]))), float(h[i - 1, j] - np.float32(al.gap_cost(a[i - 1])))
            s = max(0.0, diag, left, up)
            h[i, j] = s
            tb[i, j] = 0 if s == 0 else 1 if s == diag else 2 if s == up else 3
            if s > best:
                best, bi, bj = s, i, j
    i, j = bi, bj
    while i and j and tb[i, j]:
        d = tb[i, j]
        i, j = i - (d != 3), j - (d != 2)
    return best, i, bi, j, bj


@pytest.mark.parametrize("one_pass", [1, 10_000])
def test_model(one_pass):
    rnd = random.Random(0)
    for _ in range(40):
        a = "".join(rnd.choice("abcA -—.,@\n") for _ in range(rnd.randrange(1, 40)))
        b = "".join(rnd.choice("abcA -—.,@\n") for _ in range(rnd.randrange(1, 40)))
        got = al.align(a, b, al.AlignParams(one_pass, 0)).regions
        best, i, bi, j, bj = model(a, b)
        assert (not got and best == 0) or got == [{"start1": i, "end1": bi, "start2": j, "end2": bj, "score": best}]


def test_regions():
    core = "the quick brown fox jumps over the lazy dog"
    r = al.align(f"zzzz {core} qqqq", f"1111 {core} 2222").regions[0]
    assert core in f"zzzz {core} qqqq"[r["start1"] : r["end1"]]
    assert al.align("abc", "abc").regions == []
    two = al.align_all(f"{core} 0000000000000000 {core[::-1]}", f"{core} ######## {core[::-1]}")
    assert len(two.regions) >= 1 and "<table>" in two.html()
    assert al.largest_region_score("", "x") == 0.0


def test_column(spark):
    df = spark.createDataFrame([("hello there world", "hello there world"), (None, "x")], "text1 string, text2 string")
    got = {r["text1"]: r["regions"] for r in al.align_pairs(df).collect()}
    assert got[None] == [] and got["hello there world"][0]["score"] == 17.0


def test_many_at_a_time():
    """Pairs scored together, within a band where a least score is asked for, have the ends and unrounded scores that each has alone."""
    rng, letters = random.Random(2), "abAB .,-—@ß\n"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    pairs = [("", "x"), ("a", "a")]
    for n in (3, 17, 60, 150):
        for _ in range(6):
            a = text(n)
            b = list(a)
            for _ in range(n // 6):
                b[rng.randrange(n)] = text(rng.randint(0, 3))
            pairs += [(a, text(rng.randint(0, 2 * n))), (a, "".join(b)), (text(n // 3) + a, "".join(b) + text(n))]
    alone = []
    for a, b in pairs:
        s, t, gaps, table = al._encode(a, b)
        alone.append(al._sweep(s, t, 1.0, gaps, table, False)[:3])
    assert al.best_scores(pairs) == alone
    for least in (2, 20, 90):
        got = al.best_scores(pairs, least=least)
        assert all(x == y if y[0] >= least else x[0] < least for x, y in zip(got, alone))
    assert [s for s in al.region_scores(pairs)] == [al.align(a, b).score() for a, b in pairs]


def test_aligned_once(spark):
    """A pair is aligned once, after the pairs are dealt out, also where its regions are exploded."""
    from pyspark.sql import functions as F

    got = al.align_pairs(spark.range(3).select("id", F.lit("a text that is long").alias("text1"), F.lit("a text that is long").alias("text2"))).select("id", F.explode("regions").alias("r"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and got.count() == 3
