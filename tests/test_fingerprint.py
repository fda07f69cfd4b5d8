"""Tokens, hashes and winnowing against a plain model."""

import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from passages.functions import fingerprint as fp
from passages.params import IndexParams

M = 2**31 - 1
PARTS = ["a", "b", "the", "x-y", "é²", "½", "\u0085", "\x1c", "　", "漢字", "😀", "don't", "é", "_", "-", "...", " ", " ", "\n"]


def model(text, p):
    if not p.punctuation:
        text = re.sub(r"[^\w\s]", "", text)
    t = []
    for tok in text.split():
        h = fp.FNV_START
        for b in tok.encode():
            h = ((h ^ b) * fp.FNV_PRIME) & (2**64 - 1)
        t.append(h % M)
    k, w = p.length, p.window_size
    g = [sum(t[i + j] * pow(p.base, k - j, M) for j in range(k)) % M for i in range(len(t) - k + 1)]
    at = sorted({min(range(i, i + w), key=lambda q: (g[q], -q)) for i in range(len(g) - w + 1)})
    return [(i, g[i]) for i in at]


@pytest.mark.parametrize("p", [IndexParams(), IndexParams(3, 1), IndexParams(5, 4, 256, True), IndexParams(2, 3, 31)])
def test_model(p):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(PARTS) + rnd.choice(["", " "]) for _ in range(rnd.randrange(40))) for _ in range(500)] + ["", " ", "same " * 50]
    r, pos, f = fp.fingerprints(pa.array(texts, pa.large_string()), p)
    assert list(zip(r.tolist(), pos.tolist(), f.tolist())) == [(i, *x) for i, t in enumerate(texts) for x in model(t, p)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(texts):
    arr = pa.array([t.encode("utf-8", "ignore").decode() for t in texts], pa.large_string())
    t = fp.tokenize(arr)
    got = [[t.data[a:b].tobytes().decode() for a, b in zip(t.starts[x:y], t.ends[x:y])] for x, y in zip(t.bounds[:-1], t.bounds[1:])]
    assert got == [re.sub(r"[^\w\s]", "", x).split() for x in arr.to_pylist()]


def test_lengths_of_short_texts():
    for n, expected in ((3, 0), (4, 0), (8, 0), (9, 1)):
        text = pa.array([" ".join(f"w{i}" for i in range(n))], pa.large_string())
        assert len(fp.fingerprints(text, IndexParams())[0]) == expected
    assert len(fp.fingerprints(pa.array(["a b c d"], pa.large_string()), IndexParams().for_queries())[0]) == 1


def test_shared_run_shares_a_fingerprint():
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(1000)}"
    for _ in range(50):
        run = [word() for _ in range(9)]
        a, b = ([word() for _ in range(20)] + run + [word() for _ in range(20)] for _ in range(2))
        fa, fb = (set(fp.fingerprints(pa.array([" ".join(x)], pa.large_string()), IndexParams())[2].tolist()) for x in (a, b))
        assert fa & fb


def test_offsets_match_tokens():
    rnd = random.Random(5)
    for _ in range(200):
        text = "".join(rnd.choice(PARTS) for _ in range(30))
        toks = re.sub(r"[^\w\s]", "", text).split()
        spans = fp.token_offsets(text)
        assert len(spans) == len(toks)
        assert [re.sub(r"[^\w\s]", "", text[a:b]) for a, b in spans] == toks


def test_null_text(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b c d")], "id int, text string")
    assert [tuple(r)[:2] for r in fp.fingerprint_rows(df, IndexParams(4, 1)).collect()] == [(3, 0)]
