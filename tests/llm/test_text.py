"""Words, grams and byte-pair encoding against plain versions."""

import random
import re

import pyarrow as pa
from hypothesis import given, settings, strategies as st

from passages.llm import bpe, packing, text

WORD = re.compile(r"[0-9a-z_\x80-\U0010ffff]+")
AL = "ab Z'sdtmrevl\n\t  09,.é×ñÉ中 \u0085–\x1c\"'_-"


def random_texts(n, seed=5):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(AL) for _ in range(rnd.randrange(30))) for _ in range(n)] + ["don't we'll they've O'Reilly's '' 's 'll", "", "a", "  ", "x" * 5000]


def test_words_and_grams():
    texts = random_texts(2000)
    w = text.words(pa.array(texts, pa.large_string()))
    low = [t.lower() for t in texts]
    seen, back = {}, {}
    for i, t in enumerate(low):
        toks = WORD.findall(t)
        hs = w.hashes[w.bounds[i] : w.bounds[i + 1]].tolist()
        assert len(hs) == len(toks)
        for a, b in zip(toks, hs):
            assert seen.setdefault(a, b) == b and back.setdefault(b, a) == a
    for n in (1, 3, 5):
        g, b = text.grams(w, n)
        seen, back = {}, {}
        for i, t in enumerate(low):
            toks = WORD.findall(t)
            want = [tuple(toks[j : j + n]) for j in range(max(1, len(toks) - n + 1))] if toks else []
            have = g[b[i] : b[i + 1]].tolist()
            assert len(want) == len(have)
            for x, y in zip(want, have):
                assert seen.setdefault(x, y) == y and back.setdefault(y, x) == x


def encode_all(texts):
    arr = pa.array(texts, pa.large_string())
    out = []
    for a, b, sizes, ids in bpe.encoded(arr, bpe.DEFAULT_VOCABULARY):
        at = 0
        for k in sizes.tolist():
            out.append(ids[at : at + k].tolist())
            at += k
    return out


def test_encoding_is_the_librarys():
    texts = random_texts(5000, 7)
    e = bpe.encoder(bpe.DEFAULT_VOCABULARY).bpe
    assert encode_all(texts) == [e.encode_ordinary(t) for t in texts]
    assert [e.decode(x) for x in encode_all(texts[:500])] == texts[:500]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_encoding_of_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    e = bpe.encoder(bpe.DEFAULT_VOCABULARY).bpe
    assert encode_all(texts) == [e.encode_ordinary(t) for t in texts]


def test_decompose():
    import numpy as np

    sizes = np.array([0, 1, 7, 8, 40, 41])
    row, length = packing.decompose(sizes, 16)
    assert [length[row == i].tolist() for i in range(6)] == [[], [1], [4, 2, 1], [8], [16, 16, 8], [16, 16, 8, 1]]
