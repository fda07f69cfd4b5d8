"""The pipeline's stages against brute force."""

import random
import re
import time

import corpus_pipeline as P
from passages.llm import bpe, decontamination, jaccard_join, pii, quality_rules

from tests.llm.test_operators import brute_groups, brute_model, sentence


def test_stages(spark, sf, duck):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "pii", "packing"]
    kept = {r[0] for r in duck.sql(f"SELECT doc_id FROM ({quality_rules.oracle()}) WHERE keep").fetchall()}
    one = P.quality(spark, docs, sf).cache()
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == kept
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    groups = brute_groups(rows)
    two = P.near_duplicates(spark, one, sf).cache()
    assert two.columns == docs.columns and {r["doc_id"] for r in two.collect()} == {i for i, _ in rows if groups.get(i, i) == i}
    bad = {r[0] for r in duck.sql(f"SELECT DISTINCT doc_id FROM ({decontamination.oracle()})").fetchall()}
    three = P.decontaminate(spark, two, sf).cache()
    assert three.columns == docs.columns and {r["doc_id"] for r in three.collect()} == {r["doc_id"] for r in two.collect()} - bad
    four = P.private(spark, three, sf).cache()
    assert four.columns == docs.columns and four.count() == three.count()
    before = {r["doc_id"]: r["text"] for r in three.collect()}
    for r in four.collect():
        assert r["n_chars"] == len(r["text"])
        if not list(pii.spans(before[r["doc_id"]])):
            assert r["text"] == before[r["doc_id"]]
        assert not re.search(r"@mail\d|\b\d{16}\b|\b[0-9a-f]{40}\b", r["text"])
    e = bpe.encoder(bpe.DEFAULT_VOCABULARY).bpe
    assert P.pack(spark, four, sf).count() == sum(bin(len(e.encode_ordinary(r["text"]))).count("1") for r in four.collect() if len(e.encode_ordinary(r["text"])) < 8192) + sum(n // 8192 + bin(n % 8192).count("1") for r in four.collect() if (n := len(e.encode_ordinary(r["text"]))) >= 8192)


def test_run(spark, sf, duck):
    """All stages one after another, against what each is worked out to be without Spark."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept = {r[0] for r in duck.sql(f"SELECT doc_id FROM ({quality_rules.oracle()}) WHERE keep").fetchall()}
    groups = brute_groups([(i, docs[i]) for i in sorted(kept)])
    bad = {r[0] for r in duck.sql(f"SELECT DISTINCT doc_id FROM ({decontamination.oracle()})").fetchall()}
    left = {i: docs[i] for i in kept if groups.get(i, i) == i and i not in bad}
    counts = {}
    for t in left.values():
        for *_, sig in pii.spans(t):
            counts[sig] = counts.get(sig, 0) + 1
    table = brute_model([sig for sig, n in counts.items() for _ in range(n)])
    e = bpe.encoder(bpe.DEFAULT_VOCABULARY).bpe
    want = {}
    for i, t in left.items():
        for a, b, kind, sig in sorted(pii.spans(t), reverse=True):
            if table[sig] >= pii.LEAST:
                t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
        want[i] = e.encode_ordinary(t)
    got = {}
    for r in sorted(P.run(spark, sf).collect(), key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == len(got.setdefault(r["doc_id"], [])) and r["bucket"] == len(r["tokens"]) and r["bucket"] & (r["bucket"] - 1) == 0
        got[r["doc_id"]] += r["tokens"]
    assert got == {i: t for i, t in want.items() if t}


ODD = "doc_id long, text string, lang string, source string, n_chars long, copy string, words string, anchor string, key string, n string, t string, row string, doc string, item string, gram string, `_also_0` string"


def odd_rows():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    body = " ".join(("the", "of", "and", *(word() for _ in range(6)))[k % 9] for k in range(0, 200)) + " " + " ".join(word() for _ in range(100))
    texts = [None, "", " ", body, body, body + " mail ann.lee@mail.example.com", "x", "a" * 1_000_000, "中" + " " * 300_000 + "x", "!" * 300_000, "the of and " + " ".join(word() for _ in range(150_000)), "0123456789abcdef" * 20_000]
    rest = ("x",) * 11
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else "s", None if i == 5 else 7) + rest for i, t in enumerate(texts)]
    return rows + [rows[3], (None, body, None, None, None) + rest, (6, body + " other", None, None, 1) + rest]


def test_stages_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, None), (None, "one two three four five six seven"), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd, none = spark.createDataFrame(odd_rows(), ODD), spark.createDataFrame([], ODD)
    count = lambda df: sorted((-1 if r["doc_id"] is None else r["doc_id"], -1 if r["text"] is None else len(r["text"])) for r in df.collect())
    began = time.time()
    for name, stage in P.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
        if name != "packing":
            assert stage(spark, odd, str(tmp_path)).columns == odd.columns
    assert not {i for i, _ in count(P.quality(spark, odd, str(tmp_path)))} & {0, 1, 2}
    # 3, 4, 5 and 6 are copies of one text, in part or as a whole; of these 3 stays, with its repeated row, and the row without an id
    assert [i for i, _ in count(P.near_duplicates(spark, odd, str(tmp_path)))] == [-1, 0, 1, 2, 3, 3, 7, 8, 9, 10, 11]
    assert count(P.decontaminate(spark, odd, str(tmp_path))) == count(odd)
    hidden = P.private(spark, odd, str(tmp_path)).collect()
    assert len(hidden) == odd.count() and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in hidden)
    assert "[EMAIL]" in next(r["text"] for r in hidden if r["doc_id"] == 5)
    e = bpe.encoder(bpe.DEFAULT_VOCABULARY)
    pieces = P.pack(spark, odd, str(tmp_path)).groupBy("doc_id").agg({"bucket": "sum"}).collect()
    want = {}
    for r in odd_rows():
        if n := len(e.whole(r[1] or "")):
            want[r[0]] = want.get(r[0], 0) + n
    assert {r[0]: r[1] for r in pieces} == want
    assert time.time() - began < 300


def test_near_copies_join_few_pairs(spark, monkeypatch):
    """The stage looks up sets for pairs that meet often enough only: of texts that share a sentence and near copies, for the latter."""
    rnd = random.Random(78)
    rows = []
    for i in range(0, 60, 2):
        shared = sentence(rnd, 20)
        rows += [(i + k, shared + " " + sentence(rnd, 400)) for k in (0, 1)]
    rows += [(100 + i, rows[i][1] + " " + sentence(rnd, 30)) for i in range(10)]
    pairs, bounded = [], jaccard_join.bounded
    monkeypatch.setattr(jaccard_join, "bounded", lambda found, *rest: pairs.append(found.count()) or bounded(found, *rest))
    kept = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r["doc_id"] for r in kept.collect()} == set(range(60)) and pairs == [10]
