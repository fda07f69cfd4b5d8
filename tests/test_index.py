import io
import json

import pytest
from pyspark.sql import functions as F

from passages import cli
from passages.operators import highlight as hl, index as ix, metadata as md, scoring as sc
from passages.operators.candidates import query_fingerprints
from passages.params import IndexParams
from passages.sources import corpus
from passages.streaming.indexing import index_stream


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), "text")


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "pos", "fp").collect()))


def test_store_and_merge(spark, docs, tmp_path):
    p = IndexParams()
    whole = ix.build_postings(docs, p)
    half = F.pmod(F.col("id").cast("int"), F.lit(2))
    for k in (0, 1):
        ix.write_index(ix.build_postings(docs.filter(half == k), p), f"{tmp_path}/{k}", p)
    ix.merge_indexes(spark, [f"{tmp_path}/0", f"{tmp_path}/1"], f"{tmp_path}/all")
    back = ix.read_index(spark, f"{tmp_path}/all")
    assert back.params == p and rows(back.postings) == rows(whole)
    with pytest.raises(ValueError):
        ix.merge_indexes(spark, [f"{tmp_path}/0", f"{tmp_path}/0"], f"{tmp_path}/x")
    with pytest.raises(ValueError):
        ix.merge_indexes(spark, [], f"{tmp_path}/x")
    ix.write_index(ix.build_postings(docs.limit(3), IndexParams(5)), f"{tmp_path}/5", IndexParams(5))
    with pytest.raises(ValueError):
        ix.merge_indexes(spark, [f"{tmp_path}/0", f"{tmp_path}/5"], f"{tmp_path}/x")
    ix.write_json_index(whole, f"{tmp_path}/json")
    assert rows(ix.read_json_index(spark, f"{tmp_path}/json")) == rows(whole)
    head = ix.read_json_header(spark, f"{tmp_path}/json").first()
    assert (head["length"], head["window_size"], head["punctuation"], head["num_fingerprints"]) == (4, 6, False, whole.select("fp").distinct().count())


def test_unique_ids(spark):
    ok = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    assert ix.unique_ids(ok).count() == 2
    with pytest.raises(ValueError, match="repeated document id"):
        ix.unique_ids(ok.union(ok)).count()


def test_cli(spark, docs, tmp_path, sf):
    src = f"{tmp_path}/c.jsonl"
    with open(src, "w") as f:
        for r in docs.collect():
            f.write(json.dumps({"doc_id": r["id"], "content": r["text"], "doc_scores": [1]}) + "\n")
        f.write("{broken\n")
    assert cli.main(["index", src, f"{tmp_path}/i", "--length", "4", "--min-length", "1"], spark) == 0
    text = docs.filter(F.length("text") > 1500).orderBy("id").first()
    out = io.StringIO()
    assert cli.main(["detect", f"{tmp_path}/i", "--text", text["text"][:1400], "--output", "json"], spark, out) == 0
    assert json.loads(out.getvalue())[text["id"]] > 0.9
    with pytest.raises(ValueError):
        corpus.read_corpus(spark, "x.csv")


def test_sources(spark, tmp_path):
    import zstandard

    lines = "\n".join(json.dumps({"document": t, "title": i, "seg_langs": "x", "n": 1}) for i, t in (("a", "z" * 2000), ("b", "z" * 1999), ("c", "porn " + "z " * 2000), ("d", "pornx " + "z " * 2000))).encode()
    (tmp_path / "c.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(lines))
    got = corpus.stream(spark, f"{tmp_path}/c.jsonl.zst")
    assert sorted(r["id"] for r in got.collect()) == ["a", "d"] and got.columns == ["id", "text", "n"]
    with pytest.raises(ValueError):
        corpus.normalise(spark.createDataFrame([(1,)], "x int"))
    assert corpus.normalise(spark.createDataFrame([("t",)], "text string")).first()["id"]
    corpus.copy_to(got, f"{tmp_path}/out.jsonl.gz")
    assert corpus.read_sidecar(spark, f"{tmp_path}/none.json", "id string").count() == 0


def test_stream(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/in")
    index_stream(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/post", f"{tmp_path}/ck", once=True).awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/post/postings")) == rows(ix.build_postings(docs))
    ix.finish(spark, f"{tmp_path}/post", IndexParams())
    back = ix.read_index(spark, f"{tmp_path}/post")
    assert rows(back.postings) == rows(ix.build_postings(docs)) and back.params == IndexParams()
    assert sorted(map(tuple, back.stats.collect())) == sorted(map(tuple, ix.in_memory(docs).stats.collect()))


def test_manager(spark, docs, tmp_path):
    m = ix.IndexManager(spark, most=1)
    for k in ("a", "b", "a"):
        index = m.of(docs, f"{tmp_path}/{k}")
        assert len(m) == 1 and index.docs.count() == docs.filter(F.length("text") > 0).select("id").join(index.docs, index.docs.doc_id == docs.id).count()
    m.close()
    assert len(m) == 0


def test_ranges_of_equal_weight(spark, sf):
    """Ranges by formula hold about as many postings each, for any window."""
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    for w in (1, 6, 20):
        post = ix.build_postings(docs, IndexParams(window_size=w), "doc_id")
        n = [r["count"] for r in post.select("fp").distinct().groupBy(ix.part_of("fp", w, 8).alias("part")).count().collect()]
        assert len(n) == 8 and max(n) < 1.5 * min(n)


def test_shuffle_breaks_chains(spark, docs):
    from passages.operators.perturb import shuffled

    index = ix.in_memory(docs)
    q = docs.filter(F.length("text") > 4000).select(F.col("id").alias("query_id"), "text")
    score = lambda text, f: f(query_fingerprints(q.select("query_id", text.alias("text")), index.params), index).filter("query_id = doc_id").agg(F.avg("raw_score")).first()[0]
    plain, mixed = F.col("text"), shuffled(F.col("text"), "word_blocks", 20)
    assert score(mixed, sc.score_shared) > 0.7 * score(plain, sc.score_shared)
    assert score(mixed, sc.score_chains) < 0.3 * score(plain, sc.score_chains)


def test_intervals(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 9, 12), (1, 10, 11), (2, 0, 1)], "k int, start int, end int")
    assert sorted(map(tuple, hl.merge_intervals(df, ["k"]).collect())) == [(1, 0, 8), (1, 9, 12), (2, 0, 1)]


def test_metadata_functions(spark):
    texts = [("x\n# A  title\nmore\n\nbody",), ("none",), ("## Abstract\n\none\ntwo\n\nthree",), (None,), ("#\tB\r\n#c\n# abstract",)]
    got = spark.createDataFrame(texts, "t string").select(md.heading("t").alias("h"), md.abstract("t").alias("a")).collect()
    assert [tuple(r) for r in got] == [("A title more", None), (None, None), (None, "one two"), (None, None), ("B", None)]
    df = spark.createDataFrame([("http://WWW.Ex.org:80/a", "2020-01-02T03:04:05Z", "A b (c)"), ("::bad", None, None)], "u string, ts string, t string")
    a, b = df.select(md.host("u").alias("h"), md.wayback_url("u", "ts").alias("w"), md.wiki_url("t").alias("t")).collect()
    assert a["h"] == "ex.org" and a["w"] == "https://web.archive.org/web/20200102030405/http://WWW.Ex.org:80/a" and a["t"].endswith("/A_b_(c)")
    assert b["h"] == "" and b["w"] is None and b["t"] is None
    assert md.title_search(df.selectExpr("t AS title"), "a").count() == 0


def test_markdown_lines_once(spark):
    """A text is cut into lines once for its heading and once for its abstract."""
    df = spark.createDataFrame([("# A\n\n## Abstract\n\nx  y\nz\n#",)], "t string").select(md.heading("t").alias("h"), md.abstract("t").alias("a"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
    assert tuple(df.first()) == ("A", "x y z")


def test_parts_grow_with_files(spark, docs, tmp_path, monkeypatch):
    """Larger inputs are sorted in more tasks, whatever the session's number of partitions, and no task keeps a table of fingerprints."""
    docs.write.parquet(f"{tmp_path}/d")
    monkeypatch.setattr(ix, "PART_BYTES", 20_000)
    read = spark.read.parquet(f"{tmp_path}/d")
    placed = ix.placed(ix.build_postings(read), IndexParams())
    assert placed.rdd.getNumPartitions() > 4 and rows(placed) == rows(ix.build_postings(docs))
    assert ix.parts_for(spark.createDataFrame([(1,)], "x int")) == 4
    assert "HashAggregate" not in ix.fingerprint_stats(placed)._jdf.queryExecution().executedPlan().toString()


def test_stats_across_batches(spark):
    """Counts go on where a batch ends within a fingerprint or a document, null ids being one document."""
    own = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    data = [(f, d, p) for f in range(6) for d in (None, *range(f)) for p in range(1 + f % 3)]
    try:
        for size in (1, 2, 3, 7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = ix.fingerprint_stats(spark.createDataFrame(data, "fp long, doc_id long, pos int")).collect()
            assert sorted(map(tuple, got)) == [(f, f + 1, (f + 1) * (1 + f % 3)) for f in range(6)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", own)
