"""Every query with SQL gives the SQL's rows."""

import pytest

from passages.plans import queries as Q


def same(spark_rows, duck_rows):
    a, b = spark_rows[sorted(spark_rows.columns)], duck_rows[sorted(duck_rows.columns)]
    assert list(a.columns) == list(b.columns)
    assert sorted(map(str, a.itertuples(index=False, name=None))) == sorted(map(str, b.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_against_sql(spark, sf, duck, name):
    same(Q.QUERIES[name](spark, sf).toPandas(), duck.sql(Q.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["shuffled_scores", "align_regions"])
def test_runs(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).count() >= 0


@pytest.mark.parametrize("name", ["chain_scores_self", "chain_scores_reversed"])
def test_all_documents_are_queries(spark, sf, name):
    """Every document with enough fingerprints meets itself, short ones and long ones too."""
    counts = Q.QUERIES["winnowed_index"](spark, sf).groupBy("doc_id").agg({"fp": "count"})
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    short = {r["doc_id"] for r in docs.filter("length(text) < 2000").join(counts.filter("`count(fp)` >= 40"), "doc_id").collect()}
    got = {r["query_id"] for r in Q.QUERIES[name](spark, sf).collect()}
    assert short and short <= got


def test_streamed_tables(spark, sf, tmp_path):
    """A table that is a folder of files is streamed as one that is a file."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    docs.repartition(3).write.parquet(f"{tmp_path}/folder/documents.parquet")
    (tmp_path / "file").mkdir()
    docs.toPandas().to_parquet(tmp_path / "file/documents.parquet")
    got = [sorted(map(tuple, Q.QUERIES["streamed_index"](spark, f"{tmp_path}/{k}").collect())) for k in ("folder", "file")]
    assert got[0] and got[0] == got[1] == sorted(map(tuple, Q.QUERIES["inverted_index_df"](spark, f"{tmp_path}/folder").collect()))


def test_goldens(spark, sf):
    if not sf.endswith("sf0.001"):
        pytest.skip("goldens are for sf0.001")
    assert Q.QUERIES["winnowed_index"](spark, sf).count() == 23_611
    got = {(r["query_id"], r["doc_id"], r["n_shared"]) for r in Q.QUERIES["candidates"](spark, sf).collect()}
    assert got == {(16, 64, 16), (39, 52, 13), (33, 188, 10)}


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() == 3
    assert set(E.oracle_sql()) <= set(E.queries())
