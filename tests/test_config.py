import json

import pytest

from passages import config
from passages.operators import index as ix
from passages.params import WEB


def test_config(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(5)
    ix.write_index(ix.build_postings(docs, id_col="doc_id"), f"{tmp_path}/idx/a", ix.IndexParams())
    (tmp_path / "s.txt").write_text("a sample")
    values = {"root": "idx", "max_chars": 9, "score": {"top_k": 3}, "corpora": [{"id": "a", "name": "A", "index": "a", "search_kind": "url", "samples": [{"label": "s", "file": "s.txt"}]}, {"id": "b", "name": "B", "index": "b"}]}
    (tmp_path / "c.json").write_text(json.dumps(values))
    c = config.load(environ={config.CONFIG_VARIABLE: f"{tmp_path}/c.json"})
    assert [x.id for x in c.enabled(spark)] == ["a"] and c.corpus(spark, "a").samples[0].text == "a sample"
    with pytest.raises(KeyError):
        c.corpus(spark, "b")
    shown = c.public(spark)
    assert str(tmp_path) not in json.dumps(shown) and shown["parameters"]["min_cluster_size"] == {"default": 5, "least": 1, "most": 50}
    assert c.score.top_k == 3 and c.score.offset_threshold == WEB.offset_threshold
    assert config.load(f"{tmp_path}/c.json", {config.ROOT_VARIABLE: "/else"}).enabled(spark) == []
    assert config.load(environ={}).corpora == ()
    for bad in ({"x": 1}, {"corpora": [{"id": "a", "name": "A", "index": "a", "search_kind": "z"}]}, {"corpora": [values["corpora"][1]] * 2}):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            config.load(f"{tmp_path}/bad.json", {})
