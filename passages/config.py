"""Settings of a service over several corpora: what is offered, with which thresholds, and where the indexes lie."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import SparkSession

from passages.operators.highlight import MODES
from passages.operators.scoring import DETECTORS
from passages.params import BOUNDS, METHODS, WEB, ScoreParams

CONFIG_VARIABLE, ROOT_VARIABLE = "PASSAGES_CONFIG", "PASSAGES_INDEX_ROOT"


@dataclass(frozen=True)
class Sample:
    """A text offered to try."""

    label: str
    text: str


@dataclass(frozen=True)
class Corpus:
    """An indexed corpus: its index under the root, where its documents' metadata is, how a document is linked and searched."""

    id: str
    name: str
    index: str
    doc_meta: str | None = None
    doc_url: str | None = None
    search_kind: str | None = None
    samples: tuple[Sample, ...] = ()

    def __post_init__(self):
        if self.search_kind not in (None, "title", "url"):
            raise ValueError(f"no search of kind {self.search_kind!r}")


@dataclass(frozen=True)
class Config:
    root: str = "."
    max_chars: int = 50_000
    max_indexes: int = 1
    score: ScoreParams = WEB
    corpora: tuple[Corpus, ...] = field(default_factory=tuple)

    def path(self, corpus: Corpus) -> str:
        return corpus.index if ":" in corpus.index or corpus.index.startswith("/") else f"{self.root.rstrip('/')}/{corpus.index}"

    def enabled(self, spark: SparkSession) -> list[Corpus]:
        """The corpora whose indexes are there."""

        def there(path: str) -> bool:
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
            return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

        return [c for c in self.corpora if there(self.path(c))]

    def corpus(self, spark: SparkSession, ident: str) -> Corpus:
        """An enabled corpus by its id."""
        for c in self.enabled(spark):
            if c.id == ident:
                return c
        raise KeyError(f"no corpus {ident!r}")

    def public(self, spark: SparkSession) -> dict:
        """What a browser may see: no paths; thresholds with their bounds."""
        return {
            "max_chars": self.max_chars,
            "detectors": sorted(DETECTORS),
            "methods": list(METHODS),
            "highlight_modes": list(MODES),
            "parameters": {k: {"default": getattr(self.score, k), "least": a, "most": b} for k, (a, b) in BOUNDS.items()},
            "corpora": [{"id": c.id, "name": c.name, "search_kind": c.search_kind, "samples": [asdict(s) for s in c.samples]} for c in self.enabled(spark)],
        }


def _made(kind, values: dict):
    known = {f.name for f in fields(kind)}
    if extra := set(values) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
    return kind(**values)


def load(path: str | None = None, environ=os.environ) -> Config:
    """Settings from a JSON file (named by PASSAGES_CONFIG if none is given; the defaults without), with the root from PASSAGES_INDEX_ROOT if that is set.
    Samples may be given as ``file``, relative to the settings' folder."""
    path = path or environ.get(CONFIG_VARIABLE)
    values, base = {}, "."
    if path:
        base = os.path.dirname(os.path.abspath(path))
        with open(path, encoding="utf-8") as f:
            values = json.load(f)

    def sample(s: dict) -> Sample:
        if "file" in s:
            with open(os.path.join(base, s["file"]), encoding="utf-8") as f:
                return Sample(s["label"], f.read())
        return _made(Sample, s)

    corpora = tuple(_made(Corpus, {**c, "samples": tuple(map(sample, c.get("samples", ())))}) for c in values.get("corpora", ()))
    if len({c.id for c in corpora}) < len(corpora):
        raise ValueError("two corpora of one id")
    score = _made(ScoreParams, {**asdict(WEB), **values.get("score", {})})
    root = environ.get(ROOT_VARIABLE) or os.path.join(base, values.get("root", "."))
    return _made(Config, {**values, "root": root, "score": score, "corpora": corpora})
