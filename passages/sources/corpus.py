"""Reading, normalising and cleaning corpora; copying them out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from passages.functions.unicode_classes import SPACES

TEXT_NAMES = ("text", "content", "document", "report")
ID_NAMES = ("id", "doc_id", "document_id", "report_id", "text_id", "title")
NOISE = ("seg_langs", "web-register", "doc_scores")
STOP_WORDS = ("sex", "porn")
SUFFIXES = (".jsonl", ".jsonl.gz", ".jsonl.zst", ".json", ".json.gz")


def read_corpus(spark: SparkSession, path: str, schema: T.StructType | str | None = None, malformed: str = "DROPMALFORMED") -> DataFrame:
    """JSON lines (plain, gzip, zstandard) or Parquet by suffix; a folder is read as Parquet. Give a schema for large JSON: inference reads it all."""
    name = path.lower().rstrip("/")
    if name.endswith(SUFFIXES):
        reader = spark.read.option("mode", malformed)
        return (reader.schema(schema) if schema is not None else reader).json(path)
    if name.endswith(".parquet") or "." not in name.rsplit("/", 1)[-1]:
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file format: {path}")


def corrupt_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row: lines that aren't JSON of the schema; blank ones don't count."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    row = F.from_json("value", F.lit(f"{schema}, _corrupt_record string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select(row["_corrupt_record"].alias("c")).filter("c IS NOT NULL").agg(F.count("*").alias("corrupt"))


def normalise(df: DataFrame, text_field: str | None = None, id_field: str | None = None) -> DataFrame:
    """The text as ``text`` and the id as string ``id`` (first of the known names, decided once from the schema; a random UUID without any), noise columns dropped."""
    for name in (text_field, id_field):
        if name is not None and name not in df.columns:
            raise ValueError(f"no column {name!r}")
    text = text_field or next((c for c in TEXT_NAMES if c in df.columns), None)
    if text is None:
        raise ValueError(f"no text column among {df.columns}")
    ident = id_field or next((c for c in ID_NAMES if c in df.columns), None)
    rest = [c for c in df.columns if c not in (*NOISE, text, ident, "text", "id")]
    first = F.col(f"`{ident}`").cast("string") if ident else F.expr("uuid()")
    return df.select(first.alias("id"), F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`") for c in rest])


def clean(df: DataFrame, min_length: int = 2000, max_length: int = 100_000, text_col: str = "text") -> DataFrame:
    """Texts of min_length to max_length characters without a stop word among their words."""
    words = F.split(F.col(text_col), SPACES)
    return df.filter(F.length(text_col).between(min_length, max_length)).filter(~F.arrays_overlap(words, F.array(*map(F.lit, STOP_WORDS))))


def thin(df: DataFrame, skip_prob: float = 0.0, seed: int = 0) -> DataFrame:
    """A Bernoulli sample."""
    return df.sample(fraction=1 - skip_prob, seed=seed) if skip_prob else df


def stream(spark: SparkSession, path: str, min_length: int = 2000, skip_prob: float = 0.0, max_length: int = 100_000, max_nb: int | None = None, schema=None, seed: int = 0, unique: bool = False) -> DataFrame:
    """Read, thin, normalise, clean and limit, in this order; which rows a limit keeps isn't defined. With ``unique``, a repeated id is an error (found from the ids alone)."""
    df = normalise(thin(read_corpus(spark, path, schema), skip_prob, seed))
    if unique and (again := df.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").take(1)):
        raise ValueError(f"repeated document id: {again[0][0]}")
    df = clean(df, min_length, max_length)
    return df.limit(max_nb) if max_nb is not None else df


def copy_to(df: DataFrame, path: str, cutoff: int | None = None) -> None:
    """JSON lines; the output's compression follows the suffix."""
    out = df.limit(cutoff) if cutoff is not None else df
    out.write.mode("overwrite").option("compression", "gzip" if path.endswith(".gz") else "none").json(path)


def stream_to_file(spark: SparkSession, source: str, target: str, skip_prob: float = 0.0, min_length: int = 2000, max_length: int = 1_000_000, cutoff: int | None = None, schema=None) -> None:
    copy_to(stream(spark, source, min_length, skip_prob, max_length, None, schema), target, cutoff)


def sample_document(df: DataFrame, min_length: int, max_length: int, seed: int = 0, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """One document of a length within bounds, drawn by seeded hash; ties by id."""
    return df.filter(F.length(text_col).between(min_length, max_length)).orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(1)


def write_sidecar(df: DataFrame, path: str) -> None:
    """Gzipped JSON lines of a metadata table."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def read_sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A metadata table; empty where the path is missing."""
    try:
        df = spark.read.schema(schema).json(path)
        df.take(1)
        return df
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise
