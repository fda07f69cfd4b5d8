"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 2 << 20


def checkpoint(df: DataFrame) -> DataFrame:
    """An eager checkpoint under ``spark.checkpoint.dir`` (see ``ready``)."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def ready(spark: SparkSession) -> None:
    """Set the checkpoint folder. Without ``spark.checkpoint.dir`` a folder of our own serves where driver and executors are one
    process; on a cluster, whose machines don't share it, that is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="passages-"))


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, for a step over Arrow batches: a batch is bounded by bytes as well as by rows, so that rows of long texts make small batches.
    A session's own bound stays where it is lower."""
    conf = df.sparkSession.conf
    size = _bytes(conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
    if size <= 0 or size > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def _bytes(size: str) -> int:
    m = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", size.strip().lower())
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m[2]] if m else -1


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the same folder: columnar and compressed, for what is large or read in parts. Like a checkpoint it
    is removed with the folder."""
    ready(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
