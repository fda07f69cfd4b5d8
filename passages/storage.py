"""Tables that queries keep: in the folder that all executors share. The size of batches of texts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 2 << 20
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset a folder of our own serves if driver and executors are one process; on a cluster that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    sc = spark.sparkContext
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="passages-")
    return _own[sc.applicationId]


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, for a step over Arrow batches: a batch is bounded by bytes as well as by rows, so that rows of long texts make small batches.
    A session's own bound stays where it is lower."""
    conf = df.sparkSession.conf
    m = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", conf.get("spark.sql.execution.arrow.maxBytesPerBatch").strip().lower())
    size = int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m[2]] if m else 0
    if not 0 < size <= BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df
