"""Tables in the folder that driver and executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch, so that what a Python worker holds at once doesn't depend on how long texts are.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit for Arrow batches to BATCH_BYTES, if it is higher."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path below the folder that the cluster names in spark.checkpoint.dir. Only where that is unset, on a single
    machine, a folder of this machine serves."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/quarry"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The same rows, written once and read from there."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
