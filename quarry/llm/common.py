"""What several operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import bound_batches  # noqa: F401

#: Words are runs of anything but the six ASCII white-space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column, null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order; an empty array for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path below the folder that the cluster names in spark.checkpoint.dir. Only where that is unset
    (a single machine, as in tests) a folder of this machine is used."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/quarry"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows as a table in the shared folder: it cuts the lineage and survives lost executors. Spark drops the
    shuffle files of finished steps when the driver collects its garbage, so that is asked for here."""
    spark = df.sparkSession
    path, schema = shared_folder(spark, what), df.schema
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def own_columns(docs: DataFrame, added: tuple[str, ...], op: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of docs from what op makes of docs, where op adds columns of its own: those of docs that have their
    names are set aside meanwhile, so that they come back untouched."""
    taken = {c.lower() for c in docs.columns} | {c.lower() for c in added}
    aside = {}
    for c in docs.columns:
        if c.lower() in {a.lower() for a in added}:
            aside[c] = next(n for i in range(len(taken) + 1) if (n := f"_own{i}_{c}").lower() not in taken)
            taken.add(aside[c].lower())
    return op(docs.withColumnsRenamed(aside)).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of an id as text, modulo a number; null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by
