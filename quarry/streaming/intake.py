"""The queue's poller as a stream: files to queue rows, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.queue import intake, validate_uploads
from quarry.sources.shared import stored

FILES = "batch_id string, name string, size_bytes bigint, checksum string, file_ordinal bigint"


KNOWN = "id string, checksum string, status string, prefix string, batch bigint"
#: Hexadecimal digits of a checksum that name its folder: 256 folders. More of them for a longer queue, as a batch reads
#: the folders of its checksums.
DIGITS = 2


def known_rows(spark: SparkSession, queue_path: str, prefixes: list[str], batch_id: int) -> DataFrame:
    """What the queue knows of checksums with these beginnings, from other batches: no other folder is listed or read."""
    try:
        queue = spark.read.schema(KNOWN).option("basePath", queue_path).parquet(f"{queue_path}/prefix={{{','.join(prefixes)}}}")
    except AnalysisException as e:  # none of the folders is there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], KNOWN)
    return queue.where(F.col("batch") != batch_id)


def stream_intake(spark: SparkSession, source: str, queue_path: str, checkpoint: str, once: bool = True, digits: int = DIGITS) -> StreamingQuery:
    """Reads file rows (JSON lines, FILES) as they arrive below source and adds queue rows below queue_path.

    The queue table is the truth about known checksums, so no state grows in the stream. Its rows lie in folders by the
    first digits of their checksum and then by batch: a micro-batch reads the folders of its own checksums, whatever the
    queue has grown to, and overwrites its own (folder, batch) places without reading them, so a batch that is run again
    after a failure gives the same rows in the same places."""

    def add(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        head = F.regexp_replace(F.lower(F.substring(F.coalesce("checksum", F.lit("")), 1, digits)), "[^0-9a-z]", F.lit("_"))
        files = stored(validate_uploads(batch).withColumn("prefix", F.concat(F.lit("p"), head)), "stream-batch")
        prefixes = [r.prefix for r in files.select("prefix").distinct().collect()]  # at most 16 to the power of digits
        rows = intake(files, known_rows(s, queue_path, prefixes, batch_id), F.current_timestamp()).withColumn("batch", F.lit(batch_id).cast("bigint"))
        rows.repartition("prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix", "batch").parquet(queue_path)

    stream = spark.readStream.schema(FILES).json(source)
    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
