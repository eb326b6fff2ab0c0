"""Tables in hash buckets, changed in place: the rows of a key lie in one folder, so a change reads and rewrites the folders
of its keys and leaves the files of all others alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import stored


@dataclass(frozen=True)
class Buckets:
    """A table below path in n folders by the hash of a key. schema: of its rows, without the bucket."""

    path: str
    key: str
    schema: str
    n: int = 256

    def bucket(self, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64((F.col(self.key) if key is None else key).cast("string")), F.lit(self.n)).cast("int")

    def write(self, rows: DataFrame, mode: str = "overwrite") -> None:
        """All rows as the whole table (mode overwrite), or as those of the buckets that they are in (mode dynamic)."""
        placed = rows.withColumn("bucket", self.bucket())
        # a bucket of a hot key is written by several tasks
        dealt = placed.withColumn("_deal", F.spark_partition_id() % 4).repartition("bucket", "_deal").drop("_deal")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "static" if mode == "overwrite" else "dynamic").partitionBy("bucket").parquet(self.path)

    def read(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        rows = spark.read.schema(f"{self.schema}, bucket int").parquet(self.path)
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return rows.drop("bucket")

    def of(self, keys: DataFrame) -> list[int]:
        """The buckets that the keys of some rows are in: at most n numbers."""
        return sorted(r.b for r in keys.select(self.bucket().alias("b")).distinct().collect())

    def change(self, keys: DataFrame, changed: Callable[[DataFrame], DataFrame]) -> None:
        """Replaces the buckets of some keys by what changed() makes of their rows, which must keep a row in each. The new
        rows are stored before any file is replaced, so a change that fails on the way leaves the table as it was; one
        that is run again gives the same table if changed() does so for rows that it changed before."""
        spark = keys.sparkSession
        buckets = self.of(keys)
        if buckets:
            new = changed(self.read(spark, buckets))
            self.write(stored(new.select(*self.read(spark).columns), "changed-buckets"), "dynamic")
