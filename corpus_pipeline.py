"""Documents for training: stages in a row, each an operator of quarry.llm over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of documents; the last
adds what the mix takes of each. Null and empty texts get the classifier's score for them, and go or stay with it; rows
without id whose text no row with an id resembles stay; repeated rows are copies, of which those with the least id stay;
empty tables pass through; further columns come back as they were, whatever their names, but for those the mix adds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, mixing, ngram_join, quality_classifier, secret_scan
from quarry.llm.common import own_columns, read, remainder, shared_folder

#: Documents go when the classifier is this sure that they are poor.
LEAST_QUALITY = 0.5


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    return own_columns(docs, ("score",), lambda d: quality_classifier.scored(d, model).where(F.col("score") >= LEAST_QUALITY))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(own_columns(docs, ("blob", "spans"), lambda d: secret_scan.redacted(secret_scan.scanned(d))))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs).where("times > 0")


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secrets), ("mixing", mix)]

#: A trained classifier, sets with links and an automaton: SQL doesn't express these; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
