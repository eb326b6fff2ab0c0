"""Readers and writers: notices, extracted files, catalogues, HTML, listings, vectors, reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.schemas import CATALOGUE, EXTRACTED, NOTICE, NOTICE_FIELDS
from quarry.sources.files import bound_opens, dealt, files_below, reachable_folder, with_content
from quarry.sources.json_array import array_elements
from quarry.sources.shared import stored


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of notices with its order as ordinal, read by as many tasks as the file has blocks. Rows that aren't
    objects have error set and no fields; a file that isn't an array is one such row."""
    items, bad = array_elements(spark, path)
    parsed = items.withColumn("n", F.when(F.trim("item").startswith("{"), F.from_json("item", NOTICE)))
    error = F.when(F.col("n").isNull(), "not an object")
    rows = parsed.select(F.col("number").alias("ordinal"), *[F.col(f"n.{f}").alias(f) for f in NOTICE_FIELDS], error.alias("error"))
    return rows.unionByName(bad.select(F.lit(0).cast("long").alias("ordinal"), F.lit("not an array").alias("error")), allowMissingColumns=True)


def with_ordinal(df: DataFrame, *order: Column | str, name: str = "ordinal") -> DataFrame:
    """Numbers rows from 0 by an order, without bringing them to one task. Rows are sorted by range once and written with
    their partition and their place in it; the stored rows then start after the sum of the partitions before. A sort that
    was planned twice could cut its ranges elsewhere the second time, so nothing is numbered before it is stored. Rows of
    one key are numbered in any order, each once."""
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_i": place})
    rows = stored(sorted_, "ordinals")
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    # one row a partition
    start = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_at"))
    return rows.join(start, "_p").withColumn(name, F.col("_at") + F.col("_i")).drop("_p", "_i", "_at")


def read_extracted(spark: SparkSession, folder: str, names: str = "*.json") -> DataFrame:
    """Extracted files below a folder, ordered by path (ordinal); files that don't parse are skipped. Tasks list the folders
    and read the files twice: once for the names of those that parse, which are numbered, and once for the rows, whenever
    these are used. So neither does the driver hold a list of files, nor are texts written or sorted. A pattern instead of a
    folder, or a store that Arrow can't open, is left to Spark's reader, whose list of files the driver holds."""
    read = F.from_json(F.col("content").cast("string"), EXTRACTED, {"mode": "PERMISSIVE"})
    if at := reachable_folder(spark, folder):
        found = files_below(spark, at, names)
        # one look at what was read, where two conditions would parse it twice
        parses = F.exists(F.array(read), lambda e: e["source_file"].isNotNull() | e["pages"].isNotNull())
        whole = stored(with_content(dealt(found, found).select("path"), at).where(parses).select("path"), "extracted")
        files = with_content(dealt(with_ordinal(whole, "path", name="file_ordinal"), found), at)
        rows = files.select(F.concat(F.lit(at.address), "path").alias("extracted_file"), read.alias("e"), "file_ordinal")
        return rows.select("extracted_file", "e.*", "file_ordinal")
    bound_opens(spark)
    # as bytes: a reader of whole texts sets up more for each file
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(folder)
    rows = files.select(F.col("_metadata.file_path").alias("extracted_file"), read.alias("e"))
    rows = rows.where("e.source_file is not null or e.pages is not null").select("extracted_file", "e.*")
    return with_ordinal(stored(rows, "extracted"), "extracted_file", name="file_ordinal")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue with its schema; an empty one where there is no file yet."""
    try:
        reader = spark.read.schema(CATALOGUE)
        return reader.json(path, multiLine=True) if path.endswith(".json") else reader.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CATALOGUE)


def _single_byte(content: pd.Series) -> pd.Series:
    """Code pages that Spark's decode lacks: windows-1258, or ISO 8859-1 for bytes that it has no character for."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        try:
            return bytes(b).decode("cp1258")
        except UnicodeDecodeError:
            return bytes(b).decode("latin-1")

    return content.map(one)


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-16 by its mark, UTF-8 (a byte-order mark dropped) where valid, else a single-byte code page. Only
    what is left for that goes to Python."""
    text = content.cast("string")
    marked = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    plain = F.is_valid_utf8(text)
    other = F.pandas_udf(_single_byte, "string")(F.when(~marked & ~plain, content))
    return F.when(marked, F.decode(content, "UTF-16")).when(plain, F.regexp_replace(text, "^\uFEFF", F.lit(""))).otherwise(other)


def read_html(spark: SparkSession, folder: str) -> DataFrame:
    bound_opens(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{html,htm}").load(folder)
    return files.select("path", decoded(F.col("content")).alias("html"))


def list_files(spark: SparkSession, folder: str, extensions: tuple[str, ...]) -> DataFrame:
    """path, length, modified and extension of the files below a folder with one of the extensions, any case; contents
    aren't read."""
    bound_opens(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.withColumn("extension", ext).where(F.col("extension").isin(*extensions))


def list_documents(spark: SparkSession, folder: str) -> DataFrame:
    return list_files(spark, folder, ("pdf", "doc", "docx"))


def list_input_files(spark: SparkSession, folder: str) -> DataFrame:
    return list_files(spark, folder, ("html", "htm", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar"))


def write_catalogue(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """To a new path, or over an old one that the plan doesn't read."""
    getattr(df.write.mode("overwrite"), kind)(path)


def write_report(df: DataFrame, path: str) -> None:
    """A summary of few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("model").parquet(path)


def read_vectors(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """Chunk vectors; rows without a vector are left out. No index, or none of the model, is an empty table: no semantic
    side."""
    schema = "chunk_id string, document_id string, title string, document_number string, issue_date string, category string, page_number int, text string, embedding array<float>, model string"
    try:
        df = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    df = df.where(F.col("model") == model) if model else df
    return df.where(F.size("embedding") > 0)


def scan_table(spark: SparkSession, path: str, columns: Iterator[str] | tuple[str, ...] = (), where: str | None = None, jdbc: dict[str, str] | None = None) -> DataFrame:
    """A stored table (parquet, or a JDBC table named path), pruned to columns and filtered at the source."""
    df = spark.read.format("jdbc").options(dbtable=path, **jdbc).load() if jdbc else spark.read.parquet(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df
