"""Queries of what the library stores and asks again: files, indices, buckets. Each writes to the shared folder what it then
reads, all of it made from the given tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import queries as base
from quarry.operators import postings, vector_index
from quarry.sources import tables
from quarry.sources.files import key_in, write_files
from quarry.sources.shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def top_keyword_indexed(s: SparkSession, d: str) -> DataFrame:
    """Pages are appended to an index in two halves; then the questions are asked."""
    path, pages = shared_folder(s, "postings"), base.corpus(s, d)
    for half in (0, 1):
        postings.append_postings(pages.where(F.pmod(F.xxhash64("ordinal"), F.lit(2)) == half), path)
    found = postings.top_keyword_indexed(base.questions(s, d), path, lists=base.LISTS)
    return found.select("question_id", "document_id", "rank", "score")


def _vector_index(s: SparkSession, d: str) -> tuple[DataFrame, str]:
    path, e = shared_folder(s, "vectors"), base.read(s, d, "embeddings")
    dim = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    rows = e.select(F.col("vec_id").alias("ordinal"), F.col("vec_id").cast("string").alias("document_id"), "embedding")
    vector_index.write_index(rows, path, dim)
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "embedding"), path


def top_semantic_indexed(s: SparkSession, d: str) -> DataFrame:
    asked, path = _vector_index(s, d)
    found = vector_index.top_semantic_indexed(asked, path, 0.1, 5)
    return found.select("question_id", "document_id", "rank", F.round("similarity", 3).alias("similarity"))


def skipped_clusters(s: SparkSession, d: str) -> DataFrame:
    asked, path = _vector_index(s, d)
    return vector_index.skipped_clusters(asked, path, 0.1, 5)


#: Ways to write a text file, by what reads it back: the writer's name of an encoding, and what is put in front.
ENCODINGS = (("UTF-8", ""), ("UTF-8", "\ufeff"), ("UTF-16", ""), ("ISO-8859-1", ""))


def _page_files(s: SparkSession, d: str) -> str:
    """Pages, each on one line, as files in one of four encodings."""
    path = shared_folder(s, "page-files")
    pages = base.read(s, d, "pages").select("page_id", F.regexp_replace("html", "[\r\n]+", F.lit(" ")).alias("text"))
    for k, (encoding, mark) in enumerate(ENCODINGS):
        write_files(pages.where(F.pmod("page_id", F.lit(4)) == k).withColumn("text", F.concat(F.lit(mark), "text")), path, "page_id", encoding, "htm")
    return path


def read_html(s: SparkSession, d: str) -> DataFrame:
    pages = tables.read_html(s, _page_files(s, d))
    return pages.select(key_in("path").alias("page_id"), F.sha2(F.regexp_replace("html", "\n$", F.lit("")), 256).alias("sha"))


def list_input_files(s: SparkSession, d: str) -> DataFrame:
    files = tables.list_input_files(s, _page_files(s, d))
    return files.select(key_in("path").alias("page_id"), "extension", "length")


def list_documents(s: SparkSession, d: str) -> DataFrame:
    """Benchmark items as files, a third of each of three kinds, of which two are documents."""
    path = shared_folder(s, "item-files")
    items = base.read(s, d, "benchmark").select("item_id", F.col("item_id").cast("string").alias("text"))
    numbered = tables.with_ordinal(items, "item_id").withColumnRenamed("ordinal", "item_no_id")
    for k, extension in enumerate(("pdf", "doc", "txt")):
        rows = numbered.where(F.col("item_no_id") % 3 == k).select(F.col("item_no_id").alias("row_id"), "text")
        write_files(rows, path, "row_id", "UTF-8", extension)
    files = tables.list_documents(s, path)
    return files.select(key_in("path").alias("row_id"), "extension", "length")


def read_extracted(s: SparkSession, d: str) -> DataFrame:
    """Documents as extracted files, one each; every tenth is cut in its midst and can't be read."""
    path, x = shared_folder(s, "extracted-files"), base.extracted(s, d)
    body = F.to_json(F.struct("source_file", "source_url", "notification_title", "notification_index", "file_format", "total_pages", "pages"))
    whole = F.when(F.col("file_ordinal") % 10 == 3, F.substring(body, 1, 30)).otherwise(body)
    rows = x.select(F.format_string("%012d", "file_ordinal").alias("doc_id"), whole.alias("text"))
    write_files(rows, path, "doc_id", "UTF-8", "jsn")
    got = tables.read_extracted(s, path, "*.jsn")
    page = F.col("pages")[0]["raw_text"]
    return got.select("file_ordinal", "source_file", "notification_title", F.size("pages").alias("n_pages"), F.sha2(page, 256).alias("sha"))


def read_notices(s: SparkSession, d: str) -> DataFrame:
    """Documents as notices in JSON arrays, one array a task's file; every tenth element isn't an object."""
    path, n = shared_folder(s, "notice-files"), base.notices(s, d)
    item = F.when(F.col("ordinal") % 10 == 3, F.to_json(F.array(F.col("ordinal")))).otherwise(F.to_json(F.struct("title", "date", "detail_url", "attachments", "content", "document_number")))
    n.select(item.alias("value")).mapInArrow(_arrays, "value string").write.text(path)
    got = tables.read_notices(s, path)
    return got.select("title", "date", "detail_url", F.size("attachments").alias("n_attachments"), "document_number", "error")


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements of a task as the lines of one array."""
    written = False
    for b in batches:
        texts = b.column("value").to_pylist()
        lines = [("," if written or k else "[") + x for k, x in enumerate(texts)]
        written |= bool(texts)
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["]" if written else "[]"])], names=["value"])


def queries() -> dict[str, Query]:
    return {
        "top_keyword_indexed": top_keyword_indexed,
        "top_semantic_indexed": top_semantic_indexed,
        "skipped_clusters": skipped_clusters,
        "read_html": read_html,
        "list_input_files": list_input_files,
        "list_documents": list_documents,
        "read_extracted": read_extracted,
        "read_notices": read_notices,
    }


def oracle_sql() -> dict[str, str]:
    sql = base.own_sql()
    line = "regexp_replace(html, '[\\r\\n]+', ' ', 'g')"
    said = f"CASE page_id % 4 WHEN 2 THEN 2 * length({line}) + 4 WHEN 3 THEN length({line}) + 1 WHEN 1 THEN strlen({line}) + 4 ELSE strlen({line}) + 1 END"
    notice = "title, coalesce(strftime(CAST(issue_date AS DATE), '%d/%m/%Y'), '') AS date, 'http://docs.example/d' || id || '.html' AS detail_url, CAST(has_attachment AS INTEGER) AS n_attachments, document_number"
    page = "'Số: ' || coalesce(document_number, '7/TB') || chr(10) || 'Hạn cuối đến ngày ' || strftime(CAST(coalesce(issue_date, '2024-03-01') AS DATE) + 90, '%d/%m/%Y') || chr(10) || content"
    return {
        "top_semantic_indexed": sql["top_semantic"],
        "read_html": f"SELECT page_id, sha256({line}) AS sha FROM pages",
        "list_input_files": f"SELECT page_id, 'htm' AS extension, CAST({said} AS BIGINT) AS length FROM pages",
        "list_documents": """
WITH n AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS row_id FROM benchmark)
SELECT row_id, CASE row_id % 3 WHEN 0 THEN 'pdf' ELSE 'doc' END AS extension, CAST(length(CAST(item_id AS VARCHAR)) + 1 AS BIGINT) AS length FROM n WHERE row_id % 3 < 2""",
        "read_extracted": base.CAT + f"""
SELECT row_number() OVER (ORDER BY ordinal) - 1 AS file_ordinal, CASE WHEN ordinal % 8 = 4 THEN 'none' ELSE 'a' END || id || '.pdf' AS source_file,
  CASE WHEN ordinal % 3 = 2 THEN 'other ' || title ELSE title END AS notification_title, 1 AS n_pages, sha256({page}) AS sha
FROM cat WHERE ordinal % 10 <> 3""",
        "read_notices": base.CAT + f"""
SELECT {notice}, CAST(NULL AS VARCHAR) AS error FROM cat WHERE ordinal % 10 <> 3
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'not an object' FROM cat WHERE ordinal % 10 = 3""",
    }
