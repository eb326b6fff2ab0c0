"""Notices and extracted files to catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions.facts import category, document_number, issue_date, issuing_unit, normalize_date, validity_status
from quarry.functions.ids import document_id
from quarry.functions.text import collapse_space, strip, txt
from quarry.operators.match import match_extracted
from quarry.operators.quality import quality_checks, quality_score

PAGES = "array<struct<page_number:int,raw_text:string,cleaned_text:string>>"


def assemble_content(pages: Column, publish: bool = False) -> Column:
    """Page texts in page order, a blank line between. publish: raw text where there is no clean one, empty pages too."""
    ordered = F.array_sort(F.coalesce(pages, F.array().cast(PAGES)), lambda a, b: F.coalesce(a["page_number"], F.lit(0)) - F.coalesce(b["page_number"], F.lit(0)))
    if publish:
        return F.array_join(F.transform(ordered, lambda p: F.coalesce(F.nullif(p["cleaned_text"], F.lit("")), p["raw_text"], F.lit(""))), "\n\n")
    texts = F.transform(ordered, lambda p: F.coalesce(p["cleaned_text"], F.lit("")))
    return F.array_join(F.filter(texts, lambda t: strip(t) != ""), "\n\n")


def normalize_documents(notices: DataFrame, extracted: DataFrame, as_of: str, rules: config.CategoryRules = config.CATEGORIES, units: tuple[tuple[str, str], ...] = (), prefix: str = "doc_", parity: bool = True) -> DataFrame:
    """One catalogue row per notice, with the text and facts of its extracted file if it has one, and norm_warnings."""
    e = extracted.select("file_ordinal", "extracted_file", F.col("source_file").alias("e_file"), F.col("source_url").alias("e_url"), F.col("file_format").alias("e_format"), F.col("total_pages").alias("e_pages_n"), F.col("pages").alias("e_pages"), F.col("ocr_quality").alias("e_quality"))
    m = match_extracted(notices, extracted).join(e, "file_ordinal", "left")
    pages = F.transform(F.coalesce("e_pages", F.array().cast("array<struct<page_number:int,raw_text:string,cleaned_text:string,extraction_status:string>>")), lambda p: F.struct(p["page_number"].alias("page_number"), p["raw_text"].alias("raw_text"), p["cleaned_text"].alias("cleaned_text")))
    d = m.withColumn("pages", pages).withColumn("content", F.coalesce(F.nullif(assemble_content(F.col("pages")), F.lit("")), txt("content")))
    first = F.coalesce(F.get(F.col("pages"), 0)["cleaned_text"], F.lit(""))
    d = d.withColumns(
        {
            "title": collapse_space(F.col("title")),
            "source_url": F.coalesce(F.nullif("e_url", F.lit("")), F.get(F.coalesce("attachments", F.array().cast("array<string>")), 0), F.col("detail_url")),
            "source_file": F.col("e_file"),
            "file_format": F.col("e_format"),
            "total_pages": F.coalesce("e_pages_n", F.size("pages")),
            "document_number": F.coalesce(document_number(first), F.nullif("document_number", F.lit(""))),
            "raw_issue_date": F.coalesce(F.nullif("published_date", F.lit("")), F.col("date")),
            "issuing_unit": issuing_unit(first, units) if units else F.lit(None).cast("string"),
            "_kind": category(F.col("title"), F.col("content"), rules),
        }
    )
    d = d.withColumns(
        {
            "id": document_id(F.col("source_url"), F.col("source_file"), F.col("ordinal"), prefix),
            "issue_date": normalize_date(F.col("raw_issue_date")),
            "category": F.coalesce(F.col("_kind.category"), F.nullif("category", F.lit(""))),
            "subcategory": F.col("_kind.subcategory"),
            "deadline": F.lit(None).cast("string"),
            "replaced_by": F.lit(None).cast("string"),
        }
    )
    d = validity_status(d, as_of, parity)
    lacking = F.array_compact(F.array(F.when(F.col("file_ordinal").isNull(), "no extracted file"), F.when(F.col("document_number").isNull(), "no document number"), F.when(txt("content") == "", "no content")))
    return d.withColumns(
        {
            "effective_status": F.col("suggested_status"),
            "is_verified": F.lit(False),
            "metadata": F.struct(F.col("crawled_at").cast("string").alias("crawled_at"), "crawl_status", "content_source", "raw_issue_date", F.col("e_quality").alias("ocr_quality")),
            "provenance": F.struct(F.col("ordinal").cast("int").alias("notification_index"), F.col("title").alias("notification_title"), F.col("detail_url").alias("detail_file"), F.col("source_file").alias("document_file"), "extracted_file"),
            "norm_warnings": lacking,
        }
    ).drop("_kind", "e_file", "e_url", "e_format", "e_pages_n", "e_pages", "e_quality", "raw_issue_date", "extracted_file", "facts")


def normalization_report(docs: DataFrame) -> DataFrame:
    """One row: documents, matched and unmatched, warnings, rows that lack a number or date."""
    return docs.agg(
        F.count("*").alias("n_documents"), F.count("file_ordinal").alias("matched"), F.count_if(F.col("file_ordinal").isNull()).alias("missing"),
        F.coalesce(F.sum(F.size("norm_warnings")), F.lit(0)).alias("n_warnings"), F.count_if(txt("document_number") == "").alias("no_number"), F.count_if(txt("issue_date") == "").alias("no_date"),
    )


def normalization_summary(docs: DataFrame) -> DataFrame:
    """The report's part by document: (ordinal, id, title, document_number, category, has_ocr, total_pages, content_chars,
    warnings)."""
    return docs.select("ordinal", "id", "title", "document_number", "category", F.col("file_ordinal").isNotNull().alias("has_ocr"), "total_pages", F.length(txt("content")).alias("content_chars"), F.col("norm_warnings").alias("warnings"))


def reapply_validity(docs: DataFrame, as_of: str, parity: bool = True) -> DataFrame:
    """The catalogue with suggested statuses decided anew; verified rows stay as they are."""
    keep = old = docs.columns
    new = ("suggested_status", "certainty", "status_evidence", "status_rationale", "effective_from", "effective_to", "deadline", "replaced_by")
    marked = docs.withColumns({f"_o_{c}": F.col(c) if c in old else F.lit(None).cast("string") for c in new})
    v = validity_status(marked, as_of, parity)
    done = F.coalesce("is_verified", F.lit(False))
    v = v.withColumns({c: F.when(done, F.col(f"_o_{c}")).otherwise(F.col(c)) for c in new})
    if "effective_status" in old:
        v = v.withColumn("effective_status", F.when(done, F.col("effective_status")).otherwise(F.col("suggested_status")))
    return v.select(*keep, *[c for c in new if c not in keep])


def import_hints(pages: DataFrame, as_of: str, rules: config.CategoryRules = config.IMPORT_CATEGORIES, units: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """What an uploaded file's pages suggest. pages: (id, file_name, pages). Adds title (from the file name), number, date,
    unit, category, validity, and score and status with the import profile."""
    first = F.coalesce(F.get(F.col("pages"), 0)["cleaned_text"], F.get(F.col("pages"), 0)["raw_text"], F.lit(""))
    title = collapse_space(F.regexp_replace(F.regexp_replace(txt("file_name"), r"\.[^.]*$", F.lit("")), r"[_\-]+", F.lit(" ")))
    d = pages.withColumns(
        {
            "title": title, "content": assemble_content(F.col("pages"), publish=True), "document_number": document_number(first, "import"), "issue_date": issue_date(first),
            "issuing_unit": issuing_unit(first, units, 800) if units else F.lit(None).cast("string"), "_kind": category(title, first, rules), "deadline": F.lit(None).cast("string"), "replaced_by": F.lit(None).cast("string"),
        }
    )
    d = validity_status(d.withColumns({"category": F.col("_kind.category"), "subcategory": F.col("_kind.subcategory")}), as_of)
    d = d.withColumns({"total_pages": F.size("pages"), "source_url": F.lit("upload"), "source_file": F.col("file_name"), "effective_status": F.lit("unknown"), "provenance": F.struct(F.lit(0).alias("notification_index"), F.col("title").alias("notification_title"), F.lit("").alias("detail_file"), F.col("file_name").alias("document_file"), F.lit("").alias("extracted_file")), "ordinal": F.monotonically_increasing_id()})
    d = quality_checks(d.withColumn("_url", F.col("source_url")).withColumn("source_url", F.col("id")))
    return d.withColumn("quality", quality_score(F.size("issues"), F.size("warnings"), "import")).drop("_kind", "_url", "facts", "source_url", "source_file", "effective_status", "provenance", "ordinal")
