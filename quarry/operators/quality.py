"""Quality of pages, documents and catalogue rows, and the reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions.text import page_score, quality_label, strip, text_marks, text_metrics, txt
from quarry.operators.catalog import flag_duplicates
from quarry.sources.shared import bound_batches


def score_pages(pages: DataFrame, patterns: tuple[tuple[str, str], ...] = config.LEGAL_PATTERNS) -> DataFrame:
    """Adds metrics and quality (score, label, warnings) to rows with raw_text and cleaned_text."""
    text = F.coalesce(F.nullif("cleaned_text", F.lit("")), txt("raw_text"))
    return pages.withColumn("metrics", text_metrics(text, patterns)).withColumn("quality", page_score(F.col("metrics"), text))


def document_text_quality(pages: DataFrame, key: str = "id") -> DataFrame:
    """One row per document from scored pages: mean score (half to even), share of empty pages, label, warnings. More than
    half empty caps the score at 45, fewer than 100 characters at 40. Only pages that are WARNING or POOR pass warnings
    on; a key with a null page_number only has no pages and gets 0, POOR."""
    has = F.col("page_number").isNotNull()
    ink = F.col("metrics.non_whitespace_chars")
    bad = has & F.col("quality.label").isin("WARNING", "POOR")
    per_page = F.when(bad & (F.size("quality.warnings") > 0), F.struct("page_number", F.col("quality.warnings").alias("w")))
    g = pages.groupBy(key).agg(
        F.count_if(has).alias("n_pages"), F.avg(F.when(has, F.col("quality.score"))).alias("_mean"), F.count_if(has & (ink == 0)).alias("_empty"),
        F.coalesce(F.sum(F.when(has, F.col("metrics.text_length"))), F.lit(0)).alias("text_length"), F.array_sort(F.collect_list(per_page)).alias("page_warnings"),
    )
    ratio = F.when(F.col("n_pages") > 0, F.col("_empty") / F.col("n_pages")).otherwise(1.0)
    score = F.coalesce(F.bround("_mean").cast("int"), F.lit(0))
    score = F.when(ratio > 0.5, F.least(score, F.lit(45))).otherwise(score)
    score = F.when(F.col("text_length") < 100, F.least(score, F.lit(40))).otherwise(score)
    score = F.when(F.col("n_pages") == 0, 0).otherwise(score)
    return g.select(key, "n_pages", "text_length", F.bround(ratio, 4).alias("empty_page_ratio"), score.alias("score"), quality_label(score).alias("label"), "page_warnings")


def text_quality_report(docs: DataFrame) -> DataFrame:
    """One row: documents, pages, characters and documents per label."""
    return docs.agg(
        F.count("*").alias("n_documents"), F.coalesce(F.sum("n_pages"), F.lit(0)).alias("n_pages"), F.coalesce(F.sum("text_length"), F.lit(0)).alias("n_chars"),
        *[F.count_if(F.col("label") == x).alias(x.lower()) for x in ("GOOD", "ACCEPTABLE", "WARNING", "POOR")],
    )


def page_status_rollup(pages: DataFrame, key: str = "id", least: int = 20, page_least: int = 0) -> DataFrame:
    """One row per document: empty without pages or text, needs_ocr with fewer than least characters in all (pages under
    page_least don't count), else ok."""
    n = F.length(strip(txt("cleaned_text")))
    g = pages.groupBy(key).agg(F.count("page_number").alias("n_pages"), F.coalesce(F.sum(F.when(n >= page_least, n)), F.lit(0)).alias("chars"))
    return g.withColumn("extraction_status", F.when(F.col("n_pages") == 0, "empty").when(F.col("chars") < least, "needs_ocr").otherwise("ok"))


def extraction_stats(files: DataFrame) -> DataFrame:
    s = txt("extraction_status")
    of = lambda test, name: F.count_if(test).alias(name)
    return files.agg(F.count("*").alias("total"), of(s == "ok", "ok"), of(s == "needs_ocr", "needs_ocr"), of(s == "empty", "empty"), of(s.startswith("ocr"), "ocr"), of(s.startswith("error:"), "errors"), F.coalesce(F.sum("total_pages"), F.lit(0)).alias("n_pages"))


def ocr_file_status(pages: DataFrame, key: str = "id") -> DataFrame:
    """One row per file: ocr if all its pages were read, ocr_failed if none, else ocr_partial."""
    g = pages.groupBy(key).agg(F.count("*").alias("n_pages"), F.count_if(F.col("extraction_status") == "ocr").alias("n_ok"))
    return g.withColumn("extraction_status", F.when(F.col("n_ok") == 0, "ocr_failed").when(F.col("n_ok") < F.col("n_pages"), "ocr_partial").otherwise("ocr"))


def ocr_stats(files: DataFrame) -> DataFrame:
    s = F.col("extraction_status")
    return files.agg(F.count("*").alias("total"), *[F.count_if(s == x).alias(x) for x in ("ocr", "ocr_partial", "ocr_failed")], F.coalesce(F.sum("n_pages"), F.lit(0)).alias("n_pages"), F.coalesce(F.sum("n_ok"), F.lit(0)).alias("n_pages_ok"))


CHECKS = ("title", "document_number", "issue_date", "source_url", "source_file", "content", "page_count", "ocr_text", "ocr_characters", "metadata_consistency", "title_content_relation", "duplicate", "provenance", "effective_status")


def quality_checks(docs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Adds checks (map of name to boolean), issues and warnings (arrays of text, in the order of the checks).
    Expects the catalogue's columns; duplicates are told from the first row by ordinal. files: (path) of the files that
    exist; without it that isn't checked."""
    d = flag_duplicates(docs)
    if files is not None:
        there = files.select(F.col("path").alias("_path")).distinct()
        d = d.join(there, F.col("source_file") == F.col("_path"), "left").withColumn("_there", F.col("_path").isNotNull()).drop("_path")
    else:
        d = d.withColumn("_there", F.lit(True))
    bound_batches(docs.sparkSession)
    # what several checks ask of a text is made once a row, as columns of their own
    d = d.withColumns({"_marks": text_marks(F.col("content")), "_words": F.transform(F.regexp_extract_all(txt("title"), F.lit(r"(?U)\b([\wđĐ]{4,})\b"), F.lit(1)), F.lower)})
    d = d.withColumn("_held", F.get(F.transform(F.array(F.lower(txt("content"))), lambda low: F.size(F.filter("_words", lambda w: F.contains(low, w)))), F.lit(0)))
    mark = lambda name: F.col(f"_marks.{name}")
    blank = lambda c: mark("inner") == 0 if c == "content" else strip(txt(c)) == ""
    date, content = strip(txt("issue_date")), txt("content")
    iso = date.rlike(r"^\d{4}-\d{2}-\d{2}$")
    pages = F.coalesce("pages", F.expr("cast(array() as array<struct<page_number:int,raw_text:string,cleaned_text:string>>)"))
    n_pages = F.size(pages)
    d = d.withColumn("_short", F.transform(F.filter(pages, lambda p: F.length(strip(F.coalesce(p["cleaned_text"], F.lit("")))) < 30), lambda p: F.struct(p["page_number"].alias("page_number"))))
    short, words, runs = F.col("_short"), F.col("_words"), mark("runs")
    ink = mark("ink")
    odd, plain = mark("suspicious") / F.nullif(ink, F.lit(0)), mark("letters") / F.nullif(ink, F.lit(0))
    related = F.col("_held") / F.nullif(F.size(words), F.lit(0))
    prov = F.col("provenance")
    missing = F.array_compact(F.array(*[F.when(prov[k].isNull(), F.lit(k)) for k in ("notification_index", "notification_title", "detail_file", "document_file", "extracted_file")]))
    has = (content != "") & (ink > 0)
    say = F.format_string
    # (check, whether it fails, is it an issue, text)
    rules: list[tuple[str, Column, bool, Column]] = [
        ("title", blank("title"), True, F.lit("title: missing")),
        ("document_number", blank("document_number"), False, F.lit("document_number: missing")),
        ("issue_date", date == "", False, F.lit("issue_date: missing")),
        ("issue_date", (date != "") & ~iso, True, say("issue_date: not YYYY-MM-DD: %s", date)),
        ("issue_date", iso & F.try_to_date(date).isNull(), True, say("issue_date: not on the calendar: %s", date)),
        ("source_url", blank("source_url"), True, F.lit("source_url: missing")),
        ("source_file", blank("source_file"), True, F.lit("source_file: missing")),
        ("source_file", ~blank("source_file") & ~F.col("_there"), True, say("source_file: no such file: %s", txt("source_file"))),
        ("content", blank("content"), True, F.lit("content: empty")),
        ("content", ~blank("content") & (mark("inner") < 100), False, say("content: only %d characters", mark("inner"))),
        ("page_count", F.coalesce("total_pages", F.lit(0)) != n_pages, True, say("page_count: %d told, %d there", F.coalesce("total_pages", F.lit(0)), n_pages)),
        ("ocr_characters", has & (runs > 0), False, say("ocr_characters: %d long runs of a character", runs)),
        ("ocr_characters", has & (odd > 0.05), False, F.lit("ocr_characters: many odd characters")),
        ("ocr_characters", has & (1 - plain > 0.35), False, F.lit("ocr_characters: few letters and digits")),
        ("metadata_consistency", (content != "") & iso & ~F.contains(content, F.substring(date, 1, 4)), False, say("metadata_consistency: year %s isn't in the text", F.substring(date, 1, 4))),
        ("title_content_relation", ~blank("title") & (content != "") & (F.size(words) > 0) & (related < 0.25), False, F.lit("title_content_relation: few words of the title are in the text")),
        ("duplicate", F.col("dup_id"), False, F.lit("duplicate: id")),
        ("duplicate", F.col("dup_url"), False, F.lit("duplicate: source_url")),
        ("duplicate", F.col("dup_file"), False, F.lit("duplicate: source_file")),
        ("provenance", prov.isNull(), False, F.lit("provenance: missing")),
        ("provenance", prov.isNotNull() & (F.size(missing) > 0), False, F.concat(F.lit("provenance: lacks "), F.array_join(missing, ", "))),
        ("effective_status", txt("effective_status") != "unknown", False, say("effective_status: %s", txt("effective_status"))),
    ]
    fails: dict[str, Column] = {"ocr_text": F.size(short) > 0}
    for name, test, _, _ in rules:
        fails[name] = fails[name] | test if name in fails else test
    checks = F.create_map(*[x for c in CHECKS for x in (F.lit(c), ~F.coalesce(fails[c], F.lit(False)))])
    texts = lambda issue, names=None: [F.when(t, m) for n, t, i, m in rules if i == issue and (names is None or n in names)]
    before = texts(False, ("document_number", "issue_date", "content"))
    per_page = F.transform(short, lambda p: F.format_string("ocr_text: page %s has little text", F.coalesce(p["page_number"].cast("string"), F.lit("?"))))
    after = [F.when(t, m) for n, t, i, m in rules if not i and n not in ("document_number", "issue_date", "content")]
    warnings = F.concat(F.array_compact(F.array(*before)), per_page, F.array_compact(F.array(*after)))
    return d.withColumns({"checks": checks, "issues": F.array_compact(F.array(*texts(True))), "warnings": warnings}).drop("_there", "_marks", "_words", "_held", "_short", "dup_id", "dup_url", "dup_file")


def quality_score(n_issues: Column, n_warnings: Column, profile: str = "catalogue") -> Column:
    """Struct of score and status. catalogue: 25 and 5 off, ERROR with an issue or below 50, WARNING with a warning or below
    85. import: 20 and 5 off, GOOD from 80, WARNING from 50."""
    per_issue = 25 if profile == "catalogue" else 20
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - n_issues * per_issue - n_warnings * 5)).cast("int")
    if profile == "catalogue":
        status = F.when((n_issues > 0) | (score < 50), "ERROR").when((n_warnings > 0) | (score < 85), "WARNING").otherwise("GOOD")
    else:
        status = F.when(score >= 80, "GOOD").when(score >= 50, "WARNING").otherwise("ERROR")
    return F.struct(score.alias("score"), status.alias("status"))


def scored_documents(docs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    return quality_checks(docs, files).withColumn("quality", quality_score(F.size("issues"), F.size("warnings")))


def quality_report(scored: DataFrame) -> DataFrame:
    """One row: documents, their statuses, issues and warnings in all, mean score."""
    q = F.col("quality.status")
    return scored.agg(
        F.count("*").alias("n_documents"), *[F.count_if(q == s).alias(s.lower()) for s in ("GOOD", "WARNING", "ERROR")],
        F.coalesce(F.sum(F.size("issues")), F.lit(0)).alias("n_issues"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("n_warnings"), F.bround(F.avg("quality.score"), 2).alias("mean_score"),
    )


def quality_report_documents(scored: DataFrame) -> DataFrame:
    """The report's part by document: (document_id, title, status, score, issues, warnings, checks)."""
    return scored.select(F.col("id").alias("document_id"), "title", "quality.status", "quality.score", "issues", "warnings", "checks")


def validity_counts(docs: DataFrame) -> DataFrame:
    """Rows per suggested status, verified ones left out."""
    return docs.where(~F.coalesce("is_verified", F.lit(False))).groupBy("suggested_status").agg(F.count("*").alias("n"))
