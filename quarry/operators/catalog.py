"""Catalogue queries and statistics (columns as in schemas.CATALOGUE; ordinal gives the order that ties keep)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions.text import strip, txt


def _has(c: str, q: str) -> Column:
    return F.contains(F.lower(txt(c)), F.lit(q.lower()))


def search_catalogue(df: DataFrame, query: str = "", category: str = "", status: str = "", year: str = "", trim: bool = False, admin: bool = False) -> DataFrame:
    """Rows whose title, number or content holds the query, in any case, with equal category and status and an issue date
    that starts with the year. '' and 'all' turn a filter off. trim: the query is trimmed before that test (the public
    list does so). admin: the issue date is searched too, and 'unverified' covers unknown and missing statuses."""
    q = query.strip() if trim else query
    if q:
        hit = _has("title", q) | _has("document_number", q) | (_has("issue_date", q) if admin else _has("content", q))
        df = df.where(hit | _has("content", q) if admin else hit)
    if category and category != "all":
        df = df.where(F.col("category") == category)
    if status and status != "all":
        many = admin and status == "unverified"
        df = df.where(txt("effective_status").isin("unverified", "unknown", "") if many else F.col("effective_status") == status)
    if year and year != "all":
        df = df.where(txt("issue_date").startswith(year))
    return df


def get_document(df: DataFrame, doc_id: str) -> DataFrame:
    """The first row with an id, or none."""
    return df.where(F.col("id") == doc_id).orderBy("ordinal").limit(1)


def drop_short(df: DataFrame, title: int = 10, content: int = 120) -> DataFrame:
    return df.where((F.length(txt("title")) >= title) & (F.length(txt("content")) >= content))


def category_stats(df: DataFrame) -> DataFrame:
    """Documents and sorted distinct subcategories of each category; none is a category of its own."""
    name = F.coalesce(F.nullif("category", F.lit("")), F.lit(config.NO_CATEGORY))
    return df.groupBy(name.alias("category")).agg(F.count("*").alias("n_documents"), F.array_sort(F.collect_set(F.nullif("subcategory", F.lit("")))).alias("subcategories"))


def status_stats(df: DataFrame) -> DataFrame:
    """One row: total and a count per status; missing and unlawful ones count as unverified."""
    s = F.when(F.col("effective_status").isin(*config.STATUSES), F.col("effective_status")).otherwise("unverified")
    return df.select(s.alias("s")).agg(F.count("*").alias("total"), *[F.count_if(F.col("s") == x).alias(x) for x in config.STATUSES])


def distinct_categories(df: DataFrame) -> DataFrame:
    return df.where(txt("category") != "").select("category").distinct()


def category_facets(df: DataFrame, categories: DataFrame) -> DataFrame:
    """A count for each listed category, 0 where it has no documents."""
    n = df.groupBy("category").agg(F.count("*").alias("n"))
    return categories.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n_documents"))


def dashboard_totals(df: DataFrame, n_chunks: DataFrame, pages_if_null: int = 0) -> DataFrame:
    """One row: documents, pages, chunks. n_chunks: one row with n_chunks."""
    totals = df.agg(F.count("*").alias("n_documents"), F.coalesce(F.sum(F.coalesce("total_pages", F.lit(pages_if_null))), F.lit(0)).alias("n_pages"))
    return totals.join(n_chunks.select("n_chunks"))


def corpus_audit(df: DataFrame) -> DataFrame:
    """One row of what the corpus has and lacks, with the chunks to expect at 650 characters each."""
    lacks = lambda c: F.count_if(txt(c) == "")
    body = strip(txt("content"))
    return df.agg(
        F.count("*").alias("n_documents"), F.coalesce(F.sum("total_pages"), F.lit(0)).alias("n_pages"), F.count_distinct("id").alias("n_ids"),
        lacks("title").alias("no_title"), lacks("document_number").alias("no_number"), lacks("issue_date").alias("no_date"),
        F.count_if(F.size(F.coalesce("attachments", F.array().cast("array<string>"))) > 0).alias("with_attachments"), F.count_if(body == "").alias("empty"),
        F.coalesce(F.sum(F.ceil(F.length(body) / 650)), F.lit(0)).cast("long").alias("estimated_chunks"),
    )


def documents_by_category(df: DataFrame, fields: tuple[str, ...] = ("ordinal", "id", "title")) -> DataFrame:
    """The documents of named categories, category by category and in order. Rows, not an array for each category: one may
    hold most of the corpus."""
    return df.where(txt("category") != "").orderBy("category", "ordinal").select("category", *fields)


def recent_documents(df: DataFrame, k: int = 5) -> DataFrame:
    """Newest first by issue date, those without a date last, ties in order."""
    return df.orderBy(F.desc(txt("issue_date")), "ordinal").limit(k)


def table_counts(**tables: DataFrame) -> DataFrame:
    """(table_name, n), one row per table."""
    rows = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def status_label(c: Column, labels: dict[str, str] | None = None) -> Column:
    """Display label; 'effective' shows as active, unknown and missing as unverified."""
    labels = labels or {"active": "In force", "deadline_passed": "Deadline passed", "expired": "Expired", "replaced": "Replaced", "unverified": "Unverified"}
    s = F.when(c == "effective", "active").when(c.isin(*labels), c).otherwise("unverified")
    return F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[s]


def user_roster(df: DataFrame) -> DataFrame:
    """Users with labels and the date part, newest first."""
    return df.select(
        "id", "name", "email", F.when(F.col("role") == "ADMIN", "Admin").otherwise("User").alias("role_label"),
        F.when(F.col("is_active"), "Active").otherwise("Locked").alias("state_label"), F.to_date("created_at").alias("created_on"), "created_at",
    ).orderBy(F.desc("created_at"), "id")


def flag_duplicates(df: DataFrame) -> DataFrame:
    """Adds dup_id, dup_url and dup_file: the row isn't the first with its id, source_url or file name. A hot value is
    pre-aggregated to its first ordinal, then joined back, so no window holds it."""
    out = df.withColumn("_file", F.lower(F.regexp_extract(txt("source_file"), r"([^/\\]*)$", 1)))
    for name, key in (("dup_id", "id"), ("dup_url", "source_url"), ("dup_file", "_file")):
        first = out.where(txt(key) != "").groupBy(F.col(key).alias("_k")).agg(F.min("ordinal").alias("_first"))
        out = out.join(first, F.col(key) == F.col("_k"), "left").withColumn(name, F.coalesce(F.col("_first") < F.col("ordinal"), F.lit(False))).drop("_k", "_first")
    return out.drop("_file")


def dedupe_first(df: DataFrame, *keys: str, order: str = "ordinal") -> DataFrame:
    """The first row per key; keys are tried in turn (the first that isn't empty). Rows without any key stay."""
    key = F.coalesce(*[F.nullif(F.col(k).cast("string"), F.lit("")) for k in keys])
    keyed = df.withColumn("_k", key)
    first = keyed.where("_k is not null").groupBy("_k").agg(F.min(order).alias("_first"))
    out = keyed.join(first, "_k", "left").where(F.col("_k").isNull() | (F.col(order) == F.col("_first")))
    return out.drop("_k", "_first").select(*df.columns)


def known_by_number(df: DataFrame, year: Column) -> DataFrame:
    """(number, year) with spaces removed and upper case; the last document of a number wins."""
    number = F.upper(F.regexp_replace(txt("document_number"), r"(?U)\s+", F.lit("")))
    return df.select(number.alias("number"), year.alias("year"), "ordinal").where("number <> ''").groupBy("number").agg(F.max_by("year", "ordinal").alias("year"))


def _halves(c: Column, name: str) -> list[Column]:
    """Two sums that a set of values has in any order: a 64-bit hash in halves, so that no sum runs over."""
    h = F.when(c.isNotNull(), F.xxhash64(F.lit(name), c))
    return [F.sum(F.shiftrightunsigned(h, 32)).alias(f"_{name}h"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias(f"_{name}l")]


def stop_at_repeat(items: DataFrame, page: str = "page", url: str = "url") -> DataFrame:
    """Rows of the pages before the first one that is empty or lists the same urls, each as often, as an earlier page. An
    empty page is a row with a null url.

    A page's digest is a count and sums of two hashes of its urls, made by partial aggregation: no page is gathered. What
    has the digest of an earlier page is compared with it url by url."""
    digest = ("_n", "_ah", "_al", "_bh", "_bl")
    sign = items.groupBy(page).agg(F.count(url).alias("_n"), *_halves(F.col(url), "a"), *_halves(F.col(url), "b"))
    same = sign.where("_n > 0").groupBy(*digest).agg(F.min(page).alias("_first"), F.count("*").alias("_pages")).where("_pages > 1")
    later = sign.join(same, list(digest)).where(F.col(page) > F.col("_first")).select(F.col(page).alias("_later"), "_first")
    listed = items.where(F.col(url).isNotNull()).groupBy(page, url).agg(F.count("*").alias("_times"))
    left = later.join(listed, F.col("_later") == F.col(page)).select("_later", "_first", F.col(url).alias("_u"), F.col("_times").alias("_t"))
    right = listed.select(F.col(page).alias("_first"), F.col(url).alias("_u"), "_times")
    # counts are equal, so pages are if no url of the later one is missing or rarer in the first
    other = left.join(right, ["_first", "_u"], "left").where(F.coalesce("_times", F.lit(0)) < F.col("_t")).select("_later")
    repeated = later.join(other, "_later", "left_anti").select(F.col("_later").alias("_bad"))
    bad = repeated.unionByName(sign.where("_n = 0").select(F.col(page).alias("_bad")))
    end = bad.agg(F.min("_bad").alias("_end"))
    return items.join(end).where(F.col("_end").isNull() | (F.col(page) < F.col("_end"))).drop("_end")


def claim_checksums(files: DataFrame, known: DataFrame, order: tuple[str, ...] = ("page", "item", "attachment")) -> DataFrame:
    """Adds claim: EXACT for a checksum that is known, or that an earlier file of the run has; else NEW."""
    at = F.struct(*order)
    first = files.groupBy("checksum").agg(F.min(at).alias("_first"))
    seen = known.select("checksum").distinct().withColumn("_known", F.lit(True))
    out = files.join(first, "checksum").join(seen, "checksum", "left")
    return out.withColumn("claim", F.when(F.coalesce("_known", F.lit(False)) | (at > F.col("_first")), "EXACT").otherwise("NEW")).drop("_first", "_known")


def classify_duplicates(items: DataFrame, known_urls: DataFrame, known_checksums: DataFrame, known_numbers: DataFrame) -> DataFrame:
    """Adds duplicate_status and duplicate_reason to items (detail_url, checksum, document_number, year): a known url or
    checksum is EXACT; a known number is LIKELY unless both years are known and differ; else NEW."""
    u = known_urls.select(F.col("url").alias("_u")).where("_u <> ''").distinct()
    c = known_checksums.select(F.col("checksum").alias("_c")).where("_c <> ''").distinct()
    n = known_numbers.select(F.col("number").alias("_n"), F.col("year").alias("_y"))
    number = F.upper(F.regexp_replace(txt("document_number"), r"(?U)\s+", F.lit("")))
    j = items.withColumn("_number", number).join(u, F.col("detail_url") == F.col("_u"), "left").join(c, F.col("checksum") == F.col("_c"), "left").join(n, F.col("_number") == F.col("_n"), "left")
    other = (txt("year") != "") & (txt("_y") != "") & (F.col("year") != F.col("_y"))
    status = F.when(F.col("_u").isNotNull() | F.col("_c").isNotNull(), "EXACT").when(F.col("_n").isNotNull() & ~other, "LIKELY").otherwise("NEW")
    reason = (
        F.when(F.col("_u").isNotNull(), F.format_string("url is known: %s", F.col("_u")))
        .when(F.col("_c").isNotNull(), F.format_string("checksum is known: %s", F.substring("_c", 1, 12)))
        .when(F.col("_n").isNotNull() & other, F.format_string("number %s is known, of year %s", F.col("_n"), F.col("_y")))
        .when(F.col("_n").isNotNull(), F.format_string("number is known: %s", F.col("_n")))
    )
    return j.withColumns({"duplicate_status": status, "duplicate_reason": reason}).drop("_u", "_c", "_n", "_y", "_number")


def items_by_duplicate_status(items: DataFrame, status: str) -> DataFrame:
    return items if status in ("", "all") else items.where(F.col("duplicate_status") == status)


def duplicate_facets(items: DataFrame) -> DataFrame:
    return items.groupBy("duplicate_status").agg(F.count("*").alias("n"))


def known_union(*sets: DataFrame) -> DataFrame:
    """Distinct rows of one-column sets."""
    out = sets[0]
    for s in sets[1:]:
        out = out.union(s)
    return out.distinct()


def append_new(base: DataFrame, new: DataFrame) -> DataFrame:
    return base.unionByName(new, allowMissingColumns=True)


def merge_new_documents(base: DataFrame, new: DataFrame, target: int | None = None, check_url: bool = True) -> DataFrame:
    """base and those new rows whose url (if checked) and lower-cased title it lacks, the first per title, up to a target
    number of rows in all. New rows follow base's ordinals."""
    title = F.lower(strip(txt("title")))
    fresh = new.withColumn("_t", title)
    if check_url:
        fresh = fresh.join(base.select(F.col("source_url").alias("_u")).distinct(), F.col("source_url") == F.col("_u"), "left_anti")
    fresh = fresh.join(base.select(title.alias("_b")).distinct(), F.col("_t") == F.col("_b"), "left_anti")
    fresh = dedupe_first(fresh, "_t").drop("_t")
    if target is not None:
        fresh = fresh.orderBy("ordinal").limit(max(0, target - base.count()))
    top = base.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("_top"))
    fresh = fresh.join(top).withColumn("ordinal", F.col("ordinal") + F.col("_top") + 1).drop("_top")
    return append_new(base, fresh)


def attachment_union(a: Column, b: Column) -> Column:
    """Distinct, in first-seen order."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(a, none), F.coalesce(b, none))


def crawl_summary(items: DataFrame, files: DataFrame, started: Column, finished: Column) -> DataFrame:
    """One row of a run's counters, duration in seconds and status (blocked before failed and partial)."""
    i = items.agg(
        F.count("*").alias("items_found"), F.count_if(F.col("duplicate_status") == "NEW").alias("new_items"), F.count_if(F.col("duplicate_status") == "EXACT").alias("duplicate_items"),
        F.count_if(F.col("duplicate_status") == "LIKELY").alias("likely_items"), F.count_if(F.col("error_code").isNotNull()).alias("failed_items"), F.count_if(F.col("error_code").isin("BLOCKED", "LOGIN", "CAPTCHA")).alias("_blocked"),
    )
    f = files.agg(F.count_if(F.col("state") == "downloaded").alias("downloaded_files"), F.count_if(F.col("state") == "skipped").alias("skipped_files"))
    status = F.when(F.col("_blocked") > 0, "BLOCKED").when((F.col("failed_items") > 0) & (F.col("failed_items") >= F.col("items_found")), "FAILED").when(F.col("failed_items") > 0, "PARTIAL").otherwise("COMPLETED")
    return i.join(f).withColumns({"status": status, "seconds": finished.cast("timestamp").cast("double") - started.cast("timestamp").cast("double")}).drop("_blocked")


def count_states(df: DataFrame, state: str, *states: str) -> DataFrame:
    """One row: total and a count per named state (downloads, details, batches, uploads)."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col(state) == s).alias(s.lower()) for s in states])
