"""The import queue as a table: intake, batches, results, review, publishing. Every operator returns a new table; none
loses a row unless it says so. now is a timestamp column or literal given by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions.ids import extension, file_format, sharded_path
from quarry.functions.text import strip, txt
from quarry.operators.normalize import assemble_content
from quarry.sources.buckets import Buckets
from quarry.sources.shared import stored

STATUSES = ("PENDING", "PROCESSING", "PROCESSED", "FAILED", "PUBLISHED", "DUPLICATE")


def validate_uploads(files: DataFrame, limits: config.UploadLimits = config.UploadLimits()) -> DataFrame:
    """Adds error: the first check that a file (name, size_bytes) fails, in order: the batch's number of files and bytes,
    then empty, too large, .doc, extension. Batches (batch_id) are summed first and joined back."""
    n = files.groupBy("batch_id").agg(F.count("*").alias("_n"), F.sum("size_bytes").alias("_b"))
    ext = extension(F.col("name"))
    error = (
        F.when(F.col("_n") > limits.max_files, "BATCH_TOO_MANY_FILES")
        .when(F.col("_b") > limits.max_total_bytes, "BATCH_TOO_LARGE")
        .when(F.col("size_bytes") == 0, "EMPTY_FILE")
        .when(F.col("size_bytes") > limits.max_bytes, "FILE_TOO_LARGE")
        .when(ext == "doc", "OLD_DOC_FORMAT")
        .when(~ext.isin(*limits.allowed), "UNSUPPORTED_FORMAT")
    )
    return files.join(n, "batch_id").withColumn("error", error).drop("_n", "_b")


def queue_by_status(queue: DataFrame, status: str) -> DataFrame:
    """Rows of a status; an unknown one means no filter."""
    return queue.where(F.col("status") == status) if status in STATUSES else queue


def queue_stats(queue: DataFrame, with_duplicates: bool = True) -> DataFrame:
    names = STATUSES if with_duplicates else STATUSES[:-1]
    return queue.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in names])


def queue_page(queue: DataFrame, status: str = "", page: int = 1, limit: int = 20) -> DataFrame:
    """A page of the queue, newest first, with total and total_pages on each row. The limit is brought into 1 to 100."""
    limit, page = max(1, min(100, limit)), max(1, page)
    some = queue_by_status(queue, status)
    total = some.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / limit))
    return some.orderBy(F.desc("created_at"), "id").offset((page - 1) * limit).limit(limit).join(F.broadcast(total))


def next_batch(queue: DataFrame, mode: str = "ALL_PENDING", size: int = 20, ids: DataFrame | None = None) -> DataFrame:
    """The oldest rows to work on: pending ones, selected ones (ids) that are pending or failed, or failed ones."""
    some = {
        "ALL_PENDING": lambda: queue.where("status = 'PENDING'"),
        "RETRY_FAILED": lambda: queue.where("status = 'FAILED'"),
        "SELECTED": lambda: queue.where("status in ('PENDING', 'FAILED')").join(ids.select("id").distinct(), "id", "left_semi"),
    }[mode]()
    return some.orderBy("created_at", "id").limit(max(1, min(100, size)))


def recent_jobs(jobs: DataFrame, k: int = 20) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), "id").limit(k)


def recent_imports(queue: DataFrame, k: int = 5) -> DataFrame:
    return queue.orderBy(F.desc("created_at"), "id").limit(k)


def crawl_jobs_with_counts(jobs: DataFrame, queue: DataFrame) -> DataFrame:
    n = queue.where("crawl_job_id is not null").groupBy("crawl_job_id").agg(F.count("*").alias("n_queued"))
    return jobs.join(n, jobs["id"] == n["crawl_job_id"], "left").drop("crawl_job_id").withColumn("n_queued", F.coalesce("n_queued", F.lit(0)))


def queue_with_uploader(queue: DataFrame, users: DataFrame) -> DataFrame:
    u = users.select(F.col("id").alias("_u"), F.col("name").alias("uploader_name"), F.col("email").alias("uploader_email"))
    return queue.join(u, F.col("uploaded_by_id") == F.col("_u"), "left").drop("_u")


def _first_of(files: DataFrame, order: str) -> DataFrame:
    return files.groupBy("checksum").agg(F.min(order).alias("_first"))


def intake(files: DataFrame, queue: DataFrame, now: Column, order: str = "file_ordinal") -> DataFrame:
    """Valid files (no error) as queue rows, the new ones PENDING; a checksum that the queue has, or an earlier file of the
    batch, is DUPLICATE with existing_id. Returns the files with status, id, existing_id and the columns of a queue row."""
    known = queue.where("status <> 'DUPLICATE'").groupBy("checksum").agg(F.min("id").alias("_known"))
    j = files.where(F.col("error").isNull()).join(known, "checksum", "left").join(_first_of(files.where("error is null"), order), "checksum")
    own = F.concat(F.lit("imp_"), F.substring("checksum", 1, 16))
    new = F.col("_known").isNull() & (F.col(order) == F.col("_first"))
    ident = F.when(new, own).otherwise(F.concat(own, F.lit("_"), F.col(order).cast("string")))
    return j.withColumns(
        {
            "id": ident, "status": F.when(new, "PENDING").otherwise("DUPLICATE"), "existing_id": F.when(~new, F.coalesce("_known", own)),
            "file_format": file_format(F.col("name"), F.lit("")), "storage_path": sharded_path(F.col("checksum"), extension(F.col("name"))), "retry_count": F.lit(0), "created_at": now, "updated_at": now,
        }
    ).drop("_known", "_first")


def intake_crawled(items: DataFrame, queue: DataFrame, job: str, now: Column) -> DataFrame:
    """Crawled files as PENDING rows of a job; known checksums are skipped, a repeated one counts once. Title, number and
    date go along as edited metadata."""
    fresh = items.join(queue.select("checksum").distinct(), "checksum", "left_anti")
    fresh = fresh.groupBy("checksum").agg(F.min_by(F.struct(*[c for c in items.columns if c != "checksum"]), "file_ordinal").alias("i")).select("checksum", "i.*")
    edited = F.to_json(F.struct("title", "document_number", F.col("date").alias("issue_date")))
    return fresh.withColumns({"id": F.concat(F.lit("crawl_"), F.substring("checksum", 1, 16)), "status": F.lit("PENDING"), "source_type": F.lit("CRAWLER"), "crawl_job_id": F.lit(job), "edited_metadata": edited, "retry_count": F.lit(0), "created_at": now, "updated_at": now})


def recover_stale(queue: DataFrame, now: Column, minutes: int = 5, alive: DataFrame | None = None) -> DataFrame:
    """PROCESSING for longer than minutes goes back to PENDING; given the pids that are alive, so does what has none."""
    q = queue
    old = F.coalesce(F.col("processing_started_at") < now - F.make_dt_interval(mins=F.lit(minutes)), F.lit(True))
    if alive is not None:
        q = q.join(alive.select(F.col("worker_pid").alias("_a")).distinct(), F.col("worker_pid") == F.col("_a"), "left")
        old = old | F.col("_a").isNull()
    hit = (F.col("status") == "PROCESSING") & old
    out = q.withColumns({"worker_pid": F.when(~hit, F.col("worker_pid")), "processing_started_at": F.when(~hit, F.col("processing_started_at")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at")), "status": F.when(hit, "PENDING").otherwise(F.col("status"))})
    return out.drop("_a")


def claim(queue: DataFrame, slots: int, now: Column, pid: int | None = None) -> DataFrame:
    """The oldest pending rows, as many as slots, become PROCESSING."""
    ids = queue.where("status = 'PENDING'").orderBy("created_at", "id").limit(slots).select(F.col("id").alias("_id"))
    q = queue.join(ids, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    return q.withColumns({"status": F.when(hit, "PROCESSING").otherwise(F.col("status")), "processing_started_at": F.when(hit, now).otherwise(F.col("processing_started_at")), "worker_pid": F.when(hit, F.lit(pid).cast("int")).otherwise(F.col("worker_pid")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}).drop("_id")


#: Fields of edited metadata; those of OR_FIELDS fall through when empty, the others only when absent.
FIELDS = ("title", "document_number", "issue_date", "issuing_unit", "category", "effective_status", "status_evidence", "deadline", "effective_from", "effective_to", "replaced_by")
OR_FIELDS = ("title",)
PUBLISH_OR_FIELDS = ("title", "effective_status", "status_evidence", "effective_from", "effective_to", "replaced_by")
HINTS = {"title": "title_candidate", "category": "category_hint"}
VALIDITY = {"effective_status": "suggested_status"}


def resolve_metadata(df: DataFrame, defaults: dict[str, str] | None = None, or_fields: tuple[str, ...] = OR_FIELDS) -> DataFrame:
    """Adds meta, a struct of FIELDS: what was edited, else hinted, else from validity, else a default. An empty edited
    text stands, except for or_fields. edited_metadata and extracted_json are JSON texts."""
    defaults = {"category": "Thông báo", "effective_status": "unverified"} | (defaults or {})
    full = lambda c: F.nullif(c, F.lit(""))
    get = lambda doc, path: F.get_json_object(F.col(doc), f"$.{path}")

    def one(f: str) -> Column:
        edited = get("edited_metadata", f)
        edited = full(edited) if f in or_fields else edited
        last = F.col("original_name") if f == "title" else F.lit(defaults.get(f, ""))
        return F.coalesce(edited, full(get("extracted_json", f"metadata_hints.{HINTS.get(f, f)}")), full(get("extracted_json", f"validity_analysis.{VALIDITY.get(f, f)}")), last).alias(f)

    return df.withColumn("meta", F.struct(*[one(f) for f in FIELDS]))


def apply_results(queue: DataFrame, results: DataFrame, now: Column, prefill: bool = False) -> DataFrame:
    """results: (id, extracted_json, error). Success makes a row PROCESSED, with edited metadata prefilled if asked; failure
    makes it FAILED with one retry more. Other rows stay."""
    r = results.groupBy("id").agg(F.max_by(F.struct("extracted_json", "error"), F.coalesce("error", F.lit(""))).alias("r"))
    q = queue.join(r, "id", "left")
    ok, bad = F.col("r").isNotNull() & F.col("r.error").isNull(), F.col("r").isNotNull() & F.col("r.error").isNotNull()
    q = q.withColumns(
        {
            "status": F.when(ok, "PROCESSED").when(bad, "FAILED").otherwise(F.col("status")),
            "extracted_json": F.when(ok, F.col("r.extracted_json")).otherwise(F.col("extracted_json")),
            "error_message": F.when(ok, F.lit(None)).when(bad, F.col("r.error")).otherwise(F.col("error_message")),
            "retry_count": F.when(bad, F.coalesce("retry_count", F.lit(0)) + 1).otherwise(F.col("retry_count")),
            "processed_at": F.when(ok, now).otherwise(F.col("processed_at")),
            "updated_at": F.when(ok | bad, now).otherwise(F.col("updated_at")),
            "worker_pid": F.when(~(ok | bad), F.col("worker_pid")),
        }
    )
    if prefill:
        q = resolve_metadata(q).withColumn("edited_metadata", F.when(ok, F.to_json("meta")).otherwise(F.col("edited_metadata"))).drop("meta")
    return q.drop("r")


def edit_metadata(queue: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """edits: (id, edited_metadata). Adds edit_outcome: edited, refused (published) or null (not asked for)."""
    e = edits.select(F.col("id").alias("_id"), F.col("edited_metadata").alias("_e")).dropDuplicates(["_id"])
    q = queue.join(e, F.col("id") == F.col("_id"), "left")
    asked = F.col("_id").isNotNull()
    hit = asked & (F.col("status") != "PUBLISHED")
    return q.withColumns({"edit_outcome": F.when(hit, "edited").when(asked, "refused"), "edited_metadata": F.when(hit, F.col("_e")).otherwise(F.col("edited_metadata")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}).drop("_id", "_e")


def verify_queue(queue: DataFrame, ids: DataFrame, who: str, now: Column) -> DataFrame:
    """Processed rows among ids get their metadata filled and stamped as verified; nothing is published."""
    i = ids.select(F.col("id").alias("_id")).distinct()
    q = resolve_metadata(queue.join(i, F.col("id") == F.col("_id"), "left"))
    hit = F.col("_id").isNotNull() & (F.col("status") == "PROCESSED")
    stamped = F.to_json(F.struct("meta.*", F.lit(who).alias("verified_by"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss").alias("verified_at")))
    return q.withColumns({"edited_metadata": F.when(hit, stamped).otherwise(F.col("edited_metadata")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}).drop("_id", "meta")


def requeue(queue: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Rows among ids that aren't published: PENDING, error cleared, one retry more."""
    q = queue.join(ids.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull() & (F.col("status") != "PUBLISHED")
    return q.withColumns({"error_message": F.when(~hit, F.col("error_message")), "retry_count": F.when(hit, F.coalesce("retry_count", F.lit(0)) + 1).otherwise(F.col("retry_count")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at")), "status": F.when(hit, "PENDING").otherwise(F.col("status"))}).drop("_id")


def delete_queue_rows(queue: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the rows among ids; published ones stay."""
    gone = queue.where("status <> 'PUBLISHED'").join(ids.select("id").distinct(), "id", "left_semi").select("id")
    return queue.join(gone, "id", "left_anti")


PAGES = "array<struct<page_number:int,raw_text:string,cleaned_text:string>>"


def _document(prefix: str) -> Column:
    """The id of a catalogue row from the checksum of its file."""
    return F.concat(F.lit(prefix), F.substring("checksum", 1, 12))


def publish(queue: DataFrame, catalogue: DataFrame, now: Column, prefix: str = "doc_", low: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(queue, catalogue) after publishing: PROCESSED rows with text become catalogue rows, whose id comes from the
    checksum. One that the catalogue has is replaced in its place, others stand before all old rows. low: one row (_low),
    the lowest ordinal, where catalogue is only a part."""
    ready = resolve_metadata(queue.where("status = 'PROCESSED'"), or_fields=PUBLISH_OR_FIELDS)
    ready = ready.withColumn("pages", F.from_json(F.get_json_object("extracted_json", "$.pages"), PAGES)).withColumn("content", strip(assemble_content(F.col("pages"), publish=True)))
    ready = ready.where((F.size("pages") > 0) & (F.col("content") != "")).withColumn("_doc", _document(prefix))
    one = ready.groupBy("_doc").agg(F.min("id").alias("id"))
    ready = ready.join(one, ["_doc", "id"])
    null = lambda f: F.nullif(strip(txt(f"meta.{f}")), F.lit("")).alias(f)
    rows = ready.select(
        F.col("_doc").alias("id"), *[null(f) for f in FIELDS], F.col("source_url"), F.col("detail_url"), F.col("original_name").alias("source_file"), "file_format", F.size("pages").alias("total_pages"), "content", "pages",
    )
    low = catalogue.agg(F.coalesce(F.min("ordinal"), F.lit(0)).alias("_low")) if low is None else low
    old = catalogue.groupBy("id").agg(F.min("ordinal").alias("_old"))
    rows = rows.join(old, "id", "left").join(F.broadcast(low)).withColumn("ordinal", F.coalesce("_old", F.col("_low") - 1 - F.pmod(F.xxhash64("id"), F.lit(1 << 40)))).drop("_old", "_low")
    new_catalogue = catalogue.join(rows.select("id"), "id", "left_anti").unionByName(rows.select(*[c for c in rows.columns if c in catalogue.columns]), allowMissingColumns=True)
    done = ready.select(F.col("id").alias("_id"), F.col("_doc"))
    q = queue.join(done, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    q = q.withColumns({"document_id": F.when(hit, F.col("_doc")).otherwise(F.col("document_id")), "published_at": F.when(hit, now).otherwise(F.col("published_at")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at")), "status": F.when(hit, "PUBLISHED").otherwise(F.col("status"))}).drop("_id", "_doc")
    return q, new_catalogue


def publish_in_place(queue: DataFrame, catalogue: Buckets, now: Column, prefix: str = "doc_") -> DataFrame:
    """publish() to a stored catalogue (buckets by id): only the buckets of published documents are read whole and written,
    of the others no more than the ordinals. Returns the queue after it."""
    spark, queue = queue.sparkSession, stored(queue, "publish-queue")
    low = stored(catalogue.read(spark).agg(F.coalesce(F.min("ordinal"), F.lit(0)).alias("_low")), "publish-low")
    ids = queue.where("status = 'PROCESSED'").select(_document(prefix).alias(catalogue.key)).where(F.col(catalogue.key).isNotNull())
    buckets = catalogue.of(ids)
    if not buckets:
        return queue
    done, rows = publish(queue, catalogue.read(spark, buckets), now, prefix, low)
    done = stored(done, "published-queue")
    fresh = stored(rows.select(*catalogue.read(spark).columns), "published-rows")
    catalogue.write(fresh, "dynamic")
    return done


def update_validity_in_place(catalogue: Buckets, updates: DataFrame, now: Column) -> DataFrame:
    """update_validity() on a stored catalogue (buckets by id); (id, update_outcome) of the rows that were asked for."""
    spark, updates = updates.sparkSession, stored(updates, "validity-updates")
    buckets = catalogue.of(updates)
    done = stored(update_validity(catalogue.read(spark, buckets), updates, now), "validity-updated")
    if buckets:
        catalogue.write(done.drop("update_outcome"), "dynamic")
    return done.where("update_outcome is not null").select("id", "update_outcome")


def update_validity(catalogue: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """updates: (id, set_fields array of names, effective_status, deadline, effective_from, effective_to, replaced_by,
    status_evidence, status_rationale, verified_by, verification_note). A field in set_fields is written, null too; one
    that isn't is kept. Adds a history entry and verifies the row. Unlawful statuses are refused (update_outcome)."""
    u = updates.groupBy("id").agg(F.first(F.struct(*[c for c in updates.columns if c != "id"])).alias("u"))
    j, n = catalogue.join(u, "id", "left"), F.col("u")
    status = n["effective_status"]
    lawful = F.coalesce(status, F.lit("")).isin("", *config.STATUSES)
    hit = n.isNotNull() & lawful
    new_status = F.coalesce(F.nullif(status, F.lit("")), F.col("effective_status"))
    entry = F.struct(
        F.col("effective_status").alias("previous_status"), new_status.alias("new_status"), F.coalesce(F.nullif(n["verified_by"], F.lit("")), F.lit("admin")).alias("changed_by"),
        now.cast("timestamp").alias("changed_at"), F.coalesce(F.nullif(n["status_evidence"], F.lit("")), F.col("status_evidence")).alias("evidence"), n["verification_note"].alias("note"),
    )
    put = {c: F.when(hit & F.array_contains(n["set_fields"], c), n[c]).otherwise(F.col(c)) for c in ("deadline", "effective_from", "effective_to", "replaced_by", "status_evidence", "status_rationale")}
    none = F.array().cast("array<struct<previous_status:string,new_status:string,changed_by:string,changed_at:timestamp,evidence:string,note:string>>")
    return j.withColumns(
        put
        | {
            "status_history": F.when(hit, F.array_append(F.coalesce("status_history", none), entry)).otherwise(F.col("status_history")),
            "is_verified": F.when(hit, True).otherwise(F.col("is_verified")),
            "verified_by": F.when(hit, F.coalesce(F.nullif(n["verified_by"], F.lit("")), F.col("verified_by"), F.lit("Admin"))).otherwise(F.col("verified_by")),
            "verified_at": F.when(hit, now.cast("timestamp")).otherwise(F.col("verified_at")),
            "effective_status": F.when(hit, new_status).otherwise(F.col("effective_status")),
            "update_outcome": F.when(hit, "updated").when(n.isNotNull(), "refused"),
        }
    ).drop("u")


def verify_documents(catalogue: DataFrame, ids: DataFrame, who: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(catalogue, outcomes): rows among ids are verified with their status kept; outcomes: (id, outcome verified or
    missing)."""
    n = F.lit(None).cast("string")
    asked = ids.select("id").distinct()
    updates = asked.select("id", F.array().cast("array<string>").alias("set_fields"), *[n.alias(c) for c in ("effective_status", "deadline", "effective_from", "effective_to", "replaced_by", "status_evidence", "status_rationale")], F.lit(who).alias("verified_by"), n.alias("verification_note"))
    there = catalogue.select(F.col("id").alias("_id")).distinct()
    outcomes = asked.join(there, F.col("id") == F.col("_id"), "left").select("id", F.when(F.col("_id").isNull(), "missing").otherwise("verified").alias("outcome"))
    return update_validity(catalogue, updates, now).drop("update_outcome"), outcomes


def batch_outcome(results: DataFrame, queue: DataFrame) -> DataFrame:
    """One row: ok, duplicate and failed results, and what is still pending."""
    r = results.agg(F.count("*").alias("total"), *[F.count_if(F.col("outcome") == x).alias(x) for x in ("ok", "duplicate", "failed")])
    return r.join(queue.agg(F.count_if(F.col("status") == "PENDING").alias("remaining")))
