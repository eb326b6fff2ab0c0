"""Schemas of the tables, as DDL; every read names its schema, and what a file lacks is null."""

_PAGE = "page_number INT, raw_text STRING, cleaned_text STRING"
_SCORES = "score: INT, label: STRING, warnings: ARRAY<STRING>, metrics:"

NOTICE = """title STRING, date STRING, detail_url STRING, attachments ARRAY<STRING>, content STRING, document_number STRING,
    published_date STRING, category STRING, source_page INT, post_id STRING, crawl_status STRING, crawled_at STRING,
    content_source STRING, attachments_downloaded ARRAY<STRING>"""
EXTRACTED = f"""source_file STRING, source_url STRING, notification_title STRING, notification_index INT, file_format STRING,
    extraction_status STRING, extracted_at STRING, total_pages INT, ocr_lang STRING, ocr_at STRING, file_path STRING,
    pages ARRAY<STRUCT<{_PAGE}, extraction_status STRING>>,
    ocr_quality STRUCT<{_SCORES} STRUCT<text_length INT, non_whitespace_chars INT, vietnamese_character_ratio DOUBLE,
      alphanumeric_ratio DOUBLE, suspicious_character_ratio DOUBLE, repeated_character_ratio DOUBLE, line_count INT,
      word_count INT, detected_legal_patterns ARRAY<STRING>, empty_page_ratio DOUBLE>>"""
HISTORY = "ARRAY<STRUCT<previous_status: STRING, new_status: STRING, changed_by: STRING, changed_at: TIMESTAMP, evidence: STRING, note: STRING>>"
CATALOGUE = f"""id STRING, title STRING, document_number STRING, issue_date STRING, issuing_unit STRING, category STRING,
    subcategory STRING, deadline STRING, effective_status STRING, effective_from STRING, effective_to STRING,
    replaced_by STRING, suggested_status STRING, status_evidence STRING, status_rationale STRING, certainty STRING,
    is_verified BOOLEAN, verified_by STRING, verified_at TIMESTAMP, status_history {HISTORY}, source_url STRING,
    detail_url STRING, source_file STRING, file_format STRING, total_pages INT, content STRING,
    pages ARRAY<STRUCT<{_PAGE}>>, attachments ARRAY<STRING>,
    metadata STRUCT<crawled_at STRING, crawl_status STRING, content_source STRING, raw_issue_date STRING,
      ocr_quality STRUCT<{_SCORES} MAP<STRING, STRING>>>,
    provenance STRUCT<notification_index INT, notification_title STRING, detail_file STRING, document_file STRING,
      extracted_file STRING>, ordinal BIGINT"""
QUEUE = """id STRING, uploaded_by_id STRING, original_name STRING, storage_path STRING, mime_type STRING, file_format STRING,
    size_bytes BIGINT, checksum STRING, status STRING, source_type STRING, source_url STRING, detail_url STRING,
    crawl_job_id STRING, error_message STRING, retry_count INT, extracted_json STRING, edited_metadata STRING,
    document_id STRING, worker_pid INT, processing_started_at TIMESTAMP, processed_at TIMESTAMP, published_at TIMESTAMP,
    created_at TIMESTAMP, updated_at TIMESTAMP"""
MESSAGE = "id STRING, conversation_id STRING, role STRING, content STRING, citations STRING, model_used STRING, created_at TIMESTAMP"
CONVERSATION = "id STRING, user_id STRING, title STRING, created_at TIMESTAMP, updated_at TIMESTAMP"

NOTICE_FIELDS = tuple(f.split()[0] for f in NOTICE.split(","))
CATALOGUE_COLUMNS = tuple("id title document_number issue_date issuing_unit category subcategory deadline effective_status effective_from effective_to replaced_by suggested_status status_evidence status_rationale certainty is_verified verified_by verified_at status_history source_url detail_url source_file file_format total_pages content pages attachments metadata provenance ordinal".split())
