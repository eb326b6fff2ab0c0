"""Changes in place leave the files of other buckets alone and give what a rewrite gives."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from quarry import queries as library
from quarry.operators import chunk, queue
from quarry.schemas import CATALOGUE
from quarry.sources.buckets import Buckets

DATA = "/root/testdata/sf0.001"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def kept_and_gone(path, before):
    after = files(path)
    folders = lambda x: {os.path.dirname(f).rsplit("=")[-1] for f in x}
    same = {f for f, t in before.items() if after.get(f) == t}
    assert not folders(same) & folders(before.keys() - same)
    return len(folders(same)), len(folders(before.keys() - same))


def test_vectors(spark, tmp_path):
    schema = "chunk_id string, document_id string, embedding array<double>"
    rows = [(f"c{i}", f"d{i // 3}", [float(i)]) for i in range(300)] + [(f"h{i}", "hot", [0.0]) for i in range(200)]
    index = Buckets(f"file://{tmp_path}/v", "document_id", schema, n=32)
    index.write(spark.createDataFrame(rows, schema))
    before = files(tmp_path / "v")
    new = spark.createDataFrame([("n1", "d5", [9.0]), ("n2", "hot", [9.0]), ("n3", "fresh", [9.0])], schema)
    key = lambda df: sorted((r.chunk_id, r.document_id, tuple(r.embedding)) for r in df.collect())
    wanted = key(chunk.replace_vectors(spark.createDataFrame(rows, schema), new))
    chunk.replace_vectors_in_place(index, new)
    assert key(index.read(spark)) == wanted
    kept, gone = kept_and_gone(tmp_path / "v", before)
    assert gone <= 3 and kept >= 28
    chunk.replace_vectors_in_place(index, new)
    assert key(index.read(spark)) == wanted


def test_publish_and_validity(spark, tmp_path):
    cat = library.catalogue(spark, DATA).withColumn("metadata", F.lit(None).cast("struct<crawled_at:string,crawl_status:string,content_source:string,raw_issue_date:string,ocr_quality:struct<score:int,label:string,warnings:array<string>,metrics:map<string,string>>>"))
    stored = Buckets(f"file://{tmp_path}/cat", "id", CATALOGUE, n=64)
    stored.write(cat.select(*stored_columns()))
    before = files(tmp_path / "cat")
    text = lambda x: json.dumps({"pages": [{"page_number": 1, "raw_text": x, "cleaned_text": x}]})
    at = dt.datetime(2026, 1, 1)
    rows = [("q1", "PROCESSED", "abcdefabcdef01", text("first")), ("q2", "PROCESSED", "123456123456ff", text("second")), ("q3", "PENDING", "999999999999", text("third")), ("q4", "PROCESSED", "777777777777", text("  "))]
    q = spark.createDataFrame([(*r, None, "f.pdf") for r in rows], "id string, status string, checksum string, extracted_json string, edited_metadata string, original_name string")
    for c, t in (("source_url", "string"), ("detail_url", "string"), ("document_id", "string"), ("published_at", "timestamp"), ("updated_at", "timestamp"), ("file_format", "string")):
        q = q.withColumn(c, F.lit(None).cast(t))
    now = F.lit(at)
    wanted_q, wanted_c = queue.publish(q, cat, now)
    done = queue.publish_in_place(q, stored, now)
    look = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    assert look(done, "id", "status", "document_id") == look(wanted_q, "id", "status", "document_id")
    assert look(stored.read(spark), "id", "ordinal", "content") == look(wanted_c, "id", "ordinal", "content")
    kept, gone = kept_and_gone(tmp_path / "cat", before)
    assert gone <= 3 and kept > 40
    before = files(tmp_path / "cat")
    n = F.lit(None).cast("string")
    updates = spark.createDataFrame([("17", "expired"), ("18", "bogus"), ("none", "active")], "id string, effective_status string").withColumns({"set_fields": F.array(F.lit("deadline")), "deadline": F.lit("2024-01-01"), **{c: n for c in ("effective_from", "effective_to", "replaced_by", "status_evidence", "status_rationale", "verified_by", "verification_note")}})
    wanted = queue.update_validity(stored.read(spark), updates, now).drop("update_outcome")
    wanted = look(wanted, "id", "effective_status", "deadline", "is_verified", "status_history")
    outcomes = {r.id: r.update_outcome for r in queue.update_validity_in_place(stored, updates, now).collect()}
    assert outcomes == {"17": "updated", "18": "refused"}
    assert look(stored.read(spark), "id", "effective_status", "deadline", "is_verified", "status_history") == wanted
    kept, gone = kept_and_gone(tmp_path / "cat", before)
    assert gone <= 3 and kept > 40


def stored_columns():
    from quarry.schemas import CATALOGUE_COLUMNS

    return CATALOGUE_COLUMNS
