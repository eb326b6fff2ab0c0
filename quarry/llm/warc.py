"""WARC archives through a chunked record table.

Payloads become rows of (record id, chunk number, bytes) with the digest of the payload so far; nothing after the first
step holds more than a chunk. Of equal payloads one record is the response, the others revisit it. An oversized payload
is written as a first segment and continuation records, as the format provides, so that writing too is by chunk. The
archives are written by Spark's own text sink (a WARC record is its head, an empty line, its block and an empty line, so
rows with line ends of two CRLF make a valid file) and hold a bounded number of records each. Reading streams each
archive, makes the chunk table again, and carries the digest from chunk to chunk.

Edge cases: a null payload is empty. Null ids give records without id that are never referred to. Rows that repeat an id
are records of their own (equal payloads still revisit the largest id; among rows with that id one is the response). An
empty table writes no record and reads none. Extra columns are not part of a record and are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, shared_folder, written

CHUNK = 1 << 17
#: Smaller payloads are always stored in full.
REVISIT_FROM = 1000
#: Records in an archive at most; with CHUNK it bounds an archive, which is read as one value, to 128 MB before gzip.
ARCHIVE_RECORDS = 1000
CHUNKS = "record string, page_id long, uri string, chunk int, chunks int, bytes long, body binary, digest_so_far string"


def _split(chunk: int, id_col: str, uri_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        schema = pa.schema([("record", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("bytes", pa.int64()), ("body", pa.binary()), ("digest_so_far", pa.string())])
        for b in batches:
            held, size = [], 0
            ids, uris, bodies, rows = b.column(id_col), b.column(uri_col), b.column("_payload"), b.column("_row")
            for i in range(b.num_rows):
                payload = memoryview(bodies[i].as_buffer() or b"") if bodies[i].is_valid else memoryview(b"")
                n, sha = max(1, -(-len(payload) // chunk)), hashlib.sha1()
                record = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{rows[i].as_py()}"))
                for k in range(n):
                    part = bytes(payload[k * chunk : (k + 1) * chunk])
                    sha.update(part)
                    held.append((record, ids[i].as_py(), uris[i].as_py(), k, n, len(payload), part, sha.hexdigest()))
                    size += len(part)
                    if size > 8 * chunk:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return run


def chunked(pages: DataFrame, payload: str = "html", key: str = "page_id", uri: str = "url", chunk: int = CHUNK) -> DataFrame:
    """The chunk table. The record id is made from the key, the content and the row's number, so a lost task makes the
    same one again; digest_so_far is the SHA-1 of the payload up to and with this chunk."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    same = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.monotonically_increasing_id(), F.crc32(body))
    rows = pages.select(F.col(key).cast("long").alias(key), F.col(uri).cast("string").alias(uri), body.alias("_payload"), same.alias("_row"))
    return rows.mapInArrow(_split(chunk, key, uri), CHUNKS)


def record_types(chunks: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """(record, digest, record_type, refers_to, refers_record) for every record. Equal payloads are found by digest and
    length, with partial maxima, so a payload that a third of the pages share is one row a task."""
    ends = chunks.where(F.col("chunk") == F.col("chunks") - 1).select("record", "page_id", "bytes", F.col("digest_so_far").alias("digest"))
    first = ends.where((F.col("bytes") >= revisit_from) & F.col("page_id").isNotNull()).groupBy("digest", "bytes").agg(F.max(F.struct("page_id", "record")).alias("first"))
    revisit = F.col("first").isNotNull() & (F.col("first.record") != F.col("record"))
    return ends.join(first, ["digest", "bytes"], "left").select(
        "record", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first.page_id")).alias("refers_to"), F.when(revisit, F.col("first.record")).alias("refers_record")
    )


def write_archives(chunks: DataFrame, types: DataFrame, path: str, archive_records: int = ARCHIVE_RECORDS) -> None:
    """WARC/1.1 files below path, gzipped. A revisit has no block; its payload's length and digest stand in its head."""
    rows = chunks.join(types, "record").where((F.col("record_type") == "response") | (F.col("chunk") == 0))
    response, segments = F.col("record_type") == "response", (F.col("chunks") > 1) & (F.col("record_type") == "response")
    line = lambda name, value, when=None: F.when(F.lit(True) if when is None else when, F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), c, F.lit(">"))
    block = F.when(response, F.col("body")).otherwise(F.lit("").cast("binary"))
    uri = F.regexp_replace(F.coalesce("uri", F.lit("")), r"[\r\n]+", F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("chunk") > 0, "continuation").otherwise(F.col("record_type"))),
        line("WARC-Record-ID", urn(F.when(F.col("chunk") > 0, F.concat_ws("-", "record", F.col("chunk").cast("string"))).otherwise(F.col("record")))),
        F.lit("WARC-Date: 2000-01-01T00:00:00Z\r\n"),
        line("WARC-Target-URI", uri, uri != ""),
        line("Page-ID", F.col("page_id").cast("string"), F.col("page_id").isNotNull()),
        line("WARC-Segment-Number", (F.col("chunk") + 1).cast("string"), segments),
        line("WARC-Segment-Origin-ID", urn(F.col("record")), F.col("chunk") > 0),
        line("WARC-Segment-Total-Length", F.col("bytes").cast("string"), segments & (F.col("chunk") == F.col("chunks") - 1)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("Payload-Length", F.col("bytes").cast("string")),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ~response),
        line("WARC-Refers-To", urn(F.col("refers_record")), ~response),
        line("Refers-To-Page", F.col("refers_to").cast("string"), ~response),
        line("Content-Type", F.lit("text/html"), response),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    out = rows.select(F.concat(head.cast("binary"), block).cast("string").alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", archive_records).text(path)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("chunk", pa.int32()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("refers_record", pa.string()), ("told_bytes", pa.int64()), ("told_digest", pa.string()), ("body", pa.binary())])
    out = lambda held: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    held, size = [], 0
    for b in batches:
        for content in b.column("content"):
            for head, body in records(content.as_buffer()):
                kind, ident = head["warc-type"], head.get("warc-segment-origin-id", head["warc-record-id"])[10:-1]
                number = lambda name, head=head: int(head[name]) if name in head else None
                held.append((ident, number("page-id"), head.get("warc-target-uri"), (number("warc-segment-number") or 1) - 1, "response" if kind == "continuation" else kind, number("refers-to-page"), head["warc-refers-to"][10:-1] if "warc-refers-to" in head else None, number("payload-length"), head.get("warc-payload-digest", "sha1:")[5:], body))
                size += len(body)
                if size > 8 * CHUNK:
                    yield out(held)
                    held, size = [], 0
    if held:
        yield out(held)


def records(archive) -> Iterator[tuple[dict[str, str], bytes]]:
    """Heads and blocks of a gzipped archive, inflated piece by piece: a block is at most a chunk."""
    inflate, buffer = zlib.decompressobj(31), bytearray()
    view, at = memoryview(archive), 0

    def more() -> bool:
        nonlocal at, inflate
        while at < len(view):
            if inflate.eof:  # the next member
                at -= len(inflate.unused_data)
                inflate = zlib.decompressobj(31)
            piece = inflate.decompress(view[at : at + 65536])
            at += min(65536, len(view) - at)
            if piece:
                buffer.extend(piece)
                return True
        return False

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        lines = buffer[:end].decode("utf-8", "replace").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        stop = end + 4 + int(head["content-length"])
        while len(buffer) < stop + 4:
            if not more():
                raise ValueError("a record ends early")
        yield head, bytes(buffer[end + 4 : stop])
        del buffer[: stop + 4]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives below path: record, page_id, uri, chunk, record_type, refers_to, refers_record, told_bytes,
    told_digest (what a head says of the whole payload), body."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parse, "record string, page_id long, uri string, chunk int, record_type string, refers_to long, refers_record string, told_bytes long, told_digest string, body binary")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
    now, sha, n = None, hashlib.sha1(), 0
    for b in batches:
        done = []
        for record, body in zip(b.column("record").to_pylist(), b.column("body"), strict=True):
            if record != now:
                if now is not None:
                    done.append((now, n, sha.hexdigest()))
                now, sha, n = record, hashlib.sha1(), 0
            part = body.as_buffer()
            sha.update(part)
            n += len(part)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([n], pa.int64()), pa.array([sha.hexdigest()])], schema=schema)


def payloads(chunks: DataFrame) -> DataFrame:
    """(record, payload_bytes, payload_digest) of chunks as read. Records in one chunk are hashed where they lie; only
    the chunks of longer ones are brought together, ordered, and hashed one after another."""
    whole = chunks.where((F.col("told_bytes") <= F.octet_length("body")) | (F.col("record_type") != "response"))
    short = whole.select("record", F.octet_length("body").cast("long").alias("payload_bytes"), F.sha1("body").alias("payload_digest"))
    long = chunks.where((F.col("told_bytes") > F.octet_length("body")) & (F.col("record_type") == "response")).select("record", "chunk", "body")
    ordered = long.repartition("record").sortWithinPartitions("record", "chunk").select("record", "body")
    return short.unionByName(ordered.mapInArrow(_digest, "record string, payload_bytes long, payload_digest string"))


def checked(chunks: DataFrame) -> DataFrame:
    """One row per record, with its payload's length and digest: computed from the chunks of a response, which must
    agree with its head, and with the head of each revisit that refers to it."""
    firsts = chunks.where("chunk = 0").select("record", "page_id", "uri", "record_type", "refers_to", "refers_record", "told_bytes", "told_digest")
    got = written(firsts.join(payloads(chunks), "record"), "warc-records")
    response = F.col("record_type") == "response"
    origin = got.where(response).select(F.col("record").alias("refers_record"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    got = got.join(origin, "refers_record", "left")
    length, digest = F.when(response, F.col("payload_bytes")).otherwise(F.col("_bytes")), F.when(response, F.col("payload_digest")).otherwise(F.col("_digest"))
    fails = ~length.eqNullSafe(F.col("told_bytes")) | ~digest.eqNullSafe(F.col("told_digest"))
    sure = F.when(fails, F.raise_error(F.concat(F.lit("damaged record "), "record"))).otherwise(F.col("told_digest"))
    return got.select("record", "page_id", "uri", "record_type", "refers_to", F.col("told_bytes").alias("payload_bytes"), sure.alias("payload_digest"))


def archive(pages: DataFrame, path: str | None = None, payload: str = "html", key: str = "page_id", uri: str = "url", chunk: int = CHUNK, revisit_from: int = REVISIT_FROM) -> str:
    """Writes a record per page below path (by default in the shared folder) and returns it."""
    bound_batches(pages.sparkSession)
    path = path or shared_folder(pages.sparkSession, "warc")
    chunks = chunked(pages, payload, key, uri, chunk)
    types = written(record_types(chunks.drop("body"), revisit_from), "warc-types")
    write_archives(chunks, types, path)
    return path


def op3_warc(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    rows = read_archives(spark, archive(pages.select("page_id", "url", "html")))
    return checked(rows).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM {pages}
), f AS (
  SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 1000
"""
