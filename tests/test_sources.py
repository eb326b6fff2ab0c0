import json

from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from quarry.sources import tables
from quarry.sources.files import key_in, write_files
from quarry.streaming.intake import known_rows, stream_intake


def test_notices_and_extracted(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps([{"title": "a", "attachments": ["x"]}, 5, {"title": "b"}]))
    rows = tables.read_notices(spark, f"file://{tmp_path}/n.json").orderBy("ordinal").collect()
    assert [(r.ordinal, r.title, r.error) for r in rows] == [(0, "a", None), (1, None, "not an object"), (2, "b", None)]
    (tmp_path / "bad.json").write_text('{"a": 1}')
    assert tables.read_notices(spark, f"file://{tmp_path}/bad.json").first().error == "not an array"
    for name, body in (("e/b.json", '{"source_file": "b.pdf", "pages": [{"page_number": 1}]}'), ("e/sub/a.json", '{"source_file": "a.pdf"}'), ("e/c.json", "broken")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    got = tables.read_extracted(spark, f"file://{tmp_path}/e").orderBy("file_ordinal").collect()
    assert [(r.file_ordinal, r.source_file) for r in got] == [(0, "b.pdf"), (1, "a.pdf")]


def test_many_files_written_and_read(spark, tmp_path):
    """A file a row, few folders; read back as bytes, in the order of their paths."""
    body = F.concat(F.lit('{"source_file": "Điều '), F.col("id").cast("string"), F.lit('.pdf"}'))
    rows = spark.range(2500).select(F.format_string("%06d", "id").alias("doc_id"), F.when(F.col("id") % 10 == 3, "{").otherwise(body).alias("text"))
    write_files(rows, f"file://{tmp_path}/many", "doc_id", "UTF-8", "jsn")
    assert len(list((tmp_path / "many").iterdir())) == 3 and len(list((tmp_path / "many").glob("*/*.jsn"))) == 2500
    got = tables.read_extracted(spark, f"file://{tmp_path}/many", "*.jsn").orderBy("file_ordinal").select("source_file", key_in("extracted_file").alias("k")).collect()
    assert [(r.source_file, r.k) for r in got] == [(f"Điều {i}.pdf", i) for i in range(2500) if i % 10 != 3]


def test_extracted_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The files that Spark's reader finds, with its addresses, in its order; the driver holds no list of them."""
    top = tmp_path / "a top"
    body = lambda k: json.dumps({"source_file": k})
    names = ["a.json", "b c.json", "Điều.json", "p%20q#1.json", "x+y.json", "[z]{w}.json", "no\u00a0break.json", "x.jsonl", "_left.json", ".out.json", "_k=1/in.json", "_d/out.json", "d/e/f/deep.json", "d/e.json/g.json", "q/a^b`c|d.json"]
    for name in names:
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(body(name))
    (top / "d/broken.json").write_text("{")
    (top / "d/empty.json").write_text("")
    (top / "link.json").symlink_to(top / "none")
    with monkeypatch.context() as m:
        m.setattr(tables, "reachable_folder", lambda spark, folder: None)
        plain = tables.read_extracted(spark, f"file://{top}").orderBy("file_ordinal").collect()
    formats = []
    monkeypatch.setattr(DataFrameReader, "format", lambda self, kind, f=DataFrameReader.format: formats.append(kind) or f(self, kind))
    for folder in (f"file://{top}", f"{top}/"):
        df = tables.read_extracted(spark, folder)
        assert df.orderBy("file_ordinal").collect() == plain
    assert df.columns[0] == "extracted_file" and df.columns[-1] == "file_ordinal" and "binaryFile" not in formats
    assert sorted(r.source_file for r in plain) == sorted(set(names) - {"x.jsonl", "_left.json", ".out.json", "_d/out.json"})
    assert tables.read_extracted(spark, str(top), "{a,x+y}.js*").count() == 2
    assert tables.read_extracted(spark, str(top), "*.none").count() == 0
    assert tables.read_extracted(spark, f"{tmp_path}/a t?p").count() == len(plain)  # a pattern goes to Spark's reader


def test_catalogue_html_vectors(spark, tmp_path):
    assert tables.read_catalogue(spark, f"file://{tmp_path}/none.parquet").count() == 0
    for name, raw in (("u.html", "Điều".encode()), ("w.html", "Vi\xeat".encode("cp1252")), ("m.htm", "﻿x".encode())):
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/")[-1]: r.html for r in tables.read_html(spark, f"file://{tmp_path}").collect()}
    assert got == {"u.html": "Điều", "w.html": "Viêt", "m.htm": "x"}
    assert tables.list_files(spark, f"file://{tmp_path}", ("html",)).count() == 2
    assert tables.read_vectors(spark, f"file://{tmp_path}/v").count() == 0
    v = spark.createDataFrame([("c", "d", [1.0], "m"), ("e", "d", [], "m")], "chunk_id string, document_id string, embedding array<float>, model string")
    tables.write_vectors(v, f"file://{tmp_path}/v")
    assert [r.chunk_id for r in tables.read_vectors(spark, f"file://{tmp_path}/v", "m").collect()] == ["c"]


def test_ordinals(spark):
    got = tables.with_ordinal(spark.range(100).withColumn("k", F.col("id") * 7 % 100), "k").orderBy("ordinal").collect()
    assert [(r.ordinal, r.k) for r in got] == [(i, i) for i in range(100)]
    assert tables.with_ordinal(spark.range(0), "id").collect() == []


def test_ordinals_of_many_wide_rows(spark):
    """Wide rows and narrow counts are planned apart; keys repeat, one of them in a third of the rows."""
    n = 1_000_000
    key = F.when(F.col("id") % 3 == 0, -1).otherwise(F.pmod(F.xxhash64("id"), F.lit(400_000)))
    rows = spark.range(n, numPartitions=11).select("id", key.alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 3).alias("wide"))
    got = tables.with_ordinal(rows, "k")
    a = got.agg(F.count("*").alias("n"), F.count_distinct("ordinal").alias("distinct"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count_distinct("id").alias("ids")).first()
    assert tuple(a) == (n, n, 0, n - 1, n)
    least = got.groupBy("k").agg(F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.count("*").alias("c"))
    assert least.where("hi - lo + 1 <> c").count() == 0


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = lambda i, c: json.dumps({"batch_id": "b", "name": f"{i}.pdf", "size_bytes": 5, "checksum": c, "file_ordinal": i})
    paths = [f"file://{tmp_path}/{x}" for x in ("in", "queue", "ck")]
    (tmp_path / "in/1.json").write_text(row(1, "c1") + "\n" + row(2, "c1"))
    stream_intake(spark, *paths).awaitTermination()
    (tmp_path / "in/2.json").write_text(row(3, "c1") + "\n" + row(4, "c2"))
    stream_intake(spark, *paths).awaitTermination()
    got = {r.file_ordinal: r.status for r in spark.read.parquet(paths[1]).collect()}
    assert got == {1: "PENDING", 2: "DUPLICATE", 3: "DUPLICATE", 4: "PENDING"}


def test_stream_reads_the_folders_of_its_checksums(spark, tmp_path):
    """Batch after batch: what is read for one doesn't grow with the queue; a batch run again changes nothing."""
    (tmp_path / "in").mkdir()
    paths = [f"file://{tmp_path}/{x}" for x in ("in", "queue", "ck")]
    number = 0
    for b in range(3):
        lines = []
        for i in range(40):
            number += 1
            checksum = "ab" + "0" * 10 if i == 0 else f"{(i * 7 + b) % 200:02x}{number:010d}"
            lines.append(json.dumps({"batch_id": f"b{b}", "name": f"{number}.pdf", "size_bytes": 5, "checksum": checksum, "file_ordinal": number}))
        (tmp_path / f"in/{b}.json").write_text("\n".join(lines))
        stream_intake(spark, *paths).awaitTermination()
    queue = lambda: sorted((r.file_ordinal, r.status, r.existing_id, r.batch) for r in spark.read.parquet(paths[1]).collect())
    before = queue()
    assert [r[1] for r in before if r[0] in (1, 41, 81)] == ["PENDING", "DUPLICATE", "DUPLICATE"] and len(before) == 120
    known = known_rows(spark, paths[1], ["pab"], 99)
    assert len(known.inputFiles()) == 3 and all("prefix=pab" in f for f in known.inputFiles())
    assert known_rows(spark, paths[1], ["pzz"], 99).count() == 0
    assert known.count() == 3
    # the last batch once more, as after a failure before its commit
    last = sorted((tmp_path / "ck/commits").glob("[0-9]*"))[-1]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    stream_intake(spark, *paths).awaitTermination()
    assert queue() == before
