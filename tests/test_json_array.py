"""Arrays of any make, cut anywhere, against the standard library's parser."""

import json
import random

import pytest

from quarry.sources import json_array, tables

TRICKY = ['}', '{', '"', '\\', '\\"}', ',', '[', ']', '"},{"', 'ä}é', '\n', '\t}', 'x' * 50, '\\\\', '☃"']


def value(rng, deep=0):
    kind = rng.randrange(6 if deep < 3 else 3)
    if kind < 2:
        return "".join(rng.choice(TRICKY) for _ in range(rng.randrange(6)))
    if kind == 2:
        return rng.choice([1, 2.5, None, True])
    if kind == 3:
        return [value(rng, deep + 1) for _ in range(rng.randrange(4))]
    return {value(rng, 9) if rng.random() < 0.3 else f"k{i}": value(rng, deep + 1) for i in range(rng.randrange(4))} if kind < 6 else None


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_elements(spark, tmp_path, small_blocks, indent):
    wanted = {}
    for seed in range(6):
        rng = random.Random(seed)
        rows = [value(rng) if rng.random() < 0.5 else {"title": value(rng, 9), "more": value(rng)} for _ in range(rng.choice([0, 1, 3, 40]))]
        (tmp_path / f"{seed}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=seed % 2 == 0) + "\n" * (seed % 3), encoding="utf-8")
        wanted |= {(f"{seed}.json", i): x for i, x in enumerate(json.loads(json.dumps(rows)))}
    for name, text in (("object", '{"a": [1, 2]}'), ("open", '[{"a": 1}, {"b": "'), ("text", "hello"), ("none", ""), ("cut", '[{"a": 1}')):
        (tmp_path / f"bad-{name}.json").write_text(text)
    items, bad = json_array.array_elements(spark, f"file://{tmp_path}/*.json")
    got = [((r.file.rsplit("/")[-1], r.number), json.loads(r.item)) for r in items.collect()]
    assert len(got) == len(wanted) and dict(got) == wanted
    assert sorted(r.file.rsplit("/")[-1] for r in bad.collect()) == [f"bad-{x}.json" for x in ("cut", "object", "open", "text")]  # an empty file has no rows


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    rows = [{"title": f"title {i}}}", "attachments": [f"a{i}"]} if i % 10 else i for i in range(300)]
    (tmp_path / "n.json").write_text(json.dumps(rows))
    assert spark.read.option("lineSep", "}").text(f"file://{tmp_path}/n.json").rdd.getNumPartitions() > 20
    got = {r.ordinal: (r.title, r.attachments, r.error) for r in tables.read_notices(spark, f"file://{tmp_path}/n.json").collect()}
    assert got == {i: (x["title"], x["attachments"], None) if i % 10 else (None, None, "not an object") for i, x in enumerate(rows)}
