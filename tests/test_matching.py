"""Substring joins and the running match, against loops over rows."""

import random
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import substring
from quarry.operators.match import enrich_by_title, match_details, match_extracted
from quarry.operators.substring import _grams_of, contains_join


@pytest.mark.parametrize("seed", range(3))
def test_contains_join(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abá ") for _ in range(n))
    texts = sorted({word(rng.choice([1, 2, 5, 30, 60])) for _ in range(120)} | {"", "x" * 3000 + "the end of it"})
    parts = sorted({word(rng.choice([1, 2, 3, 4, 7, 8, 9, 12])) for _ in range(80)} | {"", "the end of", "xxxxxxxxxxxxxxxx", *rng.sample(texts, 20)})
    got = contains_join(spark.createDataFrame([(t,) for t in [*texts, None]], "t string"), spark.createDataFrame([(p,) for p in [*parts, None]], "p string"), "t", "p")
    rows = [(r.t, r.p) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(t, p) for t in texts for p in parts if t and p and p in t}


def test_substring_plans_have_no_nested_loop(spark, capsys):
    t = spark.range(3000).select(F.concat(F.lit("title of notice number "), "id").alias("t"))
    p = spark.range(3000).select(F.concat(F.lit("notice number "), "id").alias("p"))
    got = contains_join(t, p, "t", "p")
    got.explain()
    assert "NestedLoop" not in capsys.readouterr().out
    assert got.count() == sum(str(b).startswith(str(a)) for a in range(3000) for b in range(3000) if len(str(b)) - len(str(a)) in range(4))


def running(details, notices):
    """Details one after the other; new notices take later ones."""
    rows, seen = [dict(n) for n in notices], {n["detail_url"] or n["title"] or None for n in notices} - {None}
    for d in details:
        for n in rows:
            if d["title"] and n["title"] and (d["title"] in n["title"] or n["title"] in d["title"]):
                n["attachments"] = n["attachments"] + [a for a in d["attachments"] if a not in n["attachments"]]
                n["date"] = n["date"] or d["date"]
                break
        else:
            key = d["detail_url"] or d["title"] or None
            if key not in seen:
                seen.add(key)
                rows.append(dict(d))
    return sorted((r["title"], tuple(r["attachments"]), r["date"] or None) for r in rows)


@pytest.mark.parametrize("seed", range(4))
def test_running_match(spark, seed):
    rng = random.Random(seed)
    pool = ["exam", "exam plan", "exam plan 2024", "plan", "fees", "fees 2024", "2024", "list of fees", "x", "notes", "timetable", ""]
    row = lambda i, kind: {"title": rng.choice(pool[3 * (kind == "n") :]), "detail_url": rng.choice(["", "", "u1", "u2", f"u{i}"]), "attachments": [f"{kind}{i}"][: rng.randrange(2)], "date": rng.choice(["", f"d{i}"])}
    notices = [row(i, "n") for i in range(seed)]
    details = [row(i, "d") for i in range(14)]
    schema = "title string, detail_url string, attachments array<string>, date string"
    n = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(notices)], f"ordinal long, {schema}")
    d = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(details)], f"detail_ordinal long, {schema}")
    got = enrich_by_title(d, n).collect()
    assert sorted((r.title, tuple(r.attachments), r.date) for r in got) == running(details, notices)


def test_common_titles_are_matched_once(spark):
    """A title that all notices and files share makes a row a notice, not one a pair."""
    n = spark.range(4000).select(F.col("id").alias("ordinal"), F.lit("a title that all of them share").alias("title"), F.array(F.col("id").cast("string")).alias("attachments"), F.array().cast("array<string>").alias("attachments_downloaded"))
    e = spark.range(4000).select(F.col("id").alias("file_ordinal"), F.lit("").alias("source_url"), F.lit("x.pdf").alias("source_file"), F.lit("A title that all of them share ").alias("notification_title"), F.lit(-1).alias("notification_index"))
    got = match_extracted(n, e)
    # every join meets one file a key; no file tells an index or address here, which leaves two
    assert got._jdf.queryExecution().optimizedPlan().toString().count("min(file_ordinal") == 2
    seen = got.agg(F.count("*"), F.max("file_ordinal"), F.min("match_rule")).first()
    assert tuple(seen) == (4000, 0, 4)


def test_titles_are_compared_as_told(spark):
    n = spark.createDataFrame([(0, "http://x/a.html", "Twelve letters.")], "ordinal long, detail_url string, title string")
    d = spark.createDataFrame([(0, "http://x/b.html", "Twelve letters.")], "detail_ordinal long, url string, title string")
    # fifteen characters, of which the default drops the point
    assert [r.notice_ordinal for r in match_details(d, n).collect()] == [None]
    assert [r.notice_ordinal for r in match_details(d, n, lambda c: F.regexp_replace(c, r"\s+", " ")).collect()] == [0]


def test_long_parts_and_many_short_ones(spark):
    """Parts of every way of indexing are found, and short ones meet no text that doesn't hold them whole."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    parts = sorted({word(n) for n in (1, 5, 7, 8, 15, 16, 17, 31, 32, 63, 64, 127, 128, 129, 300)})
    texts = sorted({word(40) + p + word(200) for p in parts})
    found = pd.concat(_grams_of(pa.array(texts), np.arange(len(texts)), [128], None, None))
    # of windows of 128 few grams are given: fewer than a twelfth of the places
    assert 0 < len(found) < sum(map(len, texts)) / 12
    got = contains_join(spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(p,) for p in parts], "p string"), "t", "p")
    assert {(r.t, r.p) for r in got.collect()} == {(t, p) for t in texts for p in parts if p in t}


def test_grams_of_long_parts_let_no_short_ones_through():
    """Each length has its bitmap: a full one of long windows leaves that of short windows as it is."""
    texts = pa.array(["abcdefgh and then " + "x y z " * 40])
    full, none = np.full(substring.BITS // 8, 255, np.uint8), np.zeros(substring.BITS // 8, np.uint8)
    found = pd.concat(_grams_of(texts, np.arange(1), [8, 128], None, {8: none, 128: full}))
    assert set(found["kind"]) == {128}


def test_titles_are_written_once_a_side(spark):
    """What enrich_by_title writes on the way: the titles of each side once, and less than as much again besides."""
    at = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    written = lambda: sum(p.stat().st_size for p in Path(at).rglob("*.parquet"))
    title = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 256) for k in range(9)])
    n = spark.range(3000).select(F.col("id").alias("ordinal"), title.alias("title"), F.lit("").alias("detail_url"), F.array(F.lit("a")).alias("attachments"), F.lit("").alias("date"))
    d = n.withColumnRenamed("ordinal", "detail_ordinal").withColumns({"title": F.when(F.col("detail_ordinal") % 9 == 0, F.concat(F.lit("New: "), "detail_ordinal")).otherwise(F.col("title")), "date": F.lit("d")})
    before, plain = written(), sum(r.n for r in (n.agg(F.sum(F.length("title")).alias("n")).first(), d.agg(F.sum(F.length("title")).alias("n")).first()))
    got = enrich_by_title(d, n).where("ordinal < 3000").groupBy("date").count().collect()
    assert {r["date"]: r["count"] for r in got} == {"d": 2666, None: 334}
    assert written() - before < 2 * plain
