"""Stored indices give what a search over everything gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import config
from quarry.operators import postings, retrieve, vector_index

LISTS = config.Keywords(stopwords=("and",), compounds=("of the", "the end of", "a a", "x y"), core_words=("the", "en", "a"), synonyms=())
PAGES = "ordinal long, document_id string, page_number int, title string, document_number string, issue_date string, category string, subcategory string, text string"


@pytest.mark.parametrize("seed", range(2))
def test_postings(spark, tmp_path, seed, monkeypatch):
    rng = random.Random(seed)
    words = ["of", "the", "end", "ends", "the,end", "a", "aa", "thesis", "Rules", "12/TB", "2024", "x", "y", "academics", "'the'", "(end)", "Điều", "otherwise", "the\tend", "of  the", "\n", "enable"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", "\t"]) for _ in range(n))
    rows = [(i, f"d{i // 2}", i % 2 + 1, text(4), rng.choice([None, "12/TB", "7/TB"]), None, rng.choice(["the", "end rules", None]), "a", rng.choice([text(30), text(8), "", " \n", None])) for i in range(60)]
    pages = spark.createDataFrame(rows, PAGES)
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(["of the end", "what is the end of rules", "academic thesis", "12/TB of 2024", "a a otherwise", "x y", "the enable", "ends academics", "điều rules the", "zzz", ""])], "question_id int, question string")
    path = f"file://{tmp_path}/index"
    for half in (0, 1):
        postings.append_postings(pages.where(F.col("ordinal") % 2 == half), path)
    key = lambda df: sorted((r.question_id, r.ordinal, r.page_number, r["rank"], r.score, tuple(r.matched)) for r in df.collect())
    wanted = key(retrieve.top_keyword(asked, pages, 5.0, 6, LISTS))
    assert len(wanted) > 20
    got = postings.top_keyword_indexed(asked, path, 5.0, 6, LISTS)
    assert key(got) == wanted
    # texts aren't read again: they aren't there
    assert "text" not in got.columns and set(got.inputFiles()) == {f for f in got.inputFiles() if "/index/" in f or "ordinals" in f or "asked" in f or "keyword-tokens" in f}
    with pytest.raises(ValueError):
        postings.top_keyword_indexed(asked, path, lists=config.Keywords(stopwords=(), compounds=("of  the",), core_words=("the",), synonyms=()))


def test_postings_are_folded(spark, tmp_path):
    """A token is a row of a block of pages, not of each page."""
    rows = [(i, f"d{i}", 1, "Rules", None, None, "end", "a", "of the end " * 5) for i in range(600)]
    postings.append_postings(spark.createDataFrame(rows, PAGES).coalesce(1), f"file://{tmp_path}/index")
    stored = spark.read.parquet(f"file://{tmp_path}/index/postings")
    assert stored.count() == 5 and stored.agg(F.sum(F.size("place")), F.sum(F.size("spots"))).first() == (600 * 6, 600 * 18)


@pytest.mark.parametrize("most", [0, 1000])
def test_postings_of_scattered_pages(spark, tmp_path, monkeypatch, most):
    """Ordinals of any sign and distance, many pages of one document; words looked up beforehand, or in all postings."""
    monkeypatch.setattr(postings, "WORDS", most)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice(["of", "the", "of  the", "end", "Điều", "xthe", "ofx", "a", "aa", "ends", "𐐷the"]) + rng.choice(" \n ") for _ in range(n))
    rows = [(i // 7 * 700 - 9000, f"d{i // 7}", i % 7 * 3 - 4, text(3), None, None, text(2), None, text(12)) for i in range(210)]
    pages = spark.createDataFrame(rows, PAGES)
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(["of the end", "what is the end of rules", "a a end", "điều the", "ends"])], "question_id int, question string")
    for part in (0, 1, 2):
        postings.append_postings(pages.where(F.pmod("page_number", F.lit(3)) == part), f"file://{tmp_path}/index")
    key = lambda df: sorted((r.question_id, r.ordinal, r.page_number, r["rank"], r.score, tuple(r.matched)) for r in df.collect())
    wanted = key(retrieve.top_keyword(asked, pages, 1.0, 9, LISTS))
    assert len(wanted) > 20 and key(postings.top_keyword_indexed(asked, f"file://{tmp_path}/index", 1.0, 9, LISTS)) == wanted


def test_postings_in_small_parts(monkeypatch):
    """What is gathered and scored at once has no part in what is found."""
    from types import SimpleNamespace

    import pyarrow as pa
    import pyarrow.compute as pc

    from quarry.operators import keyword_scores

    rng = random.Random(2)
    asked = keyword_scores.Asked(words := [["aa", "of the"], ["fee"], ["the end of"], ["the", "end"]], words, ("of the", "the end of"))
    text = lambda n: pa.array([" ".join(rng.choice(["aa", "of", "the", "end", "fee", "coffee", "aaaa", "of\nthe"]) for _ in range(rng.randrange(n))) for _ in range(300)])
    batch = pa.RecordBatch.from_arrays([pa.array(sorted(rng.sample(range(5000), 300))), pa.array([1] * 300, pa.int32()), *[text(4) for _ in range(4)], text(20)], names=list("abcdefg"))
    best = lambda made: {q: sorted([(-r["score"], r["ordinal"], r["matched"]) for b in made for r in b.to_pylist() if r["q"] == q])[:5] for q in range(4)}
    wanted = best(list(keyword_scores.best_of_texts(SimpleNamespace(value=asked), 1.0, 5)(iter([batch]))))
    rows = pa.Table.from_batches(list(postings._postings(iter([batch]))))
    # blocks 0 to 4, of which two have the same number to sort by
    rows = rows.append_column("by", pc.bit_wise_and(rows["block"], 3)).sort_by("by")
    for gathered, pairs in ((1 << 20, 1 << 20), (1, 1), (3000, 40)):
        monkeypatch.setattr(postings, "GATHERED", gathered)
        monkeypatch.setattr(postings, "PAIRS", pairs)
        assert best(list(postings._best_of_postings(SimpleNamespace(value=asked), 1.0, 5)(iter(rows.to_batches(max_chunksize=7))))) == wanted
    assert all(len(x) == 5 for x in wanted.values())


@pytest.mark.parametrize("least, k", [(0.65, 4), (-1.0, 3), (0.9, 50)])
def test_vector_index(spark, tmp_path, least, k):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 8))
    m = np.concatenate([middles[rng.integers(12, size=900)] * rng.uniform(0.5, 2, size=(900, 1)) + rng.normal(scale=0.05, size=(900, 8)), np.repeat(middles[:1], 300, 0), np.zeros((3, 8))])
    rows = [(i, f"d{i}", [float(x) for x in v]) for i, v in enumerate(m)] + [(5000, "short", [1.0]), (5001, "none", None)]
    vectors = spark.createDataFrame(rows, "ordinal long, document_id string, embedding array<float>")
    asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate([*(middles[:5] + 0.02), *rng.normal(size=(5, 8)), np.zeros(8)])] + [(99, [1.0]), (98, None)], "question_id int, embedding array<float>")
    path = f"file://{tmp_path}/vectors"
    vector_index.write_index(vectors, path, 8, clusters=16)
    full = retrieve.top_semantic(asked.where("size(embedding) = 8"), vectors, least, k)
    key = lambda df: sorted((r.question_id, r["rank"], r.ordinal, r.document_id, r.similarity, r.relevance) for r in df.collect())
    assert key(vector_index.top_semantic_indexed(asked, path, least, k)) == key(full)
    skipped = {r.question_id: r for r in vector_index.skipped_clusters(asked, path, least, k).collect()}
    assert len(skipped) == 11 and all(r.n_vectors == 1203 for r in skipped.values())
    if k < 50:
        # questions beside a middle need few of the clusters
        assert sum(skipped[q].n_skipped_vectors for q in range(5)) > 0.6 * 5 * 1203


def test_no_vectors(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    vector_index.write_index(spark.createDataFrame([], "ordinal long, embedding array<float>"), path, 4)
    assert vector_index.top_semantic_indexed(spark.createDataFrame([(1, [0.0] * 4)], "question_id int, embedding array<float>"), path).count() == 0


def test_products_are_sliced(monkeypatch):
    rng = np.random.default_rng(1)
    m, q = rng.normal(size=(500, 6)), rng.normal(size=(40, 6))
    whole = {(i, o) for b in retrieve.nearest_in(m, np.arange(500), q, np.arange(40), 0.2, 500) for i, o in zip(b.column("q").to_pylist(), b.column("ordinal").to_pylist(), strict=True)}
    monkeypatch.setattr(retrieve, "PRODUCTS", 400)
    parts = list(retrieve.nearest_in(m, np.arange(500), q, np.arange(40), 0.2, 500))
    assert len(parts) == 50 and whole == {(i, o) for b in parts for i, o in zip(b.column("q").to_pylist(), b.column("ordinal").to_pylist(), strict=True)}


def test_keyword_search_bounds_its_batches(spark):
    """Pages reach a Python worker in batches of a limited size, whatever the session's limit was."""
    from quarry import queries as library

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(64 << 20))
    try:
        library.keyword_hits(spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(key)) <= 8 << 20
    finally:
        spark.conf.set(key, old)


def test_only_the_best_of_a_batch_leave_a_task():
    """Scores of pages and questions are folded where pages are read: k rows a question and batch, whatever they hold."""
    from types import SimpleNamespace

    import pyarrow as pa

    from quarry.operators import keyword_scores

    asked = keyword_scores.Asked([["aa", "of the"], ["fee"], ["aa"]], [["aa", "of the"], ["fee"], ["aa"]], ("of the",))
    texts = ["aaaaa aa, fee of the", "coffee", "of\nthe aa", "(fee) fee", *["aa of the fee"] * 200]
    empty = pa.array([""] * len(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([1] * len(texts), pa.int32()), *[empty] * 4, pa.array(texts)], names=list("abcdefg"))
    (out,) = keyword_scores.best_of_texts(SimpleNamespace(value=asked), 1.0, 3)(iter([batch]))
    rows = sorted((r["q"], -r["score"], r["ordinal"], r["matched"]) for r in out.to_pylist())
    # "aa" stands three times in "aaaaa aa" without overlap; a page without "of the" isn't an answer to a question with it
    assert rows[:3] == [(0, -18.0, 0, ["aa", "of the"]), (0, -15.0, 4, ["aa", "of the"]), (0, -15.0, 5, ["aa", "of the"])]
    assert rows[3:6] == [(1, -9.0, 3, ["fee"]), (1, -7.5, 0, ["fee"]), (1, -7.5, 4, ["fee"])]
    assert rows[6:] == [(2, -10.5, 0, ["aa"]), (2, -7.5, 2, ["aa"]), (2, -7.5, 4, ["aa"])]
