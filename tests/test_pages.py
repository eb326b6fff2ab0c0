"""Pages are parsed once, whatever is read off them."""

import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import html

BASE = "https://h.example"
LISTED = "<div>" + "".join(f'<a href="/tin-tuc/bai-{i}.html">Article number {i} of the list</a> 0{i % 9 + 1}/02/2024 ' for i in range(5)) + "</div>"
CARDS = '<div class="news-item"><h3><a href="/c1.html">The first of the cards</a></h3><a href="/c1b.html">Read on here</a> 05/06/2024</div><li class="media"><a href="c2.html">The second card there is</a></li>'
FORM = '<input name="username"><input name="password"><a href="/tin-tuc/x.html">A link beside the login</a>'
PAGES = [(0, LISTED), (1, CARDS), (2, FORM), (3, "  "), (4, None), (5, "<h1>A heading that is long enough</h1>"), (6, "<p>nothing</p>"), (7, '<a download href="/x">get</a><a href="/files/y">z</a>'), (8, "<div><article>open <b>tags <a href='/tin-tuc/q.html'>left open as they are")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, h, "kept") for i, h in PAGES], "page_id long, html string, text string")


def test_kinds_agree_with_items_and_details(spark, pages):
    e = html.page_events(pages)
    wanted = {r.page_id: r.page_kind for r in html.classify_pages(pages, html.extract_list_items(e, BASE), html.extract_detail(e, BASE)).collect()}
    assert wanted == {0: "list", 1: "list", 2: "login_page", 3: "empty", 4: "empty", 5: "detail", 6: "unknown", 7: "detail", 8: "list"}
    assert {r.page_id: r.page_kind for r in html.page_kinds(pages, BASE).collect()} == wanted


def test_items_of_cards_and_links(spark, pages):
    got = {(r.page_id, r.pos): (r.title, r.date, r.detail_url) for r in html.extract_list_items(html.page_events(pages), BASE).collect()}
    assert {v for (p, _), v in got.items() if p == 1} == {("The first of the cards", "05/06/2024", f"{BASE}/c1.html"), ("The second card there is", "", f"{BASE}/c2.html")}
    # links of one element share its first date
    assert {v[1] for (p, _), v in got.items() if p == 0} == {"01/02/2024"}


def test_one_pass(spark, pages, capsys):
    e, known = html.page_events(pages), spark.createDataFrame([], "url string")
    plans = [html.extract_list_items(e, BASE), html.extract_detail(e, BASE), html.page_kinds(pages, BASE), html.discover_links(e, known, BASE)]
    for df in plans:
        capsys.readouterr()
        df.explain()
        assert capsys.readouterr().out.count("MapInArrow") == 1
    for df in plans[1:3]:
        df.explain()
        assert "Exchange" not in capsys.readouterr().out


def test_many_links_in_one_element(spark):
    n = 30_000
    page = "<div>" + "".join(f'<a href="/tin-tuc/{i}.html">Article number {i} of many</a> text ' for i in range(n)) + "</div>"
    began = time.time()
    model = html._model(page)
    assert len(model["events"]) == n and len(model["blocks"]) == 1 and time.time() - began < 20


def test_sections_end(spark):
    """From the third page on, a section ends with its first page that adds nothing."""
    link = lambda u: f'<a href="/{u}.html">A link to the page {u}</a>'
    rows = [(1, "a", 1, link("a1")), (2, "a", 2, ""), (3, "a", 3, link("a3")), (4, "a", 4, link("a1")), (5, "a", 5, link("a5")), (6, "b", 1, ""), (7, "b", 3, link("known")), (8, "b", 4, link("b4"))]
    pages = spark.createDataFrame(rows, "page_id long, section string, page int, html string")
    got = html.discover_links(html.page_events(pages), spark.createDataFrame([(f"{BASE}/known.html",)], "url string"), BASE, sections=pages.select("page_id", "section", "page"))
    assert sorted(r.url.rsplit("/")[-1] for r in got.collect()) == ["a1.html", "a3.html"]
    assert html.discover_links(html.page_events(pages), spark.createDataFrame([], "url string"), BASE).where(F.col("page_id") == 5).count() == 1


def test_parsing_bounds_its_batches(spark):
    """Pages reach the parser in batches of a limited size, and leave it a limited number at a time."""
    from quarry.operators import html as pages_of

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(64 << 20))
    try:
        n = 3 * pages_of.PARSED_PAGES + 5
        pages = spark.range(n, numPartitions=1).selectExpr("id as page_id", "concat('<a href=\"/p', id, '\">a link of a page</a>') as html")
        got = pages_of.page_events(pages).selectExpr("page_id", "events[0].href as href").collect()
        assert int(spark.conf.get(key)) <= 8 << 20
        assert sorted((r.page_id, r.href) for r in got) == [(i, f"/p{i}") for i in range(n)]
    finally:
        spark.conf.set(key, old)
