"""Cases with known answers for rules and operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry import config
from quarry.functions import facts, ids, retrieval, text
from quarry.operators import catalog, chat, chunk, match, normalize, quality, queue, retrieve
from quarry.operators.html import access_state, classify_pages, extract_detail, extract_list_items, page_events


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(("given", "wanted"), [("28/08/2026", "2026-08-28"), ("03-08-2026", "2026-08-03"), (None, None), ("", None), ("soon", "soon")])
def test_date(spark, given, wanted):
    assert one(spark, facts.normalize_date, given) == wanted


def test_numbers(spark):
    assert one(spark, facts.document_number, "TRƯỜNG\nSố: 43 / TB-ĐHXYZ\nngày") == "43/TB-ĐHXYZ"
    assert one(spark, facts.document_number, "none here") is None
    assert one(spark, facts.document_number, "86: 31/TB-X") == "31/TB-X"
    assert one(spark, lambda c: facts.document_number(c, "import"), "86: 31/TB-X") is None
    assert one(spark, facts.title_number, "Thông báo 658 /TB-ĐHX về") == "658/TB-ĐHX"


def test_category_and_dates(spark):
    kind = lambda t: tuple(one(spark, facts.category, t))
    assert kind("Thu HỌC PHÍ kỳ 1") == ("Học phí", "Thu học phí & Bảo hiểm")
    assert kind("phúc khảo bài thi")[0] == "Khảo thí"
    assert kind("khác") == (None, None)
    assert one(spark, facts.posted_date, "Đăng lúc 28/12/2024 08:30:00") == "28/12/2024 08:30:00"
    assert one(spark, facts.issue_date, "Đà Lạt, ngày 3 tháng 8 năm 2026") == "2026-08-03"
    assert one(spark, facts.issue_date, "ngày 31 tháng 2 năm 2026") is None


def test_ids(spark):
    key = lambda u: one(spark, lambda c: ids.document_id(c, F.lit(""), F.lit(1)), u)
    assert key("http://a/b") == key("http://a/b") != key("http://a/c")
    assert one(spark, ids.slug, "https://x.example/tin/Thong-Bao-XYZ.html?a=1") == "thong-bao-xyz"
    assert one(spark, ids.normalize_title, "Về  việc A &nbsp; - 28/08/2026") == "về việc a"
    url = lambda u: one(spark, lambda c: ids.normalize_url(c, "https://h.example"), u)
    assert url("\\up\\\\a//b.pdf#p") == "https://h.example/up/a/b.pdf"
    assert url("/FileManager/ViewFileOnline?filePath=%2Fmedia%2Fx.pdf") == "https://h.example/media/x.pdf"
    assert url("https://k.example/a.pdf?v=2") == "https://k.example/a.pdf?v=2"
    assert one(spark, ids.magic_format, b"%PDF-1.7", "binary") == "pdf"


def test_text(spark):
    assert one(spark, text.clean_document_text, "a\r\n\tb  \n\n\n\nc\x00 ") == "a\n    b\n\nc"
    assert one(spark, text.clean_document_text, "ab\tc") == "ab  c"
    m = one(spark, text.text_metrics, "Văn bản có lỗi ~~~ ^^^ ||| {{{ }}} [[[")
    assert m.suspicious_character_ratio > 0.20
    assert one(spark, text.text_metrics, "x aaaaaaaaaaaaaa và bbbbbbbbbbb").repeated_character_ratio > 0.30
    blank = one(spark, lambda c: text.page_score(text.text_metrics(c), c), " \n ")
    assert (blank.score, blank.label) == (0, "POOR")
    assert one(spark, lambda c: text.text_metrics(c), None).text_length == 0


@pytest.mark.parametrize(("i", "w", "wanted"), [(0, 0, (100, "GOOD")), (0, 2, (90, "WARNING")), (1, 0, (75, "ERROR")), (10, 10, (0, "ERROR"))])
def test_quality_score(spark, i, w, wanted):
    assert tuple(spark.range(1).select(quality.quality_score(F.lit(i), F.lit(w)).alias("q")).first().q) == wanted


def test_keywords(spark):
    keys = lambda q: one(spark, retrieval.extract_keywords, q)
    for q in ("tôi tên gì", "liên quan gì", "thời tiết hôm nay thế nào"):
        assert keys(q) == []
    assert {"học phí", "học lại"} <= set(keys("học phí học lại bao nhiêu"))
    assert "31/tb" in keys("thông báo 31/TB nói gì")
    kind = lambda q: one(spark, retrieval.question_class, q)
    assert [kind(q) for q in ("tôi tên gì", "xin chào!", "  ", "x" * 501, "học phí bao nhiêu", "zzz")] == ["personal", "greeting", "invalid_empty", "invalid_long", "retrieve", "no_keywords"]


def test_scores(spark):
    pages = spark.createDataFrame([(0, "d1", 1, "Học phí", None, None, None, None, "học phí là học phí"), (1, "d2", 1, "Khác", None, None, None, None, "không")], "ordinal long, document_id string, page_number int, title string, document_number string, issue_date string, category string, subcategory string, text string")
    qs = spark.createDataFrame([(7, "học phí bao nhiêu"), (8, "zzz")], "question_id int, question string")
    got = retrieve.top_keyword(qs, pages, 10).collect()
    # one keyword: 20 for the title, 5 + 1 in the text, times 1.5
    assert [(r.question_id, r.document_id, r.score, r.rank) for r in got] == [(7, "d1", 39.0, 1)]


def test_cosine_and_fusion(spark):
    c = lambda a, b: spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(retrieval.cosine(F.col("a"), F.col("b")).alias("r")).first().r
    assert c([1.0, 2.0], [1.0, 2.0]) == pytest.approx(1.0)
    assert c([1.0, 0.0], [0.0, 1.0]) == 0.0
    assert c([1.0], [1.0, 2.0]) == 0.0
    kw = spark.createDataFrame([(1, "d", 1, 80.0, 1, "t", "x")], "question_id int, document_id string, page_number int, score double, rank int, text string, title string")
    sem = spark.createDataFrame([(1, "d", 1, 0.92, 1, "t", "x"), (1, "d", 1, 0.7, 2, "u", "x")], "question_id int, document_id string, page_number int, similarity double, rank int, text string, title string")
    best = retrieve.fuse_hybrid(kw, sem, config.Fusion(page_score="max")).first()
    assert best.final_score == pytest.approx(95.2)
    assert retrieve.fuse_hybrid(kw, sem).first().final_score == pytest.approx(82.0)
    assert retrieve.fuse_hybrid(kw, sem.where("false")).first().final_score == 80.0


def test_duplicates(spark):
    items = spark.createDataFrame([("u1", "c0", None, None), ("u2", "c1", None, None), ("u3", "c3", "1/TB", "2025"), ("u4", "c4", "1/TB", None), ("u5", "c5", "9/TB", "2024")], "detail_url string, checksum string, document_number string, year string")
    s = lambda name, *v: spark.createDataFrame([(x,) for x in v], f"{name} string")
    known = spark.createDataFrame([("1/TB", "2024")], "number string, year string")
    got = {r.detail_url: r.duplicate_status for r in catalog.classify_duplicates(items, s("url", "u1"), s("checksum", "c1"), known).collect()}
    assert got == {"u1": "EXACT", "u2": "EXACT", "u3": "NEW", "u4": "LIKELY", "u5": "NEW"}


def test_strict_match(spark):
    n = spark.createDataFrame([(0, "A title that is long enough", ["http://x/b.pdf"], None)], "ordinal long, title string, attachments array<string>, attachments_downloaded array<string>")
    e = spark.createDataFrame([(0, "z.pdf", "http://x/z.pdf", "other", -1), (1, "q.pdf", "HTTP://x/b.pdf ", "other", -1)], "file_ordinal long, source_file string, source_url string, notification_title string, notification_index int")
    assert match.match_extracted(n, e).select("match_rule", "file_ordinal").first() == (2, 1)
    pair = lambda **d: spark.range(1).select(match.match_detail_pair({k: F.lit(d.get(k, "")) for k in ("post_id", "canonical_url", "url", "title")}, {"post_id": F.lit("5"), "detail_url": F.lit("http://x/a.html"), "title": F.lit("A related title here")}).alias("r")).first().r
    assert pair(url="http://y/a.html") and pair(title="a related title  here") and pair(post_id="5")
    assert not pair(title="A related but different title") and not pair(post_id="6", url="http://x/a.html")


def test_validity(spark):
    page = lambda *t: [(i + 1, x, x) for i, x in enumerate(t)]
    cases = [
        ("due passed", page("Hạn cuối: đến ngày 01/02/2026"), "deadline_passed", "HIGH"),
        ("due open", page("Thời hạn nộp đến ngày 01/02/2027"), "active", "HIGH"),
        ("expired", page("hết hiệu lực từ ngày 1 tháng 2 năm 2026"), "expired", "HIGH"),
        ("replaces", page("văn bản này thay thế Quyết định số 12/QĐ-X"), "replaced", "HIGH"),
        ("in force", page("Huế, ngày 2 tháng 1 năm 2026", "có hiệu lực kể từ ngày ký"), "active", "MEDIUM"),
        ("Quy chế đào tạo", page("..."), "active", "MEDIUM"),
        ("none", page("nothing"), "unverified", "LOW"),
        ("bad date", page("Hạn cuối 31/02/2026"), "unverified", "LOW"),
        ("no pages", None, "unverified", "LOW"),
    ]
    df = spark.createDataFrame([(t, p, None, None, None) for t, p, _, _ in cases], "title string, pages array<struct<page_number:int,raw_text:string,cleaned_text:string>>, issue_date string, deadline string, replaced_by string")
    got = {r.title: (r.suggested_status, r.certainty) for r in facts.validity_status(df, "2026-09-26").collect()}
    assert got == {t: (s, c) for t, _, s, c in cases}
    other = {r.title: r for r in facts.validity_status(df, "2026-09-26", parity=False).collect()}
    assert other["replaces"].suggested_status == "unverified" and other["replaces"].replaces == "12/QĐ-X"


def test_chunks(spark):
    long = "\n\n".join(["One sentence here. " * 10, "b" * 700, "Another. " * 120, "tail"])
    got = one(spark, chunk.chunk_texts, long)
    assert "".join("".join(got).split()) == "".join(long.split())
    assert all(len(x) <= 750 for x in got)
    assert one(spark, chunk.chunk_texts, " short ") == ["short"]
    assert one(spark, chunk.chunk_texts, None) == []


def test_stop_at_repeat(spark):
    rows = [(1, "a"), (1, "b"), (2, "c"), (3, "b"), (3, "a"), (4, "d")]
    got = catalog.stop_at_repeat(spark.createDataFrame(rows, "page int, url string")).select("page").distinct().collect()
    assert sorted(r.page for r in got) == [1, 2]


def test_sources(spark):
    cat = spark.createDataFrame([("d", "T", None, None, None, 2, [(1, "x", "x"), (2, "y", "y")], "", "http://d", 0)], "id string, title string, document_number string, issue_date string, category string, total_pages int, pages array<struct<page_number:int,raw_text:string,cleaned_text:string>>, source_url string, detail_url string, ordinal long")
    got = spark.createDataFrame([(1, "d", 9, 1, "some text", ["text"]), (1, "d", 2, 2, "more", ["m"]), (1, "gone", 1, 3, "x", ["x"])], "question_id int, document_id string, page_number int, rank int, text string, matched array<string>")
    (r,) = retrieve.build_sources(got, cat).collect()
    assert (r.page, r.url, r.source_url, r["rank"]) == (2, "/documents/d#page-2", "http://d", 1)


def test_excerpt(spark):
    t = "\n".join(["HEADING IN CAPITALS", "the first line of the text", "a line with the fee in it", "a line that follows it here", "and one more after that line", "the last line is not near it"])
    got = spark.createDataFrame([(t, ["fee"]), (t, ["zzz"])], "t string, k array<string>").select(retrieve.excerpt_lines(F.col("t"), F.col("k")).alias("r")).collect()
    assert [len(r.r) for r in got] == [4, 5]


def test_queue(spark):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    files = spark.createDataFrame([("b", "a.pdf", 5, "c1", 0), ("b", "a2.pdf", 5, "c1", 1), ("b", "x.doc", 5, "c2", 2), ("b", "e.pdf", 0, "c3", 3), ("b", "k.docx", 5, "ck", 4)], "batch_id string, name string, size_bytes long, checksum string, file_ordinal long")
    known = spark.createDataFrame([("q1", "ck", "PENDING")], "id string, checksum string, status string")
    v = queue.validate_uploads(files)
    assert {r.name: r.error for r in v.collect()} == {"a.pdf": None, "a2.pdf": None, "x.doc": "OLD_DOC_FORMAT", "e.pdf": "EMPTY_FILE", "k.docx": None}
    got = {r.name: (r.status, r.existing_id) for r in queue.intake(v, known, now).collect()}
    assert got["a.pdf"] == ("PENDING", None) and got["a2.pdf"][0] == "DUPLICATE" and got["k.docx"] == ("DUPLICATE", "q1")


def test_conversations(spark):
    title = lambda q: one(spark, retrieval.conversation_title, q)
    assert title("  short   one ") == "short one"
    assert title("word " * 20) == ("word " * 9).strip() + "..."
    assert title("x" * 60) == "x" * 48 + "..."
    at = dt.datetime(2026, 5, 10, 12)
    c = spark.createDataFrame([(str(n), "u", "t", at, at - dt.timedelta(days=n)) for n in (0, 1, 6, 7)], "id string, user_id string, title string, created_at timestamp, updated_at timestamp")
    assert [r.bucket for r in chat.conversation_buckets(c, F.lit("2026-05-10")).collect()] == ["today", "yesterday", "last7Days", "older"]


LIST = """<table><tr><td><a href="/tin/mot-bai.html">Một thông báo dài thứ nhất</a></td><td>01/02/2026</td></tr>
<tr><td><a href="tin/hai.html">Một thông báo dài thứ hai</a></td><td>03/04/2026 08:30</td></tr><tr><td><a href="#">Bỏ qua liên kết này</a></td></tr></table>"""
DETAIL = """<html><head><title>Trang</title><link rel="canonical" href="/tin/x.html"></head><body><h1>Tiêu đề của thông báo</h1><nav>menu</nav>
<div class="noidung">Nội dung thông báo dài hơn hai mươi ký tự <script>no()</script></div><a href="/files/a.pdf">tải</a><a href="/b.docx">b</a><a href="/b.docx">again</a>
<a href="/upload/c.zip">c</a><iframe src="/d.pdf"></iframe></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, LIST), (2, DETAIL), (3, None)], "page_id long, html string")
    e = page_events(pages)
    items = extract_list_items(e, "https://h.example/x")
    got = sorted((r.page_id, r.title, r.date, r.detail_url) for r in items.collect())
    assert got == [(1, "Một thông báo dài thứ hai", "03/04/2026 08:30", "https://h.example/tin/hai.html"), (1, "Một thông báo dài thứ nhất", "01/02/2026", "https://h.example/tin/mot-bai.html")]
    details = extract_detail(e, "https://h.example")
    d = {r.page_id: r for r in details.collect()}[2]
    assert d.title == "Tiêu đề của thông báo" and d.detail_url == "https://h.example/tin/x.html" and d.content.startswith("Nội dung") and "no()" not in d.content
    assert d.attachments == [f"https://h.example/{x}" for x in ("files/a.pdf", "b.docx", "upload/c.zip", "d.pdf")]
    assert {r.page_id: r.page_kind for r in classify_pages(pages, items, details).collect()} == {1: "list", 2: "detail", 3: "empty"}
    assert one(spark, lambda c: access_state(c, F.lit(""), F.lit(200)), '<input name="username"><input name="password">') == "login"


def test_assembled_content(spark):
    pages = [(2, "b", "b"), (1, "a", "a"), (3, "raw", "")]
    kind = "array<struct<page_number:int,raw_text:string,cleaned_text:string>>"
    assert one(spark, normalize.assemble_content, pages, kind) == "a\n\nb"
    assert one(spark, lambda c: normalize.assemble_content(c, True), pages, kind) == "a\n\nb\n\nraw"


def test_clauses_have_their_signs():
    """Each clause's pattern asks for one of its signs, so that looking for them first loses nothing."""
    from quarry.functions.facts import CLAUSES, SIGNS

    assert set(SIGNS) == set(CLAUSES)
    said = {
        "issue": "Hà Nội, NGÀY 1 THÁNG 2 NĂM 2024", "replaces": "THAY THẾ Quyết định số 12/QĐ", "until_new": "Quy định này có HIỆU LỰC từ nay cho đến khi có thông báo mới", "signed": "có HIỆU LỰC kể từ ngày ký",
        "from": "có hiệu lực từ ngày 1 tháng 2 năm 2024", "to": "hết hiệu lực từ ngày 1 tháng 2 năm 2024", "due": "HẠN CUỐI đến ngày 01/02/2024", "event": "DIỄN RA VÀO ngày 01/02/2024", "before": "TRƯỚC ngày 01/02/2024",
    }
    assert all(any(sign in said[k] for sign in SIGNS[k]) for k in CLAUSES)


def test_strip_and_marks(spark):
    import re

    from quarry.functions.text import BLANKS, strip, text_marks

    texts = ["", " 　a b \n", "﻿\x1c", "x" * 5 + "\n" * 9 + "yyyyyy zzzz", "no runs here.", " ab\u0085c​ "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", "t", strip(F.col("t")).alias("s"), text_marks(F.col("t")).alias("m")).collect():
        assert r.s == r.t.strip(BLANKS)
        assert (r.m.ink, r.m.inner) == (sum(c not in BLANKS for c in r.t), len(r.s))
        assert r.m.runs == len(re.findall(r"([^\n])\1{4,}", r.t)) and r.m.letters == sum(c.isalnum() for c in r.t)
