"""Stored HTML to list items, details, links: one map over pages with the standard library's parser (markup nests, which
patterns can't follow) makes a nested row a page, and every operator is columns over that row."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions.facts import posted_date, title_number
from quarry.functions.ids import absolute_url, normalize_url
from quarry.functions.text import collapse_space, txt
from quarry.operators.match import valid_notice
from quarry.sources.shared import bound_batches, stored

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "noscript", "template"))
# Classes of list blocks and of content, what stands outside the content, and what marks an attachment.
CARDS = ("tin-tuc-item", "news-item", "item-news", "item-thong-bao", "list-group-item", "media", "post-item", "article-item")
CONTENT = ("detail-tin", "detail-content", "news-detail", "post-content", "article-content", "content-detail", "noidung-tin", "noidung", "content-txt", "article", "main-content", "content")
OUTSIDE_TAGS = frozenset(("header", "footer", "nav", "aside"))
OUTSIDE_CLASSES = frozenset(("header", "footer", "menu", "user-account", "search-bar", "breadcrumb", "sidebar", "menu-btn", "notification", "notification2", "tin-lien-quan", "tin-tuc-khac", "right-sidebar"))
DOWNLOAD_FOLDERS = r"(?i)/download/|/upload/|/files/|/van-ban/|viewfile|filemanager"
DOWNLOAD_WORDS = r"(?iu)tải về|đính kèm|download|tải file|\.pdf|\.doc|xem:"
ARTICLE = r"(?i)(chi-tiet|thong-bao|tin-tuc|bai-viet).*\.html$"
ELEMENT = "struct<kind:string,pos:int,block:int,first:boolean,href:string,title:string,text:string>"
MODEL = f"events array<{ELEMENT}>, blocks map<int,string>, content string, text string"
ADDED = ("events", "blocks", "content", "text")
#: Pages whose parsed rows a Python worker holds at once.
PARSED_PAGES = 128


def _usable_href(href: str) -> bool:
    return href != "" and not href.startswith("javascript:") and href != "#"


class _Tree(HTMLParser):
    """A page in one pass: its links, headings, embeds, inputs and addresses in order, and its text in pieces, of which every
    element has those from its start tag to its end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # (tag, content classes, number, what it adds to hidden, to outside and to tables)
        self.stack: list[tuple[str, frozenset[str], int, int, int, int]] = []
        self.out: list[dict] = []
        self.open: list[dict] = []
        self.pieces: list[str] = []
        self.span: dict[int, list[int]] = {}
        self.main: dict[str, list[str]] = {"": []}
        self.within: dict[str, int] = {}
        self.hidden = self.outside = self.tables = self.next = 0
        self.wanted: set[int] = set()
        self.seen: set[tuple[str, int | None]] = set()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        self.next += 1
        classes = set(a.get("class", "").lower().split())
        if tag == "article":
            classes.add("article")
        if a.get("id") == "content":
            classes.add("content")
        if tag == "a":
            self._link(a)
        elif tag in ("h1", "h2", "h3", "title"):
            self._open(tag, "", a.get("title", ""))
        elif tag in ("iframe", "embed", "object"):
            self._add("embed", (a.get("src") or a.get("data") or "").strip(), a.get("class", ""))
        elif tag == "link" and "canonical" in a.get("rel", ""):
            self._add("canonical", a.get("href", "").strip(), "")
        elif tag == "meta" and "og:url" in a.get("property", "").lower():
            self._add("og_url", a.get("content", "").strip(), "")
        elif tag == "input":
            self._add("input", a.get("name", ""), a.get("class", ""))
        if tag not in VOID:
            own = frozenset(classes.intersection(CONTENT))
            element = (tag, frozenset(classes), self.next, int(tag in HIDDEN), int(tag in OUTSIDE_TAGS or not classes.isdisjoint(OUTSIDE_CLASSES)), int(tag == "table"))
            self.stack.append(element)
            self.span[self.next] = [len(self.pieces), -1]
            self._count(element, own, 1)

    def _count(self, element: tuple, own: frozenset[str], by: int) -> None:
        self.hidden, self.outside, self.tables = self.hidden + by * element[3], self.outside + by * element[4], self.tables + by * element[5]
        for c in own:
            self.within[c] = self.within.get(c, 0) + by

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                for element in self.stack[i:]:
                    self.span[element[2]][1] = len(self.pieces)
                    self._count(element, element[1].intersection(CONTENT), -1)
                del self.stack[i:]
                break
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                del self.open[i]
                break

    def _add(self, kind: str, href: str, title: str, block: int | None = None, first: bool = False) -> dict:
        self.out.append({"kind": kind, "pos": len(self.out), "block": block, "first": first, "href": href, "title": title, "parts": []})
        return self.out[-1]

    def _open(self, tag: str, href: str, title: str, kind: str = "", block: int | None = None, first: bool = False) -> None:
        self.open.append({"tag": tag, "parts": self._add(kind or tag, href, title, block, first)["parts"]})

    def _link(self, a: dict[str, str]) -> None:
        """A link with the table row, card or parent that it is in."""
        row = card = parent = None
        for tag, classes, ident, *_ in self.stack:
            row = ident if tag == "tr" and self.tables else row
            parent = ident if tag in ("div", "li", "tr", "article") else parent
            card = ident if card is None and not classes.isdisjoint(CARDS) else card
        block, kind = row or card or parent, "row" if row else "card" if card else "link"
        href = a.get("href", "").strip()
        first = kind != "link" and _usable_href(href) and (kind, block) not in self.seen
        if first:
            self.seen.add((kind, block))
        if block:
            self.wanted.add(block)
        self._open("a", href, a.get("title", "") or ("download" if "download" in a else ""), kind, block, first)

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        for e in self.open:
            e["parts"].append(data)
        if not data.strip():
            return
        self.pieces.append(data)
        if not self.outside:
            self.main[""].append(data)
            for c, n in self.within.items():
                if n:
                    self.main.setdefault(c, []).append(data)


def _model(html: str | None) -> dict:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    main = next((tree.main[c] for c in CONTENT if len("".join(x.strip() for x in tree.main.get(c, ()))) > 20), tree.main[""])
    lines = [x.strip() for part in main for x in part.split("\n")]
    for e in tree.out:
        e["text"] = " ".join(" ".join(e.pop("parts")).split())
    blocks = [(k, " ".join(tree.pieces[slice(lo, hi if hi >= 0 else None)])) for k, (lo, hi) in tree.span.items() if k in tree.wanted]
    return {"events": tree.out, "blocks": blocks, "content": "\n".join(x for x in lines if x), "text": " ".join(tree.pieces)}


def page_events(pages: DataFrame) -> DataFrame:
    """Pages (page_id, html, ...) as one nested row each, without the html: events are its links (kind row, card or link, by
    where they stand), headings, embeds, inputs and addresses in order; a link's block is the row, card or element around
    it, whose text blocks has, and first marks the first usable link of a row or card. content and text are the page's.
    Links of one block share its text, so a list of many links in one element isn't copied for each. A worker holds a batch of
    limited bytes and the rows of PARSED_PAGES pages."""
    bound_batches(pages.sparkSession)
    kept = pages.drop(*ADDED)
    names = [c for c in kept.columns if c != "html"]
    fields = [pa.field("events", pa.list_(pa.struct([("kind", pa.string()), ("pos", pa.int32()), ("block", pa.int32()), ("first", pa.bool_()), ("href", pa.string()), ("title", pa.string()), ("text", pa.string())]))), pa.field("blocks", pa.map_(pa.int32(), pa.string())), pa.field("content", pa.string()), pa.field("text", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(lo, PARSED_PAGES) for whole in batches for lo in range(0, whole.num_rows, PARSED_PAGES)):
            models = [_model(h.as_py()) for h in b.column("html")]
            made = [pa.array([m[f.name] for m in models], f.type) for f in fields]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *made], names=[*names, *ADDED])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "html"), MODEL])
    return kept.select(*names, "html").mapInArrow(run, schema)


def _usable(href: Column) -> Column:
    return (href != "") & ~href.startswith("javascript:") & (href != "#")


def _is_link(e: Column) -> Column:
    return e["kind"].isin("row", "card", "link") & _usable(e["href"])


def _title(e: Column) -> Column:
    return collapse_space(F.coalesce(F.nullif(e["text"], F.lit("")), e["title"]))


def _listed(article: str, generic: tuple[str, ...], navigation: tuple[str, ...]) -> list[Column]:
    """Of a page's events the valid links of rows, of cards, and those that look like articles."""
    ok = lambda e: _is_link(e) & valid_notice(_title(e), e["href"], generic, navigation)
    return [
        F.filter("events", lambda e: (e["kind"] == "row") & e["first"] & ~e["href"].contains("page=") & ok(e)),
        F.filter("events", lambda e: (e["kind"] == "card") & e["first"] & ok(e)),
        F.filter("events", lambda e: e["href"].rlike(article) & ~e["href"].contains("dm-tin") & ok(e)),
    ]


def extract_list_items(events: DataFrame, base: str, generic: tuple[str, ...] = config.GENERIC_TITLES, navigation: tuple[str, ...] = config.NAVIGATION, article: str = ARTICLE) -> DataFrame:
    """(page_id, pos, title, date, detail_url, document_number): the valid links of table rows, else of cards, else links
    that look like articles; the first kind with results wins per page, a url counts once, the first of a block."""
    rows, cards, links = _listed(article, generic, navigation)
    # kinds of a page are columns, so that each is made once
    kinds = events.select("page_id", "blocks", rows.alias("_r"), cards.alias("_c"), links.alias("_l"))
    best = F.when(F.size("_r") > 0, F.col("_r")).when(F.size("_c") > 0, F.col("_c")).otherwise(F.col("_l"))
    e = kinds.select("page_id", F.transform_values("blocks", lambda k, t: posted_date(t)).alias("_dates"), F.explode(best).alias("e"))
    ok = e.select("page_id", F.col("e.pos").alias("pos"), _title(F.col("e")).alias("title"), F.coalesce(F.col("_dates")[F.col("e.block")], F.lit("")).alias("date"), absolute_url(F.col("e.href"), base).alias("detail_url"))
    first = ok.groupBy("page_id", "detail_url").agg(F.min_by(F.struct("pos", "title", "date"), "pos").alias("f"))
    return first.select("page_id", "f.pos", "f.title", "f.date", "detail_url", F.nullif(title_number(F.col("f.title")), F.lit("")).alias("document_number"))


def _heading(own_words: tuple[str, ...]) -> Column:
    """The first heading of over 10 characters without one of own_words, else the title tag, else empty."""
    low = lambda e: F.lower(e["text"])

    def heading(e: Column) -> Column:
        out = e["kind"].isin("h1", "h2", "h3") & (F.length(e["text"]) > 10)
        for w in own_words:
            out = out & ~F.contains(low(e), F.lit(w))
        return out

    tag = lambda e: (e["kind"] == "title") & (F.length(e["text"]) > 5) & ~F.contains(low(e), F.lit("đăng nhập"))
    first = lambda test: F.get(F.filter("events", test), F.lit(0))["text"]
    return F.coalesce(first(heading), first(tag), F.lit(""))


def _attachments(base: str) -> Column:
    """Addresses of attachments: from links, then from frames, distinct in order."""
    offered = lambda e: e["href"].rlike(config.ATTACHMENT_EXTENSION) | e["href"].rlike(DOWNLOAD_FOLDERS) | e["text"].rlike(DOWNLOAD_WORDS) | (e["title"] == "download")
    linked = F.filter("events", lambda e: _is_link(e) & offered(e))
    framed = F.filter("events", lambda e: (e["kind"] == "embed") & e["href"].rlike(config.ATTACHMENT_EXTENSION))
    # the rules of an address are a large expression, so it stands in the plan once
    found = F.transform(F.concat(linked, framed), lambda e: F.struct((e["kind"] == "embed").alias("framed"), normalize_url(e["href"], base).alias("u")))
    good = F.filter(found, lambda x: x["framed"] | x["u"].rlike(config.ATTACHMENT_EXTENSION) | x["u"].rlike(r"(?i)/upload/|/media/|/files/"))
    return F.array_distinct(F.transform(good, lambda x: x["u"]))


def extract_detail(events: DataFrame, base: str, own_words: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, title, date, detail_url, content, attachments). title: the first heading of over 10 characters without one
    of own_words (a site's own name), else the title tag. attachments: from links, then from frames, distinct in order."""
    address = lambda kind: F.get(F.filter("events", lambda e: (e["kind"] == kind) & (e["href"] != "")), F.lit(0))["href"]
    # the address is a column of its own, so that it is resolved once
    found = events.withColumn("_href", F.coalesce(address("canonical"), address("og_url")))
    return found.select(
        "page_id", _heading(own_words).alias("title"), posted_date(F.col("text")).alias("date"), F.coalesce(absolute_url(F.col("_href"), base), F.lit("")).alias("detail_url"),
        F.coalesce("content", F.lit("")).alias("content"), _attachments(base).alias("attachments"),
    )


def access_state(html: Column, url: Column, http_status: Column) -> Column:
    """login, captcha, blocked or ok, in that order."""
    h = txt(html)
    login = F.lower(txt(url)).rlike("dang-nhap|logout") | (h.rlike("(?i)<input[^>]*name=[\"'][^\"']*username") & h.rlike("(?i)<input[^>]*name=[\"'][^\"']*password")) | h.contains("Vui lòng đăng nhập lại hệ thống")
    captcha = h.rlike("(?i)class=[\"'][^\"']*(captcha|cf-turnstile)") | h.rlike("(?i)<iframe[^>]*(captcha|turnstile)") | h.rlike("(?i)<input[^>]*name=[\"'][^\"']*captcha") | F.lower(h).rlike("xác nhận không phải người máy|nhập mã bảo vệ|mã captcha")
    return F.when(login, "login").when(captcha, "captcha").when(F.coalesce(http_status, F.lit(200)).isin(403, 429), "blocked").otherwise("ok")


def _page_kind(blank: Column, state: Column, listed: Column, detailed: Column) -> Column:
    return F.when(blank, "empty").when(state == "login", "login_page").when(listed, "list").when(detailed, "detail").otherwise("unknown")


def classify_pages(pages: DataFrame, items: DataFrame, details: DataFrame) -> DataFrame:
    """pages with page_kind: empty, login_page, list (it has items), detail (a title or attachment), else unknown. items and
    details are those of the pages; see page_kinds where they aren't at hand."""
    n = items.groupBy("page_id").agg(F.count("*").alias("_n"))
    d = details.select("page_id", ((F.col("title") != "") | (F.size("attachments") > 0)).alias("_d"))
    kind = _page_kind(F.trim(txt("html")) == "", access_state(F.col("html"), F.lit(""), F.lit(200)), F.col("_n") > 0, F.col("_d"))
    return pages.join(n, "page_id", "left").join(d, "page_id", "left").withColumn("page_kind", kind).drop("_n", "_d")


def page_kinds(pages: DataFrame, base: str, generic: tuple[str, ...] = config.GENERIC_TITLES, navigation: tuple[str, ...] = config.NAVIGATION, article: str = ARTICLE, own_words: tuple[str, ...] = ()) -> DataFrame:
    """pages, without the html, with page_kind as classify_pages has it: one parser pass, no shuffle."""
    seen = pages.withColumns({"_blank": F.trim(txt("html")) == "", "_state": access_state(F.col("html"), F.lit(""), F.lit(200))})
    listed = F.lit(False)
    for kind in _listed(article, generic, navigation):
        listed = listed | (F.size(kind) > 0)
    detailed = (_heading(own_words) != "") | (F.size(_attachments(base)) > 0)
    return page_events(seen).withColumn("page_kind", _page_kind(F.col("_blank"), F.col("_state"), listed, detailed)).drop("_blank", "_state", *ADDED)


def discover_links(events: DataFrame, known: DataFrame, base: str, least: int = 15, link: str = r"(?i)\.html($|[?#])", sections: DataFrame | None = None, first_pages: int = 2) -> DataFrame:
    """(page_id, pos, url, text): links (.html ones, by default) whose text has more than least characters, each url once
    (first page, then position), known ones left out. sections: (page_id, section, page), the pages of lists; beyond
    first_pages a section ends with its first page that adds no url."""
    fits = lambda e: e["kind"].isin("row", "card", "link") & e["href"].rlike(link) & (F.length(e["text"]) > least)
    links = events.select("page_id", F.explode(F.filter("events", fits)).alias("e"))
    u = links.select("page_id", F.col("e.pos").alias("pos"), absolute_url(F.col("e.href"), base).alias("url"), F.col("e.text").alias("text"))
    first = u.groupBy("url").agg(F.min(F.struct("page_id", "pos", "text")).alias("f")).select("url", "f.*")
    new = first.join(known.select("url").distinct(), "url", "left_anti")
    if sections is None:
        return new
    # looked at twice, so it is stored
    new = stored(new, "new-links")
    added = sections.join(new.groupBy("page_id").agg(F.count("*").alias("_n")), "page_id", "left")
    ends = added.where((F.col("page") > first_pages) & F.col("_n").isNull()).groupBy("section").agg(F.min("page").alias("_end"))
    read = sections.join(ends, "section", "left").where(F.col("_end").isNull() | (F.col("page") < F.col("_end"))).select("page_id")
    return new.join(read.distinct(), "page_id", "left_semi")
