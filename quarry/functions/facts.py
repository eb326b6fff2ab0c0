"""Column functions that read facts from titles and texts: numbers, dates, units, categories, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions.text import strip, txt

#: Characters looked at, and whether a misread label counts, by profile.
NUMBER_PROFILES = {"normalize": (800, r"Số|SỐ|86|Số:"), "import": (1000, r"Số|SỐ|Số:"), "expand": (1200, r"Số|SỐ|Số:")}


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def document_number(c: Column, profile: str = "normalize") -> Column:
    """n/XX after a label near the start of a text; null if none is plain."""
    size, label = NUMBER_PROFILES[profile]
    got = _first(F.substring(txt(c), 1, size), rf"(?iuU)(?:{label})\s*[:.]?\s*([0-9]{{1,4}}\s*[/\-]\s*[A-Za-zĐđ0-9\-_]+)")
    got = F.regexp_replace(strip(got), r"(?U)\s+", F.lit(""))
    return F.when(F.length(got) >= 4, got)


def title_number(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(txt(c), config.TITLE_NUMBER, 1), r"(?U)\s+", F.lit(""))


def issuing_unit(c: Column, units: tuple[tuple[str, str], ...], chars: int = 600) -> Column:
    """Name of the first unit whose phrase stands near the start; units: (lower-case phrase, name). There is no default:
    the phrases name an institution, so they are the caller's."""
    head, out = F.lower(F.substring(txt(c), 1, chars)), F.lit(None).cast("string")
    for phrase, name in reversed(units):
        out = F.when(head.contains(phrase), name).otherwise(out)
    return out


def category(title: Column, content: Column | None = None, rules: config.CategoryRules = config.CATEGORIES) -> Column:
    """Struct of category and subcategory by the first rule that fits."""
    look = F.lower(txt(title))
    if rules.content_chars and content is not None:
        look = F.concat(look, F.lit(" "), F.lower(F.substring(txt(content), 1, rules.content_chars)))
    kind = lambda c, s: F.struct(F.lit(c).cast("string").alias("category"), F.lit(s).cast("string").alias("subcategory"))
    out = kind(rules.default, None)
    for words, c, s in reversed(rules.rules):
        hit = look.contains(words[0])
        for w in words[1:]:
            hit = hit | look.contains(w)
        out = F.when(hit, kind(c, s)).otherwise(out)
    return out


def _iso(day: Column, month: Column, year: Column) -> Column:
    return F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))


def normalize_date(c: Column) -> Column:
    """d/m/y with / . or - as ISO text; other text stays, blank is null. The calendar isn't asked."""
    p = r"(?U)\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\b"
    t = strip(txt(c))
    part = lambda k: F.regexp_extract(t, p, k)
    return F.when(t == "", F.lit(None)).when(t.rlike(p), _iso(part(1), part(2), part(3))).otherwise(t)


def issue_date(c: Column, chars: int = 1500, years: tuple[int, int] = (1990, 2050)) -> Column:
    """The first written-out date near the start, else the first numeric one; out of range or off the calendar: null."""
    t = F.substring(txt(c), 1, chars)
    out = F.lit(None).cast("string")
    for p in (r"(?U)\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\b", r"(?iuU)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"):
        d, m, y = (F.regexp_extract(t, p, k) for k in (1, 2, 3))
        ok = y.try_cast("int").between(*years) & F.try_to_date(_iso(d, m, y)).isNotNull()
        out = F.when(t.rlike(p) & ok, _iso(d, m, y)).otherwise(out)
    return out


def posted_date(c: Column) -> Column:
    return F.regexp_extract(txt(c), config.POSTED_DATE, 1)


# --- validity ------------------------------------------------------------------------------------------------------
# Clauses that facts are read from.
_DMY = r"(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
_NUM = r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})"
CLAUSES = {
    "issue": r"(?iuU)(?:{place})[,.]?\s*ngày\s+" + _DMY,
    "replaces": r"(?iuU)thay\s+thế\s+(?:cho\s+)?(?:Quyết\s+định|Quy\s+định|văn\s+bản|Thông\s+báo)?\s*(?:số)?\s*([0-9/\-A-Za-zĐđ_]+)",
    "until_new": r"(?iuU)(?:Thông\s+báo|Quy\s+định|Quyết\s+định)\s+này\s+có\s+hiệu\s+lực\s+từ\s+([^,.\n\r]+?)\s+cho\s+đến\s+khi\s+có\s+(?:thông\s+báo|quyết\s+định)\s+mới",
    "signed": r"(?iuU)có\s+hiệu\s+lực\s+(?:thi\s+hành\s+)?kể\s+từ\s+ngày\s+ký",
    "from": rf"(?iuU)có\s+hiệu\s+lực\s+(?:thi\s+hành\s+)?(?:kể\s+)?từ\s+ngày\s+{_DMY}",
    "to": rf"(?iuU)hết\s+hiệu\s+lực\s+(?:kể\s+từ|từ|vào)?\s*ngày\s+{_DMY}",
    "due": rf"(?iuU)(?:thời\s+hạn\s+nộp\s+học\s+phí|thời\s+hạn\s+nộp|hạn\s+nộp\s+học\s+phí|thời\s+hạn\s+nhận\s+đơn|hạn\s+cuối|hạn\s+chót)\s*[:.]?\s*[^\n]*?(?:đến|–|-|trước|vào)?\s*(?:(?:hết\s+)?ngày\s+)?{_NUM}",
    "event": rf"(?iuU)(?:Thời\s+gian\s+(?:khảo\s+sát|thi|tổ\s+chức)|diễn\s+ra\s+vào)[\s\S]{{0,100}}?ngày\s+{_NUM}",
    "before": rf"(?iuU)(?:(?:đến|trước)\s+(?:hết\s+)?ngày\s+){_NUM}",
}
#: Pieces of which a text holds one at least if it holds the clause, in all cases that the pattern takes.
SIGNS = {
    "issue": ("ă", "Ă"),
    "replaces": ("hế", "hẾ", "Hế", "HẾ"),
    **{k: ("ự", "Ự") for k in ("until_new", "signed", "from", "to")},
    "due": ("ạ", "Ạ"),
    "event": ("ờ", "Ờ", "ễ", "Ễ"),
    "before": ("ế", "Ế", "ớ", "Ớ"),
}
LONG_TERM = ("quy định", "quy chế", "quy trình", "chiến lược")


#: What each date clause ends with.
_LAST = {"issue": _DMY, "from": _DMY, "to": _DMY, "due": _NUM, "event": _NUM, "before": _NUM}


def _last_date(words: Column, form: str) -> Column:
    """The date at the end of a clause's words, as ISO text; null if there is none or the calendar lacks it."""
    d, m, y = (F.regexp_extract(words, f"(?iuU){form}$", k) for k in (1, 2, 3))
    iso = _iso(d, m, y)
    return F.when(F.try_to_date(iso).isNotNull(), iso)


def page_clauses(pages: Column, place: str) -> Column:
    """Array of structs, one a page: its number and, per clause, the matched words and what they give. Each pattern is run
    once over a page; dates are read from the words."""
    one_line = F.transform(pages, lambda p: F.struct(p["page_number"].cast("int").alias("n"), F.regexp_replace(F.coalesce(F.nullif(p["cleaned_text"], F.lit("")), p["raw_text"], F.lit("")), r"(?U)\s+", F.lit(" ")).alias("flat")))
    patterns = CLAUSES | {"issue": CLAUSES["issue"].replace("{place}", place)}
    # letters without which a clause can't stand spare most texts the pattern
    could = lambda x, k: F.exists(F.array(*map(F.lit, SIGNS[k])), lambda w: F.contains(x["flat"], w))
    look = lambda x, k, p, group: F.when(could(x, k), _first(x["flat"], p, group))
    said = F.transform(one_line, lambda x: F.struct(x["n"].alias("n"), *[look(x, k, p, 0).alias(k) for k, p in patterns.items()], look(x, "replaces", CLAUSES["replaces"], 1).alias("number")))

    def given(x: Column) -> Column:
        number = strip(x["number"])
        ok = (F.length(number) >= 3) & (number.contains("/") | number.contains("-") | number.rlike("^[0-9]+$"))
        return F.struct(x["n"].alias("n"), *[x[k].alias(f"{k}_words") for k in CLAUSES], F.when(ok, number).alias("replaces"), *[_last_date(x[k], form).alias(k) for k, form in _LAST.items()])

    return F.transform(said, given)


def _fold_clauses(said: Column, issued: Column) -> Column:
    """Facts from the clauses of the pages, in page order: replaced_by and effective_from are set once, regulatory clauses
    count only while there is no evidence, explicit dates and any deadline replace the evidence."""
    page = lambda x, words: F.concat(F.lit("Trang "), x["n"].cast("string"), F.lit(": "), words)
    names = ("effective_from", "effective_to", "replaced_by", "status_evidence", "evidence_page", "clause_type")

    def step(a: Column, x: Column) -> Column:
        f = {k: a[k] for k in names}

        def put(test: Column, **new: Column) -> None:
            f.update({k: F.when(test, v).otherwise(f[k]) for k, v in new.items()})

        put(x["replaces"].isNotNull() & f["replaced_by"].isNull(), status_evidence=page(x, x["replaces_words"]), evidence_page=x["n"], replaced_by=x["replaces"])
        for name, words in (("until_new", x["until_new_words"]), ("signed", F.lit("Có hiệu lực kể từ ngày ký"))):
            put(x[f"{name}_words"].isNotNull() & f["status_evidence"].isNull(), clause_type=F.lit("regulatory"), effective_from=F.coalesce(issued, f["effective_from"]), evidence_page=x["n"], status_evidence=page(x, words))
        put(x["from"].isNotNull() & f["effective_from"].isNull(), clause_type=F.lit("regulatory"), status_evidence=page(x, x["from_words"]), evidence_page=x["n"], effective_from=x["from"])
        put(x["to"].isNotNull() & f["effective_to"].isNull(), status_evidence=page(x, x["to_words"]), evidence_page=x["n"], effective_to=x["to"])
        return F.struct(*[v.alias(k) for k, v in f.items()])

    zero = F.struct(*[F.lit(None).cast("int" if k == "evidence_page" else "string").alias(k) for k in names])
    return F.aggregate(said, zero, step)


def validity_facts(docs: DataFrame, place: str = r"\p{L}[\p{L} ]{1,40}") -> DataFrame:
    """Adds facts, a struct of issue_date, effective_from, effective_to, deadline, replaced_by, status_evidence,
    evidence_page and clause_type, read from pages (array of structs with page_number, raw_text, cleaned_text). place:
    pattern of what stands before the issue date. Steps are columns of their own, so that none is computed twice."""
    none = F.array().cast("array<struct<page_number:int,raw_text:string,cleaned_text:string>>")
    first = lambda test: F.get(F.filter("_said", test), F.lit(0))
    d = docs.withColumn("_said", page_clauses(F.coalesce("pages", none), place))
    d = d.withColumns({"_issued": first(lambda x: x["issue"].isNotNull())["issue"], "_due": first(lambda x: x["due"].isNotNull()), "_later": first(lambda x: x["event"].isNotNull() | x["before"].isNotNull())})
    d = d.withColumn("_f", _fold_clauses(F.col("_said"), F.col("_issued")))
    use_due, has = F.col("_due").isNotNull(), F.col("_due").isNotNull() | F.col("_later").isNotNull()
    at = lambda due, event, before: F.when(use_due, F.col(f"_due.{due}")).when(F.col("_later.event").isNotNull(), F.col(f"_later.{event}")).otherwise(F.col(f"_later.{before}"))
    words = F.concat(F.lit("Trang "), at("n", "n", "n").cast("string"), F.lit(": "), at("due_words", "event_words", "before_words"))
    facts = F.struct(
        F.col("_issued").alias("issue_date"), "_f.effective_from", "_f.effective_to", at("due", "event", "before").alias("deadline"), "_f.replaced_by",
        F.when(has, words).otherwise(F.col("_f.status_evidence")).alias("status_evidence"), F.when(has, at("n", "n", "n")).otherwise(F.col("_f.evidence_page")).alias("evidence_page"), F.when(has, "deadline").otherwise(F.col("_f.clause_type")).alias("clause_type"),
    )
    return d.withColumn("facts", facts).drop("_said", "_issued", "_due", "_later", "_f")


def validity_status(docs: DataFrame, as_of: str, parity: bool = True, place: str = r"\p{L}[\p{L} ]{1,40}") -> DataFrame:
    """Adds facts (struct) and suggested_status, certainty, status_evidence, status_rationale, issue_date, effective_from,
    effective_to, deadline, replaced_by. Expects title, pages, issue_date, deadline, replaced_by.

    parity: 'replaces X' marks this very document as replaced by X, as the rules had it; without it, X goes to a
    column replaces and the status is decided by the other rules. Dates off the calendar count as absent."""
    f = validity_facts(docs, place)
    own = lambda name: F.nullif(F.col(name), F.lit(""))
    f = f.withColumns(
        {
            "issue_date": F.coalesce(own("issue_date"), F.col("facts.issue_date")),
            "effective_from": F.col("facts.effective_from"),
            "effective_to": F.col("facts.effective_to"),
            "deadline": F.coalesce(F.col("facts.deadline"), own("deadline")),
            "replaced_by": F.coalesce(F.col("facts.replaced_by"), own("replaced_by")) if parity else own("replaced_by"),
        }
    )
    if not parity:
        f = f.withColumn("replaces", F.col("facts.replaced_by"))
    now, date = F.lit(as_of).cast("date"), lambda c: F.try_to_date(c)
    to, due, start = date(F.col("effective_to")), date(F.col("deadline")), date(F.coalesce("effective_from", "issue_date"))
    regulatory = (F.col("facts.clause_type") == "regulatory") & start.isNotNull()
    long_term = F.exists(F.array(*map(F.lit, LONG_TERM)), lambda w: F.contains(F.lower(txt("title")), w))
    kind = (
        F.when(to.isNotNull(), F.when(now >= to, "expired_to").otherwise("active_to"))
        .when(F.col("replaced_by").isNotNull(), "replaced")
        .when(due.isNotNull(), F.when(now > due, "due_passed").otherwise("due_open"))
        .when(regulatory, F.when(now >= start, "in_force").otherwise("starts_later"))
        .when(long_term, "long_term")
        .otherwise("unverified")
    )
    f = f.withColumn("_kind", kind)
    of = lambda **by: F.coalesce(*[F.when(F.col("_kind") == k, F.lit(v)) for k, v in by.items()])
    status = of(expired_to="expired", active_to="active", replaced="replaced", due_passed="deadline_passed", due_open="active", in_force="active", starts_later="unverified", long_term="active", unverified="unverified")
    certainty = of(expired_to="HIGH", active_to="HIGH", replaced="HIGH", due_passed="HIGH", due_open="HIGH", in_force="MEDIUM", starts_later="LOW", long_term="MEDIUM", unverified="LOW")
    say = lambda form, c: F.format_string(form, F.coalesce(c, F.lit("")))
    rationale = (
        F.when(F.col("_kind") == "expired_to", say("Expired on %s.", F.col("effective_to")))
        .when(F.col("_kind") == "active_to", say("In force until %s.", F.col("effective_to")))
        .when(F.col("_kind") == "replaced", say("Recorded as replaced by %s.", F.col("replaced_by")))
        .when(F.col("_kind") == "due_passed", say("Its deadline %s has passed; that doesn't repeal it.", F.col("deadline")))
        .when(F.col("_kind") == "due_open", say("Its deadline %s is still open.", F.col("deadline")))
        .when(F.col("_kind") == "in_force", say("In force since %s; no repeal is recorded.", F.coalesce("effective_from", "issue_date")))
        .when(F.col("_kind") == "starts_later", "")
        .when(F.col("_kind") == "long_term", "A regulation that holds until a new one.")
        .otherwise("No clause on validity and no deadline was found; someone has to check.")
    )
    return f.withColumns({"suggested_status": status, "certainty": certainty, "status_evidence": F.col("facts.status_evidence"), "status_rationale": rationale}).drop("_kind")

