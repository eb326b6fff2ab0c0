"""Queries of facts that stand in the midst of documents' texts, near the start, farther on or beyond what is looked at; of
all profiles of category rules; and of rows whose owner is gone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import config
from quarry import queries as base
from quarry.functions import facts
from quarry.operators import queue

Query = Callable[[SparkSession, str], DataFrame]
#: Characters of a text before its fact, by the id's remainder.
PLACES = (150, 500, 900, 1100, 1400, 3000)
PROFILES = {"rules": config.CATEGORIES, "import": config.IMPORT_CATEGORIES, "expand": config.EXPANSION_CATEGORIES}


def _within(fact: Column) -> Column:
    """The document's text with a fact in it, or at its end if it is shorter than the place."""
    at = F.element_at(F.array(*map(F.lit, PLACES)), (F.col("doc_id") % len(PLACES) + 1).cast("int"))
    return F.concat(F.substring("text", F.lit(1), at), F.lit(" "), fact, F.lit(" "), F.substring("text", at + 1, F.length("text")))


def _sql_within(fact: str) -> str:
    at = f"[{', '.join(map(str, PLACES))}][CAST(doc_id % {len(PLACES)} + 1 AS INTEGER)]"
    return f"substr(text, 1, {at}) || ' ' || {fact} || ' ' || substr(text, {at} + 1)"


def title_number_within(s: SparkSession, d: str) -> DataFrame:
    fact = F.concat((F.col("doc_id") % 900).cast("string"), F.lit(" / QĐ-X2"))
    return base.read(s, d, "documents").select("doc_id", facts.title_number(_within(fact)).alias("number"))


def document_number_within(s: SparkSession, d: str) -> DataFrame:
    text = _within(F.concat(F.lit("Số: "), (F.col("doc_id") % 900).cast("string"), F.lit(" / TB-X")))
    return base.read(s, d, "documents").select("doc_id", *[facts.document_number(text, p).alias(f"number_{p}") for p in facts.NUMBER_PROFILES])


def _day_said() -> Column:
    day, month = F.col("doc_id") % 40 + 1, F.col("doc_id") % 12 + 1
    written = F.format_string("ngày %d tháng %d năm %d", day, month, 1980 + F.col("doc_id") % 100)
    return F.when(F.col("doc_id") % 2 == 0, written).otherwise(F.format_string("%d/%d/%d", day, month, 1980 + F.col("doc_id") % 100))


def issue_date_within(s: SparkSession, d: str) -> DataFrame:
    """Some of the dates are off the calendar, some out of range."""
    return base.read(s, d, "documents").select("doc_id", facts.issue_date(_within(_day_said())).alias("iso"))


def posted_date_within(s: SparkSession, d: str) -> DataFrame:
    at = F.format_string("%d/%d/2026%s", F.col("doc_id") % 28 + 1, F.col("doc_id") % 12 + 1, F.when(F.col("doc_id") % 2 == 0, F.lit(" 08:05")).otherwise(F.lit("")))
    return base.read(s, d, "documents").select("doc_id", facts.posted_date(_within(at)).alias("posted"))


def _titles(rules: config.CategoryRules) -> list[str]:
    return [f"Thông báo: {word}" for words, _, _ in rules.rules for word in words] + ["Thông báo khác"]


def category_profiles(s: SparkSession, d: str) -> DataFrame:
    """Titles and texts with each word of each profile's rules in turn, and with none."""
    out = base.read(s, d, "documents")
    for name, rules in PROFILES.items():
        titles = _titles(rules)
        said = F.element_at(F.array(*map(F.lit, titles)), (F.col("doc_id") % len(titles) + 1).cast("int"))
        first = F.when(F.col("doc_id") % 2 == 0, said).otherwise("Thông báo")
        text = F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.concat(F.substring("text", 1, 100), F.lit(" "), said))
        out = out.withColumn(f"_{name}", facts.category(first, text, rules))
    return out.select("doc_id", *[F.col(f"_{n}.{c}").alias(f"{n}_{c}") for n in PROFILES for c in ("category", "subcategory")])


def recover_dead_owners(s: SparkSession, d: str) -> DataFrame:
    """Rows in work since not long ago go back if their worker, one of seven, isn't among the four that are alive."""
    pid = (F.col("uploaded_by_id").cast("long") % 7).cast("int")
    alive = base.read(s, d, "events").select((F.col("user_id") % 4).cast("int").alias("worker_pid"))
    q = base.import_queue(s, d).withColumn("worker_pid", pid)
    return queue.recover_stale(q, F.lit("2024-01-15").cast("timestamp"), 3, alive).select("id", "status", F.coalesce("worker_pid", F.lit(-1)).alias("worker_pid"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (title_number_within, document_number_within, issue_date_within, posted_date_within, category_profiles, recover_dead_owners)}


def _sql_category(name: str, rules: config.CategoryRules) -> tuple[str, list[str]]:
    """A text to look at, and the columns of what the first rule says."""
    titles = ", ".join(f"'{t}'" for t in _titles(rules))
    said = f"[{titles}][CAST(doc_id % {len(_titles(rules))} + 1 AS INTEGER)]"
    body = f"' ' || substr(CASE WHEN doc_id % 2 = 0 THEN '' ELSE substr(text, 1, 100) || ' ' || {said} END, 1, {rules.content_chars})" if rules.content_chars else "''"
    look = f"lower(CASE WHEN doc_id % 2 = 0 THEN {said} ELSE 'Thông báo' END) || lower({body})"
    q = lambda x: "NULL" if x is None else f"'{x}'"
    hit = lambda words: " OR ".join(f"contains(look_{name}, '{w}')" for w in words)
    case = lambda k: "CASE " + " ".join(f"WHEN {hit(r[0])} THEN {q(r[k])}" for r in rules.rules) + f" ELSE {q(rules.default if k == 1 else None)} END"
    return f"{look} AS look_{name}", [f"{case(1)} AS {name}_category", f"{case(2)} AS {name}_subcategory"]


def oracle_sql() -> dict[str, str]:
    label = r"\s*[:.]?\s*([0-9]{1,4}\s*[/\-]\s*[A-Za-zĐđ0-9\-_]+)"
    number = lambda chars, names: f"regexp_replace(regexp_extract(substr(t, 1, {chars}), '(?i)(?:{names}){label}', 1), '\\s+', '', 'g')"
    numbers = ", ".join(f"CASE WHEN length({number(c, n)}) >= 4 THEN {number(c, n)} END AS number_{p}" for p, (c, n) in facts.NUMBER_PROFILES.items())
    day, month, year = "doc_id % 40 + 1", "doc_id % 12 + 1", "1980 + doc_id % 100"
    said = f"CASE WHEN doc_id % 2 = 0 THEN 'ngày ' || ({day}) || ' tháng ' || ({month}) || ' năm ' || ({year}) ELSE ({day}) || '/' || ({month}) || '/' || ({year}) END"
    form = "(?i)ngày\\s+\\d+\\s+tháng\\s+\\d+\\s+năm\\s+\\d{4}|\\b\\d{1,2}/\\d{1,2}/\\d{4}\\b"
    iso = f"printf('%04d-%02d-%02d', {year}, {month}, {day})"
    whole = lambda t: f"WITH w AS (SELECT *, {t} AS t FROM documents) "
    looks, columns = zip(*[_sql_category(n, r) for n, r in PROFILES.items()], strict=True)
    posted = "(doc_id % 28 + 1) || '/' || (doc_id % 12 + 1) || '/2026' || CASE WHEN doc_id % 2 = 0 THEN ' 08:05' ELSE '' END"
    return {
        "title_number_within": whole(_sql_within("(doc_id % 900) || ' / QĐ-X2'")) + "SELECT doc_id, (doc_id % 900) || '/QĐ-X2' AS number FROM w",
        "document_number_within": whole(_sql_within("'Số: ' || (doc_id % 900) || ' / TB-X'")) + f"SELECT doc_id, {numbers} FROM w",
        "issue_date_within": whole(_sql_within(said)) + f"SELECT doc_id, CASE WHEN regexp_matches(substr(t, 1, 1500), '{form}') AND {year} BETWEEN 1990 AND 2050 AND TRY_CAST({iso} AS DATE) IS NOT NULL THEN {iso} END AS iso FROM w",
        "posted_date_within": whole(_sql_within(posted)) + f"SELECT doc_id, {posted} AS posted FROM w",
        "category_profiles": f"WITH l AS (SELECT doc_id, {', '.join(looks)} FROM documents) SELECT doc_id, {', '.join(c for cs in columns for c in cs)} FROM l",
        "recover_dead_owners": base.Q + """
, r AS (SELECT *, status = 'PROCESSING' AND (created_at < TIMESTAMP '2024-01-15' - INTERVAL 3 MINUTE OR user_id % 7 > 3) AS back FROM q)
SELECT id, CASE WHEN back THEN 'PENDING' ELSE status END AS status, CAST(CASE WHEN back THEN -1 ELSE user_id % 7 END AS INTEGER) AS worker_pid FROM r""",
    }
