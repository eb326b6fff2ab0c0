"""Column functions for questions: keywords, matching, scores, snippets, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions.text import collapse_space, rounded, strip, txt

WORD_EDGE = r"""[\s.,;:!?"'()\[\]/\-]"""


def texts(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>") if values else F.array().cast("array<string>")


def in_order(a: Column) -> Column:
    """Distinct, first seen first."""
    return F.array_distinct(a)


def extract_keywords(question: Column, lists: config.Keywords = config.DEFAULT_KEYWORDS) -> Column:
    """Compound phrases, numbers of documents, years, then words of three letters or more that are neither stopwords nor
    part of a found phrase; then synonyms. Empty unless something of the domain is among them."""
    q = txt(question)
    norm = strip(F.regexp_replace(F.lower(q), r"""[.,?!:;()\[\]"'/\\-]""", F.lit(" ")))
    compounds = F.filter(texts(lists.compounds), lambda p: F.contains(norm, p))
    bounded = lambda body: rf"(?<![A-Za-z0-9_]){body}"
    numbers = F.transform(F.regexp_extract_all(q, F.lit(bounded(r"(\d+[/-][a-zA-Z0-9\u00C0-\u1EF9]+|\d+/(?=[A-Za-z0-9_]))")), F.lit(1)), F.lower)
    years = F.regexp_extract_all(q, F.lit(bounded(r"(202\d[-/]?202\d|202\d)(?![A-Za-z0-9_])")), F.lit(1))
    words = F.filter(
        F.split(norm, r"(?U)\s+"),
        lambda w: (F.length(w) >= 3) & ~F.array_contains(texts(lists.stopwords), w) & ~F.exists(compounds, lambda c: F.contains(c, w)),
    )
    keys = in_order(F.concat(compounds, numbers, years, words))
    for said, meant in lists.synonyms:
        fire = F.array_contains(keys, said) & ~F.array_contains(keys, meant[0])
        keys = F.when(fire, in_order(F.concat(keys, texts(meant)))).otherwise(keys)
    domain = (F.size(compounds) > 0) | (F.size(numbers) > 0) | F.exists(keys, lambda k: F.exists(texts(lists.core_words), lambda c: F.contains(k, c)))
    return F.when(domain, keys).otherwise(texts(()))


def _escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", F.lit(r"\\$1"))


def word_match(target: Column, pattern: Column) -> Column:
    """Both lower-cased. Long patterns and those with a space or slash match anywhere, others between word edges."""
    loose = (F.length(pattern) > 5) | pattern.contains(" ") | pattern.contains("/")
    edged = F.rlike(target, F.concat(F.lit(f"(?:^|{WORD_EDGE})"), _escaped(pattern), F.lit(f"(?:$|{WORD_EDGE})")))
    # the plain test comes first: few patterns are compiled
    return (pattern != "") & F.contains(target, pattern) & (loose | edged)


def occurrences(text: Column, part: Column) -> Column:
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(0)


def keyword_points(keywords: Column, title: Column, number: Column, category: Column, subcategory: Column, text: Column) -> Column:
    """Array of (k, hit, points), one per keyword. The other columns are given lower-cased, null as empty: lower-case them
    once per row, before pairs are made."""

    def hits(k: Column) -> Column:
        return F.struct(k.alias("k"), word_match(title, k).alias("title"), word_match(number, k).alias("number"), (word_match(category, k) | word_match(subcategory, k)).alias("kind"), word_match(text, k).alias("text"))

    def points(x: Column) -> Column:
        p = F.when(x["number"], 35).otherwise(0) + F.when(x["title"], 20).otherwise(0) + F.when(x["kind"], 15).otherwise(0) + F.when(x["text"], 5 + F.least(occurrences(text, x["k"]) - 1, F.lit(5))).otherwise(0)
        return F.struct(x["k"].alias("k"), (x["title"] | x["number"] | x["kind"] | x["text"]).alias("hit"), p.alias("points"))

    return F.transform(F.transform(keywords, lambda k: hits(F.lower(k))), points)


def compound_gate(keywords: Column, *fields: Column, lists: config.Keywords = config.DEFAULT_KEYWORDS) -> Column:
    """True unless keywords hold compound phrases of which no field holds one."""
    asked = F.filter(texts(lists.compounds), lambda c: F.array_contains(keywords, c))

    def held(c: Column) -> Column:
        out = F.contains(fields[0], c)
        for f in fields[1:]:
            out = out | F.contains(f, c)
        return out

    return (F.size(asked) == 0) | F.exists(asked, held)


def keyword_scores(pairs: DataFrame, keywords: str, fields: tuple[str, ...], text: str, lists: config.Keywords = config.DEFAULT_KEYWORDS) -> DataFrame:
    """Adds score and matched to pairs of keywords and pages. fields: lower-cased title, number, category, subcategory. The
    steps are columns of their own, so that each is computed once a pair."""
    f = [F.col(c) for c in fields]
    k = F.col(keywords)
    p = pairs.where((F.size(k) > 0) & (strip(F.col(text)) != "") & compound_gate(k, *f, F.col(text), lists=lists))
    p = p.withColumn("_each", keyword_points(k, *f, F.col(text)))
    # not deterministic to the optimizer, so that a filter on the score isn't moved below and the steps computed again
    p = p.withColumn("_hits", F.when(F.monotonically_increasing_id() >= 0, F.filter("_each", lambda x: x["hit"])))
    p = p.withColumns({"_n": F.size("_hits"), "_points": F.aggregate("_hits", F.lit(0), lambda a, x: a + x["points"])})
    coverage = F.col("_n") / F.size(k)
    ok = (F.col("_n") > 0) & ((F.size(k) == 1) | (coverage >= 0.4))
    return p.withColumns({"score": F.when(ok, rounded(F.col("_points") * (0.5 + coverage))).otherwise(0.0), "matched": F.when(ok, F.array_distinct(F.filter(k, lambda w: F.exists("_hits", lambda x: x["k"] == F.lower(w))))).otherwise(texts(()))}).drop("_each", "_hits", "_n", "_points")


def snippet(text: Column, keywords: Column, size: int = 240, before: int = 40) -> Column:
    """Up to size characters from a little before the earliest keyword, with dots where something is cut."""

    def cut(x: Column) -> Column:
        t, low = x["t"], x["low"]
        first = F.array_min(F.filter(F.transform(keywords, lambda k: F.position(F.lower(k), low)), lambda p: p > 0)) - 1
        return F.struct(t.alias("t"), first.alias("first"), F.length(t).alias("length"))

    def dotted(x: Column) -> Column:
        t, first, length = x["t"], x["first"], x["length"]
        start = F.greatest(F.lit(0), first - before)
        end = F.least(length, start + size)
        some = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(t, start + 1, end - start), F.when(end < length, "...").otherwise(""))
        return F.when(length <= size, t).when(first.isNull(), F.concat(F.substring(t, 1, size), F.lit("..."))).otherwise(some)

    # each step is the element of an array, so that it is made once and not for every keyword
    plain = F.transform(F.array(collapse_space(text)), lambda t: F.struct(t.alias("t"), F.lower(t).alias("low")))
    return F.get(F.transform(F.transform(plain, cut), dotted), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """In [-1, 1]; 0 for vectors of unequal or no length and for zero vectors. Norms may be given, computed once a row."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 0) & (nb > 0)
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb)))).otherwise(0.0)


# The forms of questions that aren't searched for.
PERSONAL = (
    r"(?iu)(?<![A-Za-z0-9_])(tôi|em|mình|ta)\s+(tên|là\s+ai|học\s+lớp|sinh\s+năm|ở\s+đâu|quê\s+ở|vừa\s+hỏi|mấy\s+tuổi)(?![A-Za-z0-9_])",
    r"(?iu)^(tôi tên gì|tôi là ai|tôi vừa hỏi gì|tên của tôi|tên tôi là gì|tôi học lớp nào|ai là người hỏi)(?![A-Za-z0-9_])",
)
GREETING = r"(?iu)^(chào\s*(bạn|ai|bot|em|ad|admin)?|xin chào|hello|hi|hey|alo|cảm ơn\s*(bạn|bot)?|tạm biệt|bye)\s*[!?.]*$"
MAX_QUESTION = 500


def question_class(question: Column, lists: config.Keywords = config.DEFAULT_KEYWORDS, keywords: Column | None = None) -> Column:
    """invalid_empty, invalid_long, personal, greeting, no_keywords or retrieve; the first that fits."""
    q = strip(F.lower(txt(question)))
    keys = extract_keywords(question, lists) if keywords is None else keywords
    return (
        F.when(q == "", "invalid_empty")
        .when(F.length(strip(txt(question))) > MAX_QUESTION, "invalid_long")
        .when(q.rlike(PERSONAL[0]) | q.rlike(PERSONAL[1]), "personal")
        .when(q.rlike(GREETING), "greeting")
        .when(F.size(keys) == 0, "no_keywords")
        .otherwise("retrieve")
    )


def embedding_input(title: Column, category: Column, page: Column, text: Column, limit: int = 4000) -> Column:
    """What an embedder reads of a chunk."""
    return F.substring(F.concat(F.lit("Title: "), txt(title), F.lit("\nCategory: "), txt(category), F.lit("\nPage: "), F.coalesce(page.cast("string"), F.lit("")), F.lit("\n"), txt(text)), 1, limit)


def conversation_title(question: Column) -> Column:
    """Short questions as they are; longer ones cut at the last space after 25 of 48 characters, with dots."""
    q = collapse_space(question)
    head = F.substring(q, 1, 48)
    space = F.length(head) - F.position(F.lit(" "), F.reverse(head))
    cut = F.when(F.contains(head, F.lit(" ")) & (space > 25), F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(q) <= 45, q).otherwise(F.concat(cut, F.lit("...")))


def manual_title(title: Column, default: str = "New conversation", limit: int = 100) -> Column:
    t = F.substring(strip(txt(title)), 1, limit)
    return F.when(t == "", default).otherwise(t)

