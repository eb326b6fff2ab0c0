"""Line-first quality rules, as DataFrame expressions only.

Every line is judged alone (symbol density, navigation, shouting, monotony, boilerplate), failing lines are
removed, and a document goes when too little of it is left. All work is inside one row: no shuffle at all, so a hot
source or a group of copies costs what its rows cost.

Edge cases: a null text is a text without words (counts 0, base_failed, not kept, clean_text empty). Rows are judged
one by one: repeated rows give repeated results. Other columns pass through; a column that has the name of an added
one is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_of, words_of


@dataclass(frozen=True)
class LineRules:
    """Shares are of a line's characters that are not white space, or of its words."""

    symbols: str = "#*$%&<>!"
    max_symbol_share: float = 0.08
    bars: str = "|»•·"
    max_bar_share: float = 0.08
    max_upper_share: float = 0.7
    min_distinct_share: float = 0.3
    min_words: int = 8
    #: Lines of at most so many words that hold one of the phrases are boilerplate.
    boilerplate_words: int = 40
    boilerplate: str = (
        r"(?i)\b(all rights reserved|licensed under|released under|cookie policy|privacy policy|terms of (use|service)|"
        r"subscribe to|sign up|log in|click here|javascript is (disabled|required)|copyright (\(c\)|©|\d{4})|"
        r"alle rechte vorbehalten|lizenziert unter|hier klicken|zum newsletter|unsere datenschutz|todos los derechos reservados|"
        r"bajo licencia|haga clic aqu|aviso legal|pol[ií]tica de (privacidad|cookies)|tous droits r|sous licence|cliquez ici|"
        r"mentions l[ée]gales|politique de confidentialit)"
    )
    #: Boilerplate lines with one of these and, apart from them, no other boilerplate are license lines: removed, but not
    #: counted against their document.
    license: str = (
        r"(?i)\b(all rights reserved|licensed under|released under|copyright (\(c\)|©|\d{4})|alle rechte vorbehalten|"
        r"lizenziert unter|todos los derechos reservados|bajo licencia|tous droits r|sous licence)"
    )
    #: A document goes when rules took more than this share of its characters, or it has fewer words left.
    max_lost_share: float = 0.5
    min_words_left: int = 5


def _run(text: Column, kept: str) -> Column:
    """How many characters of a class a text has; regexp_replace drops the others run by run."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", F.lit("")))


def measured_line(line: Column, words: Column, rules: LineRules) -> Column:
    """Struct of a line with the figures that rules look at, each taken once."""
    return F.struct(
        line.alias("line"),
        F.length(F.array_join(words, "")).alias("ink"),
        F.size(words).alias("words"),
        F.size(F.array_distinct(words)).alias("distinct"),
        _run(line, _class(rules.symbols)).alias("symbols"),
        _run(line, _class(rules.bars)).alias("bars"),
        _run(line, r"\p{Lu}").alias("upper"),
    )


def failed_rule(m: Column, rules: LineRules) -> Column:
    """Name of the first rule that a measured line fails, else null; "license" for the boilerplate of license lines."""
    other = F.regexp_replace(m["line"], rules.license, F.lit(" ")).rlike(rules.boilerplate)
    return (
        F.when(m["ink"] == 0, F.lit(None).cast("string"))
        .when(m["symbols"] > m["ink"] * rules.max_symbol_share, "punctuation")
        .when(m["bars"] > m["ink"] * rules.max_bar_share, "navigation")
        .when((m["words"] >= rules.min_words) & (m["upper"] > m["ink"] * rules.max_upper_share), "shouting")
        .when((m["words"] >= rules.min_words) & (m["distinct"] < m["words"] * rules.min_distinct_share), "monotony")
        .when((m["words"] <= rules.boilerplate_words) & m["line"].rlike(rules.boilerplate), F.when(other, "boilerplate").otherwise("license"))
    )


def _class(characters: str) -> str:
    return "".join(f"\\{c}" if c in r"\]^-[&|" else c for c in characters)


def line_cleaned(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """Adds clean_text, lost_share (of characters, by rules, license lines aside), words_left, failed_rules
    (distinct names, sorted; license lines fail boilerplate) and rules_kept."""
    lines = F.split(text_of(text), "\n")
    split = F.transform(lines, lambda x: F.struct(x.alias("line"), words_of(x).alias("words")))
    measured = F.transform(split, lambda x: measured_line(x["line"], x["words"], rules))
    judged = docs.withColumn("_judged", F.transform(measured, lambda m: F.struct(m["line"].alias("line"), m["words"].alias("words"), failed_rule(m, rules).alias("rule"))))
    kept = F.filter("_judged", lambda x: x["rule"].isNull())
    lost = F.filter("_judged", lambda x: x["rule"].isNotNull() & (x["rule"] != "license"))
    total = lambda a, of: F.aggregate(a, F.lit(0), lambda n, x: n + of(x))
    size = lambda x: F.length(x["line"])
    out = (
        judged.withColumn("clean_text", F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
        .withColumn("lost_share", total(lost, size) / F.greatest(F.lit(1), total(F.col("_judged"), size)))
        .withColumn("failed_rules", F.array_sort(F.array_distinct(F.array_compact(F.transform("_judged", lambda x: F.when(x["rule"] == "license", "boilerplate").otherwise(x["rule"]))))))
        .withColumn("words_left", total(kept, lambda x: x["words"]))
        .drop("_judged")
    )
    return out.withColumn("rules_kept", (F.col("lost_share") <= rules.max_lost_share) & (F.col("words_left") >= rules.min_words_left))


def _here() -> Column:
    """True. As it isn't deterministic to the optimizer, filters on what comes after aren't moved below it, where the
    array that a lambda looks into would be computed for each of its elements."""
    return F.monotonically_increasing_id() >= 0


def repetition(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (words inside five-word windows that the
    text has twice or more). Windows are compared by their 64-bit hashes within one text. Only a text with a repeated
    window has its windows sorted."""
    lines = F.filter(F.split(text_of(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = (
        docs.withColumn("_w", words_of(F.col(text)))
        .withColumn("n_symbols", F.length(F.regexp_replace(text_of(text), r"[^#*$%&|<>]+", F.lit(""))).cast("long"))
        .withColumn("_l", lines)
        .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
        .withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
        .withColumn("_h", F.when(F.size("_w") >= 5, F.transform(F.sequence(F.lit(1), F.size("_w") - 4), lambda i: F.xxhash64(F.slice("_w", i, 5)))).otherwise(F.array().cast("array<long>")))
        .withColumn("_same", F.size("_h") == F.size(F.array_distinct("_h")))
        .withColumn("_s", F.when(~F.col("_same") & _here(), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    )
    twin = F.filter(
        "_s",
        lambda x, k: ((k > 0) & (F.get("_s", k - 1)["h"] == x["h"])) | ((k + 1 < F.size("_s")) & (F.get("_s", k + 1)["h"] == x["h"])),
    )
    covered = F.aggregate(
        F.array_sort(F.transform(twin, lambda x: x["i"])),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + 5).alias("end"), (a["n"] + i + 5 - F.greatest(i, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    return out.withColumn("n_repeat_words", F.when(F.col("_same"), F.lit(0)).otherwise(covered).cast("long")).drop("_w", "_l", "_h", "_same", "_s")


def op1_quality_rules(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The contract's columns for every row of documents."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        line_cleaned(repetition(docs.select("doc_id", "text")), rules)
        .withColumn("base_failed", failed)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rules_kept")).alias("kept"), "lost_share", F.length("clean_text").cast("long").alias("clean_chars"), F.array_join("failed_rules", ",").alias("failed_rules"))
    )


_RULES = LineRules()
ORACLE = rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {{docs}}
), d AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS l FROM t
), g AS (
  SELECT rid, i, md5(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), c AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1) GROUP BY 1
), x AS (
  SELECT rid, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM (SELECT rid, unnest(l) AS line FROM d)
), m AS (
  SELECT rid, line, length(array_to_string(w, '')) AS ink, len(w) AS words, len(list_distinct(w)) AS dist, length(regexp_replace(line, '[^{_class(_RULES.symbols)}]+', '', 'g')) AS symbols,
         length(regexp_replace(line, '[^{_class(_RULES.bars)}]+', '', 'g')) AS bars, length(regexp_replace(line, '[^\p{{Lu}}]+', '', 'g')) AS upper FROM x
), r AS (
  SELECT rid, length(line) AS size, words, CASE
    WHEN ink = 0 THEN NULL
    WHEN symbols > ink * {_RULES.max_symbol_share}::DOUBLE THEN 'punctuation'
    WHEN bars > ink * {_RULES.max_bar_share}::DOUBLE THEN 'navigation'
    WHEN words >= {_RULES.min_words} AND upper > ink * {_RULES.max_upper_share}::DOUBLE THEN 'shouting'
    WHEN words >= {_RULES.min_words} AND dist < words * {_RULES.min_distinct_share}::DOUBLE THEN 'monotony'
    WHEN words <= {_RULES.boilerplate_words} AND regexp_matches(line, '{_RULES.boilerplate}') THEN
      CASE WHEN regexp_matches(regexp_replace(line, '{_RULES.license}', ' ', 'g'), '{_RULES.boilerplate}') THEN 'boilerplate' ELSE 'license' END END AS rule FROM m
), v AS (
  SELECT rid, coalesce(sum(size) FILTER (WHERE rule <> 'license'), 0) / greatest(1, sum(size))::DOUBLE AS lost_share, coalesce(sum(words) FILTER (WHERE rule IS NULL), 0) AS words_left,
         coalesce(sum(size) FILTER (WHERE rule IS NULL), 0) + greatest(0, count(*) FILTER (WHERE rule IS NULL) - 1) AS clean_chars,
         array_to_string(list_sort(list_distinct(list(CASE WHEN rule = 'license' THEN 'boilerplate' ELSE rule END) FILTER (WHERE rule IS NOT NULL))), ',') AS failed_rules FROM r GROUP BY 1
), b AS (
  SELECT doc_id, rid, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN c USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_share <= {_RULES.max_lost_share} AND words_left >= {_RULES.min_words_left} AS kept,
       lost_share, CAST(clean_chars AS BIGINT) AS clean_chars, coalesce(failed_rules, '') AS failed_rules
FROM b JOIN v USING (rid)
"""
