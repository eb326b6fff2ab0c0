"""Column functions on text: cleaning, metrics, page scores."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import config

#: Unicode white space as the rules mean it: Java's, the four separators and the byte-order mark.
SPACE = r"\s\x1c-\x1f\uFEFF"


def txt(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at both ends, any Unicode kind. Only the ends are looked at."""
    return F.btrim(c, F.lit(BLANKS))


def collapse_space(c: Column) -> Column:
    return strip(F.regexp_replace(txt(c), rf"(?U)[{SPACE}]+", F.lit(" ")))


def rounded(c: Column, digits: int = 1) -> Column:
    """Half up, also below zero towards plus infinity."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def lines(c: Column) -> Column:
    return F.split(txt(c), r"\r\n|[\n\r\x0B\f\x1c-\x1e\u0085\u2028\u2029]")


def expand_tabs(line: Column, width: int = 4) -> Column:
    """Tabs to the next multiple of width; only lines that have one are folded."""
    parts = F.split(line, "\t")
    wide = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.element_at(parts, 1),
        lambda a, p: F.concat(a, F.repeat(F.lit(" "), width - F.length(a) % width), p),
    )
    return F.when(line.contains("\t"), wide).otherwise(line)


def clean_document_text(c: Column) -> Column:
    """LF line ends, no control characters, tabs as spaces, no trailing blanks, one blank line in a row at most."""
    unix = F.regexp_replace(txt(c), r"\r\n?", F.lit("\n"))
    plain = F.regexp_replace(unix, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", F.lit(""))
    right = F.transform(F.split(plain, "\n"), lambda x: F.regexp_replace(expand_tabs(x), rf"(?U)[{SPACE}]+$", F.lit("")))
    return strip(F.regexp_replace(F.array_join(right, "\n"), r"\n{3,}", F.lit("\n\n")))


def strip_boilerplate_lines(c: Column, phrases: tuple[str, ...]) -> Column:
    """Without the lines that hold one of the phrases, in any case."""
    has = lambda x: F.exists(F.array(*[F.lit(p.lower()) for p in phrases]), lambda p: F.contains(F.lower(x), p))
    return F.array_join(F.filter(F.split(txt(c), "\n"), lambda x: ~has(x)), "\n")


#: How footers begin. A signer's name, which the rules had too, is for callers to add.
FOOTERS = r"(?iuU)^(S6:|Luu:|PHO TRUONG|KT\.\s|Noi nhan|PHONG )"


def garbage_line(c: Column, footers: str = FOOTERS) -> Column:
    """Too short, a capital-letter heading, or the start of a footer."""
    heading = c.rlike(r"^[A-Z\s.\-/\\&()]+$") & (F.length(c) < 60)
    return (F.length(c) < 5) | heading | c.rlike(footers)


def _share(c: Column, ink: Column) -> Column:
    return F.when(ink == 0, F.lit(0.0)).otherwise(F.bround(c / ink, 4))


COUNTS = "ink int, diacritics int, letters int, suspicious int, repeated int, lines int, words int"
_INK, _DIACRITIC, _LETTER, _SUSPICIOUS, _BREAK = (1 << k for k in range(5))
#: Line ends besides a carriage return before a line feed, which makes one with it.
BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The classes of every code point, a byte each."""
    out = np.full(sys.maxunicode + 1, _INK, np.uint8)
    out[[ord(c) for c in BLANKS]] = 0
    for bit, chars in ((_DIACRITIC, config.DIACRITICS), (_SUSPICIOUS, re.sub(r"\\(.)", r"\1", config.SUSPICIOUS)), (_BREAK, BREAKS)):
        out[[ord(c) for c in set(chars)]] |= bit
    out[[i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i))[0] in "LN"]] |= _LETTER
    return out


def _counted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Counts of COUNTS by one look at each character's class."""
    for batch in texts:
        yield pd.DataFrame([_count(t) for t in batch], columns=[c.split()[0] for c in COUNTS.split(", ")])


def _count(text: str) -> tuple[int, ...]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _classes()[codes]
    ink = (kinds & _INK).astype(bool)
    n = [int(np.count_nonzero(kinds & k)) for k in (_INK, _DIACRITIC, _LETTER, _SUSPICIOUS)]
    # runs of equal characters, four or more, that aren't line feeds
    starts = np.flatnonzero(np.diff(codes, prepend=np.uint32(sys.maxunicode + 1)) != 0)
    sizes = np.diff(starts, append=len(codes))
    repeated = int(sizes[(sizes >= 4) & (codes[starts] != 10)].sum())
    begins = ink & ~np.concatenate([[False], ink[:-1]]) if len(ink) else ink
    # lines are told apart by the breaks before them
    lines = len(np.unique(np.cumsum((kinds & _BREAK) > 0)[ink]))
    if not n[0] and text:
        lines = len(re.split(f"\r\n|[{BREAKS}]", re.sub(f"(\r\n|[{BREAKS}])\\Z", "", text)))
    return (*n, repeated, lines, int(np.count_nonzero(begins)))


MARKS = "ink int, suspicious int, letters int, runs int, inner int"


def _marked(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([_mark(t) for t in batch], columns=[c.split()[0] for c in MARKS.split(", ")])


def _mark(text: str) -> tuple[int, ...]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _classes()[codes]
    ink = np.flatnonzero(kinds & _INK)
    starts = np.flatnonzero(np.diff(codes, prepend=np.uint32(sys.maxunicode + 1)) != 0)
    runs = (np.diff(starts, append=len(codes)) >= 5) & (codes[starts] != 10)
    inner = int(ink[-1] - ink[0] + 1) if len(ink) else 0
    return (len(ink), *(int(np.count_nonzero(kinds & k)) for k in (_SUSPICIOUS, _LETTER)), int(runs.sum()), inner)


def text_marks(c: Column) -> Column:
    """Struct of what checks ask of a text, by one look at each character: characters that aren't white space, odd ones,
    letters and digits, runs of five equal ones or more that aren't line feeds, and the length without white space at both
    ends. Not for use inside a lambda."""
    return F.pandas_udf(_marked, MARKS)(txt(c))


def text_metrics(c: Column, patterns: tuple[tuple[str, str], ...] = config.LEGAL_PATTERNS) -> Column:
    """Struct of the nine metrics. Shares are of characters that aren't white space, to four places, half to even. Characters
    are counted in one pass over their classes, in Arrow batches; what a dozen expressions each make of a text costs twenty
    times that. Not for use inside a lambda."""
    t = txt(c)
    found = F.array_compact(F.array(*[F.when(t.rlike("(?iuU)" + p), F.lit(name)) for p, name in patterns]))

    def of(n: Column) -> Column:
        ink = n["ink"]
        return F.struct(
            F.length(t).alias("text_length"),
            ink.alias("non_whitespace_chars"),
            _share(n["diacritics"], ink).alias("vietnamese_character_ratio"),
            _share(n["letters"], ink).alias("alphanumeric_ratio"),
            _share(n["suspicious"], ink).alias("suspicious_character_ratio"),
            _share(n["repeated"], ink).alias("repeated_character_ratio"),
            n["lines"].alias("line_count"),
            n["words"].alias("word_count"),
            F.when(ink == 0, F.array().cast("array<string>")).otherwise(found).alias("detected_legal_patterns"),
        )

    # as a lambda's variable the counts are made once, however many shares look at them
    return F.get(F.transform(F.array(F.pandas_udf(_counted, COUNTS)(t)), of), F.lit(0))


def page_score(metrics: Column, c: Column) -> Column:
    """Struct of score, label and warnings (rule names) of a page from its metrics and text."""
    inked = F.filter(lines(c), lambda x: strip(x) != "")
    broken = (F.size(inked) > 5) & (F.size(F.filter(inked, lambda x: F.length(x) <= 3)) > 0.4 * F.size(inked))
    m = lambda name: metrics[name]
    rules = (
        ("too_short", m("text_length") < 80, 40),
        ("many_odd_characters", m("suspicious_character_ratio") > 0.08, 30),
        ("odd_characters", (m("suspicious_character_ratio") > 0.03) & (m("suspicious_character_ratio") <= 0.08), 15),
        ("repeated_characters", m("repeated_character_ratio") > 0.10, 20),
        ("few_letters", m("alphanumeric_ratio") < 0.65, 25),
        ("broken_lines", broken, 15),
        ("few_diacritics", (m("vietnamese_character_ratio") < 0.01) & (m("text_length") > 150), 10),
        ("no_legal_pattern", (F.size(m("detected_legal_patterns")) == 0) & (m("text_length") > 300), 10),
    )
    lost = sum((F.when(test, penalty).otherwise(0) for _, test, penalty in rules), F.lit(0))
    empty = m("non_whitespace_chars") == 0
    score = F.when(empty, 0).otherwise(F.greatest(F.lit(0), 100 - lost))
    warnings = F.when(empty, F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test, _ in rules])))
    return F.struct(score.alias("score"), quality_label(score).alias("label"), warnings.alias("warnings"))


def quality_label(score: Column) -> Column:
    return F.when(score >= 90, "GOOD").when(score >= 70, "ACCEPTABLE").when(score >= 50, "WARNING").otherwise("POOR")


def html_to_text(c: Column) -> Column:
    """Script and style dropped, tags as blank lines, the common entities resolved, cleaned."""
    t = F.regexp_replace(txt(c), r"(?is)<(script|style)\b.*?</\1\s*>", F.lit(" "))
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", F.lit(""))
    return clean_document_text(unescape(F.regexp_replace(t, r"(?s)<[^>]+>", F.lit("\n"))))


def unescape(c: Column) -> Column:
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c
