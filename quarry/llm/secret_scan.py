"""Secret scans over an incremental blob ledger, as DataFrame expressions only.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds one row per blob and rule
version that was scanned, with the spans found (none is a result too). A scan takes the blobs that the ledger lacks for
its rule version, each once however many paths or versions hold it, appends them, and joins findings back to all paths.

Copies are folded before the shuffle (partial aggregation by digest), so a blob that a third of the paths hold is sent
once per task. Joining back moves digests and findings, never texts; Spark splits a digest that is hot there.

A ledger may hold a blob twice, where an append was retried or two scans ran at once: it is read by distinct blob.

Edge cases: a null text is the empty text. Repeated rows and ties are kept: one result per row. An empty table gives an
empty result. Extra columns pass; the ones this module adds (blob, spans) replace columns with their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_of, written

SPAN = "struct<start:int,rank:int,kind:string,end:int>"
SPANS = f"array<{SPAN}>"


@dataclass(frozen=True)
class Rule:
    """pattern matches leftmost, without overlap; of group, at least min_chars code points are needed."""

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 1
    #: A text without this string has no match; None: always look.
    hint: str | None = None


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = (
    Rule("assign", ASSIGN, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Further rules; their kinds rank after the base ones. None starts inside a run that it goes through, so that a text
#: takes time in proportion to its length.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 1, "PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1, "eyJ"),
    Rule("provider", r"(gh[pousr]_[A-Za-z0-9]{30,}|xox[baprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})", 0, 1),
    Rule("urlauth", r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{1,20}://[^\s:/@]+:[^\s:/@]+@", 0, 1, "://"),
)
RULES = BASE_RULES + MORE_RULES
RULE_VERSION = "1"


#: Matches of a text that are folded at once. A fold that grows an array copies it at every step, so long arrays are
#: folded in blocks, and what blocks add up to is folded once more.
BLOCK = 256


def _blocks(array: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(array) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(array, i + 1, BLOCK))


def _running(values: Column, step) -> Column:
    """For each of a few numbers what those before it come to, from 0 on."""
    return F.aggregate(values, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before")), lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["before"], F.array(a["at"])).alias("before")), lambda a: a["before"])


def _matches(text: Column, rule: Rule) -> Column:
    """The matches of a rule in order as (gap, size, value): the code points before each, its own, and those of what the rule
    judges. Gaps come from splitting at the matches; the last entry is the text's rest. Null without a match."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("value"),
    )
    there = text.rlike(rule.pattern) if rule.hint is None else text.contains(rule.hint) & text.rlike(rule.pattern)
    return F.when(there, parts)


def _placed(block: Column, rule: Rule, rank: int) -> Column:
    """(at, spans) of a block of matches: its length, and the spans that count, as if the text began with it."""
    span = lambda start, x: F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (start + x["size"]).alias("end"))
    return F.aggregate(
        block,
        F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + F.coalesce(x["size"], F.lit(0))).alias("at"),
            F.when(x["value"] >= rule.min_chars, F.concat(a["spans"], F.array(span(a["at"] + x["gap"], x)))).otherwise(a["spans"]).alias("spans"),
        ),
    )


def _placed_blocks(matches: Column, rule: Rule, rank: int) -> Column:
    return F.transform(_blocks(matches), lambda b: _placed(b, rule, rank))


def _moved(blocks: Column, starts: Column) -> Column:
    """The spans of each block where the block begins at its start."""
    pairs = F.arrays_zip(blocks.alias("b"), starts.alias("at"))
    place = lambda s, at: F.struct((s["start"] + at).alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), (s["end"] + at).alias("end"))
    return F.transform(pairs, lambda z: F.transform(z["b"]["spans"], lambda s: place(s, z["at"])))


def with_spans(rows: DataFrame, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows with spans: of all rules' matches, ordered by start, then rank. Takes time in proportion to a text's length
    and its matches. Each step is columns of its own, so that none is computed again inside another."""
    numbers = range(len(rules))
    c = lambda what, k: f"_secret_{what}{k}"
    rows = rows.withColumns({c("matches", k): _matches(F.col(text), r) for k, r in enumerate(rules)})
    rows = rows.withColumns({c("blocks", k): _placed_blocks(F.col(c("matches", k)), r, k) for k, r in enumerate(rules)})
    rows = rows.withColumns({c("starts", k): _running(F.transform(F.col(c("blocks", k)), lambda b: b["at"]), lambda a, x: a + x) for k in numbers})
    found = [F.coalesce(F.flatten(_moved(F.col(c("blocks", k)), F.col(c("starts", k)))), F.array().cast(SPANS)) for k in numbers]
    return rows.withColumn("spans", F.array_sort(F.concat(*found))).drop(*[c(what, k) for what in ("matches", "blocks", "starts") for k in numbers])


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION, text: str = "text") -> DataFrame:
    """Ledger rows (blob, rule_version, spans) for the blobs that the ledger lacks under this rule version."""
    blobs = versions.select(blob(F.col(text)).alias("blob"), text_of(text).alias("_text")).groupBy("blob").agg(F.first("_text").alias("_text"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    return with_spans(blobs, "_text", rules).select("blob", F.lit(rule_version).alias("rule_version"), "spans")


def scanned(versions: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION, text: str = "text") -> DataFrame:
    """Every row of versions with its blob and spans (array of start, rank, kind, end; ordered by start, then rank).
    ledger_path: an existing ledger; new rows are appended there. Without one a new ledger is written."""
    spark = versions.sparkSession
    if ledger_path is None:
        ledger = written(scan_unseen(versions, None, rules, rule_version, text), "blob-ledger")
    else:
        scan_unseen(versions, spark.read.parquet(ledger_path), rules, rule_version, text).write.mode("append").parquet(ledger_path)
        ledger = spark.read.parquet(ledger_path)
    found = ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", F.col("spans").alias("_spans")).dropDuplicates(["blob"])
    out = versions.withColumn("blob", blob(F.col(text))).join(found, "blob", "left")
    return out.withColumn("spans", F.coalesce("_spans", F.array().cast(SPANS))).drop("_spans")


def redacted(scans: DataFrame, text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """The rows of scanned() with every span replaced in the text; overlapping spans are replaced as one. A text with spans
    is cut into its characters once, and what stays is joined from slices of them."""
    there = F.size("spans") > 0
    b, top, chars, kept = (F.col(f"_secret_{x}") for x in ("blocks", "tops", "chars", "kept"))
    rows = scans.withColumns({"_secret_blocks": F.when(there, _blocks(F.col("spans"))), "_secret_chars": F.when(there, F.split(text_of(text), ""))})
    # where the spans before each block end
    rows = rows.withColumn("_secret_tops", _running(F.transform(b, lambda x: F.array_max(F.transform(x, lambda s: s["end"]))), F.greatest))

    def gaps(block: Column, before: Column) -> Column:
        """What lies between spans: from the farthest end so far to the start of one that is beyond it."""
        gap = lambda a, s: F.array(F.struct(a["top"].alias("lo"), s["start"].alias("hi")))
        start = F.struct(before.alias("top"), F.array().cast("array<struct<lo:int,hi:int>>").alias("out"))
        return F.aggregate(block, start, lambda a, s: F.struct(F.greatest(a["top"], s["end"]).alias("top"), F.when(s["start"] >= a["top"], F.concat(a["out"], gap(a, s))).otherwise(a["out"]).alias("out")), lambda a: a["out"])

    rows = rows.withColumn("_secret_kept", F.flatten(F.transform(F.arrays_zip(b.alias("b"), top.alias("top")), lambda z: gaps(z["b"], z["top"]))))
    part = lambda lo, n: F.array_join(F.slice(chars, lo + 1, n), "")
    end = F.array_max(F.transform("spans", lambda s: s["end"]))
    cut = F.concat(F.array_join(F.transform(kept, lambda g: F.concat(part(g["lo"], g["hi"] - g["lo"]), F.lit(mark))), ""), part(end, F.greatest(F.size(chars) - end, F.lit(0))))
    return rows.withColumn(text, F.when(there, cut).otherwise(F.col(text))).drop(*[f"_secret_{x}" for x in ("blocks", "tops", "chars", "kept")])


def op6_secret_scan(docs: DataFrame) -> DataFrame:
    s = scanned(docs.select("doc_id", "text"))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["rank"] < len(BASE_RULES))
    return s.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
