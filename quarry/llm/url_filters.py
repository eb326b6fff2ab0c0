"""Verdicts on addresses by lists of rules.

A rule is written as filter lists write them: `||` before a host that stands for itself and its subdomains, `|` for begin or
end, `*` for anything, `^` for a separator or the end, `@@` in front for an allowing rule. Rules see an address from its
host on, without the scheme. A rule that
is a host and a path's begin alone (`||example.org/es/`) is a site rule: of those that fit, the longest decides, allowing
or not. Where none fits, pattern rules decide: an allowing one before a blocking one, the longest of either; without any
the default stands. Patterns don't mind case, hosts neither; a site rule's path does.

Rules are indexed by one literal token, a run of letters and digits that every address they fit must hold whole: the one
that the fewest distinct addresses hold. The tokens of an address fetch its candidates by an equi-join, and only those
are tried as regular expressions. A rule without a whole token is a candidate everywhere, under the empty token.

Each distinct address is judged once; verdicts are joined back to the rows. Catalyst broadcasts the index while it is
small and joins by sorted tokens beyond that, where AQE splits tokens that many addresses have; only addresses and the
numbers of rules pass a shuffle.

Edge cases: a null address, or one without `://`, has an empty host and path, no rule and the default verdict. Repeated
rows each get a row; rules of one text count once, as allowing if one of them allows. Of rules of one length that of the
lower text decides. An empty table gives an empty result, an empty list the default. Long addresses are read whole. Extra
columns pass, added names (host, path, rule, verdict, matched) replace theirs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = re.compile("[a-z0-9]+")
SITE = re.compile(r"\|\|([^/|*^]+)(/[^|*^]*)")

#: The dealt rules.
BASE_RULES = ("@@||org/", "||example.org/es/", "||example.org/en/1", "@@||com/fr/", "||com/de/")
#: Hosts and paths that text for training is seldom taken from: advertising and tracking, pills, gambling, adult pages,
#: copied software, parts of a shop or an account, and files that aren't text.
PATTERN_RULES = (
    "-ads-", "||ads.", "||ad.", "-ads.", "||ads-", "||adserver.", "/adserver/", "/banners/", "||tracker.", "||tracking.", "-tracker.", "||doubleclick.", "/click?", "&affid=", "?affid=",
    "-pills.", "||pills-", "-pharmacy.", "||cheap-", "/viagra", "/cialis", "||casino", "-casino", "/casino/", "-poker.", "-betting.", "/betting/", "||porn", "-porn", "||xxx-", "/xxx/", "-adult.",
    "||warez", "-warez.", "/keygen", "/crack/", "-torrent.", "/torrent/", "/cart^", "/checkout^", "/login^", "/logout^", "/signin^", "/wp-login.php", "/wp-admin^",
    ".exe|", ".zip|", ".rar|", ".iso|", ".apk|", ".dmg|", ".jpg|", ".jpeg|", ".png|", ".gif|", ".mp3|", ".mp4|", ".avi|", "@@/licence^", "@@/license^",
)


@dataclass(frozen=True)
class Compiled:
    """A rule as rows of the index have it. tier 0: site, 1: pattern."""

    text: str
    verdict: str
    tier: int
    pattern: str
    tokens: tuple[str, ...]


def compiled(rule: str) -> Compiled:
    """The regular expression of a rule, over an address from its host on, and its whole tokens. A site rule sees the path as
    it stands, a pattern all in lower case."""
    body = rule.removeprefix("@@")
    if not body.strip("|*"):
        raise ValueError(f"a rule without text: {rule!r}")
    site = SITE.fullmatch(body)
    text = body.strip("|") if site else body
    out, rest = ["(?s)"], body
    if rest.startswith("||"):
        out.append(r"^([^/?#]*\.)?")
        rest = rest[2:]
    elif rest.startswith("|"):
        out.append("^")
        rest = rest[1:]
    end = rest.endswith("|")
    rest = rest.removesuffix("|")
    low = rest.translate(str.maketrans(UPPER, LOWER))
    if site:
        rest = low[: len(site[1])] + rest[len(site[1]) :]
    for c in rest if site else low:
        out.append(".*" if c == "*" else r"([^a-z0-9_.%-]|\z)" if c == "^" else re.escape(c))
    pattern = "".join(out) + (r"\z" if end else "")
    whole = [m for m in TOKEN.finditer(low) if _closed(low, m.start() - 1, body.startswith("|")) and _closed(low, m.end(), end)]
    return Compiled(text, ALLOW if rule.startswith("@@") else BLOCK, 0 if site else 1, pattern, tuple(sorted({m[0] for m in whole})))


def _closed(low: str, at: int, anchored: bool) -> bool:
    """Whether an address's token can't go on past a place of a rule: something else than a wildcard stands there."""
    return anchored if at in (-1, len(low)) else low[at] != "*"


def lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next of / ? #, A-Z in lower case; empty without a ://."""
    return lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _tokens(address: Column) -> Column:
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(lower(address), F.lit("[a-z0-9]+"), F.lit(0))))


def rule_index(rules: tuple[str, ...], addresses: DataFrame) -> DataFrame:
    """One row a rule (token, text, verdict, tier, pattern): token is that of its tokens which the fewest of the addresses
    (address) hold."""
    spark = addresses.sparkSession
    rows = {}
    for r in map(compiled, rules):
        if rows.setdefault((r.tier, r.text), r).verdict != r.verdict:
            rows[r.tier, r.text] = r if r.verdict == ALLOW else rows[r.tier, r.text]
    table = spark.createDataFrame([(r.text, r.verdict, r.tier, r.pattern, list(r.tokens) or [""]) for r in rows.values()], "text string, verdict string, tier int, pattern string, tokens array<string>")
    each = table.withColumn("token", F.explode("tokens")).drop("tokens")
    held = addresses.select(F.explode(_tokens(F.col("address"))).alias("token")).join(each.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = F.min_by(F.col("token"), F.struct(F.coalesce("n", F.lit(0)), F.col("token")))
    return each.join(held, "token", "left").groupBy("text", "verdict", "tier", "pattern").agg(rarest.alias("token"))


def judged(pages: DataFrame, rules: tuple[str, ...] = BASE_RULES + PATTERN_RULES, default: str = ALLOW, url: str = "url") -> DataFrame:
    """The rows with host, path, rule (the site rule that decides, else null), verdict, and matched (the rule of either
    kind that decides, else null)."""
    parts = {"host": host_of(F.col(url)), "path": path_of(F.col(url))}
    address = F.concat(host_of(F.col(url)), F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*(.*)", 1))
    rows = pages.drop("rule", "verdict", "matched").withColumns(parts | {"_address": F.when(F.contains(F.col(url), F.lit("://")), address)})
    addresses = rows.select(F.col("_address").alias("address")).where("address is not null").distinct()
    tokens = addresses.select("address", F.explode(_tokens(F.col("address"))).alias("token"))
    fits = tokens.join(rule_index(rules, addresses), "token").withColumn("_seen", F.when(F.col("tier") == 0, F.col("address")).otherwise(lower(F.col("address")))).where(F.rlike("_seen", F.col("pattern")))
    order = F.struct("tier", F.when(F.col("tier") == 1, (F.col("verdict") != ALLOW).cast("int")).otherwise(0), -F.length("text"), F.col("text"))
    best = fits.groupBy(F.col("address").alias("_of")).agg(F.min_by(F.struct("text", "verdict", "tier"), order).alias("_best"))
    out = rows.join(best, F.col("_address") == F.col("_of"), "left")
    return out.withColumns({"rule": F.when(F.col("_best.tier") == 0, F.col("_best.text")), "verdict": F.coalesce("_best.verdict", F.lit(default)), "matched": F.col("_best.text")}).drop("_address", "_of", "_best")


def op11_url_filters(pages: DataFrame) -> DataFrame:
    return judged(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "matched")


def _sql_rule(r: Compiled) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return f"({q(r.text)}, {q(r.verdict)}, {r.tier}, {q(r.pattern)})"


def oracle(rules: tuple[str, ...] = BASE_RULES + PATTERN_RULES) -> str:
    """Site rules by host and path's begin, pattern rules by regular expression, every rule against every address."""
    site = [c for c in map(compiled, rules) if not c.tier]
    hosts = ", ".join(f"('{c.text.partition('/')[0]}', '/{c.text.partition('/')[2]}', '{c.text}', '{c.verdict}')" for c in site)
    return f"""
WITH site(h, p, rule, verdict) AS (VALUES {hosts}),
pattern(text, verdict, tier, re) AS (VALUES {", ".join(_sql_rule(c) for c in map(compiled, rules) if c.tier)}),
u AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)', 1), '{UPPER}', '{LOWER}') AS low, row_number() OVER () AS k
  FROM {{pages}}),
s AS (
  SELECT k, max_by({{'rule': rule, 'verdict': verdict}}, length(rule)) AS best
  FROM u JOIN site ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k),
m AS (
  SELECT k, min_by({{'text': text, 'verdict': verdict}}, (verdict, -length(text), text)) AS best
  FROM u JOIN pattern ON regexp_matches(low, re) WHERE contains(url, '://') GROUP BY k)
SELECT page_id, host, path, s.best.rule AS rule, coalesce(s.best.verdict, m.best.verdict, 'allow') AS verdict, coalesce(s.best.rule, m.best.text) AS matched
FROM u LEFT JOIN s USING (k) LEFT JOIN m USING (k)
"""


ORACLE = oracle()
