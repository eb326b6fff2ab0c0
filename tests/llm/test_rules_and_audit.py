"""URL filters and the filter audit on odd rows, against plain versions."""

import random
import re
from itertools import permutations

import numpy as np
import pytest

from quarry.llm import filter_audit, url_filters

URLS = [
    None, "", "no scheme/at/all", "http://Example.ORG/es/x", "https://a.example.org/es/", "http://example.org/en/12?x#y", "http://example.org/EN/1", "http://notexample.org/es/", "http://x.com/fr/a", "x://com/de/", "http://com.evil/de/",
    "http://x.org", "http://x.org?q=/", "http://x.net/r?u=http://example.org/es/", "http://x.net:80/Cart", "http://x.net/cartoon", "http://x.net/login?next=/", "http://m.ads-track.x.net/", "http://bads-x.net/", "http://x.net/a.ZIP", "http://x.net/a.zip?x",
    "://", "http:///path", "http://x.net/license/a.exe", "http://é.net/café-ads-x", "http://x.net/" + "a/" * 20000 + "viagra", "http://x.net/li\nne/cart",
]


def plain_verdict(url):
    """By every rule in turn, without an index."""
    host, path, rest = "", "", None
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        rest = (low := re.sub("[A-Z]", lambda m: m[0].lower(), host)) + rest[len(host) :]
        host, path = low, re.match(r"[^?#]*", rest[len(low) :])[0]
    sites = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    fit = [r for r in sites if ("." + host).endswith("." + r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
    if fit:
        best = max(fit, key=len)
        return host, path, best, sites[best], best
    hits = []
    for r in url_filters.PATTERN_RULES if rest is not None else ():
        text = r.removeprefix("@@")
        body = "".join("([^a-z0-9_.%-]|$)" if c == "^" else re.escape(c) for c in text.removeprefix("||").removesuffix("|"))
        form = (r"^([^/?#]*\.)?" if text.startswith("||") else "") + body + (r"\Z" if text.endswith("|") else "")
        if re.search(form.replace("|$)", r"|\Z)"), re.sub("[A-Z]", lambda m: m[0].lower(), rest)):
            hits.append((not r.startswith("@@"), -len(text), text))
    return host, path, None, "block" if hits and min(hits)[0] else "allow", min(hits)[2] if hits else None


def test_url_filters(spark):
    rows = [(i, u, "x", "mine") for i, u in enumerate([*URLS, *URLS[:6], "http://x.org/hot"] + ["http://x.com/de/hot"] * 50)]
    got = url_filters.judged(spark.createDataFrame(rows, "page_id long, url string, html string, rule string")).collect()
    assert len(got) == len(rows)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict, r.matched) for r in got} == {i: plain_verdict(u) for i, u, *_ in rows}
    assert url_filters.op11_url_filters(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert {r.verdict for r in url_filters.judged(spark.createDataFrame(rows, "page_id long, url string, html string, rule string"), (), "block").collect()} == {"block"}


def test_rules_are_indexed_by_their_rarest_whole_token(spark):
    addresses = spark.createDataFrame([(f"h{i}.net/common/{'rare' if i == 3 else 'also'}/x",) for i in range(20)], "address string")
    rules = ("/common/rare/", "/common/also*", "||net/common/", "common", "@@/never/common/")
    got = {r.text: (r.token, r.verdict) for r in url_filters.rule_index(rules, addresses).collect()}
    assert got == {"/common/rare/": ("rare", "block"), "/common/also*": ("common", "block"), "net/common/": ("common", "block"), "common": ("", "block"), "/never/common/": ("never", "allow")}
    rows = addresses.selectExpr("concat('http://', address) AS url", "1 AS page_id")
    assert {r.matched for r in url_filters.judged(rows, ("/common/rare/", "common")).collect()} == {"/common/rare/", "common"}
    with pytest.raises(ValueError):
        url_filters.compiled("||")


def test_rules_beyond_a_broadcast(spark):
    """A long list, joined by sorted tokens: the same verdicts."""
    rules = (*url_filters.BASE_RULES, *url_filters.PATTERN_RULES, *(f"||host{i}.example.net/bad/" for i in range(3000)), *(f"/word{i}/" for i in range(3000)))
    rows = spark.createDataFrame([(i, f"http://a.host{i}.example.net/{'bad' if i % 2 else 'good'}/word{i * 7}/" if i % 3 else "http://x.com/fr/") for i in range(2000)], "page_id long, url string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    got = {r.page_id: r.rule for r in url_filters.judged(rows, rules).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r.page_id: r.rule for r in url_filters.judged(rows, rules).collect()} == got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == {i: "com/fr/" if i % 3 == 0 else f"host{i}.example.net/bad/" if i % 2 else None for i in range(2000)}


def plain_audit(docs, labels):
    seen, rows = {}, []
    for i, t, p in docs:
        if i is not None:
            seen[t or ""] = min(i, seen.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    for i, t, p in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and seen[t] < i), strict=True) if bad}
        rows.append((p or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                left = [r for r in own if not r[1] & set(order[:k])]
                gone = [r for r in left if f in r[1]]
                total[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left) - len(gone), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return out


@pytest.mark.parametrize("n", [0, 1, 400])
def test_filter_audit(spark, n, monkeypatch):
    monkeypatch.setattr(filter_audit, "RANGE", 16)
    rng = random.Random(n)
    texts = [None, "", "A# b", "one two three", " ".join(f"w{k}" for k in range(150)), " ".join(["same"] * 150), "LOUD " * 30, "long " * 40000 + "$", "é\u2003ü x\x1cy", "tab\x0bbed"]
    docs = [(rng.choice([None, *range(n)]) if n > 1 else 5, rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(n)]
    labels = [(rng.choice([None, *range(n)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(n)]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, lang string, fails string").repartition(3)
    got = filter_audit.op13_filter_audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    wanted = plain_audit(docs, labels)
    assert len(got) == len(wanted)
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == wanted


def test_unions_of_sorted_lists():
    rng = random.Random(1)
    for _ in range(50):
        lists = [np.array(sorted(rng.sample(range(300), rng.choice([0, 1, 20, 250]))), np.int64) for _ in range(5)]
        sizes = filter_audit.union_sizes(lists)
        assert sizes == [len(set().union(*(set(x.tolist()) for k, x in enumerate(lists) if m >> k & 1))) for m in range(32)]
