"""How filters interact: what each removes after others, in every order, by part of the corpus.

Filters judge rows once, in one map over texts. Rows get numbers that grow with their place in the stored verdicts; a
range of numbers has, for each part, one sorted list of failing numbers a filter, of at most RANGE entries. Within a range,
unions of k lists are made by merging: the entries of the shorter list gallop to their places in the longer one (by
bisection), those that aren't there yet are put in. The size of a filter's list less a union is that of the union with it
less that of the union without it, so sizes of the 2^k unions, over all rows, rows of good quality and toxic rows, are all
that every order needs. Sizes of ranges are summed; what follows are tables of parts, unions and orders.

Copies are found by digest: the least id of each distinct text is a partial minimum, joined back by digest, so no copies
meet in a task. A range's lists are bounded whatever a part's share, and nothing but digests and ids is shuffled.

Edge cases: a null text is the empty text, a null part the empty string. A row without id has no smaller one and lets no
other row fail; repeated rows count each. Labels: a row counts as good or toxic if any label of its id says so; ids
without labels, and null ids, are neither. An empty table gives no parts, thus no rows. Long texts are judged whole. Extra
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, text_of, written

FILTERS = "ABCDE"
#: Row numbers of one range: the longest that a list can be.
RANGE = 1 << 16
LETTERS = bytes(range(ord("A"), ord("Z") + 1))
ODD_CHARS = b"#$%&*|"


def fails_of(raw: bytes, chars: int) -> int:
    """Bits of the filters A to D that a text in UTF-8 fails. Words are what bytes.split() leaves: it splits at the six
    ASCII white-space characters."""
    words = raw.split()
    short = len(words) < 100
    same = 100 * len(set(words)) < 80 * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, LETTERS))) > 10 * chars
    odd = len(raw.translate(None, ODD_CHARS)) < len(raw)
    return short | same << 1 | loud << 2 | odd << 3


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("_text")
        fails, digests = [], []
        for t, n in zip(texts.cast(pa.binary()), pc.utf8_length(texts).to_pylist(), strict=True):
            raw = t.as_py()
            fails.append(fails_of(raw, n))
            digests.append(hashlib.sha256(raw).digest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(fails, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "fails", "digest"])


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """(part, fails, good, toxic) a row of docs: fails has the bits of the filters it fails, A the lowest."""
    bound_batches(docs.sparkSession)
    ids = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), text_of(text).alias("_text"))
    rows = written(rows.mapInArrow(_judge, f"doc_id {ids}, part string, fails int, digest binary"), "audit-verdicts")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    copy = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)).cast("int")
    out = rows.join(first, "digest", "left").join(said, "doc_id", "left")
    return out.select("part", (F.col("fails") + 16 * copy).alias("fails"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists of the rows of a batch, whose numbers grow: one row a part and range."""
    for b in batches:
        number, fails = b.column("_row").to_numpy(), b.column("fails").to_numpy()
        kinds = [np.ones(len(fails), bool), np.asarray(b.column("good")), np.asarray(b.column("toxic"))]
        coded = b.column("part").dictionary_encode()
        part, ranges = coded.indices.to_numpy(), number // RANGE
        order = np.lexsort((number, ranges, part))
        ends = np.flatnonzero(np.diff(part[order]) | np.diff(ranges[order])) + 1
        out: dict[str, list] = {k: [] for k in ("part", "range", "kind", "rows", "lists")}
        for here in np.split(order, ends) if len(order) else ():
            for kind, of in enumerate(kinds):
                own = here[of[here]]
                out["part"].append(coded.dictionary[int(part[here[0]])].as_py())
                out["range"].append(int(ranges[here[0]]))
                out["kind"].append(kind)
                out["rows"].append(len(own))
                out["lists"].append([number[own[fails[own] >> k & 1 > 0]] for k in range(len(FILTERS))])
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("part", pa.string()), ("range", pa.int64()), ("kind", pa.int32()), ("rows", pa.int64()), ("lists", pa.list_(pa.list_(pa.int64())))]))


def posting_lists(verdicts: DataFrame) -> DataFrame:
    """(part, range, kind, rows, lists) of a stored table of verdicts: for a range of row numbers the sorted failing numbers
    of each filter. kind 0: all rows, 1: the good ones, 2: the toxic ones; rows: how many those are."""
    rows = verdicts.select("part", "fails", "good", "toxic", F.monotonically_increasing_id().alias("_row"))
    return rows.mapInArrow(_lists, "part string, range long, kind int, rows long, lists array<array<long>>")


def absent(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of one sorted list that another lacks, and their places in it."""
    at = np.searchsorted(long, short)
    there = at < len(long)
    there[there] = long[at[there]] == short[there]
    return short[~there], at[~there]


def union(lists: list[np.ndarray]) -> np.ndarray:
    """The union of k sorted lists, the longest first: each further one gallops through what is there already."""
    first, *rest = sorted(lists, key=len, reverse=True)
    for more in rest:
        first = np.insert(first, *absent(more, first)[::-1])
    return first


def union_sizes(lists: list[np.ndarray]) -> list[int]:
    """Sizes of the unions of all subsets of the lists, by their bits."""
    unions = [np.array([], np.int64)]
    for mask in range(1, 1 << len(lists)):
        top = mask.bit_length() - 1
        unions.append(union([unions[mask ^ 1 << top], lists[top]]))
    return [len(u) for u in unions]


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = [union_sizes([np.asarray(x.values) for x in lists.values]) for lists in b.column("lists")]
        yield pa.RecordBatch.from_arrays([b.column("part"), b.column("kind"), b.column("rows"), pa.array(sizes, pa.list_(pa.int64()))], names=["part", "kind", "rows", "sizes"])


def measured(lists: DataFrame) -> DataFrame:
    """(part, mask, rows, n, good, toxic): how many rows a part has, and how many of all, of good and of toxic rows the
    filters of a mask remove together."""
    sizes = lists.select("part", "kind", "rows", "lists").mapInArrow(_sizes, "part string, kind int, rows long, sizes array<long>")
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
    each = sizes.select("part", "kind", "rows", F.posexplode("sizes").alias("mask", "n"))
    return each.groupBy("part", "mask").agg(F.sum(F.when(F.col("kind") == 0, F.col("rows")).otherwise(0)).alias("rows"), of(0).alias("n"), of(1).alias("good"), of(2).alias("toxic"))


def _steps() -> list[tuple[int, str, int, int, int]]:
    """(number, filter_order, step, mask before it, its filter's bit) of all steps of all orders."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    steps = [("".join(p), i + 1, sum(bit[x] for x in p[:i]), bit[f]) for p in permutations(FILTERS) for i, f in enumerate(p)]
    return [(k, *s) for k, s in enumerate(steps)]


def audited(sizes: DataFrame) -> DataFrame:
    """(part, filter_order, step, ...) of every order of the filters, from the sizes of their unions. All tables here are of
    parts times 32 unions or 600 steps."""
    k, steps = len(FILTERS), _steps()
    table = sizes.groupBy("part").agg(F.max("rows").alias("rows"), F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("u"))
    at = lambda mask, c: F.col("u")[mask][c]
    more = lambda before, bit, c: at(before.bitwiseOR(bit), c) - at(before, c)
    # so many orders have a set of filters, and no other, before a filter
    weight = {m: factorial(m.bit_count()) * factorial(k - 1 - m.bit_count()) for m in range((1 << k) - 1)}
    share = lambda b: sum((more(F.lit(m), F.lit(b), "n") * w for m, w in weight.items() if not m & b), F.lit(0))
    table = table.withColumn("shares", F.create_map(*[x for i in range(k) for x in (F.lit(1 << i), share(1 << i))]))
    orders = sizes.sparkSession.createDataFrame(steps, "_k int, filter_order string, step int, before int, bit int")
    each = table.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1)))).join(orders, "_k")
    before, bit = F.col("before"), F.col("bit")
    rest, removed = F.lit((1 << k) - 1).bitwiseXOR(bit), more(before, bit, "n")
    return each.select(
        "part", "filter_order", "step", (F.col("rows") - at(before.bitwiseOR(bit), "n")).alias("kept"), removed.alias("removed"), (at(bit, "n") - removed).alias("redundant"), more(rest, bit, "n").alias("unique_fails"),
        more(before, bit, "good").alias("good_lost"), more(before, bit, "toxic").alias("toxic_lost"), F.col("shares")[bit].alias("shapley"),
    )


def op13_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    verdicts = written(judged(docs, labels), "audit-rows")
    return audited(measured(posting_lists(verdicts)))


def oracle() -> str:
    """Counts of rows by the set of filters that they fail, then every order's steps against them."""
    masks = ", ".join(f"('{o}', {step}, {before}, {bit})" for _, o, step, before, bit in _steps())
    return f"""
WITH steps(filter_order, step, before, bit) AS (VALUES {masks}),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM {{docs}}),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM {{labels}} WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, mask),
e AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM e
"""


ORACLE = oracle()
