"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the test items are put in one suffix automaton. Training texts stream through it word by word;
the state keeps the longest run of words, ending here, that some item holds. Where that run is as long as a window, the
window is looked up exactly (which items hold it) and its words are hit.

Items are dealt into blocks of BLOCK_CHARS of text (and one item more at most). A task per block builds its automaton and
stores it; the driver never unpacks one, but hands a block's bytes to all tasks, one block at a time. Documents are read
once a block; of all blocks but the last only the hits are written, keyed by a digest of the text, since hits depend on
nothing else. The last block's map carries the documents themselves, so with one block nothing is written or shuffled;
with more, the stored hits are joined to its rows by digest.

Edge cases: null or wordless texts have no words, null or wordless items no windows. An item of fewer words than a window
is one window. items are each counted, items of the same id once; items without id count as one item, whose id is
left out of hit_items' text. Repeated rows get a result each. Empty tables give empty or clean results.
Extra columns pass; added names (n_words, n_hit, hit_items, hit_spans) replace theirs.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import bound_batches, own_columns, written

WINDOW = 10
#: Characters of items in a block: its automaton is what a worker holds and what is broadcast.
BLOCK_CHARS = 1_000_000
_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Bytes to bytes: A-Z lower-cased, what is no part of a word to a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def folded(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Items:
    """The automaton over a block of items, with the windows that each holds."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.window, self.ids = window, []
        self.vocabulary: dict[bytes, int] = {}
        self.next, self.link, self.length = [{}], [-1], [0]
        self.windows: dict[tuple[int, ...], list[int]] = {}
        self.sizes: list[int] = []
        sizes = set()
        for item_id, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in folded(text)]
            if not words:
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            n = min(window, len(words))
            sizes.add(n)
            for i in range(len(words) - n + 1):
                held = self.windows.setdefault(tuple(words[i : i + n]), [])
                if not held or held[-1] != k:
                    held.append(k)
            self._add(words)
        self.sizes = sorted(sizes)

    def _add(self, words: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            if w in nxt[last] and length[nxt[last][w]] == length[last] + 1:
                last = nxt[last][w]  # this prefix is known from an item before
                continue
            known = w in nxt[last]
            if known:
                last = self._split(last, w)
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, w)
            last = new

    def _split(self, p: int, w: int) -> int:
        """Gives p's step by w a state of its own length."""
        nxt, link, length = self.next, self.link, self.length
        q, copy = nxt[p][w], len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def lengths(self, words: list[int | None]) -> Iterator[tuple[int, int]]:
        """(position, length of the longest run ending there that an item holds), where a window may end."""
        if not self.sizes:
            return
        nxt, link, length, least = self.next, self.link, self.length, self.sizes[0]
        state = run = 0
        for i, w in enumerate(words):
            if w is None:
                state = run = 0
                continue
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = nxt[state].get(w)
            if to is None:
                run = 0
                continue
            state = to
            run += 1
            if run >= least:
                yield i, run

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[int]]:
        """Number of words, hit spans of words (end exclusive, joined where they touch), items in order."""
        words = folded(text)
        known = list(map(self.vocabulary.get, words))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for i, run in self.lengths(known):
            for n in self.sizes:
                if n > run:
                    break
                if held := self.windows.get(tuple(known[i - n + 1 : i + 1])):
                    items.update(held)
                    a = i - n + 1
                    while spans and spans[-1][1] >= a:  # ends rise, so only the last spans can touch
                        a = min(a, spans.pop()[0])
                    spans.append((a, i + 1))
        return len(words), spans, sorted(items)


_SPAN, _SPANS = pa.struct([pa.field("start", pa.int32()), pa.field("end", pa.int32())]), "array<struct<start:int,end:int>>"
ADDED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, joined where they touch."""
    out: list[tuple[int, int]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(s)
    return out


def item_blocks(items: DataFrame, item_id: str, text: str, block_chars: int) -> DataFrame:
    """(bucket, part, i, t) of the distinct items: as many hash buckets as their characters need, each cut where its running
    size passes block_chars, so that a block's size is bounded however the hashes fall."""
    each = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("t <> ''").distinct()
    total = each.agg(F.sum(F.length("t"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("i", "t"), F.lit(total // block_chars + 1))
    before = Window.partitionBy("bucket").orderBy("i", "t").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("t")).over(before), F.lit(0))
    return each.withColumn("bucket", bucket).withColumn("part", F.floor(start / block_chars))


def automata(items: DataFrame, window: int, item_id: str, text: str, block_chars: int) -> DataFrame:
    """(block, automaton): one pickled automaton per block, each built in a task and stored."""

    def build(table: pa.Table) -> pa.Table:
        held = Items(list(zip(table["i"].to_pylist(), table["t"].to_pylist(), strict=True)), window)
        name = f"{table['bucket'][0].as_py()}-{table['part'][0].as_py()}"
        return pa.table({"block": [name], "automaton": pa.array([pickle.dumps(held)], pa.binary())})

    blocks = item_blocks(items, item_id, text, block_chars)
    return written(blocks.groupBy("bucket", "part").applyInArrow(build, "block string, automaton binary"), "automata")


class Packed:
    """A pickled value that is unpacked where it is received: bytes on the driver, the value in a task."""

    def __init__(self, data: bytes):
        self.data = data

    def __reduce__(self):
        return pickle.loads, (self.data,)


def _hits(shared: Broadcast):
    """Of (text, digest): the digests of texts with hits, once a task and batch, with items and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for b in batches:
            out: dict[bytes, tuple[list[str], list[dict[str, int]]]] = {}
            for t, digest in zip(b.column("t"), b.column("digest").to_pylist(), strict=True):
                if digest not in out:
                    _, s, i = items.hits(t.as_py())
                    if s:
                        out[digest] = [items.ids[x] for x in i], [{"start": x, "end": y} for x, y in s]
            ids, spans = [v[0] for v in out.values()], [v[1] for v in out.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, pa.list_(_SPAN))], names=["digest", "ids", "spans"])

    return run


def _pass(shared: Broadcast, text: str):
    """Adds n_words, hit_items and hit_spans of one block to all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for b in batches:
            n, ids, spans = [], [], []
            for t in b.column(text):
                k, s, i = items.hits(t.as_py())
                n.append(k)
                ids.append([items.ids[x] for x in i])
                spans.append([{"start": x, "end": y} for x, y in s])
            added = [pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, pa.list_(_SPAN))]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, *[f.name for f in ADDED]])

    return run


def _joined(spans: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "end": z} for a, z in _merge([(x["start"], x["end"]) for x in s])] for s in spans], dtype=object)


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def matched(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Adds n_words, n_hit, hit_items (ids as sorted strings) and hit_spans (word positions) to every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.drop("n_hit", *[f.name for f in ADDED])
    stored = automata(items, window, item_id, item_text, block_chars)
    names = sorted(r.block for r in stored.select("block").collect())

    def of(name: str) -> Broadcast:
        return spark.sparkContext.broadcast(Packed(bytes(stored.where(F.col("block") == name).first().automaton)))

    earlier = None
    for name in names[:-1]:
        shared = of(name)
        found = docs.select(F.col(text).alias("t"), digest_of(F.col(text)).alias("digest")).mapInArrow(_hits(shared), f"digest binary, ids array<string>, spans {_SPANS}")
        found = written(found, "hits")
        shared.destroy()
        earlier = found if earlier is None else earlier.union(found)
    last = of(names[-1]) if names else spark.sparkContext.broadcast(Items([], window))
    out = docs.mapInArrow(_pass(last, text), T.StructType([*docs.schema.fields, *ADDED]))
    if earlier is not None:
        # a text's hits in one block are the same from every task
        merged = earlier.distinct().groupBy("digest").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("spans")).alias("spans"))
        merged = written(merged, "hits")  # a table of known size: Spark broadcasts it or not by its own threshold
        join = F.pandas_udf(_joined, _SPANS)
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        both = out.select(row, *[f.name for f in ADDED], digest_of(F.col(text)).alias("digest")).join(merged, "digest", "left")
        spans = F.when(F.col("ids").isNull(), F.col("hit_spans")).otherwise(join(F.concat("hit_spans", F.coalesce("spans", F.array().cast(_SPANS)))))
        ids = F.concat("hit_items", F.coalesce("ids", F.array().cast("array<string>")))
        out = both.select("row.*", "n_words", ids.alias("hit_items"), spans.alias("hit_spans"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.withColumns({"n_hit": n_hit, "hit_items": F.array_sort("hit_items")})


def _without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    def cut(text: str, hit) -> str:
        if text is None or not len(hit):
            return text
        words = [m.span() for m in WORD.finditer(text)]
        out, at = [], 0
        for s in hit:
            out.append(text[at : words[s["start"]][0]])
            at = words[s["end"] - 1][1]
        return "".join([*out, text[at:]])

    return pd.Series([cut(t, h) for t, h in zip(texts, spans, strict=True)], dtype=object)


def decontaminated(docs: DataFrame, items: DataFrame, max_span: int = 0, max_coverage: float = 0.5, **kw) -> DataFrame:
    """The rows of documents without the spans of more than max_span words that items hold; rows of which items hold
    more than max_coverage are dropped. Clean rows come back as they are. Columns as in docs."""
    text = kw.get("text", "text")
    long = F.filter("hit_spans", lambda s: s["end"] - s["start"] > max_span)
    cut = F.pandas_udf(_without, "string")

    def clean(d: DataFrame) -> DataFrame:
        m = matched(d, items, **kw).where((F.col("n_hit") == 0) | (F.col("n_hit") <= max_coverage * F.col("n_words")))
        return m.withColumn(text, F.when(F.size(long) > 0, cut(F.col(text), long)).otherwise(F.col(text)))

    return own_columns(docs, ("n_words", "n_hit", "hit_items", "hit_spans"), clean)


def op8_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return matched(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", "n_words", "n_hit", F.size(F.array_distinct("hit_items")).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_distinct("hit_items"), ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {docs}
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {items}
), iw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)
), h AS (
  SELECT dw.doc_id, dw.k, p, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g
), c AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS word FROM h) GROUP BY 1
), g AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id)
"""
