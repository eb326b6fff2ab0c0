"""Joins on a substring, by an index of grams.

A text that holds a part holds all grams (runs of a few characters) of it. Each part is indexed by one of its grams, the
one that the fewest texts hold; texts meet the parts by an equi-join of hashed grams, and only those that share it are
tested. Texts and parts don't go with the grams: a candidate is a pair of hashes, to which both are joined before the
test, so what hashes confuse is only tested for nothing. Equal ones meet by a digest and aren't tested.

Grams by a part's length: below EXACT characters the part itself; below 2 * EXACT all its grams of EXACT; above, by powers of
two, of every window of that many characters the gram of half its size with the least hash. A text chooses in its windows as
the part does in its own, so that it holds all grams that the part has, of which it gives few: the longer, the fewer. Texts
give only the grams of the lengths that parts have, and of those only what a bitmap of all parts' grams lets through; its
size is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.shared import bound_batches, stored

EXACT, LONGEST = 8, 128
#: Bits of the bitmap of a length's grams, two of which stand for a gram; Spark makes it in buckets of 32,768.
LOG_BITS, BUCKET = 24, 1 << 15
BITS = 1 << LOG_BITS
#: An id's last bits are the text's length, or this if it is longer.
LENGTHS = (1 << 16) - 1
#: Characters of texts that are taken at once, about; each takes some 100 bytes then.
SLICE = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _kind(length: Column) -> Column:
    """How a part of a length is indexed: the length of its windows."""
    out = F.lit(LONGEST)
    k = LONGEST // 2
    while k >= EXACT:
        out = F.when(length < 2 * k, k).otherwise(out)
        k //= 2
    return F.when(length < EXACT, length).otherwise(out).cast("int")


def _hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Of every place the hash of the size characters from there on; what reaches over the end isn't told apart."""
    out, power, n = codes, int(MULTIPLIER), 1
    ahead = lambda a, k: np.concatenate([a[k:], np.zeros(min(k, len(a)), np.uint64)])
    if size < EXACT:
        for k in range(1, size):
            out = out * MULTIPLIER + ahead(codes, k)
    else:
        while n < size:
            out, power, n = out * np.uint64(power) + ahead(out, n), power * power % (1 << 64), 2 * n
    # mixed, so that the least of several is any of them and bits are even
    out = out + np.uint64(size * int(MULTIPLIER) % (1 << 64))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(by)
    return out ^ (out >> np.uint64(31))


def _least(a: np.ndarray, width: int) -> np.ndarray:
    """Of every place the least of width values from there on."""
    ahead = lambda x, k: np.concatenate([x[k:], np.full(min(k, len(x)), np.iinfo(np.uint64).max, np.uint64)])
    n = 1
    while 2 * n <= width:
        a, n = np.minimum(a, ahead(a, n)), 2 * n
    return np.minimum(a, ahead(a, width - n)) if width > n else a


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = at & np.uint64(BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _grams_of(texts: pa.Array, ids: np.ndarray, kinds: list[int], own: np.ndarray | None, bits: dict[int, np.ndarray] | None) -> Iterator[pd.DataFrame]:
    """(id, gram, kind) of a batch's texts, each once a kind: of all kinds, or if own is given of each text's own kind."""
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    row = np.repeat(np.arange(len(sizes)), sizes)
    left = np.cumsum(sizes)[row] - np.arange(len(codes))
    for kind in kinds:
        gram = kind if kind < 2 * EXACT else kind // 2
        values = _least(_hashes(codes, gram), kind - gram + 1)
        ok = left >= kind
        if own is not None:
            ok &= own[row] == kind
        at = np.flatnonzero(ok)
        if bits is not None:
            at = at[_has(bits[kind], values[at])]
            at = at[_has(bits[kind], values[at] >> np.uint64(LOG_BITS))]
        yield pd.DataFrame({"id": ids[row[at]], "gram": values[at].view(np.int64)}).drop_duplicates().assign(kind=np.int32(kind))


def _id(text: str) -> Column:
    """A hash of a text that ends in its length, so that of two ids the one of the longer text shows."""
    return F.xxhash64(text).bitwiseAND(~LENGTHS).bitwiseOR(F.least(F.length(text), F.lit(LENGTHS)).cast("long"))


def _grams(rows: DataFrame, text: str, kinds: list[int], bits: dict[int, bytes] | None = None, own: bool = False) -> DataFrame:
    """(_id, _gram, _kind) of the texts of rows."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(bits) if bits is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {k: np.frombuffer(x, np.uint8) for k, x in held.value.items()} if held is not None else None
        for b in batches:
            turn = np.cumsum(pc.utf8_length(b.column("_text")).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
            cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(turn)]
            for x in (b.slice(lo, hi - lo) for lo, hi in pairwise(cuts) if lo < hi):
                of = x.column("_kind").to_numpy(zero_copy_only=False) if own else None
                for found in _grams_of(x.column("_text"), x.column("_id").to_numpy(zero_copy_only=False), kinds, of, table):
                    for lo in range(0, len(found), 200_000):
                        yield pa.RecordBatch.from_pandas(found[lo : lo + 200_000].set_axis(["_id", "_gram", "_kind"], axis=1), preserve_index=False)

    return rows.select(_id(text).alias("_id"), F.col(text).alias("_text"), _kind(F.length(text)).alias("_kind")).mapInArrow(run, "_id long, _gram long, _kind int")


def _bitmaps(grams: DataFrame, kinds: list[int]) -> dict[int, bytes]:
    """By kind, two bits for each gram. BITS / 8 bytes a kind reach the driver, whatever the number of grams; there are at
    most a dozen kinds."""
    two = F.explode(F.array("_gram", F.shiftrightunsigned("_gram", LOG_BITS))).alias("_bit")
    bit = F.col("_bit").bitwiseAND(BITS - 1)
    made = grams.select("_kind", two).groupBy("_kind", F.floor(bit / BUCKET).alias("b")).agg(F.bitmap_construct_agg(bit % BUCKET).alias("m"))
    out = {k: bytearray(BITS // 8) for k in kinds}
    for r in made.toLocalIterator():
        out[r["_kind"]][r.b * BUCKET // 8 : (r.b + 1) * BUCKET // 8] = r.m
    return {k: bytes(x) for k, x in out.items()}


def strictly_held(t: DataFrame, p: DataFrame, text: str, part: str) -> DataFrame:
    """The rows of t and p of which text contains part and is longer. Both are stored, without empty texts, and should hold
    each text once. What is made of them on the way is written to the shared folder, so that none is made twice.

    Cost: one row a gram of a text that a part may have, and what shares a part's rarest gram."""
    bound_batches(t.sparkSession)
    kinds = sorted(r._k for r in p.select(_kind(F.length(part)).alias("_k")).distinct().collect())  # at most a dozen
    wanted = stored(_grams(p, part, kinds, own=True).withColumnRenamed("_id", "_part"), "part-grams")
    held = stored(_grams(t, text, kinds, bits=_bitmaps(wanted, kinds)).drop("_kind"), "text-grams")
    common = held.groupBy("_gram").agg(F.count("*").alias("_n"))
    # a part with a gram that no text holds is in none
    index = wanted.join(common, "_gram", "left").groupBy("_part").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_least"))
    index = stored(index.where("_least.n > 0").select("_part", F.col("_least.gram").alias("_gram")), "part-index")
    size = lambda c: F.col(c).bitwiseAND(LENGTHS)
    longer = (size("_id") > size("_part")) | (size("_id") == LENGTHS)
    # stored, so that few of them are known to be few before texts move to them
    candidates = stored(held.join(index, "_gram").where(longer).select("_id", "_part").distinct(), "candidates")
    met = candidates.join(p.withColumn("_part", _id(part)), "_part").join(t.withColumn("_id", _id(text)), "_id")
    return met.where(F.contains(text, part) & (F.length(text) > F.length(part))).select(*t.columns, *p.columns)


def equal_texts(t: DataFrame, p: DataFrame, text: str, part: str) -> DataFrame:
    """The rows of t and p of which text equals part. They meet by a digest of 256 bits; only t's text goes with it."""
    digest = lambda c: F.unhex(F.sha2(c, 256)).alias("_s")
    met = t.select("*", digest(text)).join(p.select(*[c for c in p.columns if c != part], digest(part)), "_s")
    return met.withColumn(part, F.col(text)).select(*t.columns, *p.columns)


def contains_join(texts: DataFrame, parts: DataFrame, text: str, part: str) -> DataFrame:
    """The rows of texts and of parts of which text contains part; empty and null ones meet nothing. Both should hold each
    text once: what has the same text is best folded before, and joined back after. Both are written to the shared folder."""
    t, p = stored(texts.where(F.length(text) > 0), "texts"), stored(parts.where(F.length(part) > 0), "parts")
    return strictly_held(t, p, text, part).unionByName(equal_texts(t, p, text, part))
