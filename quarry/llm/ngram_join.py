"""Exact Jaccard self join on sets of word five-grams, by universe-partition pigeonhole.

Sets. A text's shingles are hashed to 64 bits; texts with equal sets are one class, named by a 64-bit digest of the set.
Everything after works on classes, so copies cost one row each.

Signatures. Sets whose similarity is 0.8 or more differ in H <= (a + b) / 9 elements in all. Sizes fall in bands; in a
band the universe of hashes is dealt into m segments, so two such sets agree in all but H segments. A class emits a
signature (hash of its elements there) for each segment that isn't empty, and for the first q segments also the
neighbourhood of one deletion, which lets a segment still match with one element more or less. Allocation of (m, q) per
band takes the cheapest pair, by rows, for which segments that are not empty outnumber H with a margin. A class with too
many empty segments for that (it is counted for each one) is short; the margin makes such classes rare, and they are
compared with all that share one of the first shingles in the order of the hashes. So no pair is missed.

Buckets. Entries (signature, class) are dealt and sorted by range of both, so that a signature which a third of all
classes hold is split among tasks, and one pass keeps those whose signature has a neighbour. Signatures with equal members
are one bucket. A class that has more segments than its differences can spoil leaves the most frequent buckets, as many as
it can spare (see rarest): those that stem from a passage which many texts hold.

Verification without all pairs. Shingles are counted over the classes in buckets: a class of which less than four fifths
occur in another one has no partner. Each bucket sends one star: its most central class (whose shingles are the most
frequent on average) against its other members, a row per membership. Links join components (label propagation with
pointer jumping). A group of near copies becomes one component by that, since its centre is as near to each member as any
other is, mostly. What can still link lies in open buckets, those of several components; there the rarest shingles decide:
similar sets share one of their first few in the order of frequency, at positions and sizes that leave room for enough
others, and pairs inside a component, or inside a shingle's largest one, aren't made. So near copies cost a pair each,
and no link between components is lost. Where that join would still make many rows, which is counted beforehand, rounds of
pivots go first: each class outside of a shingle's main component is tested with a few of those inside.

Edge cases: null or wordless texts have the empty set: component_id is the row's own doc_id. Fewer than five words are one
shingle. Rows with null doc_id link as others do and get their group's component_id (null if no row of it has an id).
Repeated rows give repeated results. An empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, written

WORDS = 5
#: Similarity 0.8 as a fraction: 5 |A & B| >= 4 |A | B|.
UP, DOWN = 4, 5
#: Ratio of a size band's ends.
BAND = 1.6
#: Standard deviations by which full segments outnumber the differences.
MARGIN = 6
#: Bits of a signature that name its band.
BAND_BITS = np.uint64(6)
SEED = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RANDOM = np.random.default_rng(5).integers(1, 2**64, 256, dtype=np.uint64)
#: A random value per byte; capitals as small letters, white space as nothing.
BYTE = _RANDOM[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
BYTE[[9, 10, 11, 12, 13, 32]] = 0
STEP, BACK = np.uint64(0xD1342543DE82EF95), np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))
#: Bytes hashed at once, so that arrays stay in the cache; a longer text is a block of its own.
BLOCK = 1 << 18
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP**i and BACK**i for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, x)])) for x in (STEP, BACK)]
    return _POWERS[0], _POWERS[1]


def _block_sets(raw: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    """The shingle sets of the texts raw[cuts[i]:cuts[i + 1]]: a word's hash is a polynomial of its bytes' values, a
    shingle's mixes those of its words. All texts of a block are hashed together."""
    with np.errstate(over="ignore"):
        ink = BYTE[raw]
        on = ink != 0
        start = on.copy()
        start[1:] &= ~on[:-1]
        first = cuts[:-1][cuts[:-1] < len(raw)]
        start[first] = on[first]
        at = np.flatnonzero(start)
        if not len(at):
            return [np.empty(0, np.uint64)] * (len(cuts) - 1)
        power, back = _powers(len(raw))
        h = mix(np.add.reduceat(ink * power[: len(raw)], at) * back[at])
        words = np.searchsorted(at, cuts)
        n = max(0, len(h) - WORDS + 1)
        acc = np.full(n, np.uint64(WORDS), np.uint64)
        for i in range(WORDS):
            acc = mix(acc * SEED + h[i : i + n])
        out = []
        for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
            if b - a >= WORDS:
                s = np.sort(acc[a : b - WORDS + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif b > a:
                one = np.uint64(b - a)
                for x in h[a:b]:
                    one = mix(one * SEED + x)
                out.append(np.array([one], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the five-grams of each text."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + BLOCK, "right")) - 1)
        yield from _block_sets(raw[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i])
        i = j


def class_of(s: np.ndarray) -> int:
    """A set's name; 0 is the empty set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) or 1 if len(s) else 0


def most_diff(a: int) -> int:
    """Most elements in which a set of size a and one at least as large can differ: (a + b) / 9, where b <= 5 a / 4."""
    return (a + a * DOWN // UP) // 9


class Band:
    """Sizes low <= s <= high, dealt into m segments, with deletions in the first q."""

    def __init__(self, k: int):
        self.k, self.low, self.high = k, math.ceil(BAND**k), math.ceil(BAND ** (k + 1)) - 1
        self.m, self.q = self._allocate()

    def _allocate(self) -> tuple[int, int]:
        best = None
        least = most_diff(self.high) + 1
        few = range(max(1, least // 2), 2 * least + 8, max(1, least // 64))
        for m in [*few, *(self.high << i for i in range(10))]:
            for q in sorted({0, 1, 2, 3, m // 16, m // 8, m // 4, m // 2, m} if m in few else {0}):
                rows, ok = 0.0, True
                for s in (self.low, self.high):
                    load = s / m
                    empty = math.exp(-load)
                    # a deletion saves segments of two elements or more
                    full = m * (1 - empty) + q * (1 - empty - load * empty)
                    spread = math.sqrt(max(0.0, (m + 3 * q) * empty * (1 - (1 + load) * empty)))
                    ok &= full - MARGIN * spread >= most_diff(s) + 1
                    rows += m * (1 - empty) + q * load
                if ok and (best is None or rows < best[0]):
                    best = (rows, m, q)
        return best[1:] if best else (self.high << 9, 0)


_BANDS: dict[int, Band] = {}


def band(k: int) -> Band:
    if k not in _BANDS:
        _BANDS[k] = Band(k)
    return _BANDS[k]


def bands_of(size: int) -> list[tuple[Band, int]]:
    """The bands that a size takes part in, with the differences to allow for: its own, as the smaller set, and those
    below that hold partners of at least 0.8 times its size."""
    k = max(0, int(math.log(size) / math.log(BAND)) - 1)
    while band(k).high < size:
        k += 1
    out = [(band(k), most_diff(size))]
    least = -(-size * UP // DOWN)
    while k > 0 and band(k - 1).high >= least:
        k -= 1
        out.append((band(k), (band(k).high + size) // 9))
    return out


def signatures(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Signatures of a set in all its bands, the number that it can spare in that band, and whether it is short in one of
    them. Hashes are sorted and their leading bits choose the segment, so segments are runs. The leading bits of a
    signature are its band."""
    if len(s) == 0 or most_diff(len(s)) == 0 and len(s) * DOWN // UP == len(s):
        return np.empty(0, np.uint64), np.empty(0, np.uint16), False  # only an equal set is as similar
    out, spare, short = [], [], False
    with np.errstate(over="ignore"):
        el, high = mix(s), s >> np.uint64(32)
        for b, diff in bands_of(len(s)):
            of = (high * np.uint64(b.m)) >> np.uint64(32)
            new = np.empty(len(of), bool)
            new[0] = True
            np.not_equal(of[1:], of[:-1], out=new[1:])
            first = np.flatnonzero(new)
            sums = np.add.reduceat(el, first)
            where = of[first]
            base = where * SEED + np.uint64(b.k + 1)
            found, tough = mix(sums + base), 0
            if b.q:
                few = int(np.searchsorted(of, np.uint64(b.q)))
                part = np.cumsum(new[:few]) - 1
                found = np.append(found, mix(sums[part] - el[:few] + base[part]))
                # it takes two differences to spoil these, one for the others
                tough = int((np.bincount(part) > 1).sum()) if few else 0
            weak = len(where) - tough
            agree = len(where) - min(diff, weak) - max(0, diff - weak) // 2
            short |= agree < 1
            out.append(found >> BAND_BITS | np.uint64(b.k) << (np.uint64(64) - BAND_BITS))
            spare.append(np.full(len(found), min(max(0, agree - 1), 65_535), np.uint16))
    return np.concatenate(out), np.concatenate(spare), short


def described(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cls, n_shingles, short, sigs, spare) of every row; texts that are equal within a task are signed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        none = (np.empty(0, np.uint64), np.empty(0, np.uint16), False)
        for b in batches:
            names, sizes, signed = [], [], []
            for s in shingle_sets(b.column("t")):
                c = class_of(s)
                names.append(c)
                sizes.append(len(s))
                signed.append(none if c in seen else signatures(s))
                seen.add(c)
                if len(seen) > 1_000_000:
                    seen.clear()
            ends = np.cumsum([0, *(len(x[0]) for x in signed)]).astype(np.int32)
            flat = lambda i, t: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[i] for x in signed]).astype(t) if signed else np.empty(0, t)))
            cols = [b.column("key"), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array([x[2] for x in signed], pa.bool_()), flat(0, np.int64), flat(1, np.int32)]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "cls", "n_shingles", "short", "sigs", "spare"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(run, f"key {kind}, cls long, n_shingles long, short boolean, sigs array<long>, spare array<int>")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by signature and class, those with another class next to them; the ends of a partition pass."""
    last: list[np.ndarray] | None = None
    told = first = True
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if last is not None:
            cols = [np.concatenate(x) for x in zip(last, cols, strict=True)]
        s, c, _ = cols
        if not len(s):
            continue
        new = np.append(True, (s[1:] != s[:-1]) | (c[1:] != c[:-1]))
        s, c, e = cols = [x[new] for x in cols]
        same = s[1:] == s[:-1]
        keep = np.append(same, False) | np.append(False, same)
        keep[0] |= told
        if first:
            keep |= s == s[0]
        last, told, first = [x[-1:] for x in cols], bool(keep[-1]), False
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep[:-1]]) for x in cols], names=["sig", "cls", "spare"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], names=["sig", "cls", "spare"])


def shared(rows: DataFrame) -> DataFrame:
    """(sig, cls, spare) of the signatures that two classes or more have."""
    entries = rows.select("cls", F.explode(F.arrays_zip("sigs", "spare")).alias("e")).select("e.sigs", "cls", "e.spare").toDF("sig", "cls", "spare")
    near = entries.repartitionByRange("sig", "cls").sortWithinPartitions("sig", "cls").mapInArrow(_neighbours, "sig long, cls long, spare int")
    return near.groupBy("sig", "cls").agg(F.first("spare").alias("spare"))


def rarest(found: DataFrame) -> DataFrame:
    """(bucket, cls) without the memberships that a class can spare, the most frequent ones. Two similar sets agree in
    more signatures than either can spare; in the order of size and name, the same for all classes, the first one that
    they have in common comes before what either leaves out. So each similar pair still meets."""
    name = F.bit_xor(F.xxhash64("cls")).alias("bucket")
    buckets = found.groupBy("sig").agg(F.count("*").alias("size"), name).where("size > 1")
    band = F.shiftrightunsigned("sig", 64 - int(BAND_BITS)).alias("band")
    mine = found.join(buckets, "sig").groupBy("cls", band, "bucket").agg(F.first("size").alias("size"), F.count("*").alias("times"), F.first("spare").alias("spare"))
    order = Window.partitionBy("cls", "band").orderBy(F.desc("size"), F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = written(mine.withColumn("gone", F.sum("times").over(order)).where("gone > spare").select("band", F.col("bucket").alias("old"), "cls"), "kept")
    # buckets may have become equal or lost all but one
    same = kept.groupBy("band", "old").agg(F.count("*").alias("n"), name).where("n > 1")
    return kept.join(same, ["band", "old"]).select("bucket", "cls").distinct()


def components(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(cls, comp): smallest class that links (a, b) lead to, for classes that have links. Labels spread along links and
    jump to the label's own label, so the number of rounds grows with the logarithm of a chain's length."""
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("cls"), F.least("a", "m").alias("comp"))
    label = written(label, "labels")
    while True:
        jump = label.select(F.col("cls").alias("at"), F.col("comp").alias("far"))
        hooked = (
            both.join(label, F.col("b") == F.col("cls")).groupBy("a").agg(F.min("comp").alias("low"))
            .join(label, F.col("a") == F.col("cls")).select("cls", "comp", F.least("comp", "low").alias("low"))
        )
        # the old label's own label falls with it: hooking whole trees, not leaves alone
        trees = hooked.groupBy("comp").agg(F.min("low").alias("root")).select(F.col("comp").alias("tree"), "root")
        hooked = hooked.join(trees, F.col("comp") == F.col("tree")).select("cls", F.col("comp").alias("old"), F.least("low", "root").alias("comp"))
        new = hooked.join(jump, F.col("comp") == F.col("at"), "left").select("cls", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp"))
        new = written(new, "labels")
        if new.where("old <> comp").isEmpty():
            return new.select("cls", "comp")
        label = new.select("cls", "comp")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for x, y in zip(b.column("x"), b.column("y"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            ok.append(DOWN * both >= UP * (len(p) + len(q) - both))
        mask = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])


def links_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) of classes whose sets are similar."""
    x = sets.select(F.col("cls").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("cls").alias("b"), F.col("items").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long").distinct()


def _sets(docs: DataFrame, text: str, wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(cls, n, items) of the wanted classes: the texts of one row per class are fetched by key. A key that rows repeat
    gives a class more than once; counts and links allow for that. Classes whose rows all lack a key are found among
    the rows without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b.column("t")))
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "n", "items"])

    some = rows.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min("key").alias("key"))
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    named = texts.join(some.where("key is not null").select("key"), "key").select("t").mapInArrow(run, "cls long, n long, items binary")
    nameless = texts.where("key is null").select("t").mapInArrow(run, "cls long, n long, items binary")
    return named.union(nameless.join(some.where("key is null"), "cls", "left_semi"))


def spread(sets: DataFrame) -> DataFrame:
    """(cls, shingle): a row per element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, s in zip(b.column("cls").to_pylist(), b.column("items"), strict=True):
                of = np.frombuffer(s.as_buffer(), np.int64)
                for at in range(0, len(of), 100_000):
                    part = of[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), c)), pa.array(part)], names=["cls", "shingle"])

    return sets.select("cls", "items").mapInArrow(run, "cls long, shingle long")


def _counted(sets: DataFrame) -> DataFrame:
    """(shingle, cls, df) of the shingles that two classes or more of these hold."""
    each = spread(sets)
    often = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    return each.join(often, "shingle")


def worth(sets: DataFrame) -> DataFrame:
    """(cls, n, central) of the classes that can have a partner: four fifths of their shingles occur in another one."""
    held = _counted(sets).groupBy("cls").agg(F.count("*").alias("held"), F.sum("df").alias("weight"))
    return sets.groupBy("cls").agg(F.first("n").alias("n")).join(held, "cls").where(F.col("held") * DOWN >= F.col("n") * UP).select("cls", "n", (F.col("weight") / F.col("n")).alias("central"))


def _fit(n: str, m: str) -> Column:
    return F.least(n, m) * DOWN >= F.greatest(n, m) * UP


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


#: Most central classes of buckets that a class is tested with first.
STARS = 16


def stars(members: DataFrame, able: DataFrame) -> DataFrame:
    """(a, b): the most central class of each bucket with each other member of a fitting size; of a member's tests with
    several such classes the STARS most promising. What isn't tested here stays in an open bucket if it matters."""
    at = members.join(able, "cls")
    centre = at.groupBy("bucket").agg(F.max(F.struct("central", "cls", "n")).alias("p")).select("bucket", F.col("p.cls").alias("p"), F.col("p.n").alias("m"), F.col("p.central").alias("best"))
    tests = at.join(centre, "bucket").where((F.col("cls") != F.col("p")) & _fit("n", "m")).select("cls", "p", "best").distinct()
    rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("best"), "p"))
    return tests.select("cls", "p", rank.alias("rank")).where(F.col("rank") <= STARS).select(*_pair("cls", "p")).distinct()


#: Ratio of the ends of a size cell, in which the prefix join looks for partners.
CELL = 1.04
#: A round of pivots gives a class this many classes to be tested with, per shingle.
PIVOTS = 8
#: Rows of the prefix join for a row of its input, up to which no (further) round of pivots comes first.
MOST_ROWS = 2


def rare_rows(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """(cls, comp, n, shingle, room): the rarest shingles of open classes (cls, comp, n), one of which two similar ones
    share at places that leave room for the overlap they need. If x is no larger than y, similarity needs 4 (x + y) / 9
    common elements: at least 8/9 of x and 4/5 of y; the first common one in the order of frequency has as many left from
    there on."""
    order = F.array_sort(F.collect_set(F.struct("df", F.xxhash64("shingle").alias("h"), "shingle"))).alias("held")
    mine = _counted(sets.join(open_, "cls", "left_semi")).groupBy("cls").agg(order).join(open_, "cls").where(F.size("held") * DOWN >= F.col("n") * UP)
    # what no other class holds comes first and is passed over
    rows = mine.select("cls", "comp", "n", F.size("held").alias("k"), F.posexplode("held").alias("i", "s")).withColumn("room", F.col("k") - F.col("i"))
    return written(rows.where(F.col("room") * DOWN >= F.col("n") * UP).select("cls", "comp", "n", "s.shingle", "room"), "rare")


def between(rows: DataFrame) -> DataFrame:
    """The rows of shingles that several components hold, with the one that most of their classes are in (main)."""
    comps = rows.groupBy("shingle", "comp").agg(F.count("*").alias("k")).groupBy("shingle").agg(F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("comps"))
    return written(rows.join(comps.where("comps > 1").select("shingle", F.col("top.comp").alias("main")), "shingle"), "rare")


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The smaller and the larger set of a pair, each in the size cells where they meet."""
    cell = lambda n: F.floor(F.log(n.cast("double")) / math.log(CELL)).cast("int")
    small = rows.where(F.col("room") * 9 >= F.col("n") * 8).select("shingle", cell(F.col("n")).alias("cell"), *[F.col(c).alias(f"x_{c}") for c in ("cls", "comp", "n", "room", "main")])
    most = F.least(F.col("n"), F.floor(F.col("room") * 9 / 4) - F.col("n"))
    least = F.ceil(F.col("n") * UP / DOWN)
    return small, rows.where(most >= least).select("*", F.explode(F.sequence(cell(least), cell(most))).alias("cell"))


def _odd(side: str = "") -> Column:
    """A row outside of its shingle's main component."""
    return F.col(f"{side}comp") != F.col(f"{side}main")


def meetings(rows: DataFrame) -> int:
    """Rows that the join of rare_pairs would make, counted without making them."""
    small, large = _sides(rows)
    s = small.groupBy("shingle", "cell").agg(F.count_if(_odd("x_")).alias("so"), F.count_if(~_odd("x_")).alias("sm"))
    n = large.groupBy("shingle", "cell").agg(F.count("*").alias("l"), F.count_if(_odd()).alias("lo"))
    return s.join(n, ["shingle", "cell"]).agg(F.sum(F.col("so") * F.col("l") + F.col("sm") * F.col("lo"))).first()[0] or 0


def rare_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): classes of different components that share one of their rarest shingles with enough room after it."""
    small, large = _sides(rows)
    room = (F.least("room", "x_room") * 9 >= (F.col("n") + F.col("x_n")) * 4) & (F.col("x_n") <= F.col("n")) & (F.col("comp") != F.col("x_comp"))
    meet = lambda a, b: a.join(b.drop("main"), ["shingle", "cell"]).where(room).select(*_pair("cls", "x_cls"))
    return meet(small.where(_odd("x_")), large).union(meet(small.where(~_odd("x_")), large.where(_odd()))).distinct()


def pivot_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """(a, b): each class outside of a shingle's main component with a few of those inside. Who they are is up to a hash of
    their names and the turn, so that a class meets the same few in all its shingles."""
    by_hash = Window.partitionBy("shingle").orderBy(F.xxhash64("cls", F.lit(turn)), "cls")
    few = rows.where(~_odd()).select("shingle", "cls", "n", "room", F.row_number().over(by_hash).alias("rank")).where(F.col("rank") <= PIVOTS)
    few = few.select("shingle", F.col("cls").alias("p"), F.col("n").alias("m"), F.col("room").alias("p_room"))
    room = F.least("room", "p_room") * 9 >= (F.col("n") + F.col("m")) * 4
    return rows.where(_odd()).join(few, "shingle").where(_fit("n", "m") & room).select(*_pair("cls", "p")).distinct()


def _merged(found: DataFrame, open_: DataFrame) -> DataFrame:
    """(comp, into): components of the components of open classes that links join."""
    of = lambda side: open_.select(F.col("cls").alias(side), F.col("comp").alias(f"{side}_comp"))
    joined = found.join(of("a"), "a").join(of("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
    return components(joined).select(F.col("cls").alias("comp"), F.col("comp").alias("into"))


def rare_links(open_: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(comp, into) by the links between open classes of different components; null if there are none. Where the join of
    rare shingles would make many rows (texts put together from shared passages), rounds of pivots go first: they bring
    most classes into the main component at a few tests each, and the join has only the others left. Rounds end when the
    join is small, or when fewer than an eighth of the classes found a link."""
    rows = rare_rows(open_, sets)
    left, found, into = between(rows), None, None
    for turn in itertools.count():
        odd = left.where(_odd()).select("cls").distinct().count()
        if not odd or meetings(left) <= MOST_ROWS * left.count():
            break
        new = written(links_of(written(pivot_pairs(left, turn), "pivots"), sets), "verified")
        linked = new.count()
        if linked:
            found = new if found is None else found.union(new)
            into = _merged(found, open_)
            left = between(rows.join(into, "comp", "left").withColumn("comp", F.coalesce("into", "comp")).drop("into"))
        if linked * 8 < odd:
            break
    new = written(links_of(written(rare_pairs(left), "pairs"), sets), "verified")
    if new.isEmpty():
        return into
    return _merged(new if found is None else found.union(new), open_)


def _first_shingles(docs: DataFrame, text: str) -> DataFrame:
    """(shingle, cls, n): the first fifth of every text's set, and one more, in the order of the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in shingle_sets(b.column("t")):
                first = s[: len(s) - -(-len(s) * UP // DOWN) + 1]
                yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(np.full(len(first), class_of(s))), pa.array(np.full(len(first), len(s)))], names=["shingle", "cls", "n"])

    return docs.select(F.col(text).alias("t")).mapInArrow(run, "shingle long, cls long, n long").distinct()


def _short_pairs(docs: DataFrame, text: str, short: DataFrame) -> DataFrame:
    """(a, b): short classes with all that share one of the first shingles; similar sets do."""
    first = _first_shingles(docs, text)
    mine = first.join(short, "cls", "left_semi").select("shingle", F.col("cls").alias("s"), F.col("n").alias("m"))
    return first.join(mine, "shingle").where((F.col("cls") != F.col("s")) & _fit("n", "m")).select(*_pair("cls", "s")).distinct()


def _classed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, cls, n_shingles, ...) of every row, and (cls, component_id) of every class with words."""
    rows = written(described(docs, key, text), "classes")
    members = written(rarest(written(shared(rows), "shared")), "members")
    short = rows.where("short").select("cls").distinct()
    wanted, extra = members.select("cls").distinct(), None
    if not short.isEmpty():
        extra = written(_short_pairs(docs, text, short), "short")
        wanted = wanted.union(extra.select("a")).union(extra.select("b")).distinct()
    sets = written(_sets(docs, text, wanted, rows, key), "sets")
    able = written(worth(sets), "able")
    members = written(members.join(able.select("cls"), "cls", "left_semi"), "members")
    pairs = stars(members, able)
    pairs = written(pairs if extra is None else pairs.union(extra).distinct(), "pairs")
    labels = components(written(links_of(pairs, sets), "verified"))
    # buckets that hold more than one component still have pairs to test
    at = members.join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    mixed = at.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    open_ = written(at.join(mixed, "bucket", "left_semi").select("cls", "comp").distinct().join(able.select("cls", "n"), "cls"), "open")
    named = rows.where("cls <> 0").groupBy("cls").agg(F.min("key").alias("least")).join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    into = rare_links(open_, sets)
    if into is not None:
        named = named.join(into, "comp", "left").withColumn("comp", F.coalesce("into", "comp"))
    comp = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    return rows, named.join(comp, "comp").select("cls", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, cls, component_id) of every row: class of equal sets, smallest key that links lead to."""
    bound_batches(docs.sparkSession)
    rows, by_class = _classed(docs, key, text)
    return rows.join(by_class, "cls", "left").select(F.col("key").alias(key), "n_shingles", "cls", F.when(F.col("cls") == 0, F.col("key")).otherwise(F.col("component_id")).alias("component_id"))


def one_per_component(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows whose key names their component; of rows that repeat such a key all stay, as do rows without a key that
    link with no row that has one. Columns as in docs."""
    got = written(near_duplicates(docs, text, key), "components")
    keep = got.where(F.col(key) == F.col("component_id")).select(F.col(key).alias("_k")).distinct()
    named = docs.where(F.col(key).isNotNull()).join(keep, F.col(key) == F.col("_k"), "left_semi")
    gone = got.where(F.col(key).isNull() & F.col("component_id").isNotNull()).select("cls").distinct()
    if gone.isEmpty():
        return named.union(docs.where(F.col(key).isNull()))

    @F.pandas_udf("long")
    def cls(texts: pd.Series) -> pd.Series:
        return pd.Series([class_of(s) for s in shingle_sets(pa.array(texts, pa.string()))], dtype="int64")

    nameless = docs.where(F.col(key).isNull()).withColumn("_cls", cls(F.col(text))).join(gone, F.col("_cls") == F.col("cls"), "left_anti").drop("_cls")
    return named.union(nameless)


def op2_ngram_jaccard(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


ORACLE = """
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {docs}
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM t WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(a, b) AS (
  SELECT doc_id, doc_id FROM t UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) m USING (doc_id)
"""
