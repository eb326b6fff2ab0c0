"""Alignment of the tokens of two tokenizers, and how often their tokens meet over a corpus.

Both tokenizers read a text with one space in front. Where a token of A and a token of B end at the same byte, the text is
cut; between cuts lie groups of tokens of both. Cuts are found by dividing: an interval of tokens is cut at the common end
that is nearest to its middle (A's ends are looked up in B's by bisection), in windows around the middle that widen until
one is found; both halves go on, and an interval without a common end inside is a group. All intervals of a
batch are divided at once, level by level.

A links to B where the byte ranges of two tokens overlap. The links of a row are kept as distinct pairs of ids with their
numbers. Pairs are counted over the corpus by rows that hold them; rows meet the counts of their pairs in two joins: that
with the HEAD_PAIRS most frequent pairs is a broadcast of bounded size, and what is left has no hot key.

A text is encoded in chunks that start at a space after something that isn't white space: neither tokenizer has a token
across such a place (A's pattern cuts there; B is refused if a piece of its vocabulary goes over one), so a chunk that was
seen before in a task isn't encoded again. The same places divide a long text into parts of PART_CHARS that are aligned
one after the other, so memory doesn't follow its length (a text without such a place is one part).

Edge cases: texts that are null or empty, or that either tokenizer doesn't give back byte by byte (U+2581 is B's space),
have no tokens: zeros, and an empty digest. Strings of special tokens are plain text. Repeated rows count each, in the
counts of pairs too. An empty table gives an empty result. Extra columns pass, added names replace theirs. Ties for an id's
most frequent partner are all best.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, text_of, written

#: Characters of a long text that are aligned at once, and of the texts of a batch that are aligned together.
PART_CHARS = 250_000
#: Most frequent pairs that are broadcast: at most 40 bytes each.
HEAD_PAIRS = 1 << 19
#: Distinct chunks of a generation that a task remembers, two generations at most.
MOST_CHUNKS = 200_000

# The characters that stand for bytes in a byte-level vocabulary; all other bytes follow from U+0100 on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPACE_PIECE = "▁"


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary."""
    rest = [b for b in range(256) if b not in set(SHOWN)]
    return {chr(b): b for b in SHOWN} | {chr(256 + k): b for k, b in enumerate(rest)}


class Chunks:
    """Ids of both tokenizers by chunk (what follows a space), encoded once and remembered."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        import sentencepiece
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
            raise ValueError(f"{path_a} isn't a byte-level tokenizer with its usual pattern")
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        of = byte_alphabet()
        size = self.a.get_vocab_size(with_added_tokens=True)
        shown = [self.a.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in shown]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(f"[^{SPACE_PIECE}]{SPACE_PIECE}", p) for p in pieces):
            raise ValueError(f"{path_b} has a piece that goes on over a space")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(SPACE_PIECE, " ").encode() for p in pieces]
        # two generations: what is met again moves to the younger, the older is dropped when the younger is full
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.before: dict[str, tuple[bytes, bytes] | None] = {}
        # decimal ids with what follows them: within a group, or at its end
        self.shown = [f"{i}{end}".encode() for i in range(len(self.bytes_a)) for end in ",|"] + [f"{i}{end}".encode() for i in range(len(self.bytes_b)) for end in (",", ";", "")]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))

    def _encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both for a text after a space; None if one doesn't give it back byte by byte."""
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text) if text else [self.b.piece_to_id(SPACE_PIECE)]  # which adds no space to an empty text
        if b"".join(map(self.bytes_a.__getitem__, a)) == (" " + text).encode() == b"".join(map(self.bytes_b.__getitem__, b)):
            return np.array(a, np.int32), np.array(b, np.int32)
        return None

    def _encode_new(self, chunks: list[str]) -> Iterator[tuple[bytes, bytes] | None]:
        """Chunks that don't end in white space, encoded as one text and cut apart again: both have a token's end at each
        chunk's end."""
        whole = self._encode(" ".join(chunks))
        if whole is None:
            each = map(self._encode, chunks)
            yield from (e and (e[0].tobytes(), e[1].tobytes()) for e in each)
            return
        ends = np.cumsum([len(c.encode()) + 1 for c in chunks])
        cuts = [np.searchsorted(np.cumsum(length[ids]), ends) + 1 for length, ids in zip((self.length_a, self.length_b), whole, strict=True)]
        raw = [ids.tobytes() for ids in whole]
        i = j = 0
        for k, m in zip((4 * cuts[0]).tolist(), (4 * cuts[1]).tolist(), strict=True):
            yield raw[0][i:k], raw[1][j:m]
            i, j = k, m

    def _remember(self, new: list[str]) -> None:
        if len(self.known) + len(new) > MOST_CHUNKS:
            self.before, self.known = self.known, {}
        self.known.update((c, self.before[c]) for c in new if c in self.before)
        fresh = [c for c in new if c not in self.known]
        if fresh:
            self.known.update(zip(fresh, self._encode_new(fresh), strict=True))

    def ids(self, part: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both for a part of a text (its first space left out); None if one doesn't give it back."""
        chunks, last = part.split(" "), None
        new = {c for c in chunks if c not in self.known}
        if any(not c or c[-1].isspace() for c in new):
            # what is empty, or ends in white space, goes on in the next chunk; the last one is encoded by itself
            merged, held = [], []
            for c in chunks:
                held.append(c)
                if c and not c[-1].isspace():
                    merged.append(" ".join(held))
                    held = []
            if held:
                last = self._encode(" ".join(held))
                if last is None:
                    return None
            chunks = merged
            new = {c for c in chunks if c not in self.known}
        if new:
            self._remember(list(new))
        got = list(map(self.known.get, chunks))
        if None in got:
            # a generation has just ended, or a chunk isn't given back
            got = [x or self.before.get(c) for c, x in zip(chunks, got, strict=True)]
            if None in got:
                return None
        tail = [x.tobytes() for x in last] if last else (b"", b"")
        return np.frombuffer(b"".join([*(x[0] for x in got), tail[0]]), np.int32), np.frombuffer(b"".join([*(x[1] for x in got), tail[1]]), np.int32)


@lru_cache(maxsize=1)
def chunks_of(path_a: str, path_b: str) -> Chunks:
    """One for all tasks of a Python worker."""
    return Chunks(path_a, path_b)


def parts_of(text: str) -> Iterator[str]:
    """A text in parts that each start after a space which follows something else than white space."""
    at = 0
    while len(text) - at > PART_CHARS:
        cut = text.find(" ", at + PART_CHARS)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def near_middle(common: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For intervals of a's ends (first to last, both inside) the index of the common one that is nearest to the middle, -1
    where there is none. The middle is tried first, then windows around it, each four times as wide."""
    found = np.full(len(first), -1)
    middle, todo, width = (first + last) // 2, np.arange(len(first)), 0
    hit = common[middle]
    found[hit] = middle[hit]
    todo = todo[~hit & (first < last)]
    while len(todo):
        width = max(1, 4 * width)
        lo, hi = np.maximum(first[todo], middle[todo] - width), np.minimum(last[todo], middle[todo] + width)
        sizes = hi - lo + 1
        at = ragged(lo, sizes)
        away = at - np.repeat(middle[todo], sizes)
        # twice the distance, and one less to the left, so that the least is one place
        key = np.where(common[at], 2 * np.abs(away) - (away < 0), np.iinfo(np.int64).max)
        best = np.minimum.reduceat(key, np.cumsum(sizes) - sizes)
        hit = best < np.iinfo(np.int64).max
        step = (best[hit] + 1) // 2
        found[todo[hit]] = middle[todo[hit]] + np.where(best[hit] % 2, -step, step)
        todo = todo[~hit & ((lo > first[todo]) | (hi < last[todo]))]
    return found


def bisected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each of a's ends the first of b's that isn't before it, by bisection, and whether it is the same."""
    place = np.searchsorted(b, a)
    return place, b[np.minimum(place, len(b) - 1)] == a


def divide(place: np.ndarray, common: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end, as indices after their last token in a and in b, from what bisected() says of the ends of tokens of
    texts one after the other. texts: rows of (first, after the last) in a and in b."""
    ends_a, ends_b, open_ = [], [], texts
    while len(open_):
        a0, a1, b0, b1 = open_.T
        cut = np.full(len(open_), -1)
        more = np.flatnonzero((a1 - a0 > 1) & (b1 - b0 > 1))
        cut[more] = near_middle(common, a0[more], a1[more] - 2)
        leaf, inner = cut < 0, open_[cut >= 0]
        ends_a.append(a1[leaf])
        ends_b.append(b1[leaf])
        at_a = cut[cut >= 0] + 1
        at_b = place[at_a - 1] + 1
        open_ = np.concatenate([np.stack([inner[:, 0], at_a, inner[:, 2], at_b], 1), np.stack([at_a, inner[:, 1], at_b, inner[:, 3]], 1)])
    return np.sort(np.concatenate(ends_a)), np.sort(np.concatenate(ends_b))


class Row:
    """What the parts of one text add up to."""

    def __init__(self) -> None:
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.said = hashlib.sha256()
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pairs) < 2:
            return self.pairs[0] if self.pairs else (np.array([], np.int64), np.array([], np.int64))
        pairs, at = np.unique(np.concatenate([p for p, _ in self.pairs]), return_inverse=True)
        return pairs, np.bincount(at, np.concatenate([n for _, n in self.pairs])).astype(np.int64)


def align(chunks: Chunks, parts: list[tuple[Row, bool, np.ndarray, np.ndarray]]) -> None:
    """Aligns parts of texts, (row, whether it is the row's last part, ids of A, ids of B), and adds to their rows."""
    n_a, n_b = (np.array([len(p[k]) for p in parts]) for k in (2, 3))
    ids_a, ids_b = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (2, 3))
    to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
    place, common = bisected(np.cumsum(chunks.length_a[ids_a]), np.cumsum(chunks.length_b[ids_b]))
    group_a, group_b = divide(place, common, np.stack([to_a - n_a, to_a, to_b - n_b, to_b], 1))
    # links: for each token of A the tokens of B from the one that holds its first byte, which follows the end of the token
    # before, to the one that holds its last
    first = np.concatenate([[0], (place + common)[:-1]])
    sizes = place - first + 1
    link_b, part_of = ragged(first, sizes), np.repeat(np.arange(len(parts)), n_a)
    wide = len(chunks.bytes_b)
    pair = np.repeat(ids_a, sizes) * wide + ids_b[link_b]
    room = len(chunks.bytes_a) * wide
    keys, times = np.unique(np.repeat(part_of, sizes) * room + pair, return_counts=True)
    key_ends = np.searchsorted(keys, np.arange(1, len(parts) + 1) * room)
    # text of the groups: tokens of A and B of a group in turn
    shown, va = np.empty(len(ids_a) + len(ids_b), np.int64), len(chunks.bytes_a)
    ends_a, ends_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    ends_a[group_a - 1] = ends_b[group_b - 1] = 1
    ends_b[to_b[[k for k, p in enumerate(parts) if p[1]]] - 1] = 2
    of_a = np.repeat(np.arange(len(group_a)), np.diff(group_a, prepend=0))
    of_b = np.repeat(np.arange(len(group_b)), np.diff(group_b, prepend=0))
    shown[np.arange(len(ids_a)) + np.concatenate([[0], group_b])[of_a]] = 2 * ids_a + ends_a
    shown[np.arange(len(ids_b)) + group_a[of_b]] = 2 * va + 3 * ids_b + ends_b
    words = list(map(chunks.shown.__getitem__, shown.tolist()))
    groups = np.diff(np.searchsorted(group_a, to_a, "right"), prepend=0)
    links = np.diff(np.cumsum(sizes)[to_a - 1], prepend=0)
    at_word = at_key = 0
    for k, (row, _, x, y) in enumerate(parts):
        row.n_a, row.n_b, row.n_groups, row.n_links = row.n_a + len(x), row.n_b + len(y), row.n_groups + int(groups[k]), row.n_links + int(links[k])
        row.said.update(b"".join(words[at_word : at_word + len(x) + len(y)]))
        at_word += len(x) + len(y)
        row.pairs.append((keys[at_key : key_ends[k]] - k * room, times[at_key : key_ends[k]]))
        at_key = key_ends[k]


def rows_of(chunks: Chunks, texts: Iterable[str]) -> list[Row | None]:
    """One row a text; None for a text without tokens."""
    out: list[Row | None] = []
    held: list[tuple[Row, bool, np.ndarray, np.ndarray]] = []
    size = 0
    for text in texts:
        row, broken = Row(), not text or SPACE_PIECE in text
        parts = iter(()) if broken else parts_of(text)
        part = next(parts, None)
        while part is not None and not broken:
            ids, following = chunks.ids(part), next(parts, None)
            if ids is None:
                broken = True
                held = [h for h in held if h[0] is not row]
            else:
                held.append((row, following is None, *ids))
                size += len(part)
                if size >= PART_CHARS:
                    align(chunks, held)
                    held, size = [], 0
            part = following
        out.append(None if broken else row)
    if held:
        align(chunks, held)
    return out


ADDED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{id}>, times array<int>"


def _aligner(path_a: str, path_b: str, wide: bool):
    kind, none = pa.int64() if wide else pa.int32(), np.array([], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunks_of(path_a, path_b)
        for b in batches:
            rows = rows_of(chunks, (t.as_py() for t in b.column("_text")))
            pairs = [r.distinct() if r else (none, none) for r in rows]
            counts = [pa.array([getattr(r, c) if r else 0 for r in rows], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
            said = pa.array([r.said.hexdigest() if r else "" for r in rows], pa.string())
            ends = pa.array(np.cumsum([0, *(len(p) for p, _ in pairs)]), pa.int32())
            flat = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([none, *(p[k] for p in pairs)]), t)) for k, t in enumerate((kind, pa.int32()))]
            kept = [i for i, n in enumerate(b.schema.names) if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *counts, said, *flat], names=[*(b.schema.names[i] for i in kept), "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return run


def vocabulary_sizes(path_a: str, path_b: str) -> tuple[int, int]:
    import sentencepiece
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path_a).get_vocab_size(with_added_tokens=True), sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def aligned(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """The rows, without the text, with n_a, n_b, n_groups, n_links, groups_sha256, and pairs and times: the distinct links
    as id of A times the size of B's vocabulary plus id of B, and how often each occurs."""
    bound_batches(docs.sparkSession)
    size_a, size_b = vocabulary_sizes(path_a, path_b)
    wide = size_a * size_b >= 1 << 31
    added = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", text)
    rows = docs.withColumn("_text", text_of(text)).drop(*added)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(_aligner(path_a, path_b, wide), ", ".join(x for x in (kept, ADDED.format(id="bigint" if wide else "int")) if x))


def pair_counts(links: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): how many rows hold a pair, and whether no pair of its id of A is held by more."""
    counts = links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("_a", F.floor(F.col("pair") / size_b).cast("int"))
    most = counts.groupBy("_a").agg(F.max("n").alias("_most"))
    return counts.join(most, "_a").select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def scored(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """The rows of aligned() with n_best, how many links are of a pair that is the most frequent of its id of A, and
    count_sum, the sum of the counts of their pairs; without pairs and times."""
    links = written(aligned(docs.withColumn("_row", F.monotonically_increasing_id()), path_a, path_b, text), "alignment")
    counts = written(pair_counts(links, vocabulary_sizes(path_a, path_b)[1]), "pair-counts")
    head = F.broadcast(written(counts.orderBy(F.desc("n"), "pair").limit(HEAD_PAIRS), "frequent-pairs"))
    each = links.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("_x")).select("_row", F.col("_x.pairs").alias("pair"), F.col("_x.times").alias("k"))
    sums = lambda j: j.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("best"), F.sum(F.col("n") * F.col("k")).alias("total"))
    known, rare = sums(each.join(head, "pair")), sums(each.join(head, "pair", "left_anti").join(counts, "pair"))
    both = known.unionByName(rare).groupBy("_row").agg(F.sum("best").alias("n_best"), F.sum("total").alias("count_sum"))
    out = links.drop("pairs", "times", "n_best", "count_sum").join(both, "_row", "left").drop("_row")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def op12_token_alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    out = scored(docs.select("doc_id", "text"), path_a, path_b)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
