"""Scores of pages for a block of questions, in tasks: of every batch of pages only the best of each question leave the task,
so what is shuffled follows the questions and batches, not their product with the pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.retrieval import WORD_EDGE

#: Pages that are scored at once, and how many scores of pages and questions are held.
PAGES, SCORES = 512, 1 << 20
#: Characters of texts that are looked through at once; a longer text by itself.
CHARACTERS = 1 << 20
EDGES = np.array([c for c in range(128) if re.match(WORD_EDGE, chr(c), re.ASCII)], np.uint32)


def best_schema(pages: DataFrame) -> str:
    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    return f"q int, ordinal {kind['ordinal']}, page_number {kind['page_number']}, score double, matched array<string>"


def expanded(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from start on, size of them, for each."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def asked_of(block: DataFrame, compounds: tuple[str, ...]) -> tuple[Asked, list]:
    """The questions (question_id, keywords) of a block, numbered from 0, and their ids."""
    rows = block.select("question_id", "keywords", F.transform("keywords", F.lower).alias("low")).collect()
    return Asked([r.keywords for r in rows], [r.low for r in rows], compounds), [r.question_id for r in rows]


class Asked:
    """What a block of questions asks: distinct lower-cased words, numbered in order, and where each is asked."""

    def __init__(self, keywords: list[list[str]], low: list[list[str]], compounds: tuple[str, ...]) -> None:
        self.words, self.keywords = sorted({w for ws in low for w in ws if w}), keywords
        number = {w: i for i, w in enumerate(self.words)}
        self.low = [[number.get(w, -1) for w in ws] for ws in low]
        places = sorted((w, q, said in compounds) for q, ws in enumerate(self.low) for w, said in zip(ws, keywords[q], strict=True) if w >= 0)
        self.of = np.array([q for _, q, _ in places], np.int64)
        self.compound = np.array([c for *_, c in places], bool)
        self.start = np.searchsorted([w for w, *_ in places], np.arange(len(self.words) + 1)).astype(np.int64)
        self.size = np.array([len(ws) for ws in keywords], np.int64)
        self.in_compound = np.zeros(len(self.words), bool)
        self.in_compound[[w for w, _, c in places if c]] = True
        self.gate = np.array([any(w in compounds for w in ws) for ws in keywords], bool)

    def rows_at_once(self) -> int:
        return max(1, min(PAGES, SCORES // max(1, len(self.size))))


class Best:
    """The best pages of each question that a task has seen; scores as keyword_scores has them."""

    def __init__(self, asked: Asked, threshold: float, k: int) -> None:
        self.asked, self.threshold, self.k = asked, threshold, k
        self.top = np.full((len(asked.size), k), -np.inf)

    def of(self, ordinal: pa.Array, page: pa.Array, r: np.ndarray, w: np.ndarray, hit: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
        """Of some pages those that may be among the best. r, w: page and word of what the pages hold, ordered, each pair once."""
        a, n_q, n_r = self.asked, len(self.asked.size), len(ordinal)
        some = hit | a.in_compound[w]
        r, w, hit, points = r[some], w[some], hit[some], points[some]
        asked = a.start[w + 1] - a.start[w]
        at = expanded(a.start[w], asked)
        key, hits = np.repeat(r, asked) * n_q + a.of[at], np.repeat(hit, asked)
        of = lambda some, weights=None: np.bincount(key[some], weights, n_r * n_q).reshape(n_r, n_q)
        n, total, held = of(hits), of(hits, np.repeat(points, asked)[hits]), of(a.compound[at]) > 0
        coverage = n / a.size
        score = np.floor(total * (0.5 + coverage) * 10 + 0.5) / 10
        ok = (n > 0) & ((a.size == 1) | (coverage >= 0.4)) & (score >= self.threshold) & (~a.gate | held) & (score >= self.top[:, 0])
        row, q = np.nonzero(ok)
        score = score[row, q]
        rank = lambda c: pc.rank(c, "ascending", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)[row]
        order = np.lexsort((rank(page), rank(ordinal), -score, q))
        row, q, score = row[order], q[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        row, q, score, place = (x[place < self.k] for x in (row, q, score, place))
        new = np.full_like(self.top, -np.inf)
        new[q, place] = score
        self.top = np.sort(np.concatenate([self.top, new], 1), 1)[:, -self.k :]
        r, w = r[hit], w[hit]
        lo, hi = np.searchsorted(r, row), np.searchsorted(r, row, "right")
        matched = []
        for x, i, j in zip(q.tolist(), lo.tolist(), hi.tolist(), strict=True):
            there = set(w[i:j].tolist())
            matched.append(list(dict.fromkeys(said for said, u in zip(a.keywords[x], a.low[x], strict=True) if u in there)))
        columns = [pa.array(q.astype(np.int32)), ordinal.take(pa.array(row)), page.take(pa.array(row)), pa.array(score, pa.float64()), pa.array(matched, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["q", "ordinal", "page_number", "score", "matched"])


def summed(key: np.ndarray, hit: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys in order each once: whether one of its rows hits, and the sum of n."""
    first = np.flatnonzero(np.diff(key, prepend=-1))
    of = np.repeat(np.arange(len(first)), np.diff(first, append=len(key)))
    return key[first], np.bincount(of, hit, len(first)) > 0, np.bincount(of, n, len(first))


def points_of(fields: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, hits and points, as keyword_points has them, of what title, number, category, subcategory and text hold."""
    keys = np.unique(np.concatenate([k for k, *_ in fields]))
    hits, n = [], None
    for k, hit, n_there in fields:
        at = np.searchsorted(keys, k)
        hits.append(np.zeros(len(keys), bool))
        hits[-1][at] = hit
        n = np.zeros(len(keys), np.int64)
        n[at] = n_there
    title, number, kind, kind2, text = hits
    points = 35 * number + 20 * title + 15 * (kind | kind2) + np.where(text, 5 + np.minimum(n - 1, 5), 0)
    return keys, title | number | kind | kind2 | text, points


def counted(key: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of places in the order of keys and then of starts those that count: from a key's first on, without overlap."""
    out = np.ones(len(key), bool)
    again = np.flatnonzero((key[1:] == key[:-1]) & (start[1:] < start[:-1] + size[:-1])) + 1
    end, last = 0, -1
    # from the first place that overlaps the one before to the end of its key, one by one
    for lo, hi in zip(again.tolist(), np.searchsorted(key, key[again], "right").tolist(), strict=True):
        if hi <= last:
            continue
        end, last = start[lo - 1] + size[lo - 1], hi
        for i in range(lo, hi):
            out[i] = start[i] >= end
            end = start[i] + size[i] if out[i] else end
    return out


class Scan:
    """Words in texts, by one automaton over all words; texts are run through it joined, and what it finds is told apart
    by places."""

    def __init__(self, words: list[str]) -> None:
        self.automaton, self.size = ahocorasick.Automaton(), np.array([len(w) for w in words], np.int64)
        for i, w in enumerate(words):
            self.automaton.add_word(w, i)
        self.automaton.make_automaton()
        self.loose = np.array([len(w) > 5 or " " in w or "/" in w for w in words], bool)
        # stands in no word, so that none reaches from one text into the next
        self.between = next(c for c in map(chr, range(0x110000)) if not any(c in w for w in words))

    def field(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(page * words + word, hit, n) of what texts hold, each once and in order: whether a word matches as word_match has
        it, and how often it stands there without overlap."""
        there, n_w = texts.to_pylist(), len(self.size)
        begin = np.cumsum([1, *(len(t) + 1 for t in there)])
        joined = self.between.join(["", *there, ""])
        edge = np.isin(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), EDGES)
        edge[begin - 1] = True
        found = np.fromiter((last * n_w + w for last, w in self.automaton.iter(joined)), np.int64)
        last, w = np.divmod(found, n_w)
        start = last - self.size[w] + 1
        key = (np.searchsorted(begin, start, "right") - 1) * n_w + w
        order = np.argsort(key, kind="stable")
        last, w, start, key = last[order], w[order], start[order], key[order]
        hit = self.loose[w] | (edge[start - 1] & edge[last + 1])
        return summed(key, hit, counted(key, start, self.size[w]))


def slices(batch: pa.RecordBatch, rows: int, characters: int = CHARACTERS) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many rows and characters of text, its last column."""
    ends, lo = np.cumsum(pc.utf8_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while lo < len(ends):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + characters, "right"))
        hi = min(max(hi, lo + 1), lo + rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def best_of_texts(held, threshold: float, k: int):
    """A map over batches of ordinal, page_number and the lower-cased title, number, category, subcategory and text. held:
    the broadcast block of questions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        scan, best = Scan(asked.words), Best(asked, threshold, k)
        for whole in batches:
            for b in slices(whole, asked.rows_at_once()):
                key, hit, points = points_of([scan.field(b.column(i)) for i in range(2, 7)])
                r, w = np.divmod(key, len(asked.words))
                yield best.of(b.column(0), b.column(1), r, w, hit, points)

    return run


def with_ids(found: DataFrame, ids: list, kind: str) -> DataFrame:
    """The questions' ids for their numbers in a block."""
    numbered = found.sparkSession.createDataFrame(list(enumerate(ids)), f"q int, question_id {kind}")
    return found.join(F.broadcast(numbered), "q").drop("q")
