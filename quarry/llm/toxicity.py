"""Toxicity by a learnt lexicon, a trie and Levenshtein automata, with context windows.

Learning: words and word beginnings of labelled texts are counted by label; what is much more frequent in toxic texts
becomes a term (a word, or a stem that several words share). Catching: a word is run through the trie with the rows of a
Levenshtein automaton, so a misspelled term is found with one edit; matches that clean labelled texts hold as words of
their own are left out. Scoring: every hit looks at the words around it: quotation marks and words of reporting lower
its weight. A logistic model over these sums gives the score.

The fit takes at most MAX_LABELLED labelled rows (chosen by hash); the lexicon is made of their words, each in MIN_DOCS of
them or more and beyond chance, so it is bounded with them, and no limit cuts it. Counting is a shuffle of terms with partial sums; scoring is one map without a shuffle.

Edge cases: null and empty texts get the score of a text without hits. With no labelled rows, or none that are toxic,
the lexicon is empty and every score is the label's share (0 where unknown). Repeated rows get a score each. Extra
columns pass; a column named score is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, remainder
from quarry.llm.quality_classifier import labelled

MAX_LABELLED = 20_000
#: Beginnings of so many letters may become stems.
STEMS = (4, 5, 6, 7)
MIN_DOCS = 3
#: What a term's surprise, in nats, must be above the logarithm of the number of words.
MARGIN = 2.0
#: A term's least log odds: how often it may stand in clean texts too. What a weak term counts for is left to the model.
LEAST_WEIGHT = 1.0
FUZZY_FROM = 5
CONTEXT = 4
TOKEN = re.compile(r"[^\W_]+|[\"“”„«»‘’]")
QUOTES = frozenset("\"“”„«»‘’")
#: Words that report what others say.
REPORTING = frozenset("said says quote quoted called wrote term word dit dijo sagte citation zitat cita".split())


@dataclass
class Lexicon:
    """Terms in a trie. weights: log odds by term; stems end in '*'. clean: words that look misspelled but aren't."""

    weights: dict[str, float]
    clean: frozenset[str] = frozenset()
    trie: dict = field(default_factory=dict)
    known: dict[str, tuple[float, int]] = field(default_factory=dict)

    def __post_init__(self):
        for term in self.weights:
            node = self.trie
            for c in term.rstrip("*"):
                node = node.setdefault(c, {})
            node["*" if term.endswith("*") else ""] = term

    def __getstate__(self):
        return (self.weights, self.clean)

    def __setstate__(self, state):
        self.__init__(*state)

    def match(self, word: str) -> tuple[float, int]:
        """(weight, edits) of the best term for a word; (0, 0) if there is none."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            got = self.known[word] = self._exact(word) or (self._near(word) if len(word) >= FUZZY_FROM - 1 and word not in self.clean else None) or (0.0, 0)
        return got

    def _exact(self, word: str) -> tuple[float, int] | None:
        node, best = self.trie, None
        for c in word:
            if "*" in node:
                best = (self.weights[node["*"]], 0)
            node = node.get(c)
            if node is None:
                return best
        end = node.get("") or node.get("*")
        return (self.weights[end], 0) if end else best

    def _near(self, word: str) -> tuple[float, int] | None:
        """The trie walked with the automaton of words within one edit: its states are 'no edit yet, at letter i', which
        follow the word itself, and 'one edit made, at letter i', from which only the rest of the word leads on."""
        best, node = 0.0, self.trie
        for i in range(len(word) + 1):
            rest = word[i:]
            for c, below in node.items():
                if c not in ("", "*"):
                    best = max(best, self._rest(below, rest))  # the term has a letter more
                    if rest and c != rest[0]:
                        best = max(best, self._rest(below, rest[1:]))  # another letter
            if rest:
                best = max(best, self._rest(node, rest[1:]))  # the word has a letter more
            if len(rest) > 1 and (below := node.get(rest[1], {}).get(rest[0])) is not None:
                best = max(best, self._rest(below, rest[2:]))  # two letters changed places
            node = node.get(rest[:1] or None)
            if node is None:
                break
        return (best, 1) if best else None

    def _rest(self, node: dict, rest: str) -> float:
        """Weight of the long term that the rest of a word leads to, 0 if none. Short terms allow no edit."""
        for c in rest:
            if "*" in node and len(node["*"]) > FUZZY_FROM + 1:
                return self.weights[node["*"]]
            node = node.get(c)
            if node is None:
                return 0.0
        term = node.get("") or node.get("*")
        return self.weights[term] if term and len(term.rstrip("*")) >= FUZZY_FROM else 0.0

    def sums(self, text: str | None) -> list[float]:
        """1, and log sums of weights of: plain hits, misspelled hits, plain and misspelled hits that are quoted."""
        tokens = TOKEN.findall((text or "").lower())
        out = [0.0, 0.0, 0.0, 0.0]
        for i, t in enumerate(tokens):
            weight, edits = self.match(t)
            if weight:
                near = tokens[max(0, i - CONTEXT) : i] + tokens[i + 1 : i + 1 + CONTEXT]
                before, after = tokens[max(0, i - CONTEXT) : i], tokens[i + 1 : i + 1 + CONTEXT]
                quoted = bool(QUOTES.intersection(before) and QUOTES.intersection(after)) or not REPORTING.isdisjoint(near)
                out[edits + 2 * quoted] += weight
        return [1.0, *np.log1p(out)]


def learn_terms(rows: DataFrame) -> dict[str, float]:
    """Terms with their log odds, from (text, y) rows: numbers of distinct texts of either label that hold a word or stem.
    A term's share of toxic texts must differ from theirs in all by more than chance among so many terms explains, and its
    smoothed log odds must reach LEAST_WEIGHT. Clean texts may hold it, at any size of the data."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3))
    texts = rows.where(F.col("y").isNotNull()).groupBy(F.xxhash64("text")).agg(F.first("text").alias("text"), (F.max("y") > 0).cast("int").alias("y"))
    by_word = texts.select("y", F.explode(words).alias("w")).groupBy("w").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")).persist()
    n = texts.agg(F.sum("y").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = n.t or 0, n.n - (n.t or 0)
    if not toxic:
        by_word.unpersist()
        return {}
    stems = (
        by_word.select(F.explode(F.array(*[F.when(F.length("w") > k, F.concat(F.substring("w", 1, k), F.lit("*"))) for k in STEMS])).alias("term"), "toxic", "clean")
        .where(F.col("term").isNotNull())
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count("*").alias("kinds"))
        .where(F.col("kinds") >= 3)
    )
    terms = by_word.select(F.col("w").alias("term"), "toxic", "clean").unionByName(stems.select("term", "toxic", "clean"))
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    share, seen = toxic / (toxic + clean), F.col("toxic") + F.col("clean")
    part = lambda k, p: F.when(k > 0, k * F.log(k / (seen * p))).otherwise(0.0)
    surprise = part(F.col("toxic"), share) + part(F.col("clean"), max(1 - share, 1e-9))
    least = MARGIN + float(np.log(max(1, by_word.count())))
    best = terms.withColumn("weight", weight).where((F.col("toxic") >= MIN_DOCS) & (F.col("weight") >= LEAST_WEIGHT) & (surprise >= least))
    got = best.collect()
    by_word.unpersist()
    # a word that a stem covers needs no entry, nor does a stem below a shorter one
    held = {r.term: r.weight for r in got}
    heads = {t[:-1] for t in held if t.endswith("*")}
    covered = lambda t: any(t.rstrip("*")[:k] in heads for k in STEMS if k < len(t.rstrip("*")))
    return {t: w for t, w in held.items() if not covered(t)}


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, texts: pd.Series) -> np.ndarray:
        x = np.array([self.lexicon.sums(t) for t in texts], dtype=float).reshape(len(texts), 5)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, fits, label: str = "toxic", bound: int = MAX_LABELLED, steps: int = 8) -> Model:
    bound_batches(docs.sparkSession)
    rows = labelled(docs, labels, label, fits, bound).persist()
    lexicon = Lexicon(learn_terms(rows))

    def look_alikes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = {w for t in pdf["text"] for w in TOKEN.findall((t or "").lower()) if lexicon.match(w)[1]}
            yield pd.DataFrame({"w": sorted(found)}, dtype=object)

    # words of clean texts that are one edit from a term; at most the words of the fitted rows
    alike = rows.where("y = 0").mapInPandas(look_alikes, "w string").distinct().collect()
    lexicon = Lexicon(lexicon.weights, frozenset(r.w for r in alike))

    def sums(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            x = np.array([lexicon.sums(t) for t in pdf["text"]], dtype=float).reshape(len(pdf), 5)
            out = pd.DataFrame(x.round(2), columns=[f"x{i}" for i in range(5)]).assign(y=pdf["y"].to_numpy(), n=1)
            yield out.groupby([f"x{i}" for i in range(5)], as_index=False).agg(y=("y", "sum"), n=("n", "sum"))

    cols = [f"x{i}" for i in range(5)]
    # sums of weights, to two decimals, with their labels: at most as many rows as the fit may take
    got = rows.mapInPandas(sums, ", ".join(f"{c} double" for c in (*cols, "y", "n"))).groupBy(*cols).agg(F.sum("y").alias("y"), F.sum("n").alias("n")).toPandas()
    rows.unpersist()
    w = np.zeros(5)
    if len(got):
        x, y, n = got[cols].to_numpy(float), got["y"].to_numpy(float), got["n"].to_numpy(float)
        # misspelled hits start from a prior of half a plain hit, quoted ones of a fifth: the data correct that
        prior = np.array([0.0, 2.0, 1.0, 0.4, 0.2])
        w = prior + np.array([np.log((y.sum() + 0.5) / (n.sum() - y.sum() + 0.5)), 0, 0, 0, 0])
        center = w.copy()
        ridge = np.diag([0.01, 1.0, 1.0, 1.0, 1.0])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (y - n * p) - ridge @ (w - center)
            w = w + np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, grad)
    else:
        w[0] = -30.0
    return Model(lexicon, w)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score to every row."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts))

    return docs.withColumn("score", score(F.col(text)))


def op9_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    return scored(docs.select("doc_id", "text"), model).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
