"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

A text is described by a few statistics of its characters, words and lines. Random Fourier features of the standardised
statistics approximate a Gaussian kernel; each partition sums its part of the normal equations, the parts are added in a
tree, and the driver solves one system of fixed size. Ridge scores are calibrated by isotonic regression over a
histogram of fixed size. Scoring is one map over the texts, without a shuffle.

Labels are fitted on at most MAX_LABELLED labelled rows (chosen by a hash of the id, so reruns agree). Their ids are
joined by broadcast, whose size this bound proves; texts are not shuffled.

Edge cases: null and empty texts have all statistics 0 and get a score too. Labels that are null, repeated or without
document don't break the fit; with no labelled rows at all every score is 0.5. Repeated rows get a score each. Extra
columns pass; a column named score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, remainder

MAX_LABELLED = 20_000
FEATURES = 192
RIDGE = 1e-3
BINS = 512
#: The described labelled rows are dealt to so many partitions; of their sums, so many are added in a task.
PARTS, ARITY = 64, 8
STATISTICS = ("log_words", "word_length", "symbols", "bars", "bangs", "upper", "digits", "stops", "distinct", "distinct_pairs", "line_words", "distinct_lines")


def statistics(text: str | None) -> list[float]:
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / size
    lines = [x for x in text.split("\n") if x]
    of = lambda chars: float(sum(seen[b] for b in chars))
    return [
        np.log1p(len(words)), min(30.0, (size - len(words)) / n), min(0.3, of(b"#*$%&<>")), min(0.3, of(b"|")), min(0.3, of(b"!")),
        of(range(65, 91)), of(range(48, 58)), min(0.3, of(b".,;:")), len(set(words)) / n, len(set(zip(words, words[1:], strict=False))) / n,
        np.log1p(n / max(1, len(lines))), len(set(lines)) / max(1, len(lines)),
    ]


def _table(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=float).reshape(len(texts), len(STATISTICS))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    level: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(x), 1)), np.cos(z @ self.turn + self.shift) * np.sqrt(2 / FEATURES)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, with a little of the raw score so that ties of a step stay in order."""
        if not self.weights.any():
            return np.full(len(x), 0.5)  # nothing was learnt
        r = self.raw(x)
        return np.clip(0.98 * np.interp(r, self.at, self.level) + 0.02 / (1 + np.exp(-4 * (np.clip(r, -9, 9) - 0.5))), 0, 1)


def labelled(docs: DataFrame, labels: DataFrame, label: str, fits: Column, bound: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(text, y) of the labelled rows that fits allows, at most bound of them, chosen by the ids' hashes."""
    ok = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & fits).select(F.col(key), F.col(label).cast("double").alias("y")).groupBy(key).agg(F.max("y").alias("y"))
    # a share by hash first, so that little is ordered
    share = 2**20 * 3 * bound // (2 * max(bound, ok.count())) + 2**12
    at = F.pmod(F.xxhash64(key), F.lit(2**20))
    some = ok.where(at < share).orderBy(at, key).limit(bound)
    return docs.select(key, text).join(F.broadcast(some), key).select(F.col(text).alias("text"), "y")


def _added(parts: DataFrame, size: int) -> np.ndarray | None:
    """Sum of float64 vectors (id long, v binary), one per partition that has rows, in a tree: each task adds up to ARITY
    of them, and the driver gets as many at most."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size)
        for v in pdf.sort_values("id")["v"]:
            total += np.frombuffer(v, float)
        return pd.DataFrame({"id": [int(pdf["id"].iloc[0]) // ARITY], "v": [total.tobytes()]})

    n = PARTS
    while n > ARITY:
        n = -(-n // ARITY)
        parts = parts.groupBy(F.floor(F.col("id") / ARITY)).applyInPandas(add, "id long, v binary")
    got = sorted(parts.collect(), key=lambda r: r.id)
    return sum(np.frombuffer(r.v, float) for r in got) if got else None


def _isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks])


def fit(docs: DataFrame, labels: DataFrame, fits: Column, label: str = "quality", bound: int = MAX_LABELLED, seed: int = 7) -> Model:
    bound_batches(docs.sparkSession)
    k = len(STATISTICS)

    def described(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = pd.DataFrame(_table(pdf["text"]), columns=list(STATISTICS))
            yield out.assign(y=pdf["y"].to_numpy())

    rows = labelled(docs, labels, label, fits, bound).mapInPandas(described, ", ".join(f"{c} double" for c in (*STATISTICS, "y")))
    rows = rows.repartition(PARTS, *STATISTICS).sortWithinPartitions(*STATISTICS, "y").persist()
    stats = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(STATISTICS)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(STATISTICS)]).first()
    zero = np.zeros(FEATURES + 1)
    rng = np.random.default_rng(seed)
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(k)])
    scale = np.array([max(stats[f"s{i}"] or 0.0, 1e-3) for i in range(k)])
    model = Model(mean, scale, rng.normal(0, 1 / np.sqrt(k), (k, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), zero, np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    if not stats["n"]:
        return model
    d = FEATURES + 1

    def sums(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(d * (d + 1))
        for pdf in it:
            x, y = model.features(pdf[list(STATISTICS)].to_numpy()), pdf["y"].to_numpy()
            total += np.hstack([(x.T @ x).ravel(), x.T @ y])
        if total.any():
            yield pd.DataFrame({"id": [TaskContext.get().partitionId()], "v": [total.tobytes()]})

    total = _added(rows.mapInPandas(sums, "id long, v binary"), d * (d + 1))
    gram = total[: d * d].reshape(d, d) + np.eye(d) * RIDGE * stats["n"] / d
    model.weights = np.linalg.solve(gram, total[d * d :])

    def binned(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 * BINS)
        for pdf in it:
            at = np.clip(((model.raw(pdf[list(STATISTICS)].to_numpy()) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            total += np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=pdf["y"], minlength=BINS)])
        if total.any():
            yield pd.DataFrame({"id": [TaskContext.get().partitionId()], "v": [total.tobytes()]})

    bins = _added(rows.mapInPandas(binned, "id long, v binary"), 2 * BINS)
    rows.unpersist()
    full = np.flatnonzero(bins[:BINS])
    w, y = bins[:BINS][full], bins[BINS:][full]
    model.at, model.level = (full + 0.5) / BINS * 2 - 0.5, _isotonic((y + 0.05) / (w + 0.1), w)
    return model


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score to every row."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_table(texts)))

    return docs.withColumn("score", score(F.col(text)))


def op5_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    return scored(docs.select("doc_id", "text"), model).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
