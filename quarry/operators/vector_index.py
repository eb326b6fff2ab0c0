"""Exact nearest vectors by a stored index.

Vectors are put to the nearest of some centres on the unit sphere and stored by cluster. A cluster's radius is the largest
angle between its centre and a member, so a question at an angle t of the centre is at least t - radius from all of them;
and as many members as a question wants lie within the angles t + radius of its closest clusters. A cluster whose nearest
possible member is farther than that, or than the least similarity, is skipped whole: its folder isn't read if no question
of the block needs it, and questions that don't need it aren't multiplied with it. What is left out cannot be among the
best, so the rows are those of a full search.

Centres are fitted on all vectors in a few rounds from a bounded, documented sample (the first in the order of a hash); they
are at most MAX_CLUSTERS rows, which go to all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import rounded
from quarry.operators.retrieve import block_rows, blocks, best, nearest_in, union

MAX_CLUSTERS = 1024
#: Vectors of the sample for each centre.
SAMPLE = 8
#: Vectors of length zero, which are at no angle: similar by 0 to everything.
NOWHERE = -1
#: Angles are compared with room for what rounding may have taken.
SLACK = 1e-6
MEMBERS, CLUSTERS = "ordinal long, embedding array<double>, cluster int", "cluster int, n long, radius double, centre array<double>"


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, dim)


def _angles(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(m) @ centres.T, -1.0, 1.0))


def _spread(sample: np.ndarray, clusters: int) -> np.ndarray:
    """So many of a sample's vectors, each the farthest from those before."""
    sample = sample[np.any(sample != 0, axis=1)]
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    picked, near = [0], sample @ sample[0]
    while len(picked) < clusters and near.min() < 1 - SLACK:
        picked.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[picked[-1]])
    return sample[picked]


def _assign(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("embedding"), centres.shape[1])
            angle = _angles(m, centres)
            at = angle.argmin(axis=1) if len(m) else np.array([], int)
            least = angle[np.arange(len(m)), at]
            at = np.where(np.any(m != 0, axis=1), at, NOWHERE)
            yield pa.RecordBatch.from_arrays([b.column("ordinal"), b.column("embedding"), pa.array(at.astype(np.int32)), pa.array(least)], names=["ordinal", "embedding", "cluster", "angle"])

    return run


def _sums(centres: np.ndarray):
    """Per task and cluster the sum of its members' unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(centres)
        for b in batches:
            m = _unit(_matrix(b.column("embedding"), centres.shape[1]))
            if len(m):
                np.add.at(total, (m @ centres.T).argmax(axis=1), m)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["cluster", "sums"])

    return run


def write_index(vectors: DataFrame, path: str, dim: int, clusters: int = 64, rounds: int = 2) -> None:
    """An index of the vectors (ordinal, ..., embedding) of length dim; others are left out. Further columns are stored
    beside it and come back with the best rows."""
    if not 0 < clusters <= MAX_CLUSTERS:
        raise ValueError(f"clusters must be 1 to {MAX_CLUSTERS}")
    some = vectors.where(F.size("embedding") == dim)
    some.drop("embedding").write.parquet(f"{path}/rows")
    m = some.select(F.col("ordinal").cast("long").alias("ordinal"), F.col("embedding").cast("array<double>").alias("embedding"))
    sample = m.orderBy(F.xxhash64("ordinal")).limit(SAMPLE * clusters).collect()
    centres = _spread(_unit(np.array([r.embedding for r in sample], float).reshape(len(sample), dim)), clusters)
    for _ in range(rounds):
        sums = m.mapInArrow(_sums(centres), "cluster int, sums array<double>").select("cluster", F.posexplode("sums").alias("i", "x"))
        got = sums.groupBy("cluster", "i").agg(F.sum("x").alias("x")).collect()  # clusters times dim numbers
        total = np.zeros_like(centres)
        for r in got:
            total[r.cluster, r.i] = r.x
        centres = np.where(np.any(total != 0, axis=1, keepdims=True), _unit(total), centres)
    placed = m.mapInArrow(_assign(centres), "ordinal long, embedding array<double>, cluster int, angle double")
    # a cluster may hold a third of the rows, so it is dealt to several tasks and files
    dealt = placed.withColumn("_deal", F.pmod(F.xxhash64("ordinal"), F.lit(16))).repartition("cluster", "_deal").drop("_deal")
    dealt.write.partitionBy("cluster").parquet(f"{path}/members")
    stats = vectors.sparkSession.read.schema("angle double, cluster int").parquet(f"{path}/members").groupBy("cluster").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    of = vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)] + [(NOWHERE, [0.0] * dim)], "cluster int, centre array<double>")
    stats.join(of, "cluster").select("cluster", "n", "radius", "centre").coalesce(1).write.parquet(f"{path}/clusters")


def needed(asked: np.ndarray, clusters: list, min_similarity: float, k: int) -> np.ndarray:
    """Which clusters may hold one of the k best rows of each question, as a matrix of questions and clusters."""
    real = np.array([c.cluster != NOWHERE for c in clusters])
    centres = np.array([c.centre for c in clusters], float).reshape(len(clusters), -1)
    radius, n = np.array([c.radius for c in clusters]), np.array([c.n for c in clusters])
    angle = _angles(asked, centres)
    nowhere = ~np.any(asked != 0, axis=1)
    most = np.where(real, np.cos(np.maximum(angle - radius - SLACK, 0.0)), 0.0)
    least = np.where(real, np.cos(np.minimum(angle + radius + SLACK, np.pi)), 0.0)
    # so many rows are certain at that similarity or more: the k-th of them is a bound
    order = np.argsort(-least, axis=1)
    held = np.cumsum(n[order], axis=1) >= k
    kth = np.where(held.any(axis=1), np.take_along_axis(least, np.take_along_axis(order, held.argmax(axis=1)[:, None], 1), 1)[:, 0], -2.0)
    bound = np.maximum(kth, min_similarity) - SLACK
    out = most >= bound[:, None]
    # a question of length zero is similar by 0 to all rows
    out[nowhere] = min_similarity <= 0
    return out


def _search(vectors: np.ndarray, wanted: dict[int, np.ndarray], min_similarity: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clusters = b.column("cluster").to_numpy()
            for c in np.unique(clusters):
                at = np.flatnonzero(clusters == c)
                m = _matrix(b.column("embedding").take(pa.array(at)), vectors.shape[1])
                ordinals, of = b.column("ordinal").to_numpy()[at], wanted[int(c)]
                yield from nearest_in(m, ordinals, vectors[of], of, min_similarity, k)

    return run


def top_semantic_indexed(questions: DataFrame, path: str, min_similarity: float = 0.65, k: int = 4) -> DataFrame:
    """What top_semantic finds among the indexed vectors. Questions of another length find nothing."""
    spark: SparkSession = questions.sparkSession
    clusters = spark.read.schema(CLUSTERS).parquet(f"{path}/clusters").orderBy("cluster").collect()  # at most MAX_CLUSTERS
    dim = len(clusters[0].centre) if clusters else 0
    kind = questions.schema["question_id"].dataType.simpleString()
    parts = [spark.createDataFrame([], f"ordinal long, sim double, question_id {kind}")]
    for block in blocks(questions.where(F.size("embedding") == dim).select("question_id", "embedding"), block_rows(dim)):
        got = block.collect()
        if not got:
            continue
        asked = np.array([r.embedding for r in got], float)
        wanted = needed(asked, clusters, min_similarity, k)
        of = {c.cluster: np.flatnonzero(wanted[:, i]) for i, c in enumerate(clusters) if wanted[:, i].any()}
        members = spark.read.schema(MEMBERS).parquet(f"{path}/members").where(F.col("cluster").isin(sorted(of)))
        ids = spark.createDataFrame([(i, r.question_id) for i, r in enumerate(got)], f"q int, question_id {kind}")
        near = members.mapInArrow(_search(asked, of, min_similarity, k), "q int, ordinal long, sim double")
        parts.append(near.join(F.broadcast(ids), "q").drop("q"))
    out = best(union(parts), k, F.desc("sim"), "ordinal")
    out = out.withColumns({"similarity": rounded(F.col("sim"), 3), "relevance": rounded(F.col("sim") * 100, 1)})
    return out.join(spark.read.parquet(f"{path}/rows").drop("sim", "rank"), "ordinal")


def skipped_clusters(questions: DataFrame, path: str, min_similarity: float = 0.65, k: int = 4) -> DataFrame:
    """(question_id, n_clusters, n_skipped, n_vectors, n_skipped_vectors) of questions as long as the index's vectors."""
    spark = questions.sparkSession
    clusters = spark.read.schema(CLUSTERS).parquet(f"{path}/clusters").orderBy("cluster").collect()
    dim = len(clusters[0].centre) if clusters else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.array([c.n for c in clusters], np.int64)
        for b in batches:
            m = _matrix(b.column("embedding"), dim)
            out = ~needed(m, clusters, min_similarity, k)
            whole = [np.full(len(m), len(n)), out.sum(axis=1), np.full(len(m), n.sum()), out @ n]
            yield pa.RecordBatch.from_arrays([b.column("question_id"), *(pa.array(x.astype(np.int64)) for x in whole)], names=["question_id", "n_clusters", "n_skipped", "n_vectors", "n_skipped_vectors"])

    kind = questions.schema["question_id"].dataType.simpleString()
    return questions.where(F.size("embedding") == dim).select("question_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, f"question_id {kind}, n_clusters long, n_skipped long, n_vectors long, n_skipped_vectors long")
