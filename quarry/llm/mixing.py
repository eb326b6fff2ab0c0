"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed hash. A source with target t and size s takes every document floor(t / s) times and, for
the remainder, the documents whose hash is below a threshold. The threshold is found from histograms: sizes are summed
by source and leading hash bits, the bucket in which the budget runs out is found from its running sums, and only that
bucket is refined by the next bits, level by level, down to single hash values. Nothing is sorted; a level's histogram
has at most sources x 2**bits rows, and larger budgets take supersets (thresholds are nested).

Edge cases: a null text has size 0 and is taken 0 times its size. Null is a source of its own, ordered last. Repeated
rows have the same hash, and are taken or left together. Sources without words have target 0. Extra columns pass.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import words_of, written

BITS, LEVELS = 12, 4  # 48 hash bits
MAX_REPEATS = 3


def id_hash(doc_id: Column) -> Column:
    """48 bits of the md5 of an id; the same in any run and engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")


def source_targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """From (source, source_size) rows, one per source: adds weight and target. Sources by code point, null last, weigh
    1, 2, 3, 1, ...; targets stop at max_repeats x size and what is over is shared by weight among the others.

    The share per unit of weight rises until the sum of min(cap, weight x share) is the total: sources reach their cap in
    the order of cap / weight, so running sums in that order give the level without a loop."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_cap = Window.orderBy("_reach", "_rank")
    s = (
        sources.withColumn("_rank", F.row_number().over(by_name))
        .withColumn("weight", ((F.col("_rank") - 1) % 3 + 1).cast("double"))
        .withColumn("_cap", F.col("source_size").cast("double") * max_repeats)
        .withColumn("_reach", F.col("_cap") / F.col("weight"))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_heavy", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_heavy"))
        # the level rises while sources below it are capped and falls after that: its largest value holds for all
        .withColumn("_final", F.max("_level").over(Window.partitionBy()))
    )
    return s.select("source", "source_size", "weight", F.least(F.col("_cap"), F.col("weight") * F.col("_final")).alias("target"))


def _thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, whole, below): documents are taken whole times, and once more if their hash is below."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    state = targets.withColumn("whole", whole.cast("long")).withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))).withColumn("prefix", F.lit(0).cast("long"))
    state = written(state, "mix-targets")
    for level in range(LEVELS):
        low = BITS * (LEVELS - 1 - level)
        bucket = F.shiftright("hash", low)
        at = state.select(F.col("source").alias("_s"), "prefix")
        inside = sized if level == 0 else sized.join(at, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("hash", low + BITS) == F.col("prefix")), "left_semi")
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("words").over(run)).select(F.col("source").alias("_s"), "bucket", "words", "upto")
        # the boundary bucket: the first whose running sum is over what is left
        edge = (
            state.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("upto") > F.col("left")), "left")
            .groupBy("source", "source_size", "weight", "target", "whole", "left", "prefix")
            .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"), "words")).alias("e"))
        )
        prefix = F.coalesce(F.col("e.bucket"), F.shiftleft("prefix", BITS))
        state = edge.select("source", "source_size", "weight", "target", "whole", (F.col("left") - F.coalesce("e.before", F.lit(0))).alias("left"), prefix.alias("prefix"), F.col("e.words").alias("edge_words"))
        state = written(state, "mix-level")
    # the last bucket is one hash value: it is taken when that brings the sum nearer to the target
    more = (F.col("left") > 0) & (F.col("left") * 2 > F.coalesce(F.col("edge_words"), F.lit(0)))
    return state.select("source", "source_size", "weight", "target", "whole", (F.col("prefix") + F.when(more, 1).otherwise(0)).alias("below"))


def mixed(docs: DataFrame, max_repeats: int = MAX_REPEATS, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """Adds size, source_size, weight, target, times (how often the mix takes a document) and taken = times x size.

    The per-source table is joined with AQE's choice of strategy: it is as long as there are sources, which a mix
    names by hand, and Spark measures it before it broadcasts it."""
    new = ("size", "source_size", "weight", "target", "times", "taken", "hash", "_s")
    base = docs.drop(*[c for c in docs.columns if c in new])
    sized = base.select(F.col(source).alias("source"), F.size(words_of(F.col(text))).cast("long").alias("size"), id_hash(F.col(key)).alias("hash"))
    sized = written(sized, "mix-sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), max_repeats)
    plan = _thresholds(sized, targets).withColumnRenamed("source", "_s")
    out = base.withColumn("size", F.size(words_of(F.col(text))).cast("long")).withColumn("hash", id_hash(F.col(key)))
    out = out.join(plan, F.col(source).eqNullSafe(F.col("_s")), "left").drop("_s")
    out = out.withColumn("times", F.least(F.lit(max_repeats).cast("long"), F.col("whole") + (F.col("hash") < F.col("below")).cast("long")))
    return out.withColumn("taken", F.col("times") * F.col("size")).drop("hash", "whole", "below")


def op4_mixing(docs: DataFrame) -> DataFrame:
    return mixed(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS hash
  FROM {docs}
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS DOUBLE) AS weight,
         row_number() OVER (ORDER BY source IS NULL, encode(source)) AS r
  FROM d GROUP BY source
), c AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS reach FROM s
), v AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY reach, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY reach, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM c
), t AS (
  SELECT source, source_size, least(cap, weight * max(lvl) OVER ()) AS target FROM v
), w AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-12) AS BIGINT) ELSE 0 END AS whole FROM t
), h AS (
  SELECT source, hash, sum(size) AS words FROM d GROUP BY source, hash
), k AS (
  SELECT h.*, greatest(0, w.target - w.whole * w.source_size) AS leftover,
         sum(words) OVER (PARTITION BY h.source ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM h JOIN w ON h.source IS NOT DISTINCT FROM w.source
), x AS (
  SELECT source, hash, upto <= leftover OR (upto - words < leftover AND 2 * (leftover - (upto - words)) > words) AS more FROM k
)
SELECT d.doc_id, d.size, w.source_size, w.target,
       CAST(least(3, w.whole + CASE WHEN x.more THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.hash = x.hash
"""
