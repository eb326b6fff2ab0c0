"""Whole jobs as one lazy plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.operators.retrieve import assemble_context, build_sources, extractive_answer, fuse_hybrid, route_questions, top_keyword, top_semantic


def answer_questions(questions: DataFrame, pages: DataFrame, catalogue: DataFrame, vectors: DataFrame | None = None, fusion: config.Fusion = config.Fusion(), lists: config.Keywords = config.DEFAULT_KEYWORDS) -> DataFrame:
    """(question_id, question_class, context, answer, n_sources) of a batch of questions. The corpus is scanned once a
    side for the whole batch. questions: (question_id, question [, embedding])."""
    routed = route_questions(questions, lists)
    asked = routed.where("question_class = 'retrieve'")
    kw = top_keyword(asked, pages, fusion.min_keyword, 2 * fusion.k, lists)
    if vectors is None:
        best = kw.where(F.col("score") >= fusion.min_final).where(F.col("rank") <= fusion.k)
    else:
        fused = fuse_hybrid(kw, top_semantic(asked, vectors, fusion.min_similarity, 2 * fusion.k), fusion)
        about = pages.select("document_id", "page_number", "document_number", "issue_date", "category").dropDuplicates(["document_id", "page_number"])
        best = fused.join(about, ["document_id", "page_number"], "left").join(asked.select("question_id", F.col("keywords").alias("matched")), "question_id")
    sources = build_sources(best, catalogue)
    n = sources.groupBy("question_id").agg(F.count("*").alias("n"))
    out = routed.select("question_id", "question_class").join(assemble_context(asked, best), "question_id", "left").join(extractive_answer(asked, best, sources), "question_id", "left")
    return out.join(n, "question_id", "left").withColumn("n_sources", F.coalesce("n", F.lit(0))).drop("n")
