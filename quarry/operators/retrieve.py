"""Batches of questions against a corpus: keyword, vector and hybrid top k, sources, context, answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import config
from quarry.functions.retrieval import extract_keywords, question_class, snippet
from quarry.functions.text import garbage_line, rounded, strip, txt
from quarry.operators.keyword_scores import asked_of, best_of_texts, best_schema, with_ids
from quarry.sources.shared import bound_batches

#: Questions sent to every task at once; a larger batch is taken in blocks of this size.
QUESTION_BLOCK = 10_000
#: The same for vectors, in bytes of a block's matrix; and how many similarities are held at once.
VECTOR_BYTES, PRODUCTS = 32 << 20, 1_000_000


def blocks(questions: DataFrame, size: int) -> list[DataFrame]:
    """The questions in blocks of about size rows, each small enough to broadcast."""
    n = questions.count()
    if n <= size:
        return [questions]
    k = -(-n // size) * 2
    return [questions.where(F.pmod(F.xxhash64("question_id"), F.lit(k)) == b) for b in range(k)]


def block_rows(dim: int) -> int:
    """Questions of a block, by the length of their vectors."""
    return max(1, VECTOR_BYTES // (8 * max(1, dim)))


def best(scored: DataFrame, k: int, *order: Column | str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(*order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def route_questions(questions: DataFrame, lists: config.Keywords = config.DEFAULT_KEYWORDS) -> DataFrame:
    """Adds keywords and question_class."""
    q = questions.withColumn("keywords", extract_keywords(F.col("question"), lists))
    return q.withColumn("question_class", question_class(F.col("question"), lists, F.col("keywords")))


def best_pages(scored: DataFrame, k: int) -> DataFrame:
    return best(scored, k, F.desc("score"), "ordinal", "page_number")


def top_keyword(questions: DataFrame, pages: DataFrame, threshold: float = 20.0, k: int = 4, lists: config.Keywords = config.DEFAULT_KEYWORDS) -> DataFrame:
    """The k best pages of each question: (question_id, document_id, page_number, rank, score, matched, ...). pages:
    (ordinal, document_id, page_number, title, document_number, issue_date, category, subcategory, text). Ties keep the
    corpus order.

    Pages are read once a block of questions: tasks look up each distinct token once, score the pages for all questions of
    the block and hand on the best of each. Texts don't pass the shuffle: the winners' are fetched by key."""
    spark, names = pages.sparkSession, ("title", "document_number", "category", "subcategory", "text")
    bound_batches(spark)
    asked = questions.select("question_id", extract_keywords(F.col("question"), lists).alias("keywords")).where(F.size("keywords") > 0)
    low = pages.where(strip(txt("text")) != "").select("ordinal", "page_number", *[F.lower(txt(c)).alias(f"_{c}") for c in names])
    parts = []
    for block in blocks(asked, QUESTION_BLOCK):
        said, ids = asked_of(block, lists.compounds)
        if said.words:
            found = low.mapInArrow(best_of_texts(spark.sparkContext.broadcast(said), threshold, k), best_schema(low))
            parts.append(with_ids(found, ids, questions.schema["question_id"].dataType.simpleString()))
    if not parts:
        parts = [low.select("ordinal", "page_number").join(questions.select("question_id").where("false")).select("question_id", "ordinal", "page_number", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("matched"))]
    return best_pages(union(parts), k).join(pages.drop("question_id", "score", "matched", "rank"), ["ordinal", "page_number"])


def nearest_in(m: np.ndarray, ordinals: np.ndarray, vectors: np.ndarray, of: np.ndarray, min_similarity: float, k: int) -> Iterator[pa.RecordBatch]:
    """Of rows and questions (numbered of) the similarities that are high enough: the k best of each question, and what ties
    with the last of them. Rows are taken in slices, so that at most PRODUCTS similarities are held."""
    size, step = np.linalg.norm(vectors, axis=1), max(1, PRODUCTS // max(1, len(vectors)))
    for lo in range(0, len(m), step):
        part = m[lo : lo + step]
        by = np.outer(np.linalg.norm(part, axis=1), size)
        sim = np.where(by > 0, np.clip(part @ vectors.T / np.where(by > 0, by, 1.0), -1.0, 1.0), 0.0)
        least = np.full(len(of), min_similarity)
        if len(part) > k:
            least = np.maximum(least, np.partition(sim, -k, axis=0)[-k])
        at, q = np.nonzero(sim >= least)
        yield pa.RecordBatch.from_arrays([pa.array(of[q].astype(np.int32)), pa.array(ordinals[lo + at]), pa.array(sim[at, q])], names=["q", "ordinal", "sim"])


def _nearest(vectors: np.ndarray, min_similarity: float, k: int):
    """A map over batches of (ordinal, embedding): similarities with all questions are matrix products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            there = b.filter(b.column("embedding").is_valid())
            fits = there.filter(pc.equal(pc.list_value_length(there.column("embedding")), vectors.shape[1]))
            m = np.asarray(fits.column("embedding").flatten(), float).reshape(len(fits), vectors.shape[1])
            yield from nearest_in(m, fits.column("ordinal").to_numpy(zero_copy_only=False), vectors, np.arange(len(vectors)), min_similarity, k)

    return run


def top_semantic(questions: DataFrame, vectors: DataFrame, min_similarity: float = 0.65, k: int = 4) -> DataFrame:
    """The k nearest chunks of each question by cosine, at least min_similarity: similarity to 3 places and relevance to 1,
    rounded after the cut. questions: (question_id, embedding); vectors: (ordinal, ..., embedding). Vectors of another
    length than the questions', or null, are near to nothing.

    Questions are taken in blocks of at most VECTOR_BYTES, whose matrix goes to all tasks; of a batch of vectors only the
    best of each question reach the shuffle."""
    spark, kind = questions.sparkSession, vectors.schema["ordinal"].dataType.simpleString()
    parts = []
    there = questions.where("embedding is not null").select("question_id", "embedding")
    for (dim,) in there.select(F.size("embedding")).distinct().collect():  # the lengths that vectors have
        for block in blocks(there.where(F.size("embedding") == dim), block_rows(dim)):
            of = block.collect()
            ids = spark.createDataFrame([(i, r.question_id) for i, r in enumerate(of)], f"q int, question_id {questions.schema['question_id'].dataType.simpleString()}")
            near = _nearest(np.array([r.embedding for r in of], float).reshape(len(of), dim), min_similarity, k)
            s = vectors.select("ordinal", "embedding").mapInArrow(near, f"q int, ordinal {kind}, sim double")
            parts.append(s.join(F.broadcast(ids), "q").drop("q"))
    if not parts:
        parts = [vectors.select("ordinal", F.lit(0.0).alias("sim")).join(questions.select("question_id").where("false"))]
    out = best(union(parts), k, F.desc("sim"), "ordinal")
    out = out.withColumns({"similarity": rounded(F.col("sim"), 3), "relevance": rounded(F.col("sim") * 100, 1)})
    return out.join(vectors.drop("embedding", "sim", "rank"), "ordinal")


def fuse_hybrid(keyword: DataFrame, semantic: DataFrame, fusion: config.Fusion = config.Fusion()) -> DataFrame:
    """The k best pages of each question from both sides, joined on (question_id, document_id, page_number).

    keyword: score, rank, ...; semantic: similarity, rank, .... Keyword scores are scaled by the question's best (at
    least 1); what is below min_final and not strong by keyword drops out; scores are rounded after that. A question
    without a semantic side keeps its keyword results from min_final on. Several chunks of one page: page_score 'last'
    lets the lowest similarity stand, as the rules had it, 'max' the highest."""
    sim = F.min("similarity") if fusion.page_score == "last" else F.max("similarity")
    s = semantic.groupBy("question_id", "document_id", "page_number").agg(sim.alias("semantic_score"), F.min("rank").alias("s_rank"), F.min_by("text", "rank").alias("s_text"), F.min_by("title", "rank").alias("s_title"))
    w = Window.partitionBy("question_id")
    kw = keyword.select("question_id", "document_id", "page_number", F.col("score").alias("keyword_score"), F.col("rank").alias("k_rank"), F.col("text").alias("k_text"), F.col("title").alias("k_title"), F.greatest(F.max("score").over(w), F.lit(1.0)).alias("k_max"))
    j = kw.join(s, ["question_id", "document_id", "page_number"], "full")
    j = j.withColumn("_sem", F.max(F.col("semantic_score").isNotNull()).over(w))
    k0, s0 = F.coalesce("keyword_score", F.lit(0.0)), F.coalesce("semantic_score", F.lit(0.0))
    final = F.coalesce(k0 / F.col("k_max") * 100, F.lit(0.0)) * fusion.keyword_weight + s0 * 100 * fusion.semantic_weight
    alone = ~F.col("_sem")
    kept = j.withColumn("_final", F.when(alone, k0).otherwise(final)).where((F.col("_final") >= fusion.min_final) | (~alone & (k0 >= fusion.strong_keyword)))
    kept = kept.withColumn("final_score", F.when(alone, F.col("_final")).otherwise(rounded(F.col("_final"))))
    top = best(kept, fusion.k, F.desc("final_score"), F.coalesce("k_rank", F.lit(1 << 30)), F.coalesce("s_rank", F.lit(1 << 30)), "document_id", "page_number")
    return top.select("question_id", "document_id", "page_number", "rank", F.coalesce("k_title", "s_title").alias("title"), F.coalesce("k_text", "s_text").alias("text"), k0.alias("keyword_score"), s0.alias("semantic_score"), "final_score", F.col("_sem").alias("is_hybrid"))


def top_hybrid(questions: DataFrame, pages: DataFrame, vectors: DataFrame, fusion: config.Fusion = config.Fusion(), lists: config.Keywords = config.DEFAULT_KEYWORDS) -> DataFrame:
    """Both sides with twice the wanted number, fused. questions: (question_id, question, embedding)."""
    kw = top_keyword(questions, pages, fusion.min_keyword, 2 * fusion.k, lists)
    sem = top_semantic(questions, vectors, fusion.min_similarity, 2 * fusion.k)
    return fuse_hybrid(kw, sem, fusion)


def build_sources(retrieved: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Citations: chunks of missing documents drop out, pages are brought into [1, total_pages], each (document, page) is
    cited once per question, by rank. retrieved: (question_id, document_id, page_number, rank, text, matched)."""
    n = F.size(F.coalesce("pages", F.expr("cast(array() as array<struct<page_number:int,raw_text:string,cleaned_text:string>>)")))
    c = catalogue.groupBy(F.col("id").alias("document_id")).agg(F.min_by(F.struct("title", "document_number", "issue_date", "category", F.coalesce(F.nullif("total_pages", F.lit(0)), F.greatest(n, F.lit(1))).alias("total"), (n > 0).alias("has_pages"), F.coalesce(F.nullif("source_url", F.lit("")), F.nullif("detail_url", F.lit(""))).alias("source_url")), "ordinal").alias("c"))
    r = retrieved.select("question_id", "document_id", "page_number", "rank", "text", "matched").join(c, "document_id")
    page = F.least(F.greatest(F.coalesce("page_number", F.lit(1)), F.lit(1)), F.col("c.total"))
    r = r.withColumn("page", page)
    first = Window.partitionBy("question_id", "document_id", "page").orderBy("rank")
    r = r.withColumn("_i", F.row_number().over(first)).where("_i = 1")
    url = F.concat(F.lit("/documents/"), F.col("document_id").cast("string"), F.when(F.col("c.has_pages"), F.concat(F.lit("#page-"), F.col("page").cast("string"))).otherwise(""))
    return r.select("question_id", "document_id", "rank", F.col("c.title").alias("title"), F.col("c.document_number").alias("document_number"), F.col("c.issue_date").alias("issue_date"), F.col("c.category").alias("category"), "page", snippet(F.col("text"), F.col("matched")).alias("snippet"), url.alias("url"), F.col("c.source_url").alias("source_url"))


#: The frame of a context.
CONTEXT_OPEN, CONTEXT_CLOSE, NO_CONTEXT = "[VĂN BẢN NGUỒN LIÊN QUAN]", "[/VĂN BẢN NGUỒN LIÊN QUAN]", "Không có văn bản nào liên quan được tìm thấy trong kho dữ liệu."


def assemble_context(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(question_id, context): numbered blocks in rank order, or a fixed text. At most k chunks a question are gathered."""
    or_ = lambda c, label, none: F.concat(F.lit(label), F.coalesce(F.nullif(c, F.lit("")), F.lit(none)))
    block = F.concat(
        F.lit("ID: "), F.col("document_id").cast("string"), F.lit("\nTIÊU ĐỀ: "), txt("title"), F.lit("\n"), or_("document_number", "Số hiệu: ", "Chưa xác định"), F.lit(" | "), or_("issue_date", "Ngày ban hành: ", "Chưa rõ"), F.lit(" | "), or_("category", "Chủ đề: ", "Chưa phân loại"),
        F.lit("\nTRANG: "), F.col("page_number").cast("string"), F.lit("\nNỘI DUNG:\n"), txt("text"),
    )
    got = retrieved.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("blocks"))
    label = lambda i, close: F.concat(F.lit("[/VĂN BẢN " if close else "[VĂN BẢN "), (i + 1).cast("string"), F.lit("]"))
    body = F.array_join(F.transform("blocks", lambda x, i: F.concat(label(i, False), F.lit("\n"), x["b"], F.lit("\n"), label(i, True))), "\n\n")
    context = F.when(F.size("blocks") > 0, F.concat(F.lit(CONTEXT_OPEN + "\n"), body, F.lit("\n" + CONTEXT_CLOSE))).otherwise(NO_CONTEXT)
    return questions.select("question_id").join(got, "question_id", "left").select("question_id", F.coalesce(context, F.lit(NO_CONTEXT)).alias("context"))


def user_prompt(question: Column, context: Column, intro: str = "Documents:", ask: str = "Question:", rule: str = "Answer from the documents above alone; say so if they don't hold the answer.") -> Column:
    return F.concat(F.lit(intro + "\n\n"), context, F.lit("\n\n" + ask + '\n"'), question, F.lit('"\n\n' + rule))


def excerpt_lines(text: Column, keywords: Column, most: int = 8, garbage=garbage_line) -> Column:
    """Lines worth quoting: those with a keyword, one before and two after, until most lines are held; without a match the
    first ones."""
    good = F.filter(F.transform(F.split(txt(text), r"\n+"), strip), lambda x: (F.length(x) > 15) & ~garbage(x))
    keys = F.transform(keywords, F.lower)
    hits = F.filter(F.transform(good, lambda x, i: F.when(F.exists(keys, lambda k: F.contains(F.lower(x), k)), i)), lambda i: i.isNotNull())
    last = F.size(good) - 1
    picked = F.aggregate(
        hits,
        F.array().cast("array<int>"),
        lambda a, i: F.when(F.size(a) >= most, a).otherwise(F.array_union(a, F.sequence(F.greatest(i - 1, F.lit(0)), F.least(i + 2, last)))),
    )
    return F.when(F.size(hits) == 0, F.slice(good, 1, most)).otherwise(F.transform(F.array_sort(picked), lambda i: F.get(good, i)))


#: The frame of an extractive answer.
NO_ANSWER = "Không tìm thấy thông tin liên quan trong kho tài liệu."


def extractive_answer(questions: DataFrame, retrieved: DataFrame, sources: DataFrame, closing: str = "") -> DataFrame:
    """(question_id, answer): quotes lines of the best chunk, and of the second if its source is another document."""
    at = lambda df, *cols: df.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", *cols))).alias("_x"))
    chunks = at(retrieved, "text", "matched").withColumnRenamed("_x", "c")
    cited = at(sources, "document_id", "title", "document_number", "issue_date").withColumnRenamed("_x", "s")
    j = questions.select("question_id").join(chunks, "question_id", "left").join(cited, "question_id", "left")
    s1, s2, c1, c2 = F.get("s", F.lit(0)), F.get("s", F.lit(1)), F.get("c", F.lit(0)), F.get("c", F.lit(1))
    given = lambda label, v, end="": F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(label), v, F.lit(end))).otherwise("")
    own, other = excerpt_lines(c1["text"], c1["matched"], 8), excerpt_lines(c2["text"], c2["matched"], 4)
    body = F.when(F.size(own) > 0, F.array_join(own, "\n- ")).otherwise(strip(F.substring(c1["text"], 1, 500)))
    more = F.when(
        c2.isNotNull() & s2.isNotNull() & (s2["document_id"] != s1["document_id"]) & (F.size(other) > 0),
        F.concat(F.lit("\n\n**Thông tin liên quan** theo **"), txt(s2["title"]), F.lit("**"), given(" (Số: ", s2["document_number"], ")"), F.lit(" [Nguồn 2]:\n- "), F.array_join(other, "\n- ")),
    ).otherwise("")
    answer = F.concat(F.lit("Theo **"), txt(s1["title"]), F.lit("**"), given(" (Số: ", s1["document_number"], ")"), given(" ngày ", s1["issue_date"]), F.lit(" [Nguồn 1]:\n\n- "), body, more, F.lit(closing))
    return j.select("question_id", F.when(c1.isNull() | s1.isNull(), NO_ANSWER).otherwise(answer).alias("answer"))
