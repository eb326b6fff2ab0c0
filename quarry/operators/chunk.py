"""Pages to chunks, chunks to vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.retrieval import embedding_input
from quarry.functions.text import strip, txt
from quarry.sources.buckets import Buckets
from quarry.sources.shared import stored

MAX_CHARS = 750
TEXTS = "array<string>"


def _pack(parts: Column, start: Column, joint: str, size: int) -> Column:
    """Struct of done (array) and tail: parts packed, in order, into texts of at most size; a longer part stays whole."""
    return F.aggregate(
        parts,
        F.struct(F.array().cast(TEXTS).alias("done"), start.alias("tail")),
        lambda a, p: F.when(F.length(a["tail"]) + len(joint) + F.length(p) <= size, F.struct(a["done"].alias("done"), F.when(a["tail"] == "", p).otherwise(F.concat(a["tail"], F.lit(joint), p)).alias("tail"))).otherwise(
            F.struct(F.when(a["tail"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["tail"]))).alias("done"), p.alias("tail"))
        ),
    )


def chunk_texts(text: Column, size: int = MAX_CHARS, paragraphs: str = r"\n{2,}") -> Column:
    """A page as an array of chunk texts: whole if short; else paragraphs are packed, one that is too long is split at
    sentence ends, and its last piece starts the next chunk."""
    clean = strip(txt(text))
    paras = F.filter(F.transform(F.split(clean, paragraphs), strip), lambda p: p != "")

    def step(a: Column, p: Column) -> Column:
        fits = F.length(a["tail"]) + 2 + F.length(p) <= size
        done = F.when(a["tail"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(strip(a["tail"]))))
        sentences = _pack(F.split(p, r"(?U)(?<=[.!?])\s+"), F.lit(""), " ", size)
        long = F.struct(F.concat(done, F.transform(sentences["done"], strip)).alias("done"), sentences["tail"].alias("tail"))
        return (
            F.when(fits, F.struct(a["done"].alias("done"), F.when(a["tail"] == "", p).otherwise(F.concat(a["tail"], F.lit("\n\n"), p)).alias("tail")))
            .when(F.length(p) > size, long)
            .otherwise(F.struct(done.alias("done"), p.alias("tail")))
        )

    packed = F.aggregate(paras, F.struct(F.array().cast(TEXTS).alias("done"), F.lit("").alias("tail")), step, lambda a: F.when(strip(a["tail"]) == "", a["done"]).otherwise(F.concat(a["done"], F.array(strip(a["tail"])))))
    return F.when(clean == "", F.array().cast(TEXTS)).when(F.length(clean) <= size, F.array(clean)).otherwise(packed)


def explode_pages(docs: DataFrame, *keep: str) -> DataFrame:
    """A row per page with page_number, raw_text, cleaned_text; a document without pages is its content as page 1."""
    own = F.struct(F.lit(1).alias("page_number"), txt("content").alias("raw_text"), txt("content").alias("cleaned_text"))
    pages = F.when(F.size(F.coalesce("pages", F.expr("cast(array() as array<struct<page_number:int,raw_text:string,cleaned_text:string>>)"))) > 0, F.col("pages")).otherwise(F.array(own))
    return docs.select(*keep, F.explode(pages).alias("_p")).select(*keep, "_p.*")


def chunk_pages(docs: DataFrame, size: int = MAX_CHARS, paragraphs: str = r"\n{2,}", overlap: int = 0) -> DataFrame:
    """(chunk_id, document_id, title, document_number, issue_date, category, page_number, chunk_number, text) of catalogue
    rows. overlap is accepted and has no effect."""
    keep = ("id", "title", "document_number", "issue_date", "category")
    text = F.coalesce(F.nullif("cleaned_text", F.lit("")), F.col("raw_text"))
    rows = explode_pages(docs, *keep).select(*keep, "page_number", F.posexplode(chunk_texts(text, size, paragraphs)).alias("n", "text"))
    number = F.col("n") + 1
    return rows.select(F.concat(F.col("id").cast("string"), F.lit("_p"), F.col("page_number").cast("string"), F.lit("_c"), number.cast("string")).alias("chunk_id"), F.col("id").alias("document_id"), "title", "document_number", "issue_date", "category", "page_number", number.alias("chunk_number"), "text")


def embed_chunks(chunks: DataFrame, embed: Callable[[list[str]], list[list[float] | None]], model: str, batch: int = 64) -> DataFrame:
    """chunks with embedding and model by a caller's function over batches of texts; a batch that raises is tried text by
    text, and what fails has a null embedding."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(text: str) -> list[float] | None:
            try:
                return embed([text])[0]
            except Exception:  # noqa: BLE001  a caller's function: its failure is a row without vector
                return None

        for pdf in frames:
            out: list[list[float] | None] = []
            for i in range(0, len(pdf), batch):
                texts = pdf["_input"].iloc[i : i + batch].tolist()
                try:
                    out += embed(texts)
                except Exception:  # noqa: BLE001
                    out += [one(t) for t in texts]
            yield pdf.drop(columns="_input").assign(embedding=out)

    given = chunks.withColumn("_input", embedding_input(F.col("title"), F.col("category"), F.col("page_number"), F.col("text")))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields]
    return given.mapInPandas(run, ", ".join([*fields, "embedding array<float>"])).withColumn("model", F.lit(model))


def embedded(chunks: DataFrame) -> DataFrame:
    """The rows that got a vector."""
    return chunks.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))


def embedding_failures(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n_chunks"), F.count_if(F.col("embedding").isNull()).alias("failed"))


def replace_vectors(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with all chunks of the new rows' documents replaced by the new rows."""
    return index.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new, allowMissingColumns=True)


def replace_vectors_in_place(index: Buckets, new: DataFrame) -> None:
    """replace_vectors() on a stored index (buckets by document_id): other documents' buckets keep their files."""
    new = stored(new, "new-vectors")
    index.change(new.select("document_id"), lambda rows: replace_vectors(rows, new))
