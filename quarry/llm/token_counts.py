"""Token counts with a digest cache.

The cache is a table of (digest, tokenizer, n_tokens): digest is the SHA-256 of a text, tokenizer the SHA-256 of the
tokenizer's file. Contents are joined to it, only distinct misses are encoded, and these are appended. Copies are
folded before the shuffle, so a text that a third of the rows hold is encoded once. A cache may hold a digest twice, where
an append was retried or two runs met: it is read by distinct digest.

A byte-level tokenizer's tokens never cross the pieces that its pattern makes, so within a task each distinct piece is
encoded once by the library and remembered; texts for which that isn't certain are encoded as they are.

Edge cases: a null text counts as the empty text. Whole texts are encoded, in batches of bounded characters. Repeated
rows each get a row. An empty table gives an empty result. Extra columns pass, added names replace theirs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, text_of, written

#: Characters encoded at once, however many texts that is; a longer text is a batch of its own.
BATCH_CHARS = 500_000
CACHE = "digest string, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """SHA-256 of a tokenizer's file, which is part of the environment of driver and executors alike."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _counter(path: str):
    """A function from texts to token counts: library tokenizers for .json, sentencepiece for .model."""
    if path.endswith(".json"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        whole = lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        return _by_piece(whole, [x["content"] for x in spec["added_tokens"]]) if _splits_at_pieces(spec) else whole
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(e) for e in p.encode(texts, num_threads=1)]


# The pieces that a byte-level pre-tokenizer with its own pattern makes, none of which a token crosses.
PIECE = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Characters whose classes are the same in all versions of Unicode; a text with others is encoded as a whole.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\u00a1-\u024f]*")
MOST_PIECES = 500_000


def _splits_at_pieces(spec: dict) -> bool:
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model.get("type") == "BPE" and not model.get("dropout")


def _by_piece(whole, added: list[str]):
    """Counts by piece: the library encodes each piece once per task, and its count is kept. Texts that hold an added
    token, or characters that aren't plain, are left to the library as they are."""
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        pieces = [PIECE.findall(t) if PLAIN.fullmatch(t) and not any(a in t for a in added) else None for t in texts]
        if len(known) > MOST_PIECES:
            known.clear()
        new = list({p for ps in pieces if ps for p in ps if p not in known})
        known.update(zip(new, whole(new), strict=True))
        odd = iter(whole([t for t, ps in zip(texts, pieces, strict=True) if ps is None]))
        return [next(odd) if ps is None else sum(map(known.__getitem__, ps)) for ps in pieces]

    return count


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for b in batches:
            sizes, texts, held = [], [], 0
            for s in b.column("_text"):
                texts.append(t := s.as_py())
                held += len(t)
                if held >= BATCH_CHARS:
                    sizes += count(texts)
                    texts, held = [], 0
            sizes += count(texts) if texts else []
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(sizes, pa.int64())], names=["digest", "n_tokens"])

    return run


def encode_misses(docs: DataFrame, cache: DataFrame | None, path: str, text: str = "text") -> DataFrame:
    """Cache rows for the distinct contents that the cache lacks for this tokenizer."""
    version = tokenizer_version(path)
    t = text_of(text)
    texts = docs.select(F.sha2(t.cast("binary"), 256).alias("digest"), t.alias("_text")).groupBy("digest").agg(F.first("_text").alias("_text"))
    if cache is not None:
        texts = texts.join(cache.where(F.col("tokenizer") == version).select("digest"), "digest", "left_anti")
    return texts.mapInArrow(_encode(path), "digest string, n_tokens long").select("digest", F.lit(version).alias("tokenizer"), "n_tokens")


def token_counts(docs: DataFrame, path: str, cache_path: str | None = None, text: str = "text") -> DataFrame:
    """Adds digest, n_bytes and n_tokens. cache_path: an existing cache, appended to; without one a new one is written."""
    spark = docs.sparkSession
    bound_batches(spark)
    if cache_path is None:
        cache = written(encode_misses(docs, None, path, text), "token-cache")
    else:
        encode_misses(docs, spark.read.parquet(cache_path), path, text).write.mode("append").parquet(cache_path)
        cache = spark.read.parquet(cache_path)
    t = text_of(text)
    counts = cache.where(F.col("tokenizer") == tokenizer_version(path)).select("digest", "n_tokens").dropDuplicates(["digest"])
    out = docs.drop("n_tokens").withColumn("digest", F.sha2(t.cast("binary"), 256)).withColumn("n_bytes", F.octet_length(t).cast("long"))
    return out.join(counts, "digest", "left")


def op10_token_counts(docs: DataFrame, path: str) -> DataFrame:
    return token_counts(docs.select("doc_id", "text"), path).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
