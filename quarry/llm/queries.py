"""The queries of this subpackage, each over its whole tables, with their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import align, chat_format, decontaminate, filter_audit, mixing, ngram_join, quality_classifier, quality_rules, secret_scan, token_counts, toxicity, url_filters, warc
from quarry.llm.common import read

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _op10(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    return token_counts.op10_token_counts(read(spark, d, "documents"), public_tokenizers.path(TOKENIZER))


def _op12(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    return align.op12_token_alignment(read(spark, d, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": lambda s, d: quality_rules.op1_quality_rules(read(s, d, "documents")),
        "op2_ngram_jaccard": lambda s, d: ngram_join.op2_ngram_jaccard(read(s, d, "documents")),
        "op3_warc": lambda s, d: warc.op3_warc(read(s, d, "pages")),
        "op4_mixing": lambda s, d: mixing.op4_mixing(read(s, d, "documents")),
        "op5_quality_classifier": lambda s, d: quality_classifier.op5_quality_classifier(read(s, d, "documents"), read(s, d, "labels")),
        "op6_secret_scan": lambda s, d: secret_scan.op6_secret_scan(read(s, d, "documents")),
        "op7_chat_format": lambda s, d: chat_format.op7_chat_format(read(s, d, "conversations")),
        "op8_decontamination": lambda s, d: decontaminate.op8_decontamination(read(s, d, "documents"), read(s, d, "benchmark")),
        "op9_toxicity": lambda s, d: toxicity.op9_toxicity(read(s, d, "documents"), read(s, d, "labels")),
        "op10_token_counts": _op10,
        "op11_url_filters": lambda s, d: url_filters.op11_url_filters(read(s, d, "pages")),
        "op12_token_alignment": _op12,
        "op13_filter_audit": lambda s, d: filter_audit.op13_filter_audit(read(s, d, "documents"), read(s, d, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.ORACLE.replace("{docs}", "documents"),
        "op2_ngram_jaccard": ngram_join.ORACLE.replace("{docs}", "documents"),
        "op3_warc": warc.ORACLE.replace("{pages}", "pages"),
        "op4_mixing": mixing.ORACLE.replace("{docs}", "documents"),
        "op8_decontamination": decontaminate.ORACLE.replace("{docs}", "documents").replace("{items}", "benchmark"),
        "op11_url_filters": url_filters.ORACLE.replace("{pages}", "pages"),
        "op13_filter_audit": filter_audit.ORACLE.replace("{docs}", "documents").replace("{labels}", "labels"),
    }
