"""The registered queries of this subpackage, thin: a table goes through its operator, the contract's columns come out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, nearest, ngram_jaccard


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(modulus: int, remainder: int) -> Column:
    return (F.crc32(F.col("doc_id").cast("string")) % modulus == remainder).alias("held_out")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(_table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=5, num=80, den=100)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.formatted(_table(spark, sf_dir, "conversations"))


def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3 on calls and results that are made of the messages, since the given tables hold none."""
    return chat_format.formatted(*chat_format.as_tool_calls(_table(spark, sf_dir, "conversations")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learned_rows, with_toxicity

    labels = learned_rows(_table(spark, sf_dir, "labels"), "toxic", 3, 1)
    out = with_toxicity(_table(spark, sf_dir, "documents").select("doc_id", "text"), labels, threshold=0.7)
    return out.select("doc_id", _held_out(3, 1), "score", "predicted")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_codec import bpe_digests

    return bpe_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import with_main_text

    return with_main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_digests

    return repeated_digests(_table(spark, sf_dir, "documents"), length=100)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_mil import with_quality
    from .toxicity import learned_rows

    labels = learned_rows(_table(spark, sf_dir, "labels"), "quality", 5, 0)
    out = with_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"), labels, threshold=0.3)
    return out.select("doc_id", _held_out(5, 0), "score", "predicted")


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_benchmark_decontamination,
        op3_chat_formatting,
        op4_token_counts,
        op5_nearest_neighbours,
        op6_toxicity,
        op7_bpe_codec,
        op8_html_extraction,
        op9_suffix_array_dedup,
        op10_quality_classifier,
        chat_tool_calls,
    )
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_jaccard.ORACLE,
    "op2_benchmark_decontamination": decontaminate.ORACLE,
    "op3_chat_formatting": chat_format.ORACLE,
    "op5_nearest_neighbours": nearest.ORACLE,
    "chat_tool_calls": chat_format.TOOLS_ORACLE,
}
