"""A cleaning pipeline over `documents`: five stages, each an operator, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sheetwright.llm import bpe_codec, decontaminate, ngram_jaccard, suffix_dedup, toxicity
from sheetwright.llm.common import materialize, swept


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more for toxicity go; labels of two thirds of the ids teach the score."""
    labels = toxicity.learned_rows(spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", 3, 1)
    return toxicity.with_toxicity(docs, labels, threshold=0.7, names=("_toxicity", "_toxic")).where("_toxic = 0").drop("_toxicity", "_toxic")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by five-word shingles at a Jaccard similarity of 0.8 or more, the one of the smallest id stays."""
    return ngram_jaccard.one_per_group(docs, words=5, num=80, den=100)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a 100-byte string that also starts earlier go; a document that loses all of its text goes."""
    return suffix_dedup.without_repeats(docs, length=100)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's five-word shingles go."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=5, num=80, den=100)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids are little-endian unsigned 32-bit integers."""
    return bpe_codec.bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("bpe_codec", encode),
]

#: Viterbi decoding, learned scores, suffix sorting and BPE are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each one's result written to the shared folder and read again; only the last table stays there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with swept(spark) as kept:
        for name, stage in STAGES:
            with swept(spark) as own:
                docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
                own.append(docs)
        kept.append(docs)
    return docs
