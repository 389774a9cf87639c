"""Registered queries of the library proper, each with its DuckDB oracle."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def put(f: Callable) -> Callable:
        key = name or f.__name__

        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            find_package(spark)
            return f(spark, sf_dir)

        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return f

    return put


def find_package(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it; on a cluster, also ship it with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
SELECT lang, count(*) AS n_docs,
       CAST(sum(len(list_filter(string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+'), lambda w: w <> ''))) AS BIGINT) AS n_words,
       CAST(sum(length(text)) AS BIGINT) AS n_chars,
       CAST(sum(len(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> ''))) AS BIGINT) AS n_paragraphs
FROM documents GROUP BY lang
""")
def doc_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, code points and paragraphs of the documents by language, in one pass with partial sums."""
    d = table(spark, sf_dir, "documents")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    paragraphs = F.size(F.filter(F.split("text", "\n"), lambda p: F.trim(p) != ""))
    return d.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(words).alias("n_words"), F.sum(F.char_length("text")).cast("long").alias("n_chars"), F.sum(paragraphs).alias("n_paragraphs")
    )


def _load() -> None:
    from . import editor, files, pages, scalars, tables, trees_logs  # noqa: F401


_load()
