"""Queries over page tables, pagination, stores and request checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formula import with_formulas
from ..operators import pages, store
from .registry import query, table


def _q(name: str, sql: str | None, make) -> None:
    query(sql, name)(make)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as documents, each turn a page."""
    return table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), F.lit(0).alias("rotation"), F.concat_ws("-", "conv_id", "turn").alias("content"))


_PAGES = "(SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn + 1 AS page_no, conv_id || '-' || turn AS content FROM conversations)"
_q("page_delete", f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS INT) AS page_no, content FROM {_PAGES} WHERE page_no <> 2", lambda s, d: pages.delete_pages(_pages(s, d), [2]).select("doc_id", "page_no", "content"))
_q("page_move", f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE page_no WHEN 1 THEN 3.5 ELSE page_no END) AS INT) AS page_no, content FROM {_PAGES}", lambda s, d: pages.move_page(_pages(s, d), 1, 3).select("doc_id", "page_no", "content"))
_q("page_rotate", f"SELECT content, CASE page_no WHEN 1 THEN 270 ELSE 0 END AS rotation FROM {_PAGES}", lambda s, d: pages.rotate_pages(_pages(s, d), [1], -90).select("content", "rotation"))
_q("page_duplicate", f"SELECT CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS INT) AS page_no, content FROM (SELECT * FROM {_PAGES} UNION ALL SELECT * FROM {_PAGES} WHERE page_no = 1)", lambda s, d: pages.duplicate_page(_pages(s, d), 1).select("page_no", "content"))
_q("page_merge", f"SELECT 'm' AS doc_id, CAST(row_number() OVER (ORDER BY doc_id DESC, page_no) AS INT) AS page_no, content FROM {_PAGES} WHERE doc_id IN ('1', '2')", lambda s, d: pages.merge_documents(_pages(s, d), ["2", "1"], "m").select("doc_id", "page_no", "content"))
_q("redact_text", "SELECT item_id, regexp_replace(text, 'the', '███', 'g') AS text FROM benchmark", lambda s, d: table(s, d, "benchmark").select("item_id", pages.redact(F.col("text"), ["the"]).alias("text")))
_q("paginate_blocks", """
    WITH RECURSIVE b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn, length(text)::DOUBLE AS h FROM conversations),
    p(conv_id, i, turn, page, used) AS (SELECT conv_id, i, turn, 1, h FROM b WHERE i = 1
      UNION ALL SELECT b.conv_id, b.i, b.turn, CASE WHEN p.used > 0 AND p.used + b.h > 1000 THEN p.page + 1 ELSE p.page END, CASE WHEN p.used > 0 AND p.used + b.h > 1000 THEN b.h ELSE p.used + b.h END FROM p JOIN b ON b.conv_id = p.conv_id AND b.i = p.i + 1)
    SELECT conv_id AS doc_id, turn AS ord, CAST(page AS INT) AS page FROM p""",
    lambda s, d: pages.paginate_blocks(table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.char_length("text").alias("height"), F.lit(False).alias("keep_next")), 1000))
_q("doc_table_ranges", """
    WITH e AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events)
    SELECT user_id AS doc_id, n AS first, CASE WHEN n % 5 = 4 OR n + 1 = total THEN n ELSE n + 1 END AS last, CAST(CASE WHEN n % 5 = 4 THEN 1 WHEN n + 1 = total THEN 2 ELSE 3 END AS BIGINT) AS cells FROM e WHERE n % 5 IN (1, 4)""",
    lambda s, d: pages.table_ranges(_marks(s, d)))


def _marks(spark: SparkSession, d: str) -> DataFrame:
    """Events as paragraphs of their user's document; of five the second and third hold cell marks, and the last."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), (F.row_number().over(w) - 1).alias("ord"), "event_type")
    return rows.select("doc_id", "ord", F.expr("concat(event_type, case ord % 5 when 1 then concat(char(7), 'b', char(7)) when 2 then char(7) when 4 then char(7) else '' end)").alias("text"))


_q("safe_filename", r"""SELECT url, CASE WHEN regexp_matches(f, '^\.*$') THEN 'document' ELSE f END AS safe FROM (SELECT url, regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '[<>:"|?*]', '_', 'g') AS f FROM pages)""",
    lambda s, d: table(s, d, "pages").select("url", pages.safe_filename(F.col("url")).alias("safe")))
_q("private_host", "SELECT url, regexp_matches(split_part(split_part(url, '://', 2), '/', 1), '^localhost$|[.](local|internal)$') AS private FROM pages",
    lambda s, d: table(s, d, "pages").select("url", pages.is_private_host(F.col("url")).alias("private")))
_q("private_address", """
    WITH a AS (SELECT event_id, event_id % 256 AS a, (event_id // 256) % 256 AS b FROM events)
    SELECT event_id, a IN (0, 10, 127) AND (a > 0 OR b = 0 AND event_id % 2 = 0) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR a BETWEEN 224 AND 239 OR (a = 192 AND b = 0 AND event_id % 2 = 1) AS private FROM a""",
    lambda s, d: table(s, d, "events").select("event_id", pages.is_private_host(F.expr("concat('http://', event_id % 256, '.', (event_id div 256) % 256, case when event_id % 2 = 0 then '.0.0:80/x' else '.2.7' end)")).alias("private")))
_q("named_ranges", "SELECT o_orderkey, o_totalprice * 1.1 + 5 AS v FROM orders",
    lambda s, d: with_formulas(table(s, d, "orders"), {"v": store.expand_names("=gross+fee", {"gross": "=[o_totalprice]*rate", "rate": "1.1", "fee": "5"})}, errors=False).select("o_orderkey", "v"))
_q("builder_tables_csv", "SELECT 'd' AS doc_id, 'a,\"b,c\"' || chr(10) || '1,2' || chr(10) || chr(10) || 'x' AS text",
    lambda s, d: store.tables_csv(store.Builder("d").heading(1, "T").table([["a", "b,c"], ["1", "2"]]).paragraph("p").items(["i", "j"]).table([["x"]]).build(s)))
_q("cross_sheet_range", "SELECT p_partkey, CAST(p_partkey // 10 AS INT) AS row, CAST(p_partkey % 10 AS INT) AS col FROM part WHERE p_size % 2 = 1 AND p_partkey // 10 BETWEEN 2 AND 99 AND p_partkey % 10 BETWEEN 1 AND 4",
    lambda s, d: store.read_range(table(s, d, "part").selectExpr("p_partkey", "case when p_size % 2 = 1 then 'T' else 'S' end as sheet", "cast(p_partkey div 10 as int) as row", "cast(p_partkey % 10 as int) as col"), "T!$B$3:E100").select("p_partkey", "row", "col"))
