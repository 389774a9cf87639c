"""Queries over a sheet's editor, document edits and a replica's log, on tables made into cells, edits and ops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import edits, oplog, sheetops
from ..sources import office
from .registry import query, table


def _q(name: str, sql: str, make) -> None:
    query(sql, name)(make)


def _cells(spark: SparkSession, d: str) -> DataFrame:
    value = F.expr("case event_id % 4 when 0 then event_type when 1 then '' when 2 then concat(' ', cast(event_id as string), ' ') else cast(user_id as string) end")
    return table(spark, d, "events").select((F.col("user_id") % 5).cast("string").alias("sheet"), F.col("event_id").alias("row"), F.lit(0).alias("col"), value.alias("value"))


_CELLS = "(SELECT CAST(user_id % 5 AS VARCHAR) AS sheet, event_id AS row, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN '' WHEN 2 THEN ' ' || event_id || ' ' ELSE CAST(user_id AS VARCHAR) END AS value FROM events)"
_q("sheet_aggregates", f"WITH n AS (SELECT sheet, TRY_CAST(trim(value) AS DOUBLE) AS n FROM {_CELLS}) SELECT sheet, sum(n) AS sum, round(avg(n), 6) AS average, count(n) AS count, min(n) AS min, max(n) AS max FROM n GROUP BY 1",
    lambda s, d: sheetops.range_aggregates(_cells(s, d)).withColumn("average", F.round("average", 6)))
_q("sheet_aggregates_no_numbers", f"SELECT sheet, 0::DOUBLE AS sum, NULL::DOUBLE AS average, 0::BIGINT AS count, 0::DOUBLE AS min, 0::DOUBLE AS max FROM {_CELLS} WHERE row % 4 < 2 GROUP BY 1", lambda s, d: sheetops.range_aggregates(_cells(s, d).where("row % 4 < 2")))
_q("editor_arithmetic", "WITH l AS (SELECT l_orderkey, l_linenumber AS a, CAST(l_quantity AS INT) AS b FROM lineitem) SELECT l_orderkey, a AS l_linenumber, CASE WHEN a <> 3 THEN floor(((a + b) * 3 - b / (a - 3)::DOUBLE) * 1e10 + 0.5) / 1e10 END AS v FROM l",
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", sheetops.evaluate_arithmetic(F.expr("concat('(', l_linenumber, ' + ', cast(l_quantity as int), ')*3-', cast(l_quantity as int), '/(', l_linenumber, '-3')")).alias("v")))
_q("sheet_find", f"SELECT sheet, row FROM {_CELLS} WHERE contains(lower(value), 'r')", lambda s, d: sheetops.find_cells(_cells(s, d), "R").select("sheet", "row"))
_q("sheet_replace", f"SELECT row, regexp_replace(value, 'C', '$1.', 'gi') AS value, regexp_matches(value, '[cC]') AS changed FROM {_CELLS}", lambda s, d: sheetops.replace_cells(_cells(s, d), "C", "$1.").select("row", "value", "changed"))


def _copied(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    formula = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("=A"), "c_custkey"))
    style = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment"))
    return c.select(F.col("c_custkey").alias("row"), F.lit(1).alias("col"), F.col("c_nationkey").alias("value"), formula.alias("formula"), style.alias("style"))


_q("paste_values", "SELECT c_custkey + 10 AS row, 6 AS col, CAST(c_nationkey AS VARCHAR) AS value FROM customer", lambda s, d: sheetops.paste(_copied(s, d), "values", 10, 5))
_q("paste_formulas", "SELECT c_custkey + 10 AS row, 6 AS col, CASE WHEN c_custkey % 2 = 0 THEN '=A' || c_custkey ELSE CAST(c_nationkey AS VARCHAR) END AS value FROM customer", lambda s, d: sheetops.paste(_copied(s, d), "formulas", 10, 5))
_q("paste_formatting", "SELECT c_custkey + 10 AS row, 6 AS col, c_mktsegment AS style FROM customer WHERE c_custkey % 3 = 0", lambda s, d: sheetops.paste(_copied(s, d), "formatting", 10, 5))
_q("paste_transpose", "SELECT 11 AS row, c_custkey + 5 AS col, CASE WHEN c_custkey % 2 = 0 THEN '=A' || c_custkey ELSE CAST(c_nationkey AS VARCHAR) END AS value FROM customer", lambda s, d: sheetops.paste(_copied(s, d), "transpose", 10, 5))
_q("fill_formulas", "SELECT c_custkey, '=A' || n || '*$B$1+C$2' AS formula FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer)", lambda s, d: sheetops.fill_formulas(table(s, d, "customer").select("c_custkey"), ["c_custkey"], "=A1*$B$1+C$2"))


def _sheet_ops(spark: SparkSession, d: str) -> DataFrame:
    action = F.when(F.col("event_id") % 5 == 0, "ssFormat").otherwise("ssSetCell")
    value = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("event_id").cast("string"))
    style = F.when(F.col("event_id") % 5 == 0, F.create_map("event_type", F.col("event_id").cast("string")))
    return table(spark, d, "events").select(F.lit("d").alias("doc_id"), F.col("event_id").alias("arrival"), action.alias("action"), F.lit("s").alias("sheet"), (F.col("user_id") % 20).alias("row"), (F.col("event_id") % 3).alias("col"), value.alias("value"), style.alias("style"))


_q("sheet_shared_edits", """
    WITH o AS (SELECT event_id, event_id % 5 = 0 AS fmt, user_id % 20 AS row, event_id % 3 AS col, CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS value, event_type FROM events),
    b AS (SELECT row, col, max(event_id) AS at, arg_max(value, event_id) AS value FROM o WHERE NOT fmt GROUP BY 1, 2),
    f AS (SELECT o.row, o.col, count(DISTINCT event_type) AS n FROM o LEFT JOIN b USING (row, col) WHERE fmt AND event_id > coalesce(b.at, -1) GROUP BY 1, 2)
    SELECT row, col, coalesce(b.value, '') AS value, CAST(coalesce(f.n, 0) AS INT) AS styles FROM b FULL JOIN f USING (row, col) WHERE f.n IS NOT NULL OR coalesce(b.value, '') <> ''""",
    lambda s, d: sheetops.shared_sheet(_sheet_ops(s, d)).select("row", "col", "value", F.size("style").alias("styles")))

# --- edits of documents: each message is a paragraph put first; every third transaction is bad, odd conversations undo the last good one

_q("edited_documents", """
    WITH k AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE turn % 3 <> 2), g AS (SELECT * FROM k WHERE conv_id % 2 = 0 OR n > 1)
    SELECT CAST(conv_id AS VARCHAR) AS doc_id, 'p' || turn AS node_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS INT) AS pos, 'Paragraph' AS type, '' AS text FROM g
    UNION ALL SELECT CAST(conv_id AS VARCHAR), 't' || turn, 0, 'Text', coalesce(text, '') || '!' FROM g""",
    lambda s, d: edits.edited_documents(_transactions(s, d)).where("type in ('Paragraph', 'Text')").select("doc_id", "node_id", "pos", "type", "text"))


def _transactions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), "conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    t = F.col("turn").cast("string")
    node = lambda prefix, kind, parent, kids: F.struct(F.concat(F.lit(prefix), t).alias("id"), F.lit(kind).alias("type"), (F.concat(F.lit(parent), t) if parent else F.lit("body")).alias("parent"), (F.array(F.concat(F.lit(kids), t)) if kids else F.array().cast("array<string>")).alias("kids"))
    nodes = F.array(node("p", "Paragraph", "", "r"), node("r", "Run", "p", "t"), node("t", "Text", "r", ""))
    insert = F.to_json(F.struct(F.lit("InsertNode").alias("kind"), F.lit("body").alias("parent"), F.lit(0).alias("index"), nodes.alias("nodes")))
    write = F.to_json(F.struct(F.lit("InsertText").alias("kind"), F.concat(F.lit("t"), t).alias("target"), F.lit(0).alias("offset"), F.concat("text", F.lit("!")).alias("text")))
    bad = F.when(F.col("turn") % 3 == 2, ',{"kind":"DeleteNode","target":"nowhere"}').otherwise("")
    runs = c.select("doc_id", (F.col("turn") + 1).alias("seq"), F.lit("run").alias("action"), F.concat(F.lit("["), insert, F.lit(","), write, bad, F.lit("]")).alias("ops"))
    body = '[{"kind":"InsertNode","parent":"root","index":0,"nodes":[{"id":"body","type":"Body"}]}]'
    begin = c.select("doc_id").distinct().select("doc_id", F.lit(0).cast("long").alias("seq"), F.lit("run").alias("action"), F.lit(body).alias("ops"))
    good = c.where("conv_id % 2 = 1 and turn % 3 <> 2").select("doc_id").distinct()
    undo = good.select("doc_id", F.lit(10**6).cast("long").alias("seq"), F.lit("undo").alias("action"), F.lit(None).cast("string").alias("ops"))
    return runs.unionByName(begin).unionByName(undo)


# --- a replica's log

_q("stamp_local", "SELECT conv_id AS doc_id, turn AS seq, CAST(coalesce(sum(greatest(coalesce(length(text), 1), 1)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + conv_id % 2 * 100 + 1 AS BIGINT) AS lamport FROM conversations",
    lambda s, d: oplog.stamp_local(table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("replica"), F.col("turn").alias("seq"), F.col("text").alias("value")),
                                   table(s, d, "conversations").where("conv_id % 2 = 1").select(F.col("conv_id").alias("doc_id"), F.lit(9).alias("replica"), F.lit(100).cast("long").alias("lamport")).distinct()).select("doc_id", "seq", "lamport"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Events as letters that their user types one after the other into a document of their own; every fourth op deletes instead."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    kind = F.when(F.col("event_id") % 4 == 0, "DeleteText").otherwise("InsertText")
    return table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.lit("n").alias("target"), kind.alias("kind"), F.lit(1).alias("replica"), n.alias("lamport"), F.substring("event_type", 1, 1).alias("value"), (n - 1).alias("offset"))


_LOG = "(SELECT user_id AS doc_id, event_id % 4 = 0 AS gone, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS lamport, substring(event_type, 1, 1) AS value, count(*) OVER (PARTITION BY user_id) AS size FROM events)"
_COMPACT = f"""
    WITH o AS (SELECT * FROM {_LOG}), i AS (SELECT *, lamport - row_number() OVER (PARTITION BY doc_id ORDER BY lamport) AS run FROM o WHERE NOT gone AND size >= 8),
    c AS (SELECT doc_id, min(lamport) AS lamport, string_agg(value, '' ORDER BY lamport) AS value FROM i GROUP BY doc_id, run UNION ALL SELECT doc_id, lamport, value FROM o WHERE gone OR size < 8)"""
_q("log_compacted", f"{_COMPACT} SELECT * FROM c", lambda s, d: oplog.compacted(_log(s, d), 8).select("doc_id", "lamport", "value"))
_q("compression_ratio", f"{_COMPACT} SELECT doc_id, count(c.lamport) / any_value(n) AS ratio FROM c JOIN (SELECT doc_id, count(*) AS n FROM o GROUP BY 1) USING (doc_id) GROUP BY 1", lambda s, d: oplog.compression_ratio(_log(s, d), oplog.compacted(_log(s, d), 8)))
_q("fork", f"SELECT 'copy' AS doc_id, lamport FROM {_LOG} WHERE doc_id = 7", lambda s, d: oplog.fork(_log(s, d).withColumn("doc_id", F.col("doc_id").cast("string")), "7", "copy").select("doc_id", "lamport"))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    kind = F.expr("case event_id % 4 when 0 then 'RemoveStyle' when 1 then 'SetStyle' else 'SetMetadata' end")
    e = table(spark, d, "events")
    return e.select(F.lit("d").alias("doc_id"), F.lit(1).alias("replica"), F.col("event_id").alias("lamport"), kind.alias("kind"), F.lit(None).cast("string").alias("target"), F.concat(F.lit("k"), F.col("user_id") % 30).alias("key"), F.expr("case when event_id % 6 <> 2 then cast(event_id as string) end").alias("value"), F.lit(None).cast("long").alias("left_lamport"), F.lit(None).cast("long").alias("left_replica"))


_MIXED = "(SELECT event_id, event_id % 4 AS k, 'k' || (user_id % 30) AS key, CASE WHEN event_id % 6 <> 2 THEN CAST(event_id AS VARCHAR) END AS value FROM events)"
_q("resolver_metadata", f"SELECT key, value FROM (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY event_id DESC) AS n FROM {_MIXED} WHERE k > 1) WHERE n = 1 AND value IS NOT NULL", lambda s, d: oplog.resolve(_mixed(s, d))["metadata"].select("key", "value"))
_q("resolver_styles", f"SELECT key, value FROM (SELECT key, value, k, row_number() OVER (PARTITION BY key ORDER BY event_id DESC) AS n FROM {_MIXED} WHERE k < 2) WHERE n = 1 AND k = 1", lambda s, d: oplog.resolve(_mixed(s, d))["styles"].select("key", "value"))
_q("registered_hooks", "SELECT event_id AS seq, user_id AS id FROM events e WHERE event_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM events r WHERE r.event_id % 3 = 0 AND r.user_id = e.user_id AND r.event_id > e.event_id)",
    lambda s, d: oplog.registered_hooks(table(s, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "remove").otherwise("register").alias("action"), F.col("user_id").alias("id"))))
_q("preserved_parts", "SELECT CAST(item_id AS VARCHAR) AS path, 'word/document.xml' AS name FROM benchmark",
    lambda s, d: office.preserved_parts(office.export_documents(table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("path"), F.lit(0).alias("ord"), F.lit("paragraph").alias("kind"), F.lit(0).alias("level"), "text"), "docx")).where("name like 'word/doc%'").select("path", "name"))
