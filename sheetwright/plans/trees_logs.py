"""Queries over document trees, operation logs, sessions and file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formula import recalculate_frame
from ..operators import doctree, oplog
from ..sources import markup, office
from ..streaming import sessions
from .registry import query, table


def _q(name: str, sql: str | None, make) -> None:
    query(sql, name)(make)


# --- trees: documents as one body with a paragraph a line


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return doctree.from_text(table(spark, d, "documents"), "doc_id", "text")


_LINES = "(SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(string_split(text, chr(10))) AS l, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS i FROM documents)"
_NTH = "(SELECT CAST(user_id AS VARCHAR) AS doc_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS n FROM events)"


def _nth(spark: SparkSession, d: str) -> DataFrame:
    """Events with their place among those of their user."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("doc_id"), "event_id", "event_type", (F.row_number().over(w) - 1).alias("n"))


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """A document a user, a line an event: headings, lists of two levels, page breaks, plain and empty lines in turn."""
    line = F.expr("""concat(case n % 11 when 0 then concat(repeat('#', 1 + n div 11 % 6), ' ') when 3 then '  1. ' when 5 then '- ' when 6 then '' else '1. ' end, event_type, event_id)""")
    lines = _nth(spark, d).select("doc_id", "n", F.expr("n % 11").alias("k"), line.alias("l")).withColumn("l", F.expr("case k when 8 then '---' when 10 then '' else l end"))
    texts = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "l"))), lambda x: x["l"]), "\n").alias("text"))
    return doctree.from_text(texts, "doc_id", "text")


_q("node_type_counts", f"SELECT doc_id, 'Paragraph' AS type, count(*) AS n FROM {_LINES} WHERE l <> '---' GROUP BY 1 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'Body', 1 FROM documents UNION ALL SELECT doc_id, 'PageBreak', count(*) FROM {_LINES} WHERE l = '---' GROUP BY 1",
    lambda s, d: doctree.type_counts(_nodes(s, d)))
_q("plain_text", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(ltrim(regexp_replace(text, '\\n+', chr(10), 'g'), chr(10))) AS h FROM documents",
    lambda s, d: doctree.plain_text(doctree.from_text(table(s, d, "documents"), "doc_id", "text")).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("h")))
_q("headings", f"SELECT doc_id, CAST(1 + n // 11 % 6 AS INT) AS level, event_type || event_id AS text FROM {_NTH} WHERE n % 11 = 0", lambda s, d: doctree.headings(_marked(s, d)).select("doc_id", "level", "text"))
_q("toc_entries", f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INT) AS entry, 'TOC' || (1 + n // 11 % 6) AS style, event_type || event_id AS text FROM {_NTH} WHERE n % 11 = 0 AND n // 11 % 6 < 3", lambda s, d: doctree.toc_entries(_marked(s, d)))
_q("list_counters", f"""
    WITH r AS (SELECT *, n % 11 AS k, sum(CASE WHEN n % 11 IN (0, 6, 8, 10) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM {_NTH})
    SELECT doc_id, '0.' || n AS node_id, CASE WHEN k = 3 THEN 1 ELSE 0 END AS level, CAST(row_number() OVER (PARTITION BY doc_id, run, k = 3 ORDER BY n) AS INT) AS counter FROM r WHERE k IN (1, 2, 3, 4, 7, 9)""",
    lambda s, d: doctree.list_counters(_marked(s, d)))
_q("text_roundtrip", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS h FROM documents",
    lambda s, d: doctree.render_text(doctree.from_text(table(s, d, "documents"), "doc_id", "text")).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("h")))
_q("body_paragraph_count", f"SELECT doc_id, count(*) AS n FROM {_LINES} WHERE l <> '---' GROUP BY 1", lambda s, d: doctree.body_paragraphs(_nodes(s, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
_q("hierarchy_errors", f"SELECT doc_id, '0.' || i AS node_id, 'TableRow' AS type, 'Body' AS parent_type FROM {_LINES} WHERE i % 10 = 3",
    lambda s, d: doctree.hierarchy_errors(_nodes(s, d).withColumn("type", F.expr("case when depth = 1 and pos % 10 = 3 then 'TableRow' else type end"))))

_TURNS = """(SELECT doc_id, node_id, turn, depth, CASE WHEN depth = 1 AND turn % 4 = 1 THEN 'Insert' WHEN depth = 1 AND turn % 4 = 2 THEN 'Delete' WHEN depth = 1 AND turn % 4 = 3 THEN 'FormatChange' END AS kind, role FROM (
    SELECT DISTINCT CAST(conv_id AS VARCHAR) AS doc_id, 'b' AS node_id, -1 AS turn, 0 AS depth, NULL AS role FROM conversations UNION ALL
    SELECT CAST(conv_id AS VARCHAR), 'p' || turn, turn, 1, role FROM conversations UNION ALL SELECT CAST(conv_id AS VARCHAR), 'r' || turn, turn, 2, role FROM conversations))"""


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """A document a conversation, a paragraph with a run a turn; of four paragraphs one is inserted, one deleted and one formatted anew."""
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("turn"), "role")
    change = "case turn % 4 when 1 then map('RevisionType', 'Insert', 'RevisionAuthor', role, 'RevisionDate', '2024') when 2 then map('RevisionType', 'Delete', 'RevisionAuthor', role) when 3 then map('RevisionType', 'FormatChange', 'Bold', '1') else map('Bold', '1') end"
    plain = "cast(map() as map<string,string>)"
    body = c.select("doc_id").distinct().selectExpr("doc_id", "'b' as node_id", "cast(null as string) as parent_id", "0 as pos", "array(0) as path", "0 as depth", "'Body' as type", "cast(null as string) as text", f"{plain} as attrs")
    paragraphs = c.selectExpr("doc_id", "concat('p', turn) as node_id", "'b' as parent_id", "turn as pos", "array(0, turn) as path", "1 as depth", "'Paragraph' as type", "cast(null as string) as text", f"{change} as attrs")
    runs = c.selectExpr("doc_id", "concat('r', turn) as node_id", "concat('p', turn) as parent_id", "0 as pos", "array(0, turn, 0) as path", "2 as depth", "'Run' as type", "role as text", f"{plain} as attrs")
    return body.unionByName(paragraphs).unionByName(runs)


_q("tracked_changes", f"SELECT doc_id, node_id, kind, CASE WHEN kind <> 'FormatChange' THEN role END AS author, CASE WHEN kind = 'Insert' THEN '2024' END AS date FROM {_TURNS} WHERE kind IS NOT NULL", lambda s, d: doctree.tracked_changes(_turns(s, d)))
_q("accept_changes", f"SELECT doc_id, node_id, CASE WHEN depth = 1 AND turn % 4 IN (0, 3) THEN 'Bold' ELSE '' END AS attrs FROM {_TURNS} WHERE turn % 4 <> 2", lambda s, d: doctree.settle_changes(_turns(s, d), True).select("doc_id", "node_id", F.array_join(F.map_keys("attrs"), ",").alias("attrs")))
_q("reject_changes", f"SELECT doc_id, node_id, CASE WHEN depth = 1 AND turn % 4 IN (0, 3) THEN 'Bold' ELSE '' END AS attrs FROM {_TURNS} WHERE turn % 4 <> 1", lambda s, d: doctree.settle_changes(_turns(s, d), False).select("doc_id", "node_id", F.array_join(F.map_keys("attrs"), ",").alias("attrs")))
_q("descendants", f"SELECT doc_id, 'b' AS root_id, node_id FROM {_TURNS} WHERE depth > 0 UNION ALL SELECT doc_id, 'p' || turn, node_id FROM {_TURNS} WHERE depth = 2 AND turn % 2 = 0",
    lambda s, d: doctree.within(_turns(s, d), _turns(s, d).where("depth = 0 or depth = 1 and pos % 2 = 0").select("doc_id", F.col("node_id").alias("root_id"))).select("doc_id", "root_id", "node_id"))
_q("is_descendant", f"""SELECT doc_id, node_id, 'p1' AS ancestor_id, depth = 2 AND turn = 1 AS below FROM {_TURNS} UNION ALL SELECT doc_id, node_id, 'b', depth > 0 FROM {_TURNS} UNION ALL SELECT doc_id, node_id, 'gone', false FROM {_TURNS}""",
    lambda s, d: doctree.is_descendant(_turns(s, d), _turns(s, d).select("doc_id", "node_id", F.explode(F.array(*map(F.lit, ("p1", "b", "gone")))).alias("ancestor_id"))))
_q("ancestors_recursive", "SELECT a.conv_id AS doc_id, a.turn AS node_id, b.turn AS ancestor_id, CAST(a.turn - b.turn AS INT) AS distance FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn",
    lambda s, d: doctree.ancestors(table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("node_id"), F.expr("case when turn > 0 then turn - 1 end").alias("parent_id"))))
_q("selection_range", f"SELECT doc_id, node_id FROM {_TURNS} WHERE turn BETWEEN 1 AND 3 AND (depth = 2 OR turn > 1)", lambda s, d: doctree.selection(_turns(s, d), [0, 1, 0], [0, 3, 0]).select("doc_id", "node_id"))
_q("style_resolution", "SELECT a.n_nationkey AS style_id, 'k' || (b.n_nationkey % 3) AS key, arg_max(b.n_name, b.n_nationkey) AS value FROM nation a JOIN nation b ON b.n_nationkey <= a.n_nationkey GROUP BY 1, 2",
    lambda s, d: doctree.resolve_styles(table(s, d, "nation").select(F.col("n_nationkey").alias("style_id"), F.expr("case when n_nationkey > 0 then n_nationkey - 1 end").alias("parent_id"), F.create_map(F.concat(F.lit("k"), F.col("n_nationkey") % 3), "n_name").alias("attrs"))).select("style_id", F.explode("attrs").alias("key", "value")))
_q("attr_merge", "SELECT event_id, unnest(['a', 'b', 'c'][1:2 + event_id % 2]) AS k, unnest([event_type, CAST(event_id AS VARCHAR), event_type || '!'][1:2 + event_id % 2]) AS v FROM events",
    lambda s, d: table(s, d, "events").select("event_id", F.explode(doctree.merge_attrs(F.expr("map('a', event_type, 'b', cast(user_id as string))"), F.expr("map_filter(map('b', cast(event_id as string), 'c', case when event_id % 2 = 1 then concat(event_type, '!') end), (k, v) -> v is not null)"))).alias("k", "v")))
_q("comment_threads", "SELECT conv_id AS doc_id, turn AS comment_id, CASE WHEN turn > 0 THEN 0 END AS parent_id, CASE WHEN turn = 0 THEN count(*) FILTER (turn > 0) OVER (PARTITION BY conv_id) ELSE 0 END AS replies FROM conversations",
    lambda s, d: doctree.comment_threads(_comments(s, d)))
_q("numbering_override", "SELECT c_custkey, c_nationkey AS num_id, c_custkey % 3 AS level, CASE WHEN c_nationkey % 4 = 0 AND c_custkey % 3 = 1 THEN 'roman' ELSE ['decimal', 'alpha', 'bullet'][c_custkey % 3 + 1] END AS format FROM customer",
    lambda s, d: doctree.numbering(table(s, d, "customer").selectExpr("c_custkey", "c_nationkey as num_id", "c_custkey % 3 as level"), _levels(s, d), _levels(s, d).where("num_id % 4 = 0 and level = 1").withColumn("format", F.lit("roman"))))
_q("block_change_detection", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, text FROM documents WHERE doc_id % 7 = 0) GROUP BY 1",
    lambda s, d: _changed(s, d))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("num_id"), F.posexplode(F.array(*map(F.lit, ("decimal", "alpha", "bullet")))).alias("level", "format"))


def _comments(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as comments: each turn after the first replies to it."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("comment_id"), F.expr("case when turn > 0 then 0 end").alias("parent_id"))


def _changed(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose content hash is not in the earlier snapshot, in which those divisible by seven read otherwise."""
    docs = table(spark, d, "documents")
    old = docs.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    h = lambda df: df.select("doc_id", F.xxhash64("text").alias("h"))
    return h(docs).join(h(old), ["doc_id", "h"], "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


# --- operation logs: events as ops


def _ops(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.when(F.col("event_id") % 5 == 0, "RemoveAttributes").otherwise("SetAttributes")
    return e.select(F.lit("doc").alias("doc_id"), (F.col("user_id") % 5).alias("replica"), F.col("event_id").alias("lamport"), kind.alias("kind"), (F.col("user_id") % 50).cast("string").alias("target"), F.col("event_type").alias("key"), F.col("value").cast("string").alias("value"), F.col("ts").alias("arrival"))


_OPS = "(SELECT 'doc' AS doc_id, user_id % 5 AS replica, event_id AS lamport, CASE WHEN event_id % 5 = 0 THEN 'RemoveAttributes' ELSE 'SetAttributes' END AS kind, CAST(user_id % 50 AS VARCHAR) AS target, event_type AS key, value, ts AS arrival FROM events)"


def _sv(spark: SparkSession, d: str) -> DataFrame:
    return oplog.state_vector(_ops(spark, d).where("lamport % 3 = 0 and replica <> 4"))


_SV = f"(SELECT doc_id, replica, max(lamport) AS seen FROM {_OPS} WHERE lamport % 3 = 0 AND replica <> 4 GROUP BY ALL)"
_q("lww_metadata", f"SELECT key, arg_max(lamport, struct_pack(l := lamport, r := replica)) AS lamport FROM {_OPS} GROUP BY key", lambda s, d: oplog.last_writer(_ops(s, d), ["key"], "lamport"))
_q("lww_attr_remove", f"SELECT doc_id, target, key, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, target, key ORDER BY lamport DESC, replica DESC) AS n FROM {_OPS}) WHERE n = 1 AND kind = 'SetAttributes' GROUP BY ALL",
    lambda s, d: oplog.attributes(_ops(s, d)).groupBy("doc_id", "target", "key").agg(F.count(F.lit(1)).alias("n")))
_q("changes_since", f"SELECT o.replica, o.lamport FROM {_OPS} o LEFT JOIN {_SV} v USING (doc_id, replica) WHERE o.lamport > coalesce(v.seen, 0)", lambda s, d: oplog.changes_since(_ops(s, d), _sv(s, d)).select("replica", "lamport"))
_q("sv_merge", f"SELECT doc_id, replica, max(lamport) AS lamport FROM {_OPS} WHERE (lamport % 3 = 0 AND replica <> 4) OR lamport % 7 = 0 GROUP BY ALL", lambda s, d: oplog.merge_vectors(_sv(s, d), oplog.state_vector(_ops(s, d).where("lamport % 7 = 0"))))
_q("sv_diff", f"SELECT a.doc_id, a.replica, coalesce(seen, 0) AS from_lamport, a.m AS to_lamport FROM (SELECT doc_id, replica, max(lamport) AS m FROM {_OPS} GROUP BY ALL) a LEFT JOIN {_SV} v USING (doc_id, replica) WHERE m > coalesce(seen, 0)", lambda s, d: oplog.vector_diff(oplog.state_vector(_ops(s, d)), _sv(s, d)))
_q("sv_dominates", "SELECT 'doc' AS doc_id, 'dominates' AS relation", lambda s, d: oplog.compare_vectors(oplog.state_vector(_ops(s, d)), _sv(s, d)))
_q("op_redelivery", f"SELECT count(*) AS n FROM {_OPS}", lambda s, d: oplog.once(_ops(s, d).unionAll(_ops(s, d))).agg(F.count(F.lit(1)).alias("n")))
_TYPED = [("d", 1, 1, "InsertText", "n", "ab", 0, None, None), ("d", 1, 3, "InsertText", "n", "c", 2, 2, 1), ("d", 1, 4, "InsertText", "n", "é", 3, 3, 1), ("d", 1, 5, "InsertText", "n", "f", 4, 4, 1), ("d", 1, 6, "InsertText", "n", "g", 5, 1, 1), ("d", 2, 6, "InsertText", "n", "z", 0, None, None)]
_q("op_compress", "SELECT * FROM (VALUES (1, 1, 0, 3, 'abcé'), (1, 5, 4, 1, 'f'), (1, 6, 5, 1, 'g'), (2, 6, 0, 1, 'z')) AS t(replica, lamport, \"offset\", merged, value)",
    lambda s, d: oplog.compress(s.createDataFrame(_TYPED, "doc_id string, replica int, lamport int, kind string, target string, value string, offset int, left_lamport int, left_replica int")).select("replica", "lamport", "offset", "merged", "value"))
_q("op_compress_events", """
    WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, substring(event_type, 1, 1) AS c, event_id % 4 <> 0 AS goes FROM events),
    r AS (SELECT *, sum(CASE WHEN goes AND n > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n) AS run FROM e)
    SELECT user_id AS replica, min(n) AS lamport, count(*) AS merged, string_agg(c, '' ORDER BY n) AS value FROM r GROUP BY user_id, run""",
    lambda s, d: oplog.compress(_typed(s, d)).select("replica", "lamport", "merged", "value"))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """Events as letters that their user types one after the other; every fourth one stands elsewhere."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    rows = table(spark, d, "events").select(F.lit("d").alias("doc_id"), F.lit("n").alias("target"), F.lit("InsertText").alias("kind"), F.col("user_id").alias("replica"), n.alias("lamport"), F.substring("event_type", 1, 1).alias("value"), (n - 1).alias("offset"), "event_id")
    return rows.withColumn("left_lamport", F.expr("case when event_id % 4 <> 0 then lamport - 1 end")).withColumn("left_replica", F.col("replica"))


_q("tombstone_gc", f"SELECT o.replica, o.lamport FROM {_OPS} o JOIN (SELECT replica, min(m) AS low FROM (SELECT replica, max(lamport) AS m FROM {_OPS} WHERE lamport % 3 = 0 GROUP BY 1 UNION ALL SELECT replica, max(lamport) FROM {_OPS} WHERE lamport % 2 = 0 GROUP BY 1) GROUP BY 1) v USING (replica) WHERE kind = 'RemoveAttributes' AND o.lamport <= low",
    lambda s, d: oplog.collectable(_ops(s, d).where("kind = 'RemoveAttributes'"), _peers(s, d)).select("replica", "lamport"))


def _peers(spark: SparkSession, d: str) -> DataFrame:
    return oplog.state_vector(_ops(spark, d).where("lamport % 3 = 0")).withColumn("peer", F.lit("a")).unionByName(oplog.state_vector(_ops(spark, d).where("lamport % 2 = 0")).withColumn("peer", F.lit("b")))


_q("gc_excess", f"SELECT lamport FROM {_OPS} WHERE kind = 'RemoveAttributes' ORDER BY lamport DESC, replica DESC OFFSET 50", lambda s, d: oplog.excess(_ops(s, d).where("kind = 'RemoveAttributes'"), 50).select("lamport"))
_q("size_estimate", f"SELECT doc_id, CAST(count(*) * 100 + count(DISTINCT replica) * 16 AS BIGINT) AS bytes FROM {_OPS} GROUP BY 1", lambda s, d: oplog.size_estimate(_ops(s, d)))


def _rooms(spark: SparkSession, d: str) -> DataFrame:
    return oplog.room_versions(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"])


_ROOMS = "(SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events)"
_q("room_versions", f"SELECT event_id, version FROM {_ROOMS}", lambda s, d: _rooms(s, d).select("event_id", "version"))
_q("catch_up", f"SELECT event_id FROM {_ROOMS} WHERE version > 20", lambda s, d: oplog.catch_up(_rooms(s, d), 20).select("event_id"))
_q("retention_1h", f"""
    WITH r AS (SELECT * FROM {_ROOMS} WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 240 HOUR), z AS (SELECT user_id, count(*) AS n, min(version) AS v FROM r GROUP BY 1)
    SELECT event_id FROM r JOIN z USING (user_id) WHERE n <= 20 OR version >= v + 10""",
    lambda s, d: oplog.retained(_rooms(s, d), "user_id", "ts", F.lit(table(s, d, "events").agg(F.max("ts")).first()[0]), 240, 20, 10).select("event_id"))
_q("validate_op", """SELECT event_id, CASE event_id % 8 WHEN 1 THEN 'unknown_type' WHEN 2 THEN 'bad_json' WHEN 3 THEN 'no_type' WHEN 5 THEN 'unknown_action' WHEN 7 THEN 'unknown_type' END AS problem FROM events""",
    lambda s, d: _messages(s, d).select("event_id", oplog.message_errors("body").alias("problem")))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    body = F.expr("""case event_id % 8 when 0 then '{"type":"awareness-batch"}' when 1 then '{"type":"cursor"}' when 2 then '{"type":' when 3 then props when 4 then '{"action":"ssCursor"}'
        when 5 then '{"action":"cursor"}' when 6 then '{"type":5,"action":"insert"}' else '{"type":"leave","action":"op"}' end""")  # fmt: skip
    return table(spark, d, "events").select("event_id", body.alias("body"))


_q("relay_filter", "SELECT m.event_id, p.p AS \"to\" FROM (SELECT event_id, user_id % 3 AS sender, CASE WHEN event_id % 2 = 0 THEN 1 END AS target FROM events) m, (VALUES (0), (1), (2)) AS p(p) WHERE p <> sender AND (target IS NULL OR target = p)",
    lambda s, d: oplog.relay(table(s, d, "events").select("event_id", F.lit("r").alias("room"), (F.col("user_id") % 3).alias("sender"), F.expr("case when event_id % 2 = 0 then 1 end").alias("target")), s.createDataFrame([("r", 0), ("r", 1), ("r", 2)], "room string, peer int")).select("event_id", "to"))
_q("latest_cursor", "SELECT user_id % 5 AS replica, max(event_id) AS seq FROM events GROUP BY 1", lambda s, d: oplog.latest_cursors(table(s, d, "events").select(F.lit("d").alias("doc_id"), (F.col("user_id") % 5).alias("replica"), F.col("event_id").alias("seq"), F.col("props").alias("state"))).select("replica", "seq"))
_q("sheet_last_write", "SELECT CAST(user_id % 10 AS INT) AS row, arg_max(event_id, event_id) AS value FROM events GROUP BY 1",
    lambda s, d: oplog.last_cell_writes(table(s, d, "events").select(F.lit("d").alias("doc_id"), F.lit("s").alias("sheet"), (F.col("user_id") % 10).cast("int").alias("row"), F.lit(0).alias("col"), F.col("event_id").alias("value"), F.col("event_id").alias("arrival"))).select("row", "value"))
_q("text_crdt", "SELECT * FROM (VALUES ('d', 'n', 'heXy')) AS t(doc_id, target, text)", lambda s, d: oplog.converge_text(_crdt(s)))
_q("text_crdt_between", "SELECT * FROM (VALUES ('d', 'n', 'axyc')) AS t(doc_id, target, text)",
    lambda s, d: oplog.converge_text(s.createDataFrame([("d", "n", "InsertText", *r) for r in [(4, 2, 1, 1, 2, 1, "y"), (3, 1, 1, 1, 2, 1, "x"), (2, 1, 1, 1, None, None, "c"), (1, 1, None, None, None, None, "a")]], "doc_id string, target string, kind string, lamport int, replica int, left_lamport int, left_replica int, right_lamport int, right_replica int, value string")))
_q("text_crdt_events", """
    WITH e AS (SELECT user_id, event_id, substring(event_type, 1, 1) AS c FROM events), h AS (SELECT user_id, min(event_id) AS first FROM events GROUP BY 1)
    SELECT CAST(user_id AS VARCHAR) AS doc_id, 'n' AS target, coalesce(string_agg(c, '' ORDER BY CASE WHEN event_id = first THEN 0 WHEN event_id % 3 = 0 THEN -1 ELSE 1 END, CASE WHEN event_id % 3 = 0 THEN -event_id ELSE event_id END) FILTER (event_id % 7 <> 0), '') AS text
    FROM e JOIN h USING (user_id) GROUP BY 1""",
    lambda s, d: oplog.converge_text(_edited(s, d)))
_q("tree_crdt", "SELECT * FROM (VALUES ('a', NULL, 0), ('b', 'c', 0), ('c', 'a', 0), ('f', 'a', 1)) AS t(node_id, parent_id, pos)",
    lambda s, d: oplog.converge_tree(s.createDataFrame([("d", 1, 1, "InsertNode", "a", None), ("d", 1, 2, "InsertNode", "b", "a"), ("d", 2, 3, "InsertNode", "c", "a"), ("d", 1, 4, "MoveNode", "b", "c"), ("d", 2, 5, "MoveNode", "c", "b"), ("d", 2, 6, "InsertNode", "e", "c"), ("d", 1, 7, "DeleteNode", "e", None), ("d", 1, 8, "InsertNode", "f", "a")], "doc_id string, replica int, lamport int, kind string, target string, value string")).select("node_id", "parent_id", "pos"))


def _edited(spark: SparkSession, d: str) -> DataFrame:
    """Events as edits of their user's text: each writes a letter at the end, every third one at the begin; every seventh letter is deleted again."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, d, "events").withColumn("front", F.col("event_id") % 3 == 0).withColumn("first", F.min("event_id").over(Window.partitionBy("user_id")))
    last = F.max(F.when(~F.col("front") | (F.col("event_id") == F.col("first")), F.col("event_id"))).over(w)
    head = F.coalesce(F.max(F.when(F.col("front"), F.col("event_id"))).over(w), F.when(F.col("event_id") > F.col("first"), F.col("first")))
    ids = lambda c, when: F.when(when, c)
    e = e.withColumn("left_lamport", ids(last, ~F.col("front"))).withColumn("right_lamport", ids(head, F.col("front")))
    base = [F.col("user_id").cast("string").alias("doc_id"), F.lit("n").alias("target")]
    typed = e.select(*base, F.lit("InsertText").alias("kind"), F.col("event_id").alias("lamport"), F.lit(1).alias("replica"), "left_lamport", F.lit(1).alias("left_replica"), "right_lamport", F.lit(1).alias("right_replica"), F.substring("event_type", 1, 1).alias("value"))
    gone = e.where("event_id % 7 = 0").select(*base, F.lit("DeleteText").alias("kind"), (F.col("event_id") + 10**9).alias("lamport"), F.lit(1).alias("replica"), F.col("event_id").alias("left_lamport"), F.lit(1).alias("left_replica"), F.lit(None).cast("long").alias("right_lamport"), F.lit(1).alias("right_replica"), F.lit(None).cast("string").alias("value"))
    return typed.unionByName(gone)


def _crdt(spark: SparkSession) -> DataFrame:
    rows = [("InsertText", 1, 1, None, None, "h"), ("InsertText", 2, 1, 1, 1, "e"), ("InsertText", 3, 1, 2, 1, "y"), ("InsertText", 4, 2, 1, 1, "X"), ("InsertText", 5, 2, 3, 1, "!"), ("DeleteText", 6, 1, 5, 2, None)]
    return spark.createDataFrame([("d", "n", *r) for r in rows], "doc_id string, target string, kind string, lamport int, replica int, left_lamport int, left_replica int, value string")


_q("undo_redo", f"""
    WITH e AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM {_NTH})
    SELECT doc_id, string_agg(substring(event_type, 1, 1), '' ORDER BY n DESC) FILTER (n % 5 = 0 OR n % 5 = 1 AND n + 5 > total AND total % 5 IN (2, 4)) AS text FROM e GROUP BY 1""",
    lambda s, d: oplog.replay(_typing(s, d)))


def _typing(spark: SparkSession, d: str) -> DataFrame:
    """Events as what their user does to a text: two letters put in front, the second undone, redone and undone again; deletions beyond the text change nothing."""
    kind = "case n % 5 when 2 then 'undo' when 3 then 'redo' when 4 then 'undo' else 'insert' end"
    done = _nth(spark, d).selectExpr("doc_id", "n * 2 as seq", f"{kind} as kind", "0 as offset", "0 as length", "substring(event_type, 1, 1) as value")
    bad = _nth(spark, d).selectExpr("doc_id", "n * 2 + 1 as seq", "'delete' as kind", "90000000 as offset", "1 as length", "cast(null as string) as value")
    return done.unionByName(bad)


# --- sessions

_q("session_windows", """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS n FROM events), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 5 MINUTE AS "end", count(*) AS events FROM r GROUP BY user_id, s""",
    lambda s, d: sessions.session_windows(table(s, d, "events"), "user_id", "ts").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "events"))
_SESSIONS = """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS n FROM events), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g),
    w AS (SELECT epoch(date_trunc('second', max(ts) + INTERVAL 5 MINUTE)) - epoch(date_trunc('second', min(ts))) AS length, count(*) AS events FROM r GROUP BY user_id, s)"""


def _anchored(seconds: int, past: str = ">=") -> str:
    """Each user's events in order, with the place in a window that begins with its first event."""
    return f"""
    WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    w(event_id, user_id, ts, i, start, nth) AS (SELECT event_id, user_id, ts, i, ts, 1 FROM e WHERE i = 1
      UNION ALL SELECT e.event_id, e.user_id, e.ts, e.i, CASE WHEN e.ts - w.start {past} INTERVAL {seconds} SECOND THEN e.ts ELSE w.start END, CASE WHEN e.ts - w.start {past} INTERVAL {seconds} SECOND THEN 1 ELSE w.nth + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)"""


_q("session_stats", f"{_SESSIONS} SELECT count(*) AS sessions, CAST(sum(events) AS BIGINT) AS events, CAST(max(length) AS BIGINT) AS longest_s, count(*) FILTER (events > 1) AS with_several FROM w", lambda s, d: sessions.session_stats(sessions.session_windows(table(s, d, "events"), "user_id", "ts")))
_q("stale_editors", "SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1 HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 60 MINUTE", lambda s, d: sessions.stale_editors(table(s, d, "events"), "user_id", "ts", 60))
_q("upload_rate", f"{_anchored(86400)} SELECT event_id FROM w WHERE nth > 2", lambda s, d: sessions.over_limit(table(s, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 2, 86400, ["event_id"]).select("event_id"))
_q("login_limit", f"{_anchored(86400, '>')} SELECT event_id, CAST(86400 - floor((epoch_us(ts) - epoch_us(start)) / 1000000) AS BIGINT) AS remaining FROM w WHERE nth > 3",
    lambda s, d: sessions.blocked_attempts(table(s, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 3, 86400, ["event_id"]).select("event_id", "remaining"))
_q("msg_rate_anchored", f"{_anchored(3600)} SELECT CAST(nth AS BIGINT) AS nth, count(*) AS n FROM w GROUP BY 1", lambda s, d: sessions.anchored_windows(table(s, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 3600, ["event_id"]).groupBy("nth").agg(F.count(F.lit(1)).alias("n")))
_q("msg_rate_per_second", f"{_anchored(1)} SELECT event_id, CAST(nth AS BIGINT) AS nth FROM w", lambda s, d: sessions.anchored_windows(table(s, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 1, ["event_id"]).select("event_id", "nth"))
_q("admin_errors_page", "SELECT event_id FROM (SELECT event_id, ts FROM events WHERE event_type = 'error' OR value > 90 ORDER BY ts DESC, event_id DESC LIMIT 500) ORDER BY ts DESC, event_id DESC LIMIT 10 OFFSET 5",
    lambda s, d: table(s, d, "events").where("event_type = 'error' or value > 90").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(500).orderBy(F.col("ts").desc(), F.col("event_id").desc()).offset(5).limit(10).select("event_id"))

# --- files and kernels

_ROWS = "(SELECT p_brand, p_size, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INT) AS n FROM part)"
_SHEETS = f"""(SELECT p_brand AS workbook_id, 'S' AS sheet, n AS row, 0 AS col, 'number' AS kind, CAST(p_size AS DOUBLE) AS num, NULL AS txt, NULL AS err FROM {_ROWS}
    UNION ALL SELECT p_brand, 'S', n, 1, 'number', p_size * 2, NULL, NULL FROM {_ROWS} UNION ALL SELECT p_brand, 'S', n, 2, CASE WHEN p_size > 25 THEN 'text' ELSE 'error' END, NULL, CASE WHEN p_size > 25 THEN 'big' END, CASE WHEN p_size <= 25 THEN '#DIV/0!' END FROM {_ROWS}
    UNION ALL SELECT p_brand, 'T', 0, 0, 'number', sum(p_size), NULL, NULL FROM {_ROWS} GROUP BY 1)"""


def _book(spark: SparkSession, d: str) -> DataFrame:
    """A workbook a brand: sizes, formulas over them by row, and a sheet with their sum."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    part = table(spark, d, "part").select(F.col("p_brand").alias("workbook_id"), "p_size", F.row_number().over(w).alias("n"))
    blank = {n: f"cast(null as {t})" for n, t in (c.split() for c in office.CELLS.split(", "))}

    def made(df: DataFrame, **cells: str) -> DataFrame:
        return df.selectExpr(*[f"{e} as {n}" for n, e in (blank | {"workbook_id": "workbook_id", "sheet": "'S'", "row": "n - 1", "kind": "'empty'"} | cells).items()])

    sizes = made(part, col="0", kind="'number'", num="cast(p_size as double)")
    twice = made(part, col="1", formula="concat('=A', n, '*2')")
    tests = made(part, col="2", formula="concat('=IF(B', n, '>50,\"big\",1/0)')")
    total = made(part.groupBy("workbook_id").agg(F.count(F.lit(1)).alias("n")), sheet="'T'", row="0", col="0", formula="concat('=SUM(S!A1:A', n, ')')")
    return sizes.unionByName(twice).unionByName(tests).unionByName(total)


def _reread(spark: SparkSession, d: str, kind: str) -> DataFrame:
    files = office.write_workbooks(recalculate_frame(_book(spark, d)), kind)
    return office.read_workbooks(files.select(F.col("workbook_id").alias("path"), F.lit(kind).alias("format"), "content"))


_q("recalculate", f"SELECT * FROM {_SHEETS}", lambda s, d: recalculate_frame(_book(s, d)).select("workbook_id", "sheet", "row", "col", "kind", "num", "txt", "err"))
_q("xlsx_roundtrip", f"SELECT * FROM {_SHEETS}", lambda s, d: _reread(s, d, "xlsx").select("workbook_id", "sheet", "row", "col", "kind", "num", "txt", "err"))
_q("ods_roundtrip", f"SELECT workbook_id, sheet, row, col, num FROM {_SHEETS} WHERE kind = 'number'", lambda s, d: _reread(s, d, "ods").where("kind = 'number'").select("workbook_id", "sheet", "row", "col", "num"))
_BLOCKS = "SELECT CAST(item_id AS VARCHAR) AS path, md5(replace(text, chr(10), ' ')) AS h FROM benchmark"


def _export(spark: SparkSession, d: str, kind: str) -> DataFrame:
    b = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("path"), F.lit(0).alias("ord"), F.lit("paragraph").alias("kind"), F.lit(0).alias("level"), F.regexp_replace("text", "\n", " ").alias("text"))
    files = office.export_documents(b, kind).select("path", F.lit(kind).alias("format"), "content")
    return office.read_documents(files).select("path", F.md5(F.encode("text", "UTF-8")).alias("h"))


_q("docx_roundtrip", _BLOCKS, lambda s, d: _export(s, d, "docx"))
_q("odt_roundtrip", _BLOCKS, lambda s, d: _export(s, d, "odt"))
_q("convert_formats", "SELECT CAST(item_id AS VARCHAR) AS path, md5(replace(text, chr(10), ' ')) AS h FROM benchmark UNION ALL SELECT 'x' || item_id, 'BadZipFile' FROM benchmark", lambda s, d: _converted(s, d))


def _converted(spark: SparkSession, d: str) -> DataFrame:
    """Texts to DOCX, to ODT, to Markdown and back to texts, beside files that are none."""
    b = table(spark, d, "benchmark")
    files = b.select(F.col("item_id").cast("string").alias("path"), F.encode(F.regexp_replace("text", "\n", " "), "UTF-8").alias("content"))
    kind, bad = "txt", b.select(F.concat(F.lit("x"), "item_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    for to in ("docx", "odt", "md", "txt"):
        files = office.convert(files.withColumn("format", F.lit(kind)), to).drop("err")
        kind = to
    broken = office.convert(bad.withColumn("format", F.lit("docx")), "odt").where("content is null")
    return files.select("path", F.md5("content").alias("h")).unionByName(broken.select("path", F.split("err", ":")[0].alias("h")))


_q("markdown_read", """
    SELECT p_partkey AS id, unnest([0, 1, 2, 3, 4, 5]) AS ord, unnest(['heading', 'paragraph', 'bullet', 'bullet', 'row', 'row']) AS kind, unnest([CAST(1 + p_size % 6 AS INT), 0, 0, 1, 0, 0]) AS level,
    unnest([p_name, p_type, p_brand, CAST(p_size AS VARCHAR), 'x' || chr(9) || 'y', p_partkey || chr(9) || p_size]) AS text FROM part""",
    lambda s, d: markup.read_markdown(_markdown(s, d, True), "id", "text"))
_q("markdown_roundtrip", "SELECT p_partkey AS id, repeat('#', CAST(1 + p_size % 6 AS INT)) || ' ' || p_name || chr(10) || chr(10) || p_type || chr(10) || chr(10) || '- ' || p_brand || chr(10) || '  - ' || p_size AS text FROM part",
    lambda s, d: markup.write_markdown(markup.read_markdown(_markdown(s, d, False), "id", "text"), "id"))
_q("html_table_rows", """
    SELECT s_suppkey AS id, unnest([0, 0, 1, 1, 2, 2]) AS row, unnest([0, 1, 0, 1, 0, 1]) AS col, unnest([s_name, '', s_suppkey || '&', CAST(s_nationkey AS VARCHAR), '', 'd']) AS value, unnest([true, true, false, false, false, false]) AS header FROM supplier""",
    lambda s, d: markup.read_html_tables(table(s, d, "supplier").selectExpr("s_suppkey as id", "concat('<p>x</p><table><tr><th colspan=2> ', s_name, '</th></tr><tr><td rowspan=2>', s_suppkey, '&amp;</td><td>', s_nationkey, '</td></tr><tr><td>d</td></tr></table><table><tr><td>no</td></tr></table>') as html"), "id", "html"))


def _markdown(spark: SparkSession, d: str, with_table: bool) -> DataFrame:
    text = "concat(repeat('#', cast(1 + p_size % 6 as int)), ' ', p_name, '\\n\\n', p_type, '\\n\\n- ', p_brand, '\\n  - ', p_size" + (", '\\n\\n| x | y |\\n|---|---|\\n| ', p_partkey, ' | ', p_size, ' |')" if with_table else ")")
    return table(spark, d, "part").selectExpr("p_partkey as id", f"{text} as text")
