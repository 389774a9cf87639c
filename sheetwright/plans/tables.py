"""Queries over table operators, aggregates and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.formula import aggregate_formulas
from ..functions.formula.criteria import predicate
from ..operators import lookup, tableops
from .registry import query, table


_TEXT = "CASE WHEN {0} = floor({0}) AND abs({0}) < 9e15 THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"

# --- aggregates


@query("""
SELECT l_returnflag, sum(l_quantity) AS sum_qty, avg(l_extendedprice) AS avg_price, min(l_discount) AS min_disc, max(l_tax) AS max_tax
FROM lineitem GROUP BY l_returnflag""")
def agg_sum_avg_min_max(spark: SparkSession, d: str) -> DataFrame:
    return aggregate_formulas(
        table(spark, d, "lineitem"), {"sum_qty": "=SUM([l_quantity])", "avg_price": "=AVERAGE([l_extendedprice])", "min_disc": "=MIN([l_discount])", "max_tax": "=MAX([l_tax])"}, ["l_returnflag"]
    )


@query("SELECT CAST(count(o_totalprice) AS DOUBLE) AS n_numbers, CAST(count(o_orderpriority) AS DOUBLE) AS n_values, CAST(0 AS DOUBLE) AS n_text_numbers FROM orders")
def agg_count_counta(spark: SparkSession, d: str) -> DataFrame:
    return aggregate_formulas(table(spark, d, "orders"), {"n_numbers": "=COUNT([o_totalprice])", "n_values": "=COUNTA([o_orderpriority])", "n_text_numbers": "=COUNT([o_orderpriority])"})


@query("SELECT CAST(count(*) FILTER (l_quantity >= 25) AS DOUBLE) AS n FROM lineitem")
def countif_numeric(spark: SparkSession, d: str) -> DataFrame:
    return aggregate_formulas(table(spark, d, "lineitem"), {"n": '=COUNTIF([l_quantity],">=25")'})


@query("SELECT CAST(count(*) FILTER (lower(p_type) LIKE '%a%e_') AS DOUBLE) AS n FROM part")
def countif_wildcard(spark: SparkSession, d: str) -> DataFrame:
    return aggregate_formulas(table(spark, d, "part"), {"n": '=COUNTIF([p_type],"*A*e?")'})


@query("SELECT CAST(count(*) FILTER (lower(o_orderstatus) <> 'f') AS DOUBLE) AS n FROM orders")
def countif_not_equal(spark: SparkSession, d: str) -> DataFrame:
    return aggregate_formulas(table(spark, d, "orders"), {"n": '=COUNTIF([o_orderstatus],"<>F")'})


@query("SELECT round(coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 0), 2) AS total FROM lineitem")
def sumif_flag(spark: SparkSession, d: str) -> DataFrame:
    return aggregate_formulas(table(spark, d, "lineitem"), {"total": '=SUMIF([l_returnflag],"r",[l_extendedprice])'}).select(F.round("total", 2).alias("total"))


@query("SELECT round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS mean FROM orders")
def averageif_status(spark: SparkSession, d: str) -> DataFrame:
    return aggregate_formulas(table(spark, d, "orders"), {"mean": '=AVERAGEIF([o_orderstatus],"O",[o_totalprice])'}).select(F.round("mean", 4).alias("mean"))


@query("SELECT count(*) FILTER (l_quantity > 10 AND l_returnflag = 'A') AS n FROM lineitem")
def countifs_multi(spark: SparkSession, d: str) -> DataFrame:
    """An extra: all pairs of range and criterion count."""
    li = table(spark, d, "lineitem")
    return li.agg(F.count_if(predicate(F.col("l_quantity"), ">10", True) & predicate(F.col("l_returnflag"), "a", False)).alias("n"))


@query("SELECT round(coalesce(sum(l_extendedprice) FILTER (l_discount < 0.05 AND l_linestatus = 'F'), 0), 2) AS total FROM lineitem")
def sumifs_multi(spark: SparkSession, d: str) -> DataFrame:
    """An extra: all pairs of range and criterion count."""
    both = predicate(F.col("l_discount"), "<0.05", True) & predicate(F.col("l_linestatus"), "F", False)
    return table(spark, d, "lineitem").agg(F.round(F.coalesce(F.sum(F.when(both, F.col("l_extendedprice"))), F.lit(0.0)), 2).alias("total"))


# --- pivots and reshaping


@query("""
SELECT o_orderpriority, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 2) AS "F", round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0), 2) AS "O",
  round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0), 2) AS "P" FROM orders GROUP BY 1""")
def pivot_sum(spark: SparkSession, d: str) -> DataFrame:
    p = tableops.pivot(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", "sum", "o_orderstatus", ["F", "O", "P"])
    return p.select("o_orderpriority", *[F.round(c, 2).alias(c) for c in ("F", "O", "P")])


@query("""
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def pivot_count(spark: SparkSession, d: str) -> DataFrame:
    return tableops.pivot(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", "count", "o_orderstatus", ["F", "O", "P"])


@query("""
SELECT l_returnflag, round(coalesce(avg(l_quantity) FILTER (l_linestatus = 'F'), 0), 6) AS "F", round(coalesce(avg(l_quantity) FILTER (l_linestatus = 'O'), 0), 6) AS "O" FROM lineitem GROUP BY 1""")
def pivot_average(spark: SparkSession, d: str) -> DataFrame:
    p = tableops.pivot(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "average", "l_linestatus", ["F", "O"])
    return p.select("l_returnflag", F.round("F", 6).alias("F"), F.round("O", 6).alias("O"))


@query("SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY 1")
def pivot_no_column(spark: SparkSession, d: str) -> DataFrame:
    return tableops.pivot(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", "count")


@query("SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS label, unnest(['l_quantity', 'l_discount']) AS series, unnest([l_quantity, l_discount]) AS value FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'")
def chart_series_unpivot(spark: SparkSession, d: str) -> DataFrame:
    li = tableops.filter_date(table(spark, d, "lineitem"), "l_shipdate", "before", "1997-01-01")
    return tableops.chart_series(li.withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber")), "id", ["l_quantity", "l_discount"])


@query("SELECT 0 AS row, r_regionkey AS col, CAST(r_regionkey AS VARCHAR) AS value FROM region UNION ALL SELECT 1, r_regionkey, r_name FROM region")
def transpose_region(spark: SparkSession, d: str) -> DataFrame:
    return tableops.transpose_cells(tableops.to_cells(table(spark, d, "region").withColumn("r", F.col("r_regionkey")), ["r_regionkey", "r_name"], "r"))


@query("WITH s AS (SELECT c_mktsegment AS label, sum(c_acctbal) AS v FROM customer GROUP BY 1) SELECT label, round(greatest(v, 0), 2) AS value, round(greatest(v, 0) / (SELECT sum(greatest(v, 0)) FROM s), 9) AS share FROM s")
def pie_share(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.sum("c_acctbal").alias("v"))
    return tableops.pie_shares(s, "c_mktsegment", "v").select("label", F.round("value", 2).alias("value"), F.round("share", 9).alias("share"))


@query("""
WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), p AS (SELECT *, (hi - lo) / 5 AS rough FROM r), q AS (SELECT *, pow(10, floor(log10(rough))) AS pw FROM p),
s AS (SELECT lo, hi, pw * CASE WHEN rough / pw <= 1 THEN 1 WHEN rough / pw <= 2 THEN 2 WHEN rough / pw <= 5 THEN 5 ELSE 10 END AS step FROM q)
SELECT lo, hi, step, floor(lo / step) * step AS axis_min, ceil(hi / step) * step AS axis_max FROM s""")
def nice_scale(spark: SparkSession, d: str) -> DataFrame:
    return tableops.nice_scale(table(spark, d, "orders"), "o_totalprice")


@query("""
WITH m AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)
SELECT e.event_type, round(sum((value - lo) / (hi - lo)), 4) AS total, count(*) AS n FROM events e JOIN m USING (event_type) GROUP BY 1""")
def sparkline_points(spark: SparkSession, d: str) -> DataFrame:
    s = tableops.sparkline(table(spark, d, "events"), ["event_type"], "value", ["ts", "event_id"])
    return s.select("event_type", F.round(F.aggregate("points", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("points").cast("long").alias("n"))


@query("SELECT CAST(max(c) + 1 AS INT) AS cols, CAST(max(r) + 1 AS INT) AS rows FROM (SELECT unnest([0, 1]) AS c, n_nationkey AS r FROM nation)")
def sheet_dimensions(spark: SparkSession, d: str) -> DataFrame:
    c = tableops.to_cells(table(spark, d, "nation"), ["n_nationkey", "n_name"], "n_nationkey")
    return tableops.dimensions(c.withColumn("sheet", F.lit("s")), ["sheet"]).select("cols", "rows")


@query("SELECT CASE WHEN r_regionkey >= 2 THEN r_regionkey + 1 ELSE r_regionkey END AS row, r_name AS value FROM region")
def insert_row_shift(spark: SparkSession, d: str) -> DataFrame:
    c = tableops.to_cells(table(spark, d, "region"), ["r_name"], "r_regionkey")
    return tableops.insert_rows(c, 2).select("row", "value")


@query("SELECT CASE WHEN r_regionkey > 1 THEN r_regionkey - 1 ELSE r_regionkey END AS row, r_name AS value FROM region WHERE r_regionkey <> 1")
def delete_row_shift(spark: SparkSession, d: str) -> DataFrame:
    c = tableops.to_cells(table(spark, d, "region"), ["r_name"], "r_regionkey")
    return tableops.delete_rows(c, 1).select("row", "value")


@query("SELECT r_regionkey AS row, CAST(CASE WHEN r_regionkey BETWEEN 1 AND 3 THEN 1 ELSE r_regionkey END AS INT) AS owner_row, 0 AS owner_col FROM region")
def merge_cells_owner(spark: SparkSession, d: str) -> DataFrame:
    c = tableops.to_cells(table(spark, d, "region"), ["r_name"], "r_regionkey")
    return tableops.merge_owner(c, spark.createDataFrame([(1, 0, 3, 0)], "r1 int, c1 int, r2 int, c2 int")).select("row", "owner_row", "owner_col")


@query("""
WITH k AS (SELECT DISTINCT l_orderkey AS r FROM lineitem WHERE l_quantity > 10), g AS (SELECT r, r - row_number() OVER (ORDER BY r) AS g FROM k)
SELECT min(r) AS first_row, max(r) AS last_row, count(*) AS rows FROM g GROUP BY g""")
def contiguous_regions(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("row"), F.lit("x").alias("value"))
    return tableops.regions(li)


@query("SELECT o_orderkey, CAST(10 + (row_number() OVER (ORDER BY o_orderkey) - 1) * 5 AS DOUBLE) AS fill FROM orders")
def autofill_series(spark: SparkSession, d: str) -> DataFrame:
    return tableops.fill_numbers(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 10, 5)


@query("SELECT c_name AS name, 'customer' AS sheet FROM customer UNION ALL SELECT s_name, 'supplier' FROM supplier")
def append_sheets(spark: SparkSession, d: str) -> DataFrame:
    return tableops.append_sheets({"customer": table(spark, d, "customer").select(F.col("c_name").alias("name")), "supplier": table(spark, d, "supplier").select(F.col("s_name").alias("name"))})


@query("SELECT p_type AS value, CAST(row_number() OVER (ORDER BY p_type) - 1 AS BIGINT) AS id FROM (SELECT DISTINCT p_type FROM part)")
def shared_strings(spark: SparkSession, d: str) -> DataFrame:
    return tableops.shared_strings(table(spark, d, "part"), "p_type")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS media_id FROM documents")
def media_dedup(spark: SparkSession, d: str) -> DataFrame:
    return tableops.dedupe_media(table(spark, d, "documents"), "doc_id", "text")


# --- filters


def _filter(name: str, sql: str, make) -> None:
    query(sql, name)(make)


_filter("filter_values", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (3, 7, 12)", lambda s, d: tableops.filter_values(table(s, d, "customer"), {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": ["3", "7", "12"]}).select("c_custkey"))
_filter("filter_and_columns", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F') AND o_orderpriority IN ('1-URGENT', '2-HIGH')", lambda s, d: tableops.filter_values(table(s, d, "orders"), {"o_orderstatus": ["F"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}).select("o_orderkey"))
_filter("filter_text_contains", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a')", lambda s, d: tableops.filter_text(table(s, d, "part"), "p_name", "contains", "A").select("p_partkey", "p_name"))
_filter("filter_text_not_contains", "SELECT p_partkey FROM part WHERE NOT contains(lower(p_type), 'steel')", lambda s, d: tableops.filter_text(table(s, d, "part"), "p_type", "notContains", "Steel").select("p_partkey"))
_filter("filter_starts_with", "SELECT p_partkey FROM part WHERE starts_with(lower(p_brand), 'brand#1')", lambda s, d: tableops.filter_text(table(s, d, "part"), "p_brand", "startsWith", "BRAND#1").select("p_partkey"))
_filter("filter_ends_with", "SELECT c_custkey FROM customer WHERE ends_with(lower(c_name), '7')", lambda s, d: tableops.filter_text(table(s, d, "customer"), "c_name", "endsWith", "7").select("c_custkey"))
_filter("filter_num_gt", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000", lambda s, d: tableops.filter_number(table(s, d, "orders"), "o_totalprice", "gt", 300000).select("o_orderkey", "o_totalprice"))
_filter("filter_num_lt", "SELECT c_custkey FROM customer WHERE c_acctbal < 0", lambda s, d: tableops.filter_number(table(s, d, "customer"), "c_acctbal", "lt", 0).select("c_custkey"))
_filter("filter_num_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 7", lambda s, d: tableops.filter_number(table(s, d, "lineitem"), "l_quantity", "between", 5, 7).select("l_orderkey", "l_linenumber"))
_filter("filter_top10", "SELECT o_orderkey, o_totalprice FROM (SELECT *, rank() OVER (ORDER BY o_totalprice DESC) AS r FROM orders) WHERE r <= 10", lambda s, d: tableops.filter_top(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 10))
_filter("filter_date_before", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01'", lambda s, d: tableops.filter_date(table(s, d, "orders"), "o_orderdate", "before", "1995-06-01").select("o_orderkey"))
_filter("filter_date_after", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-01'", lambda s, d: tableops.filter_date(table(s, d, "orders"), "o_orderdate", "after", "1996-06-01").select("o_orderkey"))
_filter("filter_date_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'", lambda s, d: tableops.filter_date(table(s, d, "lineitem"), "l_shipdate", "between", "1995-01-01", "1995-12-31").select("l_orderkey", "l_linenumber"))

# --- sorting, limits, duplicates

_filter("sort_single", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders", lambda s, d: tableops.numbered(table(s, d, "orders").select("o_orderkey", (-F.col("o_totalprice")).alias("k")), ["k", "o_orderkey"]).select("o_orderkey", F.col("ord").alias("place")))
_filter("sort_multi", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey", lambda s, d: tableops.sort_rows(table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), [("c_mktsegment", "asc"), ("c_acctbal", "desc")], ["c_custkey"]))
_filter("paginate_recent", "SELECT event_id, count(*) OVER () AS total FROM events ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40", lambda s, d: tableops.paginate(table(s, d, "events"), [F.col("ts").desc(), F.col("event_id").desc()], 40, 20).select("event_id", "total"))
_filter("ring_last_n", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100", lambda s, d: tableops.last_rows(table(s, d, "events"), [F.col("ts").desc(), F.col("event_id").desc()], 100).select("event_id"))
_filter("dedupe_keep_first", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1", lambda s, d: tableops.remove_duplicates(table(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id"))
_filter("dup_count", "SELECT CAST(count(*) - count(DISTINCT text) AS BIGINT) AS duplicates FROM documents", lambda s, d: tableops.duplicate_count(table(s, d, "documents"), ["text"]))
_filter("distinct_values", "SELECT p_brand AS value, min(p_partkey) AS first_at FROM part GROUP BY 1", lambda s, d: tableops.distinct_values(table(s, d, "part"), "p_brand", "p_partkey"))

# --- lookups

_filter("vlookup_exact", "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey", lambda s, d: lookup.lookup_exact(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(s, d, "customer"), "c_custkey", ["c_name", "c_mktsegment"], ["c_custkey"]).drop("o_custkey"))


@query("""
WITH p AS (SELECT p_retailprice AS k, max(p_partkey) AS p_partkey FROM part GROUP BY 1)
SELECT l_orderkey, l_linenumber, p.p_partkey FROM (SELECT *, l_extendedprice / l_quantity AS unit FROM lineitem) l ASOF LEFT JOIN p ON l.unit >= p.k""")
def vlookup_approx_asof(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    return lookup.lookup_asof(li, "unit", table(spark, d, "part").select("p_retailprice", "p_partkey"), "p_retailprice", ["p_partkey"], order=["p_partkey"]).drop("unit")


@query("""
WITH o AS (SELECT user_id AS u, ts AS t, max(event_id) AS ref FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT e.event_id, o.ref AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN o ON e.user_id = o.u AND e.ts >= o.t""")
def asof_by_user(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    buys = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"))
    return lookup.lookup_asof(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), "ts", buys, "ts", ["last_purchase"], ["user_id"], ["last_purchase"]).select("event_id", "last_purchase")


@query("SELECT n_nationkey, r_name AS name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def hlookup(spark: SparkSession, d: str) -> DataFrame:
    """A wide table of one row, looked up by its column heads."""
    wide = table(spark, d, "region").groupBy().pivot("r_regionkey", [0, 1, 2, 3, 4]).agg(F.first("r_name"))
    tall = wide.unpivot([], [str(i) for i in range(5)], "k", "name").select(F.col("k").cast("int").alias("k"), "name")
    return lookup.lookup_exact(table(spark, d, "nation"), "n_regionkey", tall, "k", ["name"], ["k"]).select("n_nationkey", "name")


def _vector(s: SparkSession, d: str) -> DataFrame:
    return tableops.numbered(table(s, d, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"]).select("s_acctbal", F.col("ord").alias("position"))


@query("SELECT o_orderkey, p.position FROM orders LEFT JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS position FROM customer) p ON o_custkey = c_custkey")
def match_exact(spark: SparkSession, d: str) -> DataFrame:
    v = tableops.numbered(table(spark, d, "customer").select("c_custkey"), ["c_custkey"]).withColumnRenamed("ord", "position")
    return lookup.match_position(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", v, "c_custkey", "position", 0).drop("o_custkey")


@query("""
WITH v AS (SELECT s_acctbal AS k, max(p) AS position FROM (SELECT s_acctbal, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS p FROM supplier) GROUP BY 1)
SELECT c_custkey, position FROM customer ASOF LEFT JOIN v ON c_acctbal >= k""")
def match_le(spark: SparkSession, d: str) -> DataFrame:
    return lookup.match_position(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", _vector(spark, d), "s_acctbal", "position", 1).drop("c_acctbal")


@query("""
WITH v AS (SELECT s_acctbal AS k, max(p) AS position FROM (SELECT s_acctbal, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS p FROM supplier) GROUP BY 1)
SELECT c_custkey, position FROM customer ASOF LEFT JOIN v ON c_acctbal <= k""")
def match_ge(spark: SparkSession, d: str) -> DataFrame:
    return lookup.match_position(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", _vector(spark, d), "s_acctbal", "position", -1).drop("c_acctbal")


_filter("index_row", "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE n IN (1, 10, 100)", lambda s, d: lookup.index_rows(tableops.numbered(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"]), "ord", [1, 10, 100]).drop("ord"))


@query("""
SELECT event_id, h.id AS hook_id FROM events JOIN (VALUES ('a', ['click', 'view'], true), ('b', ['*'], true), ('c', ['purchase', '*'], true), ('d', ['click'], false)) AS h(id, kinds, active)
ON active AND (list_contains(kinds, event_type) OR list_contains(kinds, '*'))""")
def webhook_routing(spark: SparkSession, d: str) -> DataFrame:
    hooks = spark.createDataFrame([("a", ["click", "view"], True), ("b", ["*"], True), ("c", ["purchase", "*"], True), ("d", ["click"], False)], "id string, events array<string>, active boolean")
    return lookup.route(table(spark, d, "events"), "event_type", hooks).select("event_id", "hook_id")


@query("SELECT user_id, count(*) FILTER (event_type IN ('purchase', 'click')) AS n_allowed FROM events GROUP BY 1")
def permission_check(spark: SparkSession, d: str) -> DataFrame:
    ok = lookup.allowed(table(spark, d, "events"), "event_type", {"view": 1, "click": 2, "purchase": 3}, "click")
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(ok).alias("n_allowed"))


# --- rules

RULES = [
    {"type": "greaterThan", "col": "l_quantity", "a": 45, "style": "red"},
    {"type": "between", "col": "l_discount", "a": 0.02, "b": 0.04, "style": "blue"},
    {"type": "equalTo", "col": "l_returnflag", "a": "N", "style": "green"},
    {"type": "textContains", "col": "l_linestatus", "a": "f", "style": "grey"},
    {"type": "lessThan", "col": "l_tax", "a": 0.01, "style": "pink"},
]


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN 'red' WHEN l_discount BETWEEN 0.02 AND 0.04 THEN 'blue' WHEN l_returnflag = 'N' THEN 'green'
WHEN contains(lower(l_linestatus), 'f') THEN 'grey' WHEN l_tax < 0.01 THEN 'pink' END AS style FROM lineitem""")
def cond_rules_first_match(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", tableops.conditional_style(li, RULES).alias("style"))


_filter("cond_top10", "SELECT c_custkey FROM (SELECT *, rank() OVER (ORDER BY c_acctbal DESC) AS r FROM customer) WHERE r <= 10", lambda s, d: tableops.filter_top(table(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 10).select("c_custkey"))


@query("""
WITH m AS (SELECT c_mktsegment, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1), r AS (SELECT c_custkey, CASE WHEN hi > lo THEN (c_acctbal - lo) / (hi - lo) ELSE 0.5 END AS ratio FROM customer JOIN m USING (c_mktsegment))
SELECT c_custkey, ratio, CAST(floor(ratio * 255 + 0.5) AS INT) AS red, CAST(floor((1 - ratio) * 255 + 0.5) AS INT) AS green, 100 AS blue FROM r""")
def color_scale(spark: SparkSession, d: str) -> DataFrame:
    return tableops.color_scale(table(spark, d, "customer"), "c_acctbal", ["c_mktsegment"]).select("c_custkey", "ratio", "red", "green", "blue")


_filter("validate_list", "SELECT c_custkey, '0:c_mktsegment:list' AS rule, c_mktsegment AS value FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE')", lambda s, d: tableops.validate(table(s, d, "customer"), [{"type": "list", "col": "c_mktsegment", "values": ["BUILDING", "AUTOMOBILE"]}], ["c_custkey"]))
_filter("validate_number", "SELECT p_partkey, '0:p_size:number' AS rule, CAST(p_size AS VARCHAR) AS value FROM part WHERE NOT p_size BETWEEN 5 AND 40", lambda s, d: tableops.validate(table(s, d, "part"), [{"type": "number", "col": "p_size", "min": 5, "max": 40}], ["p_partkey"]))
_filter("validate_text_length", "SELECT p_partkey, '0:p_name:textLength' AS rule, p_name AS value FROM part WHERE NOT length(p_name) BETWEEN 1 AND 9 UNION ALL SELECT p_partkey, '1:p_size:custom', CAST(p_size AS VARCHAR) FROM part WHERE p_size % 2 <> 0", lambda s, d: tableops.validate(table(s, d, "part"), [{"type": "textLength", "col": "p_name", "min": 1, "max": 9}, {"type": "custom", "col": "p_size", "condition": "p_size % 2 = 0"}], ["p_partkey"]))
_filter("number_text", f"SELECT o_orderkey, {_TEXT.format('o_totalprice')} AS shown FROM orders", lambda s, d: table(s, d, "orders").select("o_orderkey", cells.number_text(F.col("o_totalprice")).alias("shown")))
