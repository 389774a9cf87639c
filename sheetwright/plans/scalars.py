"""Queries over the formula functions and text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.formula import with_formulas
from ..operators import store, text
from ..sources import delimited, detect
from .registry import query, table


def _formulas(name: str, source: str, keys: list[str], formulas: dict[str, str], sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return with_formulas(table(spark, d, source), formulas, errors=False).select(*keys, *formulas)

    query(sql, name)(run)


_formulas("fn_string_basic", "part", ["p_partkey"], {"a": "=LEFT([p_name],3)", "b": "=RIGHT([p_type],4)", "c": "=MID([p_brand],2,4)", "n": "=LEN([p_name])", "j": '=CONCATENATE([p_brand],"/",[p_size])', "k": '=[p_size]&"-"&[p_partkey]'},
    "SELECT p_partkey, p_name[1:3] AS a, right(p_type, 4) AS b, substring(p_brand, 2, 4) AS c, CAST(length(p_name) AS DOUBLE) AS n, p_brand || '/' || p_size AS j, p_size || '-' || p_partkey AS k FROM part")
_formulas("fn_find_search", "part", ["p_partkey"], {"f": '=IFERROR(FIND("a",[p_type]),0)', "s": '=IFERROR(SEARCH("A",[p_type],3),-1)'},
    "SELECT p_partkey, CAST(instr(p_type, 'a') AS DOUBLE) AS f, CAST(CASE WHEN instr(substr(lower(p_type), 3), 'a') > 0 THEN instr(substr(lower(p_type), 3), 'a') + 2 ELSE -1 END AS DOUBLE) AS s FROM part")
_formulas("fn_substitute", "customer", ["c_custkey"], {"all_": '=SUBSTITUTE([c_name],"0","o")', "second": '=SUBSTITUTE([c_name],"0","X",2)'},
    "SELECT c_custkey, replace(c_name, '0', 'o') AS all_, regexp_replace(c_name, '^([^0]*0[^0]*)0', '\\1X') AS second FROM customer")
_formulas("fn_text_value", "orders", ["o_orderkey"], {"p": '=TEXT([o_totalprice]/1000000,"0.0%")', "v": '=VALUE("$1,250.5")', "w": '=IFERROR(VALUE([o_orderpriority]),-1)', "t": "=[o_orderkey]&\"\""},
    "SELECT o_orderkey, format('{:.1f}%', o_totalprice / 1000000 * 100) AS p, 1250.5::DOUBLE AS v, -1::DOUBLE AS w, CAST(o_orderkey AS VARCHAR) AS t FROM orders")
_formulas("fn_trim_case", "documents", ["doc_id"], {"t": "=TRIM([text])", "u": "=UPPER([lang])", "l": "=LOWER([source])"},
    r"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS t, upper(lang) AS u, lower(source) AS l FROM documents")
_formulas("fn_round_mod_int", "lineitem", ["l_orderkey", "l_linenumber"], {"r": "=ROUND([l_extendedprice]*[l_discount],2)", "m": "=MOD([l_quantity],-7)", "i": "=INT(-[l_tax]*100)", "a": "=ABS([l_discount]-0.05)"},
    """SELECT l_orderkey, l_linenumber, sign(x) * (floor(abs(x * 100)) + CASE WHEN abs(x * 100) - floor(abs(x * 100)) >= 0.5 THEN 1 ELSE 0 END) / 100 AS r, l_quantity + 7 * floor(l_quantity / -7) AS m, floor(-l_tax * 100) + 0 AS i, abs(l_discount - 0.05) AS a
    FROM (SELECT *, l_extendedprice * l_discount AS x FROM lineitem)""")  # fmt: skip
_formulas("fn_trig_log", "lineitem", ["l_orderkey", "l_linenumber"], {"s": "=ROUND(SIN([l_quantity]),9)", "c": "=ROUND(COS([l_discount])+TAN([l_tax]),9)", "l": "=ROUND(LOG([l_quantity],2),9)", "t": "=ROUND(LOG10([l_extendedprice]),9)", "e": "=ROUND(LN([l_quantity])+EXP([l_tax]),9)", "q": "=ROUND(SQRT([l_quantity])+ASIN([l_tax])+ACOS([l_tax])+ATAN([l_tax]),9)"},
    """SELECT l_orderkey, l_linenumber, round(sin(l_quantity), 9) AS s, round(cos(l_discount) + tan(l_tax), 9) AS c, round(ln(l_quantity) / ln(2), 9) AS l, round(log10(l_extendedprice), 9) AS t,
    round(ln(l_quantity) + exp(l_tax), 9) AS e, round(sqrt(l_quantity) + asin(l_tax) + acos(l_tax) + atan(l_tax), 9) AS q FROM lineitem""")  # fmt: skip
_formulas("fn_ceiling_floor", "lineitem", ["l_orderkey", "l_linenumber"], {"c": "=CEILING([l_extendedprice],50)", "f": "=FLOOR([l_extendedprice],12.5)", "e": "=IFERROR(CEILING([l_quantity],-1),-99)"},
    "SELECT l_orderkey, l_linenumber, ceil(l_extendedprice / 50) * 50 AS c, floor(l_extendedprice / 12.5) * 12.5 AS f, -99::DOUBLE AS e FROM lineitem")
_formulas("fn_date_parts", "orders", ["o_orderkey"], {"y": "=YEAR([o_orderdate])", "m": "=MONTH([o_orderdate])", "d": "=DAY([o_orderdate])"},
    "SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) AS y, CAST(month(o_orderdate) AS DOUBLE) AS m, CAST(day(o_orderdate) AS DOUBLE) AS d FROM orders")
_formulas("fn_date_serial", "orders", ["o_orderkey"], {"s": "=INT([o_orderdate])", "o": "=DATE(YEAR([o_orderdate]),MONTH([o_orderdate])+14,31)", "z": "=DATE(24,1,1)"},
    """SELECT o_orderkey, CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS DOUBLE) AS s,
    CAST(date_diff('day', DATE '1899-12-30', CAST(date_trunc('month', o_orderdate) + INTERVAL 14 MONTH AS DATE)) + 30 AS DOUBLE) AS o, 45292::DOUBLE AS z FROM orders""")  # fmt: skip
_formulas("fn_logic_if_iferror", "customer", ["c_custkey"], {"b": '=IF([c_acctbal]<0,"debt",IF(AND([c_acctbal]>5000,[c_nationkey]<10),"gold","plain"))', "x": "=IFERROR([c_acctbal]/([c_nationkey]-3),-1)", "n": "=NOT(OR([c_nationkey]=1,[c_nationkey]=2))"},
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 AND c_nationkey < 10 THEN 'gold' ELSE 'plain' END AS b, CASE WHEN c_nationkey = 3 THEN -1 ELSE c_acctbal / (c_nationkey - 3) END AS x,
    c_nationkey NOT IN (1, 2) AS n FROM customer""")  # fmt: skip
_formulas("fn_compare_coerce", "customer", ["c_custkey"], {"e": '=[c_mktsegment]="building"', "g": "=[c_acctbal]>=[c_nationkey]*100", "t": '=[c_nationkey]="7"'},
    "SELECT c_custkey, lower(c_mktsegment) = 'building' AS e, c_acctbal >= c_nationkey * 100 AS g, c_nationkey = 7 AS t FROM customer")
_formulas("fn_percent_power", "lineitem", ["l_orderkey", "l_linenumber"], {"p": "=[l_extendedprice]*5%", "u": "=-2^2", "r": "=2^3^2", "w": "=POWER([l_discount],2)"},
    "SELECT l_orderkey, l_linenumber, l_extendedprice * 0.05 AS p, 4::DOUBLE AS u, 512::DOUBLE AS r, pow(l_discount, 2) AS w FROM lineitem")


def _q(name: str, sql: str | None, make) -> None:
    query(sql, name)(make)


_q("a1_roundtrip", "SELECT o_orderkey, CAST(o_orderkey % 16384 AS INT) AS back FROM orders",
    lambda s, d: table(s, d, "orders").select("o_orderkey", cells.column_number(cells.column_letters(F.col("o_orderkey") % 16384)).alias("back")))
_q("fn_now_today", "SELECT r_regionkey, true AS same_day FROM region", lambda s, d: with_formulas(table(s, d, "region"), {"n": "=NOW()", "t": "=TODAY()"}, errors=False).select("r_regionkey", (F.floor("n") == F.col("t")).alias("same_day")))
_q("serial_time_format", "SELECT event_id, strftime(ts, '%H:%M:%S') AS t FROM events",
    lambda s, d: table(s, d, "events").select("event_id", cells.serial_time(F.expr("(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts))) / 86400D")).alias("t")))
_q("display_formats", "SELECT o_orderkey, format('{:.2f}%', o_totalprice) AS pct, format('{:.2e}', o_totalprice) AS sci FROM orders",
    lambda s, d: table(s, d, "orders").select("o_orderkey", text.display(F.col("o_totalprice") / 100, "percentage").alias("pct"), text.display(F.col("o_totalprice"), "scientific").alias("sci")))
_q("roman_alpha", "SELECT r_regionkey, ['i', 'ii', 'iii', 'iv', 'v'][r_regionkey + 1] AS roman, chr(97 + r_regionkey) AS alpha FROM region",
    lambda s, d: table(s, d, "region").select("r_regionkey", text.roman(F.col("r_regionkey") + 1).alias("roman"), text.alpha(F.col("r_regionkey") + 1).alias("alpha")))

# --- text

_q("word_char_counts", """
    SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS words, length(text) AS chars, length(regexp_replace(text, '\\s', '', 'g')) AS chars_no_spaces,
    CAST(len(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> '')) AS BIGINT) AS paragraphs FROM documents""",
    lambda s, d: text.counts(table(s, d, "documents"), "doc_id", "text"))
_q("split_paragraphs", "SELECT doc_id, CAST(i - 1 AS INT) AS ord, p AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)",
    lambda s, d: text.paragraphs(table(s, d, "documents"), "doc_id", "text"))
_q("auto_heading", r"""
    WITH l AS (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS l FROM conversations), p AS (SELECT conv_id, turn, CAST(unnest(range(len(l))) AS INT) AS line, trim(unnest(l)) AS t FROM l),
    q AS (SELECT *, len(string_split_regex(t, '\s+')) AS w, NOT regexp_matches(t[1:length(t) - 1], '[.!?;]') AS plain FROM p)
    SELECT conv_id, turn, line, CAST(CASE WHEN t = '' THEN 0 WHEN length(t) < 80 AND upper(t) = t AND length(t) > 3 AND regexp_matches(t, '[A-Z]') AND w <= 15 THEN 1
    WHEN length(t) < 80 AND NOT regexp_matches(t, '(^|\s)[^\sA-Za-z0-9_]*[a-z]') AND plain AND w BETWEEN 2 AND 15 THEN 2 WHEN length(t) < 120 AND regexp_matches(t, '^\d+[.)]\s') AND plain AND w <= 12 THEN 2
    WHEN length(t) < 80 AND ends_with(t, ':') AND w <= 10 THEN 3 ELSE 0 END AS INT) AS level FROM q""",
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "t")).select("conv_id", "turn", "line", text.heading_level(F.col("t")).alias("level")))
_q("autocorrect_replace", "SELECT doc_id, list_aggregate(list_transform(string_split(replace(text, 'the', 'teh'), ' '), lambda w: CASE w WHEN 'teh' THEN 'the' ELSE w END), 'string_agg', ' ') AS text FROM documents",
    lambda s, d: table(s, d, "documents").select("doc_id", text.autocorrect(F.call_function("replace", F.col("text"), F.lit("the"), F.lit("teh"))).alias("text")))
_q("find_whole_word", r"""
    WITH h AS (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w = 'the')) AS hits, text FROM documents)
    SELECT doc_id, CAST(hits AS BIGINT) AS hits FROM h WHERE hits > 0""",
    lambda s, d: text.find(table(s, d, "documents"), "doc_id", "text", "the", whole_word=True).select("doc_id", "hits"))
_q("find_literal", "SELECT doc_id, CAST((length(text) - length(replace(text, 'ing', ''))) / 3 AS BIGINT) AS hits, CAST(instr(text, 'ing') - 1 AS BIGINT) AS first_at FROM documents WHERE contains(text, 'ing')",
    lambda s, d: text.find(table(s, d, "documents"), "doc_id", "text", "ing", match_case=True))
_q("regex_find_offsets", """
    SELECT item_id, CAST(i - 1 AS INT) AS nth, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS at, h[i] AS hit
    FROM (SELECT item_id, regexp_extract_all(text, 'th[a-z]') AS h, string_split_regex(text, 'th[a-z]') AS g, unnest(range(1, 1 + len(regexp_extract_all(text, 'th[a-z]')))) AS i FROM benchmark)""",
    lambda s, d: text.find_offsets(table(s, d, "benchmark"), "item_id", "text", "th[a-z]"))
_q("replace_all", "SELECT item_id, replace(text, 'the', '<$1>') AS text FROM benchmark",
    lambda s, d: table(s, d, "benchmark").select("item_id", text.replace_all(F.col("text"), "the", "<$1>", match_case=True).alias("text")))
_q("positional_diff", """
    WITH a AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations WHERE turn = 0),
    b AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations WHERE turn = 1)
    SELECT conv_id, count(*) FILTER (a.l = b.l) AS same, count(*) FILTER (b.l IS NOT NULL AND a.l IS DISTINCT FROM b.l) AS added, count(*) FILTER (a.l IS NOT NULL AND a.l IS DISTINCT FROM b.l) AS removed
    FROM a FULL JOIN b USING (conv_id, i) GROUP BY conv_id""",
    lambda s, d: text.line_diff(table(s, d, "conversations").where("turn = 0"), table(s, d, "conversations").where("turn = 1"), "conv_id", "text"))
_q("version_word_delta", """
    WITH w AS (SELECT conv_id, turn, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS words FROM conversations)
    SELECT conv_id, turn, words, words - first_value(words) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS delta FROM w""",
    lambda s, d: text.version_deltas(table(s, d, "conversations"), "conv_id", "turn", "text"))
_q("text_to_columns", "SELECT p_partkey, trim(split_part(p_name, ' ', 1)) AS part1, CASE WHEN len(string_split(p_name, ' ')) >= 2 THEN trim(split_part(p_name, ' ', 2)) END AS part2 FROM part",
    lambda s, d: text.text_to_columns(table(s, d, "part"), "p_name", " ", 2, "part").select("p_partkey", "part1", "part2"))
_q("script_mix", r"SELECT doc_id, CAST(length(regexp_replace(text, '[^\p{Latin}]', '', 'g')) AS BIGINT) AS latin, CAST(length(regexp_replace(text, '[^\p{Greek}]', '', 'g')) AS BIGINT) AS greek FROM documents",
    lambda s, d: text.script_counts(table(s, d, "documents"), ["doc_id"], "text").select("doc_id", "latin", "greek"))

# --- formats of texts

_SIGNS = "[',', chr(9), ';', '|', ' ']"
_FIELDS = f"(SELECT p_partkey AS id, p_partkey % 5 AS k, {_SIGNS}[p_partkey % 5 + 1] AS s, [[p_name, p_type, p_brand], [CAST(p_partkey AS VARCHAR), CAST(p_size AS VARCHAR), 'q'], [p_brand, '', '2']] AS f FROM part)"


def _texts(spark: SparkSession, d: str, quoted: bool = False) -> DataFrame:
    """A text a part: three lines of three fields behind each other, set apart by a sign of five in turn; with quotes, the last field of all holds the sign and a quote."""
    last = "case when p_partkey % 5 < 4 then concat('\"2', s, '\"\"\"') else '2' end" if quoted else "'2'"
    lines = f"concat_ws('\\n', concat_ws(s, p_name, p_type, p_brand), concat_ws(s, p_partkey, p_size, 'q'), concat_ws(s, p_brand, '', {last}))"
    return table(spark, d, "part").withColumn("s", F.expr("element_at(array(',', '\\t', ';', '|', ' '), cast(p_partkey % 5 + 1 as int))")).selectExpr("p_partkey as id", f"{lines} as text")


_q("detect_delimiter", f"SELECT id, CASE WHEN k < 4 THEN s ELSE ',' END AS sign FROM {_FIELDS}",
    lambda s, d: _texts(s, d).select("id", detect.detect_delimiter(F.col("text")).alias("sign")))
_q("looks_like_csv", r"""
    WITH l AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '\n$', ''), chr(10))[1:10], lambda x: length(x) - length(replace(x, ',', ''))) AS n FROM documents)
    SELECT doc_id, coalesce(len(n) >= 2 AND n[1] >= 1 AND len(list_filter(n, lambda k: k = n[1])) * 100 >= len(n) * 70, false) AS csv FROM l""",
    lambda s, d: table(s, d, "documents").select("doc_id", detect.looks_like_csv(F.col("text")).alias("csv")))
_q("looks_like_markdown", r"""
    SELECT conv_id, turn, coalesce(list_sum(list_transform(list_transform(string_split(text, chr(10))[1:30], lambda x: trim(x)), lambda x: CASE WHEN starts_with(x, '#') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(x, '^(- |\* |1\. )') THEN 1 ELSE 0 END
    + CASE WHEN contains(x, '](') THEN 2 ELSE 0 END + CASE WHEN starts_with(x, '```') THEN 2 ELSE 0 END + CASE WHEN contains(x, '**') OR contains(x, '__') THEN 1 ELSE 0 END)), 0) >= 3 AS md
    FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '# ' || text WHEN 1 THEN '- a' || chr(10) || '1. ' || text || chr(10) || '* __c__' WHEN 2 THEN '2. a' || chr(10) || '+ [x](y)' ELSE text END AS text FROM conversations)""",
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", detect.looks_like_markdown(F.expr("case turn % 4 when 0 then concat('# ', text) when 1 then concat('- a\\n1. ', text, '\\n* __c__') when 2 then '2. a\\n+ [x](y)' else text end")).alias("md")))
_q("csv_escape_row", """
    SELECT doc_id, CASE WHEN regexp_matches(text, '[",\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END || ',' || lang || ',' || doc_id AS line FROM documents""",
    lambda s, d: table(s, d, "documents").select("doc_id", delimited.csv_line([F.col("text"), F.col("lang"), F.col("doc_id").cast("string")]).alias("line")))
_q("formula_injection_escape", "SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+@|\\t\\r-]') THEN '''' || text ELSE text END AS safe FROM documents",
    lambda s, d: table(s, d, "documents").select("doc_id", cells.escape_formula(F.col("text")).alias("safe")))
_q("type_infer", r"""
    WITH v AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN CAST(conv_id AS VARCHAR) WHEN 1 THEN 'TRUE' WHEN 2 THEN '=A1+' || turn ELSE text END AS t FROM conversations)
    SELECT conv_id, turn, CASE WHEN coalesce(t, '') = '' THEN 'empty' WHEN starts_with(t, '=') OR starts_with(t, '{=') THEN 'formula' WHEN lower(t) IN ('true', 'false') THEN 'boolean'
    WHEN regexp_matches(t, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$') THEN 'number' ELSE 'string' END AS kind FROM v""",
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", cells.infer_type(F.expr("case turn % 4 when 0 then cast(conv_id as string) when 1 then 'TRUE' when 2 then concat('=A1+', turn) else text end")).alias("kind")))
_q("format_by_name", "SELECT url, CASE WHEN regexp_matches(url, '\\.md$') THEN 'md' END AS format FROM (SELECT 'x/' || page_id || CASE WHEN page_id % 2 = 0 THEN '.md' ELSE '.bin' END AS url FROM pages)",
    lambda s, d: table(s, d, "pages").select(F.expr("concat('x/', page_id, case when page_id % 2 = 0 then '.md' else '.bin' end)").alias("url")).select("url", detect.format_by_name(F.col("url")).alias("format")))
_q("csv_cells", f"""
    WITH r AS (SELECT id, k, s, CAST(unnest([0, 1, 2]) AS INT) AS row, unnest(f) AS f FROM {_FIELDS})
    SELECT id, row, CAST(unnest([0, 1, 2]) AS INT) AS col, unnest([f[1], f[2], CASE WHEN row = 2 THEN '2' || s || '"' ELSE f[3] END]) AS value FROM r WHERE k < 4
    UNION ALL SELECT id, row, 0, f[1] || s || f[2] || s || f[3] FROM r WHERE k = 4""",
    lambda s, d: delimited.cells_of_texts(_texts(s, d, True), "id", "text"))
_q("csv_model_roundtrip", f"""
    SELECT CAST(id AS VARCHAR) AS doc_id, f[1][1] || s || f[1][2] || s || f[1][3] || chr(10) || f[2][1] || s || f[2][2] || s || f[2][3] || chr(10) || f[3][1] || s || s || l AS text
    FROM (SELECT id, f, CASE WHEN k < 4 THEN ',' ELSE s END AS s, CASE WHEN k < 4 THEN chr(34) || '2' || s || repeat(chr(34), 3) ELSE '2' END AS l FROM {_FIELDS})""",
    lambda s, d: store.tables_csv(store.table_nodes(delimited.cells_of_texts(_texts(s, d, True), "id", "text"), "id")))
_q("table_to_csv", "SELECT 's' AS sheet, string_agg(r_regionkey || ',' || r_name, chr(10) ORDER BY r_regionkey) AS text FROM region",
    lambda s, d: delimited.table_text(_region_cells(s, d), ["sheet"]))
_q("text_table_import", f"""
    SELECT id, CAST(unnest([0, 1, 2]) AS INT) AS row, unnest([f[1], f[2], [f[3][1], f[3][2], '2,"']]) AS cells, unnest([true, false, false]) AS header FROM {_FIELDS} WHERE k = 0
    UNION ALL SELECT id, CAST(unnest([0, 1, 2]) AS INT), unnest(f), unnest([true, false, false]) FROM {_FIELDS} WHERE k BETWEEN 1 AND 3""",
    lambda s, d: delimited.text_table(_texts(s, d, True).where("id % 5 in (0, 4)").unionByName(_texts(s, d).where("id % 5 not in (0, 4)")), "id", "text"))


def _region_cells(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.tableops import to_cells

    return to_cells(table(spark, d, "region"), ["r_regionkey", "r_name"], "r_regionkey").withColumn("sheet", F.lit("s"))
