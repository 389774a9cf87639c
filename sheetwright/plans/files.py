"""Queries over what office files hold beside cells and blocks: written from the tables, read back from the bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import layout, office
from .registry import query, table


def _cells(part: DataFrame) -> DataFrame:
    none = {n: f"cast(null as {t})" for n, t in (c.split() for c in office.CELLS.split(", "))}
    made = none | {"workbook_id": "p_brand", "sheet": "'s'", "row": "cast(p_partkey as int)", "col": "0", "kind": "'text'", "txt": "p_name"}
    return part.selectExpr(*[f"{e} as {n}" for n, e in made.items()])


def _layout(part: DataFrame) -> DataFrame:
    def rows(df: DataFrame, kind: str, r1: str, c1: str, r2: str, c2: str, size: str) -> DataFrame:
        named = zip(("row1", "col1", "row2", "col2"), (r1, c1, r2, c2), strict=True)
        return df.selectExpr("p_brand as workbook_id", "'s' as sheet", f"'{kind}' as kind", *[f"cast({e} as int) as {n}" for n, e in named], f"cast({size} as double) as size")

    at = "p_partkey"
    sheets = part.select("p_brand").distinct()
    return (
        rows(part, "row", at, "null", at, "null", "p_size + 12.5")
        .unionByName(rows(part, "merge", at, "1", at, "2 + p_size % 3", "null"))
        .unionByName(rows(part.select("p_brand", "p_size").distinct(), "column", "null", "p_size", "null", "p_size", "p_size + 8.25"))
        .unionByName(rows(sheets, "pane", "1", "2", "1", "2", "null"))
    )


def _formats(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        "p_brand as workbook_id", "'s' as sheet", "cast(p_partkey as int) as row", "cast(p_size % 2 as int) as col", "case p_size % 3 when 0 then '0.00' when 1 then 'yyyy\"-\"mm' else 'General' end as number_format",
        "case when p_size % 5 > 0 then 'Serif' end as font", "case when p_size % 4 > 0 then p_size / 2D end as font_size", "p_size > 25 as bold", "p_size % 7 = 0 as italic", "case when p_size < 9 then 'FF0000FF' end as color",
        "case when p_size > 40 then 'FFFFEE00' end as fill", "case when p_size % 2 = 0 then 'center' end as horizontal", "case when p_size % 6 = 0 then 'top' end as vertical", "p_size % 10 = 0 as wrap",
    )


def _books(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return layout.write_styled_workbooks(_cells(part), _layout(part), _formats(part)).select(F.col("workbook_id").alias("path"), F.lit("xlsx").alias("format"), "content")


@query("""
SELECT p_brand AS workbook_id, 's' AS sheet, 'row' AS kind, CAST(p_partkey AS INT) AS row1, CAST(NULL AS INT) AS col1, CAST(p_partkey AS INT) AS row2, CAST(NULL AS INT) AS col2, p_size + 12.5::DOUBLE AS size FROM part
UNION ALL SELECT p_brand, 's', 'merge', p_partkey, 1, p_partkey, 2 + p_size % 3, NULL FROM part
UNION ALL SELECT DISTINCT p_brand, 's', 'column', NULL, p_size, NULL, p_size, p_size + 8.25 FROM part
UNION ALL SELECT DISTINCT p_brand, 's', 'pane', 1, 2, 1, 2, NULL FROM part
""")
def xlsx_layout(spark: SparkSession, d: str) -> DataFrame:
    """Widths, heights, merges and panes of the workbooks of the parts, one a brand."""
    return layout.read_layout(_books(spark, d))


@query("""
SELECT p_brand AS workbook_id, 's' AS sheet, CAST(p_partkey AS INT) AS row, CAST(p_size % 2 AS INT) AS col, CASE p_size % 3 WHEN 0 THEN '0.00' WHEN 1 THEN 'yyyy"-"mm' ELSE 'General' END AS number_format,
CASE WHEN p_size % 5 > 0 THEN 'Serif' END AS font, CASE WHEN p_size % 4 > 0 THEN p_size / 2 END AS font_size, p_size > 25 AS bold, p_size % 7 = 0 AS italic, CASE WHEN p_size < 9 THEN 'FF0000FF' END AS color,
CASE WHEN p_size > 40 THEN 'FFFFEE00' END AS fill, CASE WHEN p_size % 2 = 0 THEN 'center' END AS horizontal, CASE WHEN p_size % 6 = 0 THEN 'top' END AS vertical, p_size % 10 = 0 AS wrap FROM part
""")
def xlsx_formats(spark: SparkSession, d: str) -> DataFrame:
    """Number formats, fonts, fills and alignments of the parts' cells."""
    return layout.read_formats(_books(spark, d))


@query("SELECT p_brand AS workbook_id, CAST(p_partkey AS INT) AS row, p_name AS txt FROM part")
def xlsx_styled_cells(spark: SparkSession, d: str) -> DataFrame:
    """The texts of workbooks that hold layouts and formats."""
    return office.read_workbooks(_books(spark, d)).where("kind = 'text'").select("workbook_id", "row", "txt")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """A document a conversation: a paragraph a turn of two runs, a comment and a footnote a turn, a section, two lists."""
    said = table(spark, d, "conversations").withColumn("path", F.col("conv_id").cast("string")).withColumn("ord", F.col("turn").cast("int"))
    text = said.selectExpr("path", "ord", "0 as nth", "text", "role = 'user' as bold", "turn % 3 = 0 as italic", "false as underline", "turn % 4 = 1 as strike", "'Sans' as font", "10.5D as font_size", "cast(null as string) as color", "case turn % 3 when 1 then 'Insert' when 2 then 'Delete' end as revision", "case when turn % 3 > 0 then role end as author", "case when turn % 3 = 1 then '2024-05-01T00:00:00Z' end as date")
    mark = text.selectExpr("path", "ord", "1 as nth", "concat('[', ord, ']') as text", "false as bold", "false as italic", "true as underline", "false as strike", "cast(null as string) as font", "cast(null as double) as font_size", "'336699' as color", "cast(null as string) as revision", "cast(null as string) as author", "cast(null as string) as date")
    comments = said.selectExpr("path", "cast(turn as string) as comment_id", "case when turn > 0 then '0' end as parent_id", "role as author", "cast(null as string) as date", "text")
    notes = said.selectExpr("path", "case when turn % 2 = 0 then 'footnote' else 'endnote' end as kind", "cast(turn as string) as note_id", "concat(role, ' ', turn) as text")
    first = said.where("turn = 0")
    numbering = first.selectExpr("path", "cast(conv_id as int) + 1 as num_id", "0 as level", "'decimal' as format", "'%1.' as shown", "cast(conv_id % 5 as int) as start")
    sections = first.selectExpr("path", "0 as section", "612D as width", "792D + conv_id % 3 as height", "72D as top", "72D as bottom", "90D as left", "cast(null as double) as right", "cast(1 + conv_id % 2 as int) as columns", "'continuous' as start")
    props = first.selectExpr("path", "'title' as name", "concat('c', conv_id) as value")
    made = layout.write_rich_documents(text.unionByName(mark), comments, notes, numbering, sections, props)
    return made.select("path", F.lit("docx").alias("format"), "content")


_TEXT = "CASE WHEN text <> '' THEN text ELSE '' END"


@query(f"""
SELECT CAST(conv_id AS VARCHAR) AS path, CAST(turn AS INT) AS ord, 0 AS nth, md5({_TEXT}) AS h, role = 'user' AS bold, turn % 3 = 0 AS italic, false AS underline, turn % 4 = 1 AS strike, 'Sans' AS font, 10.5::DOUBLE AS font_size, NULL AS color,
CASE turn % 3 WHEN 1 THEN 'Insert' WHEN 2 THEN 'Delete' END AS revision, CASE WHEN turn % 3 > 0 THEN role END AS author, CASE WHEN turn % 3 = 1 THEN '2024-05-01T00:00:00Z' END AS date FROM conversations
UNION ALL SELECT CAST(conv_id AS VARCHAR), turn, 1, md5('[' || turn || ']'), false, false, true, false, NULL, NULL, '336699', NULL, NULL, NULL FROM conversations
""")
def docx_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs with their formats and tracked changes."""
    return layout.read_runs(_documents(spark, d)).withColumn("text", F.md5(F.encode("text", "UTF-8"))).withColumnRenamed("text", "h")


@query("SELECT CAST(conv_id AS VARCHAR) AS path, CAST(turn AS VARCHAR) AS comment_id, CASE WHEN turn > 0 THEN '0' END AS parent_id, role AS author, md5(coalesce(text, '')) AS h FROM conversations")
def docx_comments(spark: SparkSession, d: str) -> DataFrame:
    """Threaded comments."""
    return layout.read_comments(_documents(spark, d)).select("path", "comment_id", "parent_id", "author", F.md5(F.encode("text", "UTF-8")).alias("h"))


@query("SELECT CAST(conv_id AS VARCHAR) AS path, CASE WHEN turn % 2 = 0 THEN 'footnote' ELSE 'endnote' END AS kind, CAST(turn AS VARCHAR) AS note_id, role || ' ' || turn AS text FROM conversations")
def docx_notes(spark: SparkSession, d: str) -> DataFrame:
    """Foot- and endnotes."""
    return layout.read_notes(_documents(spark, d))


@query("""
SELECT CAST(conv_id AS VARCHAR) AS path, CAST(conv_id AS INT) + 1 AS num_id, 0 AS level, 'decimal' AS format, '%1.' AS shown, CAST(conv_id % 5 AS INT) AS start, 612::DOUBLE AS width, 792::DOUBLE + conv_id % 3 AS height, 90::DOUBLE AS left_edge,
CAST(1 + conv_id % 2 AS INT) AS columns, 'c' || conv_id AS title FROM conversations WHERE turn = 0
""")
def docx_setup(spark: SparkSession, d: str) -> DataFrame:
    """Lists, page set-up and title of each document."""
    setup = layout.read_setup(_documents(spark, d)).select("path", F.explode("numbering").alias("n"), "sections", "properties")
    setup = setup.select("path", "n", F.explode("sections").alias("s"), "properties").select("path", "n", "s", F.explode(F.filter("properties", lambda p: p["name"] == "title")).alias("p"))
    return setup.select("path", "n.*", "s.width", "s.height", F.col("s.left").alias("left_edge"), "s.columns", F.col("p.value").alias("title"))
