"""Small cases written out by hand: trees, lists, revisions, tables in texts, workbooks."""

import pytest
from pyspark.sql import functions as F

from sheetwright.functions.formula import recalculate_frame
from sheetwright.operators import doctree, pages, store
from sheetwright.sources import delimited, detect, markup, office

MARKED = [("1", "# One\ntext\n## Two\n1. a\n1. b\n  1. c\n1. d\nx\n1. e\n- f\n---"), ("2", "plain"), ("3", "### Three\n#### Four")]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def marked(spark):
    return doctree.from_text(spark.createDataFrame(MARKED, "doc_id string, text string"), "doc_id", "text")


def test_headings_and_lists(marked):
    assert rows(doctree.headings(marked).select("doc_id", "level", "text")) == [("1", 1, "One"), ("1", 2, "Two"), ("3", 3, "Three"), ("3", 4, "Four")]
    assert rows(doctree.toc_entries(marked)) == [("1", 1, "TOC1", "One"), ("1", 2, "TOC2", "Two"), ("3", 1, "TOC3", "Three")]
    assert rows(doctree.list_counters(marked)) == [("1", "0.3", 0, 1), ("1", "0.4", 0, 2), ("1", "0.5", 1, 1), ("1", "0.6", 0, 3), ("1", "0.8", 0, 1)]


TREE = [
    ("a", None, [0], "Body", {}), ("b", "a", [0, 0], "Paragraph", {"RevisionType": "Insert", "RevisionAuthor": "x", "RevisionDate": "2024"}), ("b1", "b", [0, 0, 0], "Run", {}),
    ("c", "a", [0, 1], "TableRow", {"RevisionType": "Delete", "RevisionAuthor": "y"}), ("c1", "c", [0, 1, 0], "TableCell", {}), ("e", "a", [0, 2], "Paragraph", {"RevisionType": "FormatChange", "Bold": "1"}),
]


def test_revisions(spark):
    tree = spark.createDataFrame([("d", n, p, path[-1], path, len(path) - 1, t, n, a) for n, p, path, t, a in TREE], "doc_id string, node_id string, parent_id string, pos int, path array<int>, depth int, type string, text string, attrs map<string,string>")
    assert rows(doctree.tracked_changes(tree).select("node_id", "kind")) == [("b", "Insert"), ("c", "Delete"), ("e", "FormatChange")]
    assert rows(doctree.settle_changes(tree, True).select("node_id")) == [("a",), ("b",), ("b1",), ("e",)]
    assert rows(doctree.settle_changes(tree, False).select("node_id")) == [("a",), ("c",), ("c1",), ("e",)]
    assert rows(doctree.selection(tree, [0, 0, 0], [0, 1, 0]).select("node_id")) == [("b1",), ("c",), ("c1",)]
    roots = spark.createDataFrame([("d", "a"), ("d", "b")], "doc_id string, root_id string")
    assert rows(doctree.within(tree, roots).select("root_id", "node_id")) == [("a", "b"), ("a", "b1"), ("a", "c"), ("a", "c1"), ("a", "e"), ("b", "b1")]


TABLES = {
    1: ("a,b\n\n1,2", [(0, ["a", "b"], True), (1, ["1", "2"], False)]),
    2: ('x,"y, ""z"""\n"open,1', [(0, ["x", 'y, "z"'], False), (1, ["open,1"], False)]),
    3: ("|n|v|\n|---|:-:|\n| 10 | 02 |", [(0, ["n", "v"], True), (1, ["10", "02"], False)]),
    4: ("1;2\n3;4", [(0, ["1", "2"], False), (1, ["3", "4"], False)]),
    5: ("a\tb|c\nd|e", [(0, ["a", "b|c"], False), (1, ["d|e"], False)]),
    6: ("a,b\nno sign", []), 7: ("a,b", []), 8: ("", []), 9: (None, []),
    10: ("a,b,\n1,,2", [(0, ["a", "b", ""], True), (1, ["1", "", "2"], False)]),
    11: ("a,b\n" + "x" * 200_000 + ",1", [(0, ["a", "b"], True), (1, ["x" * 200_000, "1"], False)]),
}


def test_tables_in_texts(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in TABLES.items()], "id int, text string")
    want = [(k, *r) for k, (_, found) in TABLES.items() for r in found]
    assert rows(delimited.text_table(df, "id", "text")) == want


def test_delimiters(spark):
    texts = [(1, "a,b,c\n1,2,3"), (2, "x;y\n1;2"), (3, "p\tq\tr\n1\t2\t3"), (4, "plain words"), (5, "u|v\n|1|2\n"), (6, "a,b\nlonely\nother"), (7, "")]
    df = spark.createDataFrame(texts, "id int, text string")
    assert [s for _, s in rows(df.select("id", detect.detect_delimiter(F.col("text"))))] == [",", ";", "\t", ",", "|", ",", ","]
    assert rows(delimited.cells_of_texts(df.where("id in (5, 6)"), "id", "text", ","))[-2:] == [(6, 1, 0, "lonely"), (6, 2, 0, "other")]


def test_workbook_with_errors(spark):
    cells = [("w", "S", 0, 0, "number", 2.0, None, None, None, None), ("w", "S", 1, 0, "number", 3.0, None, None, None, None), ("w", "S", 0, 1, "empty", None, None, None, None, "=SUM(A1:A2)*2"), ("w", "S", 1, 1, "empty", None, None, None, None, "=B1/0"), ("w", "T", 0, 0, "empty", None, None, None, None, '=IFERROR(S!B2,"bad")&S!B1')]
    book = recalculate_frame(spark.createDataFrame(cells, office.CELLS))
    want = [("S", 0, 0, "number", 2.0, None), ("S", 0, 1, "number", 10.0, None), ("S", 1, 0, "number", 3.0, None), ("S", 1, 1, "error", None, None), ("T", 0, 0, "text", None, "bad10")]
    again = office.read_workbooks(office.write_workbooks(book, "xlsx").select(F.col("workbook_id").alias("path"), F.lit("xlsx").alias("format"), "content"))
    for df in (book, again):
        assert rows(df.select("sheet", "row", "col", "kind", "num", "txt")) == want


def test_markup(spark):
    df = spark.createDataFrame([(1, "# T\n\n- a\n  - b\n\nend")], "id int, text string")
    assert markup.write_markdown(markup.read_markdown(df, "id", "text"), "id").first()["text"] == "# T\n\n- a\n  - b\n\nend"


def test_ranges(spark):
    marks = spark.createDataFrame([("d", 0, "x"), ("d", 1, "a\x07b\x07"), ("d", 2, "c\x07"), ("d", 3, "y"), ("d", 4, "z\x07")], "doc_id string, ord int, text string")
    assert rows(pages.table_ranges(marks)) == [("d", 1, 2, 3), ("d", 4, 4, 1)]
    cells = spark.createDataFrame([("S", 0, 1), ("T", 0, 1), ("T", 1, 1), ("T", 2, 1), ("T", 0, 0)], "sheet string, row int, col int")
    assert rows(store.read_range(cells, "T!$B$1:B2").select("row", "col")) == [(0, 1), (1, 1)]
