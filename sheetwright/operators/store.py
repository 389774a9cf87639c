"""A document store on Parquet, defined names, and a builder of document trees."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formula.parse import column_index


class Store:
    """Versions of documents in an append-only table (id, name, updated_at, deleted, content); the newest one counts."""

    SCHEMA = "id string, name string, updated_at timestamp, deleted boolean, content string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def put(self, rows: DataFrame) -> None:
        """Add versions of documents(id, name, updated_at, content)."""
        rows.withColumn("deleted", F.lit(False)).select("id", "name", "updated_at", "deleted", "content").write.mode("append").parquet(self.path)

    def delete(self, ids: DataFrame, at) -> None:
        """Mark documents(id) deleted; their versions stay."""
        ids.select("id", F.lit(None).cast("string").alias("name"), F.lit(at).cast("timestamp").alias("updated_at"), F.lit(True).alias("deleted"), F.lit(None).cast("string").alias("content")).write.mode("append").parquet(self.path)

    def current(self) -> DataFrame:
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        last = rows.groupBy("id").agg(F.max_by(F.struct("name", "updated_at", "deleted", "content"), F.struct("updated_at", F.col("deleted").cast("int"))).alias("r"))
        return last.where("not r.deleted").select("id", "r.name", "r.updated_at", "r.content")

    def get(self, ids: list[str]) -> DataFrame:
        return self.current().where(F.col("id").isin(ids))

    def listed(self, offset: int, limit: int) -> DataFrame:
        """A page of (id, name, updated_at), newest first, with the number of all."""
        rows = self.current().select("id", "name", "updated_at")
        total = rows.agg(F.count(F.lit(1)).alias("total"))
        return rows.orderBy(F.col("updated_at").desc(), "id").offset(offset).limit(limit).join(F.broadcast(total))  # one row


def expand_names(formula: str, names: dict[str, str], passes: int = 10) -> str:
    """The formula with defined names replaced by what they stand for, names in names too; names in a circle stop after `passes`."""
    lower = {k.lower(): v.lstrip("=") for k, v in names.items()}

    def swap(m: re.Match) -> str:
        return lower.get(m[0].lower(), m[0])

    for _ in range(passes):
        before = formula

        parts = re.split(r'("(?:[^"]|"")*"|\[[^\]]*\])', formula)
        formula = "".join(p if i % 2 else re.sub(r"(?<![A-Za-z0-9_.$!])[A-Za-z_][A-Za-z0-9_.]*(?![A-Za-z0-9_.(!])", swap, p) for i, p in enumerate(parts))
        if formula == before:
            break
    return formula


def read_range(cells: DataFrame, address: str, default_sheet: str | None = None) -> DataFrame:
    """Cells of an address such as Sheet2!A1:B3; names of sheets that aren't there give no rows."""
    sheet, _, area = address.rpartition("!")
    a, _, b = area.replace("$", "").partition(":")
    corner = [(column_index(re.match(r"[A-Za-z]+", x)[0]), int(re.search(r"\d+", x)[0]) - 1) for x in (a, b or a)]
    (c1, r1), (c2, r2) = corner
    box = F.col("col").between(min(c1, c2), max(c1, c2)) & F.col("row").between(min(r1, r2), max(r1, r2))
    name = sheet.strip("'") or default_sheet
    return cells.where(box & (F.col("sheet") == name) if name else box)


class Builder:
    """A document tree put together on the driver: headings, paragraphs, lists, tables."""

    def __init__(self, doc_id: str) -> None:
        self.doc_id = doc_id
        self.rows: list[tuple] = [(doc_id, "0", None, 0, [0], 0, "Body", None, {})]
        self.at = 0

    def _add(self, kind: str, text: str | None, attrs: dict[str, str], parent: tuple[int, ...] = (0,), pos: int | None = None) -> tuple[int, ...]:
        path = (*parent, self.at if pos is None else pos)
        self.at += pos is None
        self.rows.append((self.doc_id, ".".join(map(str, path)), ".".join(map(str, parent)), path[-1], list(path), len(path) - 1, kind, text, attrs))
        return path

    def heading(self, level: int, text: str) -> Builder:
        self._add("Paragraph", text, {"StyleId": f"Heading{level}"})
        return self

    def paragraph(self, text: str) -> Builder:
        self._add("Paragraph", text, {})
        return self

    def items(self, texts: list[str], ordered: bool = False, level: int = 0) -> Builder:
        for t in texts:
            self._add("Paragraph", t, {"ListFormat": "decimal" if ordered else "bullet", "ListLevel": str(level)})
        return self

    def table(self, rows: list[list[str]]) -> Builder:
        top = self._add("Table", None, {})
        for r, row in enumerate(rows):
            line = self._add("TableRow", None, {}, top, r)
            for c, text in enumerate(row):
                self._add("Paragraph", text, {}, self._add("TableCell", None, {}, line, c), 0)
        return self

    def build(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "doc_id string, node_id string, parent_id string, pos int, path array<int>, depth int, type string, text string, attrs map<string,string>")


def table_nodes(cells: DataFrame, key: str) -> DataFrame:
    """The nodes of documents that hold one table each, of parsed cells(key, row, col, value); each cell is a paragraph.

    Rows begin at column 0 and tables at row 0, as parsers give them: a first cell brings the nodes above it, in one pass.
    """
    row, col, zero = F.col("row").cast("int"), F.col("col").cast("int"), F.lit(0)
    none = F.lit(None).cast("string")

    def node(kind: str, path: list[Column], text: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.array(*path).alias("path"), text.alias("text"))

    first = (row == 0) & (col == 0)
    made = F.array(
        F.when(first, node("Body", [zero])), F.when(first, node("Table", [zero, zero])), F.when(col == 0, node("TableRow", [zero, zero, row])),
        node("TableCell", [zero, zero, row, col]), node("Paragraph", [zero, zero, row, col, zero], F.col("value")),
    )
    rows = cells.select(F.col(key).cast("string").alias("doc_id"), F.explode(made).alias("n")).where("n is not null").select("doc_id", "n.*")
    above = F.when(F.size("path") > 1, F.array_join(F.slice("path", 1, F.size("path") - 1), "."))
    return rows.select("doc_id", F.array_join("path", ".").alias("node_id"), above.alias("parent_id"), F.element_at("path", -1).alias("pos"), "path", (F.size("path") - 1).alias("depth"), "type", "text", F.expr("cast(map() as map<string,string>)").alias("attrs"))


def tables_csv(nodes: DataFrame, delimiter: str = ",") -> DataFrame:
    """(doc_id, text): every table of a document as CSV, tables apart by an empty line."""
    from ..sources.delimited import quote

    cells = nodes.where("type = 'Paragraph'").where(F.size("path") >= 5)
    cells = cells.select("doc_id", F.slice("path", 1, F.greatest(F.size("path") - 3, F.lit(0))).alias("t"), F.try_element_at("path", F.lit(-3)).alias("r"), F.try_element_at("path", F.lit(-2)).alias("c"), F.try_element_at("path", F.lit(-1)).alias("p"), "text")
    cell = cells.groupBy("doc_id", "t", "r", "c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "text"))), lambda x: x["text"]), " ").alias("v"))
    line = cell.groupBy("doc_id", "t", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", quote(F.col("v"), delimiter).alias("q")))), lambda x: x["q"]), delimiter).alias("l"))
    table = line.groupBy("doc_id", "t").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "l"))), lambda x: x["l"]), "\n").alias("s"))
    return table.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "s"))), lambda x: x["s"]), "\n\n").alias("text"))


def statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """Words, characters and paragraphs of texts, as the package's `stats`."""
    from .text import counts

    return counts(df, key, text)


__all__ = ["Builder", "Store", "expand_names", "read_range", "statistics", "tables_csv"]
