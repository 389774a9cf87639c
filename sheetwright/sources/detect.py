"""What kind of file a text or some bytes are: magic bytes, extensions, text heuristics; all as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXTENSIONS = {"docx": "docx", "odt": "odt", "pdf": "pdf", "txt": "txt", "text": "txt", "md": "md", "markdown": "md", "doc": "doc", "csv": "csv", "tsv": "csv", "xlsx": "xlsx", "ods": "ods"}


def format_by_name(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for p in EXTENSIONS.items() for x in p]), ext)


def lines_of(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _commas(line: Column, sign: str) -> Column:
    """How often a sign of one byte occurs."""
    return F.octet_length(line) - F.octet_length(F.call_function("replace", line, F.lit(sign), F.lit("")))


def _first_lines(text: Column, n: int) -> Column:
    """Lines end with LF or CRLF; the last line end begins no other.  What follows the first lines is cut before any is split."""
    head = F.substring_index(text, "\n", n + 1)
    end = F.when(head.endswith("\n"), 1).otherwise(0)
    lines = once(F.split(head, r"\r?\n", -1), lambda x: F.slice(x, F.lit(1), F.least(F.lit(n), F.size(x) - end)))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(lines)


def looks_like_csv(text: Column) -> Column:
    """At least two of the first ten lines, a comma in the first, and seven in ten lines with as many commas as it; blank lines count."""

    def decide(n: Column) -> Column:
        first = F.get(n, F.lit(0))
        return (F.size(n) >= 2) & (first >= 1) & (F.size(F.filter(n, lambda k: k == first)) * 100 >= F.size(n) * 70)

    return F.coalesce(once(F.transform(_first_lines(text, 10), lambda x: _commas(x, ",")), decide), F.lit(False))


def looks_like_markdown(text: Column) -> Column:
    """Marks of the first thirty lines, weighed: # at the begin 2, list mark 1, link 2, fence 2, bold or italic 1; three are enough."""
    weight = lambda x: (
        F.when(x.startswith("#"), 2).otherwise(0) + F.when(x.startswith("- ") | x.startswith("* ") | x.startswith("1. "), 1).otherwise(0) + F.when(x.contains("]("), 2).otherwise(0)
        + F.when(x.startswith("```"), 2).otherwise(0) + F.when(x.contains("**") | x.contains("__"), 1).otherwise(0)
    )
    trimmed = F.transform(_first_lines(text, 30), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(F.aggregate(trimmed, F.lit(0), lambda a, x: a + weight(x)) >= 3, F.lit(False))


def detect_delimiter(text: Column) -> Column:
    """Of comma, tab, semicolon and pipe the one whose count is most even over ten lines, times its mean count; ties to the earlier, else comma."""
    lines = F.slice(F.filter(lines_of(text), lambda x: x != ""), 1, 10)

    def score(sign: str) -> Column:
        n = F.transform(lines, lambda x: _commas(x, sign))
        first = F.get(n, F.lit(0))
        even = F.size(F.filter(n, lambda k: k == first)) / F.size(lines)
        mean = F.aggregate(n, F.lit(0), lambda a, k: a + k) / F.size(lines)
        return F.when((F.size(lines) > 0) & (first > 0), even * mean).otherwise(0.0)

    scored = [(s, score(s)) for s in (",", "\t", ";", "|")]
    best = F.greatest(*[c for _, c in scored])
    out: Column | None = None
    for s, c in scored:
        out = F.when((c == best) & (c > 0), s) if out is None else out.when((c == best) & (c > 0), s)
    return out.otherwise(",")


def format_of_bytes(content: Column) -> Column:
    """doc, zip, pdf or text by the first bytes; archives are told apart by the names they list."""
    head = F.hex(F.substring(content, 1, 8))
    names = F.decode(content, "ISO-8859-1")
    zipped = F.when(names.contains("word/"), "docx").when(names.contains("xl/"), "xlsx").when(names.contains("opendocument.text"), "odt").when(names.contains("opendocument.spreadsheet"), "ods").otherwise("zip")
    text = F.decode(content, "ISO-8859-1")
    plain = F.when(looks_like_csv(text), "csv").when(looks_like_markdown(text), "md").otherwise("txt")
    return F.when(head == "D0CF11E0A1B11AE1", "doc").when(head.startswith("504B0304"), zipped).when(head.startswith("25504446"), "pdf").otherwise(plain)


def read_files(spark, path: str) -> DataFrame:
    """(path, format, content) of the files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.coalesce(F.when(~format_by_name(F.col("path")).isin("txt", "csv", "md"), format_of_bytes(F.col("content"))), format_by_name(F.col("path")), format_of_bytes(F.col("content"))).alias("format"), "content")
