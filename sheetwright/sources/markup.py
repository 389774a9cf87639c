"""Markdown and HTML tables: parsers to rows, writers from rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_INLINE = re.compile(r"(?P<code>`[^`]+`)|(?P<bold>\*\*[^*]+\*\*|__[^_]+__)|(?P<strike>~~[^~]+~~)|(?P<italic>\*[^*]+\*|_[^_]+_)|!?\[(?P<label>[^\]]*)\]\((?P<url>[^)\s]*)[^)]*\)")


def inline_runs(text: str) -> list[tuple[str, str, str | None]]:
    """(style, text, link) runs: plain, bold, italic, strike, code, link."""
    out, last = [], 0
    for m in _INLINE.finditer(text):
        if m.start() > last:
            out.append(("plain", text[last : m.start()], None))
        if m["url"] is not None:
            out.append(("link", m["label"], m["url"]))
        else:
            kind = m.lastgroup
            n = 1 if kind in ("code", "italic") else 2
            out.append((kind, m[0][n:-n], None))
        last = m.end()
    if last < len(text):
        out.append(("plain", text[last:], None))
    return out


def markdown_blocks(text: str) -> list[tuple[str, int, str]]:
    """(kind, level, text): heading, paragraph, bullet, decimal, quote, code, rule and table rows (cells joined by tabs)."""
    out: list[tuple[str, int, str]] = []
    para: list[str] = []
    code: list[str] | None = None

    def flush() -> None:
        if para:
            out.append(("paragraph", 0, " ".join(para)))
            para.clear()

    lines = re.sub("\r\n?", "\n", text).split("\n")
    for i, line in enumerate(lines):
        if code is not None:
            if re.match(r"\s*(```|~~~)", line):
                out.append(("code", 0, "\n".join(code)))
                code = None
            else:
                code.append(line)
            continue
        if re.match(r"\s*(```|~~~)", line):
            flush()
            code = []
        elif not line.strip():
            flush()
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line):
            flush()
            out.append(("heading", len(m[1]), m[2]))
        elif para and re.fullmatch(r"\s*(=+|-+)\s*", line) and "|" not in para[-1]:
            out.append(("heading", 1 if "=" in line else 2, " ".join(para)))
            para.clear()
        elif re.fullmatch(r"\s*([-*_])(\s*\1){2,}\s*", line):
            flush()
            out.append(("rule", 0, ""))
        elif m := re.match(r"(\s*)([-*+]|\d+[.)])\s+(.*)", line):
            flush()
            out.append(("decimal" if m[2][0].isdigit() else "bullet", len(m[1].expandtabs(4)) // 2, m[3]))
        elif m := re.match(r"\s*>\s?(.*)", line):
            flush()
            out.append(("quote", 0, m[1]))
        elif re.fullmatch(r"[\s|:-]*-[\s|:-]*", line) and out and out[-1][0] == "row":
            continue
        elif "|" in line and (out and out[-1][0] == "row" and not para and lines[i - 1].strip() or i + 1 < len(lines) and re.fullmatch(r"[\s|:-]*-[\s|:-]*", lines[i + 1]) and "|" in lines[i + 1]):
            flush()
            out.append(("row", 0, "\t".join(c.strip() for c in line.strip().strip("|").split("|"))))
        else:
            para.append(line.strip())
    flush()
    if code is not None:
        out.append(("code", 0, "\n".join(code)))
    return out


def read_markdown(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, kind, level, text) of Markdown texts."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, *b) for k, t in zip(pdf["k"], pdf["t"], strict=True) if isinstance(t, str) for i, b in enumerate(markdown_blocks(t))]
            yield pd.DataFrame(rows, columns=[key, "ord", "kind", "level", "text"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"`{key}` {kind}, ord int, kind string, level int, text string")


def write_markdown(blocks: DataFrame, key: str) -> DataFrame:
    """(key, text): the inverse of read_markdown(), tables with a rule below their first row."""
    indent = F.repeat(F.lit("  "), F.col("level"))
    cells = F.split("text", "\t", -1)
    row = F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(cells)))
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("ord")
    same = F.coalesce(F.lag("kind").over(w) == F.col("kind"), F.lit(False))
    number = F.col("kind") == "decimal"
    line = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text")))
        .when(F.col("kind") == "bullet", F.concat(indent, F.lit("- "), F.col("text")))
        .when(number, F.concat(indent, F.lit("1. "), F.col("text")))
        .when(F.col("kind") == "quote", F.concat(F.lit("> "), F.col("text")))
        .when(F.col("kind") == "code", F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```")))
        .when(F.col("kind") == "rule", "---")
        .when((F.col("kind") == "row") & ~F.col("same"), F.concat(row, F.lit("\n"), rule))
        .when(F.col("kind") == "row", row)
        .otherwise(F.col("text"))
    )
    tight = F.col("same") & F.col("kind").isin("bullet", "decimal", "quote", "row")
    made = blocks.withColumn("same", same).select(key, "ord", F.concat(F.when(F.col("ord") == 0, "").when(tight, "\n").otherwise("\n\n"), line).alias("s"))
    return made.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "s"))), lambda x: x["s"]), "").alias("text"))


class _Table(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.depth, self.done = 0, False
        self.rows: list[list[tuple[str, int, int, bool]]] = []
        self.cell: list | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.done:
            return
        a = dict(attrs)
        if tag == "table":
            self.depth += 1
        elif self.depth == 1 and tag == "tr":
            self.rows.append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self.end_cell()
            if not self.rows:
                self.rows.append([])
            self.cell = [[], _span(a.get("colspan")), _span(a.get("rowspan")), tag == "th"]
        elif self.cell is not None and tag == "br":
            self.cell[0].append(" ")

    def end_cell(self) -> None:
        if self.cell is not None:
            self.rows[-1].append((" ".join("".join(self.cell[0]).split()), *self.cell[1:]))
            self.cell = None

    def handle_endtag(self, tag: str) -> None:
        if self.done:
            return
        if self.depth == 1 and tag in ("td", "th", "tr"):
            self.end_cell()
        if tag == "table" and self.depth:
            self.depth -= 1
            if not self.depth:
                self.end_cell()
                self.done = True

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell[0].append(data)


def _span(v: str | None) -> int:
    return max(1, min(1000, int(v))) if v and v.strip().isdigit() else 1


def html_table(page: str) -> list[tuple[int, int, str, bool]]:
    """(row, col, text, header) of the first table; spans leave their other cells blank."""
    p = _Table()
    p.feed(page)
    p.close()
    out, taken = [], set()
    for r, row in enumerate(p.rows):
        c = 0
        for text, wide, high, head in row:
            while (r, c) in taken:
                c += 1
            for dr in range(high):
                for dc in range(wide):
                    taken.add((r + dr, c + dc))
                    if r + dr < len(p.rows):
                        out.append((r + dr, c + dc, text if not dr and not dc else "", head))
            c += wide
    return sorted(out)


def read_html_tables(df: DataFrame, key: str, page: str) -> DataFrame:
    """(key, row, col, value, header) of the first table of each page."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *c) for k, t in zip(pdf["k"], pdf["t"], strict=True) if isinstance(t, str) and "<table" in t.lower() for c in html_table(t)]
            yield pd.DataFrame(rows, columns=[key, "row", "col", "value", "header"])

    return df.select(F.col(key).alias("k"), F.col(page).alias("t")).mapInPandas(run, f"`{key}` {kind}, row int, col int, value string, header boolean")
