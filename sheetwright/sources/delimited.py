"""Delimited text: a lenient RFC 4180 parser and writer, tables in and out of cells, text-table import."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import infer_type
from .detect import detect_delimiter, lines_of, once


def decode_bytes(raw: bytes) -> str:
    """UTF-8 or UTF-16 by their marks, else UTF-8, else Latin-1."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    raw = raw[3:] if raw[:3] == b"\xef\xbb\xbf" else raw
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def parse_rows(text: str, delimiter: str = ",") -> list[list[str]]:
    """Rows of fields as they are, ragged or not; an open quote runs to the end; an empty last row is none."""
    rows: list[list[str]] = []
    row: list[str] = []
    i, n = 0, len(text)
    begun = False
    while i <= n:
        begun = True
        if i < n and text[i] == '"':
            parts, i = [], i + 1
            while True:
                end = text.find('"', i)
                if end < 0:
                    parts.append(text[i:])
                    i = n
                    break
                parts.append(text[i:end])
                i = end + 1
                if i < n and text[i] == '"':
                    parts.append('"')
                    i += 1
                else:
                    break
            field = "".join(parts)
            stop = i
            while stop < n and text[stop] != delimiter and text[stop] not in "\r\n":
                stop += 1
            field += text[i:stop]
            i = stop
        else:
            stop = i
            while stop < n and text[stop] != delimiter and text[stop] not in "\r\n":
                stop += 1
            field, i = text[i:stop], stop
        row.append(field)
        if i >= n:
            break
        if text[i] == delimiter:
            i += 1
            continue
        i += 2 if text[i] == "\r" and i + 1 < n and text[i + 1] == "\n" else 1
        rows.append(row)
        row = []
        begun = False
    if begun and row != [""]:
        rows.append(row)
    return rows


def quote(field: Column, delimiter: str = ",") -> Column:
    """Quoted only where a delimiter, a quote or a line end asks for it."""
    f = F.coalesce(field, F.lit(""))
    needs = f.contains(delimiter) | f.rlike('["\r\n]')
    return F.when(needs, F.concat(F.lit('"'), F.call_function("replace", f, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(f)


def csv_line(columns: list[Column], delimiter: str = ",") -> Column:
    return F.concat_ws(delimiter, *[quote(c, delimiter) for c in columns])


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True) -> None:
    """CRLF line ends, minimal quotes."""
    df.write.option("sep", delimiter).option("header", header).option("lineSep", "\r\n").option("escape", '"').option("emptyValue", "").csv(path)


def read_csv(spark, path: str, delimiter: str = ",", header: bool = False) -> DataFrame:
    """All columns texts; records may span lines."""
    return spark.read.option("sep", delimiter).option("header", header).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)


def stream_csv(spark, path: str, schema: str, delimiter: str = ",", header: bool = True) -> DataFrame:
    """New files of a folder as they come."""
    return spark.readStream.schema(schema).option("sep", delimiter).option("header", header).option("multiLine", True).option("escape", '"').csv(path)


def cells_of_texts(df: DataFrame, key: str, text: str, delimiter: str | None = None) -> DataFrame:
    """(key, row, col, value) of delimited texts; without a delimiter each text's own is found."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, r, c, v) for k, t, d in zip(pdf["k"], pdf["t"], pdf["d"], strict=True) if isinstance(t, str) for r, row in enumerate(parse_rows(t.removeprefix("﻿"), d)) for c, v in enumerate(row)]
            yield pd.DataFrame(rows, columns=[key, "row", "col", "value"])

    sign = F.lit(delimiter) if delimiter else detect_delimiter(F.col(text))
    return df.select(F.col(key).alias("k"), F.col(text).alias("t"), sign.alias("d")).mapInPandas(run, f"`{key}` {kind}, row int, col int, value string")


def table_text(cells: DataFrame, key: list[str], delimiter: str = ",", line_end: str = "\n") -> DataFrame:
    """(key..., text): a dense grid over the cells used, row after row."""
    size = cells.groupBy(*key).agg(F.max("row").alias("_r"), F.max("col").alias("_c"), F.map_from_entries(F.collect_list(F.struct(F.col("row").cast("long") * 16384 + F.col("col"), "value"))).alias("_m"))
    line = lambda r: F.array_join(F.transform(F.sequence(F.lit(0), F.col("_c")), lambda c: quote(F.try_element_at("_m", r.cast("long") * 16384 + c), delimiter)), delimiter)
    return size.select(*key, F.array_join(F.transform(F.sequence(F.lit(0), F.col("_r")), line), line_end).alias("text"))


def _comma_fields(line: Column) -> Column:
    """The fields of a line at commas outside of quotes, quotes taken off; an open quote runs to the line's end."""
    raw = F.regexp_extract_all(F.concat(line, F.lit("\n")), F.lit(r'((?:[^",\n]++|"(?:[^"\n]++|"")*+"?+)*+)[,\n]'), 1)
    return F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(x, r'"((?:[^"]++|"")*+)"?+', "$1"), '""', '"'))


def text_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, cells, header): pasted text that is a table, of two rows and two columns at least.

    It is split at the tab if the first line has one, else at the pipe, semicolon or comma (outside of quotes) that every
    line has.  Rules of dashes between pipes go.  The first row is a header if it has no number and the second has one.
    """

    def signed(lines: Column) -> Column:
        has = lambda s: F.forall(lines, lambda x: x.contains(s))
        sign = F.when(F.contains(F.get(lines, F.lit(0)), F.lit("\t")), "\t").when(has("|"), "|").when(has(";"), ";").when(has(","), ",")
        return F.when(F.size(lines) > 0, F.struct(lines.alias("lines"), sign.alias("sign")))

    def fields(lines: Column, sign: Column) -> Column:
        """Patterns of one literal each are compiled once, not once a line."""
        trimmed = lambda f: F.transform(lines, lambda x: F.transform(f(x), lambda c: F.trim(c)))  # noqa: E731, PLW0108
        piped = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^\||\|$", "")), lambda x: ~x.rlike(r"^[\s|:-]+$"))
        bars = F.transform(piped, lambda x: F.transform(F.split(x, r"\|", -1), lambda c: F.trim(c)))  # noqa: PLW0108
        commas = trimmed(lambda x: F.when(x.contains('"'), _comma_fields(x)).otherwise(F.split(x, ",", -1)))
        return F.when(sign == "|", bars).when(sign == ",", commas).when(sign == ";", trimmed(lambda x: F.split(x, ";", -1))).when(sign == "\t", trimmed(lambda x: F.split(x, "\t", -1)))

    def kept(grid: Column) -> Column:
        first = F.get(grid, F.lit(0))
        header = ~F.exists(first, number) & F.exists(F.get(grid, F.lit(1)), number)
        shown = lambda h: F.transform(grid, lambda x, i: F.struct(i.alias("row"), x.alias("cells"), (h & (i == 0)).alias("header")))
        return F.when((F.size(grid) > 1) & (F.size(first) > 1), once(header, shown))

    number = lambda c: infer_type(c) == "number"
    lines = F.filter(lines_of(F.col(text)), lambda x: F.trim(x) != "")
    rows = once(once(once(lines, signed), lambda x: fields(x["lines"], x["sign"])), kept)
    return df.select(key, F.explode(rows).alias("_r")).select(key, "_r.row", "_r.cells", "_r.header")
