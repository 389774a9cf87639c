"""XLSX, ODS, DOCX and ODT files: bytes to rows and rows to bytes, with zipfile and ElementTree alone."""

from __future__ import annotations

import datetime
import io
import itertools
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formula.parse import column_index, column_letters
from .batches import made_by_key, read_by_file

CELLS = "workbook_id string, sheet string, row int, col int, kind string, num double, txt string, bool boolean, err string, formula string"
COLUMNS = [c.split()[0] for c in CELLS.split(", ")]
#: Bytes of an unpacked entry at most; larger ones are refused as hostile.
MOST = 256 << 20
_EPOCH = datetime.date(1899, 12, 30)


def _entry(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    if name not in z.namelist():
        return None
    if z.getinfo(name).file_size > MOST:
        raise ValueError(f"{name} is too large")
    return ET.fromstring(z.read(name))


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _find(e: ET.Element | None, name: str) -> list[ET.Element]:
    if e is None:
        return []
    spaced = "}" + name
    return [x for x in e.iter() if x.tag == name or x.tag.endswith(spaced)]


def _stream(z: zipfile.ZipFile, name: str, whole: tuple[str, ...], outer: tuple[str, ...] = ()) -> Iterator[tuple[bool, ET.Element]]:
    """(False, element) where an element with a tag of `whole` or `outer` ends, (True, element) where one of `outer` begins; what ended outside of `whole` is let go."""
    if name not in z.namelist():
        return
    if z.getinfo(name).file_size > MOST:
        raise ValueError(f"{name} is too large")
    above: list[ET.Element] = []
    inside = 0
    with z.open(name) as f:
        for event, e in ET.iterparse(f, ("start", "end")):
            tag = _tag(e)
            if event == "start":
                above.append(e)
                inside += tag in whole
                if tag in outer:
                    yield True, e
                continue
            above.pop()
            if tag in whole or tag in outer:
                yield False, e
            inside -= tag in whole
            if not inside and above:
                del above[-1][:]


def _sheet_parts(z: zipfile.ZipFile) -> Iterator[tuple[str | None, str]]:
    """Each sheet's name and the entry that holds it."""
    rels = {_attr(r, "Id"): _attr(r, "Target") for r in _find(_entry(z, "xl/_rels/workbook.xml.rels"), "Relationship")}
    for sheet in _find(_entry(z, "xl/workbook.xml"), "sheet"):
        target = (rels.get(_attr(sheet, "id")) or "").lstrip("/")
        yield _attr(sheet, "name"), target if target.startswith("xl/") else f"xl/{target}"


def read_xlsx(raw: bytes) -> list[tuple]:
    """(sheet, row, col, kind, num, txt, bool, err, formula) of all cells; dates stay numbers."""
    return list(xlsx_cells(raw))


def xlsx_cells(raw: bytes) -> Iterator[tuple]:
    """read_xlsx()'s rows one after the other."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    strings = ["".join(t.text or "" for t in _find(si, "t")) for _, si in _stream(z, "xl/sharedStrings.xml", ("si",))]
    for sheet, part in _sheet_parts(z):
        for _, c in _stream(z, part, ("c",)):
            m = re.fullmatch(r"([A-Z]+)(\d+)", _attr(c, "r") or "")
            if not m:
                continue
            kind = _attr(c, "t") or "n"
            v = next((x.text or "" for x in c if _tag(x) == "v"), None)
            f = next((x.text for x in c if _tag(x) == "f"), None)
            if kind == "inlineStr":
                v = "".join(t.text or "" for t in _find(c, "t"))
            where = (sheet, int(m[2]) - 1, column_index(m[1]))
            f = f"={f}" if f else None
            if v is None:
                cell = ("empty", None, None, None, None)
            elif kind == "s":
                cell = ("text", None, strings[int(v)], None, None)
            elif kind == "b":
                cell = ("boolean", None, None, v == "1", None)
            elif kind == "e":
                cell = ("error", None, None, None, v)
            elif kind in ("str", "inlineStr"):
                cell = ("text", None, v, None, None)
            else:
                cell = ("number", float(v), None, None, None)
            yield *where, *cell, f


#: 1 January 2000, as zip files state it.
_DAY = 20 << 9 | 1 << 5 | 1


def _zip(entries: dict[str, str], stored: tuple[str, ...] = ()) -> bytes:
    """A zip file of texts, written in one go: for small files most of ZipFile's time goes to its records."""
    if len(entries) > 60_000 or sum(map(len, entries.values())) > MOST:  # these may need the wider records of large files
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in entries.items():
                z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), text, zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED)
        return buf.getvalue()
    out, listed, at = [], [], 0
    for name, text in entries.items():
        raw = text.encode()
        packed = raw if name in stored else zlib.compress(raw, wbits=-15)
        key = name.encode()
        about = struct.pack("<5H3L2H", 20, 0 if name.isascii() else 0x800, 0 if name in stored else 8, 0, _DAY, zlib.crc32(raw), len(packed), len(raw), len(key), 0)
        out += (b"PK\3\4", about, key, packed)
        listed += (b"PK\1\2\x14\3", about, struct.pack("<3H2L", 0, 0, 0, 0o600 << 16, at), key)
        at += 30 + len(key) + len(packed)
    size = sum(map(len, listed))
    return b"".join([*out, *listed, struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, len(entries), len(entries), size, at, 0)])


class _Package:
    """A zip file that is written entry after entry, each in pieces."""

    def __init__(self) -> None:
        self.buf = io.BytesIO()
        self.zip = zipfile.ZipFile(self.buf, "w", zipfile.ZIP_DEFLATED)

    def put(self, name: str, pieces: Iterable[str], how: int = zipfile.ZIP_DEFLATED) -> None:
        info = zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0))
        info.compress_type = how
        with self.zip.open(info, "w") as f:
            for some in itertools.batched(pieces, 1000):
                f.write("".join(some).encode())

    def bytes(self) -> bytes:
        self.zip.close()
        return self.buf.getvalue()


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_SHEET_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG_NS = "http://schemas.openxmlformats.org/package/2006"
_WORD_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def cell_xml(cell: tuple, strings: dict[str, int], style: int | None = None) -> str:
    """The element of a row of read_xlsx(); texts without a formula go to the shared strings."""
    _, row, col, kind, num, txt, flag, err, formula = cell
    f = f"<f>{escape(formula[1:])}</f>" if formula else ""
    if kind == "text":
        t, v = ("str", escape(txt)) if formula else ("s", str(strings.setdefault(txt, len(strings))))
    elif kind == "boolean":
        t, v = "b", str(int(flag))
    elif kind == "error":
        t, v = "e", escape(err)
    elif kind in ("number", "date"):
        t, v = "n", repr(float(num))
    else:
        t, v = "n", None
    s = f' s="{style}"' if style else ""
    return f'<c r="{column_letters(col)}{row + 1}"{s} t="{t}">{f}' + (f"<v>{v}</v>" if v is not None else "") + "</c>"


def write_book(sheets: Iterable[tuple[str, Iterable[str]]], strings: dict[str, int], styles: Callable[[], str] | None = None) -> bytes:
    """A workbook of sheets, (name, the pieces of the sheet's XML below its root), which fill `strings` and are written one after the other."""
    out, names = _Package(), []
    for name, pieces in sheets:
        names.append(name)
        out.put(f"xl/worksheets/sheet{len(names)}.xml", itertools.chain([f'{_HEAD}<worksheet xmlns="{_SHEET_NS}">'], pieces, ["</worksheet>"]))
    shown = "".join(f'<sheet name={quoteattr(s)} sheetId="{n}" r:id="rId{n}"/>' for n, s in enumerate(names, 1))
    rels = "".join(f'<Relationship Id="rId{n}" Type="{_REL_NS}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(names) + 1))
    rels += f'<Relationship Id="rId{len(names) + 1}" Type="{_REL_NS}/sharedStrings" Target="sharedStrings.xml"/>'
    main = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{main}.worksheet+xml"/>' for n in range(1, len(names) + 1))
    if styles:
        rels += f'<Relationship Id="rIdStyles" Type="{_REL_NS}/styles" Target="styles.xml"/>'
        parts += f'<Override PartName="/xl/styles.xml" ContentType="{main}.styles+xml"/>'
        out.put("xl/styles.xml", [styles()])
    out.put("xl/sharedStrings.xml", itertools.chain([f'{_HEAD}<sst xmlns="{_SHEET_NS}" uniqueCount="{len(strings)}">'], (f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings), ["</sst>"]))
    out.put("[Content_Types].xml", [f'{_HEAD}<Types xmlns="{_PKG_NS}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{main}.sheet.main+xml"/><Override PartName="/xl/sharedStrings.xml" ContentType="{main}.sharedStrings+xml"/>{parts}</Types>'])
    out.put("_rels/.rels", [f'{_HEAD}<Relationships xmlns="{_PKG_NS}/relationships"><Relationship Id="rId1" Type="{_REL_NS}/officeDocument" Target="xl/workbook.xml"/></Relationships>'])
    out.put("xl/workbook.xml", [f'{_HEAD}<workbook xmlns="{_SHEET_NS}" xmlns:r="{_REL_NS}"><sheets>{shown}</sheets></workbook>'])
    out.put("xl/_rels/workbook.xml.rels", [f'{_HEAD}<Relationships xmlns="{_PKG_NS}/relationships">{rels}</Relationships>'])
    return out.bytes()


def write_xlsx(cells: list[tuple]) -> bytes:
    """A workbook from read_xlsx()'s rows, with a shared string table and formulas beside their values."""
    place = {s: n for n, s in enumerate(dict.fromkeys(c[0] for c in cells))}
    return write_xlsx_sorted(sorted(cells, key=lambda c: (place[c[0]], c[1], c[2])))


def write_xlsx_sorted(cells: Iterable[tuple]) -> bytes:
    """As write_xlsx(), of cells that come sheet by sheet, by row and column."""
    strings: dict[str, int] = {}

    def pieces(rows: Iterable[tuple]) -> Iterator[str]:
        yield "<sheetData>"
        for r, row in itertools.groupby(rows, itemgetter(1)):
            yield f'<row r="{r + 1}">' + "".join(cell_xml(c, strings) for c in row) + "</row>"
        yield "</sheetData>"

    return write_book(((name, pieces(rows)) for name, rows in itertools.groupby(cells, itemgetter(0))), strings)


# --- OpenDocument


def from_open_formula(f: str) -> str:
    """of:=SUM([.A1:.B2];[$Sheet2.C3]) -> =SUM(A1:B2,Sheet2!C3)."""
    f = re.sub(r"^(of|oooc):", "", f)

    def ref(m: re.Match) -> str:
        parts = m[1].split(":")
        sheet = parts[0].rpartition(".")[0].lstrip("$").strip("'")
        cells = ":".join(p.rpartition(".")[2] for p in parts)
        return f"{sheet}!{cells}" if sheet else cells

    return re.sub(r"\[([^\]]+)\]", ref, f).replace(";", ",")


def to_open_formula(f: str) -> str:
    """The inverse of from_open_formula()."""

    def ref(m: re.Match) -> str:
        sheet = f"${m[1][:-1]}" if m[1] else ""
        return f"[{sheet}.{m[2]}" + (f":.{m[3]}" if m[3] else "") + "]"

    out = re.sub(r"([A-Za-z_][A-Za-z0-9_]*!)?(\$?[A-Z]{1,3}\$?\d+)(?::(\$?[A-Z]{1,3}\$?\d+))?(?![A-Za-z0-9_(])", ref, f)
    return "of:" + out.replace(",", ";")


def iso_to_serial(text: str) -> float:
    d, _, t = text.partition("T")
    n = float((datetime.date.fromisoformat(d) - _EPOCH).days)
    if t:
        h, m, s = (float(x) for x in t.split(":"))
        n += (h * 3600 + m * 60 + s) / 86400
    return n


def serial_to_iso(n: float) -> str:
    return (_EPOCH + datetime.timedelta(days=int(n))).isoformat()


def read_ods(raw: bytes) -> list[tuple]:
    """As read_xlsx(), with dates as such."""
    return list(ods_cells(raw))


def ods_cells(raw: bytes) -> Iterator[tuple]:
    """read_ods()'s rows one after the other; a table inside a cell follows the one around it, whose rows count its rows too."""
    tables: list[list] = []  # the open ones: name, rows seen, tables inside
    for begun, e in _stream(zipfile.ZipFile(io.BytesIO(raw)), "content.xml", ("table-row",), ("table",)):
        if _tag(e) == "table":
            if begun:
                tables.append([_attr(e, "name"), 0, []])
            elif len(tables) > 1:
                tables.pop()
            else:
                _, _, inner = tables.pop()
                for t in inner:
                    r = 0
                    for row in _find(t, "table-row"):
                        yield from _ods_row(_attr(t, "name"), r, row)
                        r += int(_attr(row, "number-rows-repeated") or 1)
        elif len(tables) == 1:
            top = tables[0]
            for row in _find(e, "table-row"):
                yield from _ods_row(top[0], top[1], row)
                top[1] += int(_attr(row, "number-rows-repeated") or 1)
            top[2] += _find(e, "table")


def _ods_row(name: str | None, r: int, row: ET.Element) -> Iterator[tuple]:
    c = 0
    for cell in (x for x in row if _tag(x) in ("table-cell", "covered-table-cell")):
        times = int(_attr(cell, "number-columns-repeated") or 1)
        kind, v, f = _attr(cell, "value-type"), _attr(cell, "value"), _attr(cell, "formula")
        if kind in ("float", "percentage", "currency"):
            made = ("number", float(v), None, None, None)
        elif kind == "boolean":
            made = ("boolean", None, None, _attr(cell, "boolean-value") == "true", None)
        elif kind == "date":
            made = ("date", iso_to_serial(_attr(cell, "date-value")), None, None, None)
        elif kind == "string":
            made = ("text", None, "\n".join("".join(p.itertext()) for p in _find(cell, "p")), None, None)
        else:
            made = ("empty", None, None, None, None) if f else None
        if made:
            for k in range(min(times, 16384)):
                yield name, r, c + k, *made, from_open_formula(f) if f else None
        c += times


def write_ods(cells: list[tuple]) -> bytes:
    place = {s: n for n, s in enumerate(dict.fromkeys(c[0] for c in cells))}
    return write_ods_sorted(sorted(cells, key=lambda c: (place[c[0]], c[1], c[2])))


def write_ods_sorted(cells: Iterable[tuple]) -> bytes:
    """As write_ods(), of cells that come sheet by sheet, by row and column; rows end with their last cell."""

    def element(cell: tuple) -> str:
        _, _, _, kind, num, txt, flag, err, formula = cell
        f = f" table:formula={quoteattr(to_open_formula(formula))}" if formula else ""
        if kind == "number":
            return f'<table:table-cell{f} office:value-type="float" office:value="{num!r}"/>'
        if kind == "date":
            return f'<table:table-cell{f} office:value-type="date" office:date-value="{serial_to_iso(num)}"/>'
        if kind == "boolean":
            return f'<table:table-cell{f} office:value-type="boolean" office:boolean-value="{str(flag).lower()}"/>'
        if kind in ("text", "error"):
            paras = "".join(f"<text:p>{escape(p)}</text:p>" for p in (txt or err or "").split("\n"))
            return f'<table:table-cell{f} office:value-type="string">{paras}</table:table-cell>'
        return f"<table:table-cell{f}/>"

    def pieces() -> Iterator[str]:
        head, tail = _open("spreadsheet", "\0").split("\0")
        yield head
        for name, rows in itertools.groupby(cells, itemgetter(0)):
            yield f"<table:table table:name={quoteattr(name)}>"
            at = 0
            for r, row in itertools.groupby(rows, itemgetter(1)):
                for _ in range(at, r):
                    yield "<table:table-row></table:table-row>"
                at, last = r + 1, {c[2]: c for c in row}
                yield "<table:table-row>" + "".join(element(last[k]) if k in last else "<table:table-cell/>" for k in range(max(last) + 1)) + "</table:table-row>"
            yield "</table:table>"
        yield tail

    out = _Package()
    out.put("mimetype", ["application/vnd.oasis.opendocument.spreadsheet"], zipfile.ZIP_STORED)
    out.put("META-INF/manifest.xml", [_manifest("spreadsheet")])
    out.put("content.xml", pieces())
    return out.bytes()


def _manifest(kind: str) -> str:
    ns = "urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"
    return f'{_HEAD}<manifest:manifest xmlns:manifest="{ns}"><manifest:file-entry manifest:full-path="/" manifest:media-type="application/vnd.oasis.opendocument.{kind}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>'


def _open(kind: str, body: str) -> str:
    ns = "urn:oasis:names:tc:opendocument:xmlns"
    return f'{_HEAD}<office:document-content xmlns:office="{ns}:office:1.0" xmlns:table="{ns}:table:1.0" xmlns:text="{ns}:text:1.0"><office:body><office:{kind}>{body}</office:{kind}></office:body></office:document-content>'


# --- text documents: (ord, kind, level, text), kind heading, paragraph, bullet or row (cells joined by tabs)


def read_docx(raw: bytes) -> list[tuple[int, str, int, str]]:
    z = zipfile.ZipFile(io.BytesIO(raw))
    body = next(iter(_find(_entry(z, "word/document.xml"), "body")), None)
    out: list[tuple[int, str, int, str]] = []

    def text(e: ET.Element) -> str:
        return "".join({"t": x.text or "", "tab": "\t", "br": "\n"}.get(_tag(x), "") for x in e.iter() if _tag(x) in ("t", "tab", "br"))

    for e in body if body is not None else []:
        if _tag(e) == "p":
            style = next((_attr(s, "val") or "" for s in _find(e, "pStyle")), "")
            m = re.fullmatch(r"[Hh]eading ?(\d)", style)
            level = next((int(_attr(x, "val") or 0) for x in _find(e, "ilvl")), None)
            out.append((len(out), *(("heading", int(m[1])) if m else ("bullet", level) if level is not None else ("paragraph", 0)), text(e)))
        elif _tag(e) == "tbl":
            for row in (x for x in e if _tag(x) == "tr"):
                out.append((len(out), "row", 0, "\t".join(" ".join(text(p) for p in _find(c, "p")) for c in row if _tag(c) == "tc")))
    return out


def write_docx(blocks: list[tuple[int, str, int, str]]) -> bytes:
    def run(s: str) -> str:
        lines = "</w:t><w:br/><w:t xml:space=\"preserve\">".join(escape(x) for x in s.split("\n"))
        return f'<w:r><w:t xml:space="preserve">{lines}</w:t></w:r>'

    xml, table = [], False
    for _, kind, level, s in blocks:
        if table and kind != "row":
            xml.append("</w:tbl>")
        if kind == "row":
            xml.append(("" if table else "<w:tbl>") + "<w:tr>" + "".join(f"<w:tc><w:p>{run(c)}</w:p></w:tc>" for c in s.split("\t")) + "</w:tr>")
        else:
            pr = f'<w:pPr><w:pStyle w:val="Heading{level}"/></w:pPr>' if kind == "heading" else f'<w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="1"/></w:numPr></w:pPr>' if kind == "bullet" else ""
            xml.append(f"<w:p>{pr}{run(s)}</w:p>")
        table = kind == "row"
    xml.append("</w:tbl>" if table else "")
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
    return _zip(
        {
            "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PKG_NS}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{kind}"/></Types>',
            "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PKG_NS}/relationships"><Relationship Id="rId1" Type="{_REL_NS}/officeDocument" Target="word/document.xml"/></Relationships>',
            "word/document.xml": f'{_HEAD}<w:document xmlns:w="{_WORD_NS}"><w:body>{"".join(xml)}</w:body></w:document>',
        }
    )


def read_odt(raw: bytes) -> list[tuple[int, str, int, str]]:
    z = zipfile.ZipFile(io.BytesIO(raw))
    body = next(iter(_find(_entry(z, "content.xml"), "text")), None)
    out: list[tuple[int, str, int, str]] = []

    def walk(e: ET.Element, depth: int) -> None:
        for x in e:
            tag = _tag(x)
            if tag == "h":
                out.append((len(out), "heading", int(_attr(x, "outline-level") or 1), "".join(x.itertext())))
            elif tag == "p":
                out.append((len(out), "bullet" if depth else "paragraph", max(0, depth - 1), "".join(x.itertext())))
            elif tag == "list":
                walk(x, depth + 1)
            elif tag == "table":
                for row in _find(x, "table-row"):
                    out.append((len(out), "row", 0, "\t".join("".join(c.itertext()) for c in row if _tag(c) == "table-cell")))
            else:
                walk(x, depth)

    if body is not None:
        walk(body, 0)
    return out


def write_odt(blocks: list[tuple[int, str, int, str]]) -> bytes:
    xml, table = [], False
    for _, kind, level, s in blocks:
        if table and kind != "row":
            xml.append("</table:table>")
        if kind == "row":
            xml.append(("" if table else "<table:table>") + "<table:table-row>" + "".join(f"<table:table-cell><text:p>{escape(c)}</text:p></table:table-cell>" for c in s.split("\t")) + "</table:table-row>")
        elif kind == "heading":
            xml.append(f'<text:h text:outline-level="{level}">{escape(s)}</text:h>')
        elif kind == "bullet":
            xml.append("<text:list><text:list-item>" * (level + 1) + f"<text:p>{escape(s)}</text:p>" + "</text:list-item></text:list>" * (level + 1))
        else:
            xml.append(f"<text:p>{escape(s)}</text:p>")
        table = kind == "row"
    xml.append("</table:table>" if table else "")
    return _zip({"mimetype": "application/vnd.oasis.opendocument.text", "META-INF/manifest.xml": _manifest("text"), "content.xml": _open("text", "".join(xml))}, ("mimetype",))


# --- on DataFrames


#: What readers raise on bytes that aren't what they seem.
_BROKEN = (zipfile.BadZipFile, zlib.error, ET.ParseError, ValueError, KeyError, IndexError, AttributeError, EOFError, NotImplementedError, RuntimeError)


def read_workbooks(files: DataFrame) -> DataFrame:
    """Cells of files(path, format, content) that are xlsx or ods; a file that can't be read gives one row of kind `error`, its `err` says why."""
    return read_by_file(files, CELLS, {"xlsx": xlsx_cells, "ods": ods_cells}, _BROKEN, lambda e: (None, None, None, "error", None, None, None, f"{type(e).__name__}: {e}", None))


def write_workbooks(cells: DataFrame, kind: str = "xlsx") -> DataFrame:
    """(workbook_id, content): each workbook's file."""
    make = {"xlsx": write_xlsx_sorted, "ods": write_ods_sorted}[kind]
    return made_by_key(cells.select(*COLUMNS), "workbook_id", ["sheet", "row", "col"], make)


def read_documents(files: DataFrame) -> DataFrame:
    """(path, ord, kind, level, text) of files(path, format, content) that are docx, odt, md or txt; one that can't be read gives a row of kind `error`."""
    from .delimited import decode_bytes
    from .markup import markdown_blocks

    def blocks(kind: str, raw: bytes) -> list[tuple[int, str, int, str]]:
        if kind in ("docx", "odt"):
            return (read_docx if kind == "docx" else read_odt)(raw)
        text = decode_bytes(raw)
        return [(i, *b) for i, b in enumerate(markdown_blocks(text) if kind == "md" else [("paragraph", 0, x) for x in re.sub("\r\n?", "\n", text).split("\n")])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, kind, raw in zip(pdf["path"], pdf["format"], pdf["content"], strict=True):
                try:
                    rows += [(path, *b) for b in blocks(kind, bytes(raw))]
                except _BROKEN as e:
                    rows.append((path, 0, "error", 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "ord", "kind", "level", "text"])

    return files.where("format in ('docx', 'odt', 'md', 'txt')").select("path", "format", "content").mapInPandas(run, "path string, ord int, kind string, level int, text string")


def export_documents(blocks: DataFrame, kind: str) -> DataFrame:
    """(path, content): blocks(path, ord, kind, level, text) as docx or odt files."""
    make = {"docx": write_docx, "odt": write_odt}[kind]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("ord")[["ord", "kind", "level", "text"]].itertuples(index=False, name=None))
        return pd.DataFrame([(pdf["path"].iloc[0], make(rows))], columns=["path", "content"])

    return blocks.groupBy("path").applyInPandas(run, "path string, content binary")


def convert(files: DataFrame, to: str) -> DataFrame:
    """(path, content, err): files(path, format, content) that are docx, odt, md or txt as `to`, one of these.

    A file that can't be read has no content, and `err` says why.
    """
    from .markup import write_markdown

    if to not in ("docx", "odt", "md", "txt"):
        raise ValueError(f"no conversion to {to}")
    blocks = read_documents(files)
    good = blocks.where("kind <> 'error'")
    if to in ("docx", "odt"):
        made = export_documents(good, to)
    elif to == "md":
        made = write_markdown(good, "path").select("path", F.encode("text", "UTF-8").alias("content"))
    else:
        lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
        made = good.groupBy("path").agg(F.encode(F.array_join(lines, "\n"), "UTF-8").alias("content"))
    bad = blocks.where("kind = 'error'").select("path", F.lit(None).cast("binary").alias("content"), F.col("text").alias("err"))
    return made.select("path", "content", F.lit(None).cast("string").alias("err")).unionByName(bad)


def open_files(spark, path: str) -> DataFrame:
    """(path, format, content) of the files below a path, formats told by their bytes and names, for the readers here."""
    from .detect import read_files

    return read_files(spark, path)


#: The parts of a workbook that the reader understands, beside the sheets.
KNOWN_PARTS = ("[Content_Types].xml", "_rels/.rels", "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/styles.xml", "xl/sharedStrings.xml")


def preserved_parts(files: DataFrame) -> DataFrame:
    """(path, name, content): the entries of files(path, content) that are workbooks which the reader doesn't know; bytes that are no archive have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                        sheets = len(_find(_entry(z, "xl/workbook.xml"), "sheet")) if "xl/workbook.xml" in z.namelist() else 1
                        known = {*KNOWN_PARTS, *(f"xl/worksheets/sheet{i + 1}.xml" for i in range(sheets))}
                        rows = [(path, i.filename, z.read(i)) for i in z.infolist() if i.filename not in known and not i.is_dir() and i.file_size <= MOST]
                except _BROKEN:
                    pass
                yield pd.DataFrame(rows, columns=["path", "name", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, content binary")
