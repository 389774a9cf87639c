"""Layouts, formats, runs, comments, notes, lists, sections, properties and signatures of office files."""

import cProfile
import io
import pstats
import tracemalloc
import zipfile

import pytest

from sheetwright.plans import files as plans
from sheetwright.sources import layout, office

BOOK = {
    "xl/workbook.xml": '<workbook xmlns:r="urn:r"><sheets><sheet name="Data" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="0.000"/></numFmts><fonts><font/><font><b/><i val="0"/><sz val="14"/><color rgb="FFFF0000"/><name val="Serif"/></font></fonts>'
    '<fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF00FF00"/></patternFill></fill></fills>'
    '<cellXfs><xf numFmtId="0"/><xf numFmtId="14" fontId="1" fillId="1"><alignment horizontal="right" wrapText="1"/></xf><xf numFmtId="164" fontId="9"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": '<worksheet><sheetViews><sheetView><pane xSplit="1" ySplit="2" state="frozen"/></sheetView></sheetViews><cols><col min="1" max="3" width="15.5"/></cols><sheetData><row r="1" ht="25.5"><c r="A1" s="1"><v>1</v></c><c r="B1" s="2"/><c r="C1"/></row>'
    '<row r="2"/><row r="3" ht="30.0"/></sheetData><mergeCells><mergeCell ref="A1:C2"/></mergeCells></worksheet>',
}


def pack(entries):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for k, v in entries.items():
            z.writestr(k, v)
    return buf.getvalue()


def test_layout_and_formats():
    raw = pack(BOOK)
    rows = layout.xlsx_layout(raw)
    assert [(r[3], r[6]) for r in rows if r[1] == "column"] == [(0, 15.5), (1, 15.5), (2, 15.5)]
    assert [(r[2], r[6]) for r in rows if r[1] == "row"] == [(0, 25.5), (2, 30.0)]
    assert ("Data", "merge", 0, 0, 1, 2, None) in rows and ("Data", "pane", 2, 1, 2, 1, None) in rows
    assert layout.xlsx_formats(raw) == [
        ("Data", 0, 0, "mm-dd-yy", "Serif", 14.0, True, False, "FFFF0000", "FF00FF00", "right", None, True),
        ("Data", 0, 1, "0.000", None, None, False, False, None, None, None, None, False),
    ]


def test_styled_workbook_round_trip():
    rows, formats = layout.xlsx_layout(pack(BOOK)), layout.xlsx_formats(pack(BOOK))
    cells = [("Data", 0, 0, "number", 1.0, None, None, None, None)]
    raw = layout.write_styled_xlsx(cells, [*rows, ("Other", "column", None, 1, None, 1, 3.0)], formats)
    assert sorted(map(repr, layout.xlsx_layout(raw))) == sorted(map(repr, [*rows, ("Other", "column", None, 1, None, 1, 3.0)]))
    assert layout.xlsx_formats(raw) == formats
    assert [c for c in office.read_xlsx(raw) if c[3] != "empty"] == cells


def test_document_round_trip():
    runs = [
        (0, 0, "a<b\tc\nd ", True, False, True, False, "Serif", 10.5, "336699", None, None, None), (0, 1, "new", False, True, False, True, None, None, None, "Insert", "x", "2024"),
        (2, 0, "old & gone", False, False, False, False, None, None, None, "Delete", None, None),
    ]
    comments = [("0", None, "x", "2024", "why\nhere"), ("1", "0", "y", None, "")]
    notes = [("footnote", "2", "f"), ("endnote", "3", "e"), ("header", "header1", "top"), ("footer", "footer1", "end")]
    numbering = [(1, 0, "decimal", "%1.", 1), (1, 1, "lowerLetter", "%2)", 3)]
    sections = [(0, 612.0, 792.0, 72.0, 72.0, None, 90.0, 2, "continuous"), (1, None, None, None, None, None, None, 1, "nextPage")]
    raw = layout.write_rich_docx(runs, comments, notes, numbering, sections, [("title", "T & U"), ("keywords", "k")])
    assert layout.docx_runs(raw) == runs
    assert layout.docx_comments(raw) == comments
    assert sorted(layout.docx_notes(raw)) == sorted(notes)
    assert layout.docx_numbering(raw) == numbering
    assert layout.docx_sections(raw) == sections
    assert layout.properties(raw) == [("title", "T & U"), ("keywords", "k")]
    assert [b[3] for b in office.read_docx(raw)][:3] == ["a<b\tc\nd new", "", ""]


def test_replies_overrides_and_separators():
    w = 'xmlns:w="urn:w" xmlns:x="urn:x"'
    raw = pack({
        "word/comments.xml": f'<w:comments {w}><w:comment w:id="5"><w:p x:paraId="A"/></w:comment><w:comment w:id="6"><w:p x:paraId="B"/></w:comment></w:comments>',
        "word/commentsExtended.xml": f'<x:commentsEx {w}><x:commentEx x:paraId="A"/><x:commentEx x:paraId="B" x:paraIdParent="A"/></x:commentsEx>',
        "word/footnotes.xml": f'<w:footnotes {w}><w:footnote w:id="0" w:type="separator"><w:p/></w:footnote><w:footnote w:id="1"><w:p/></w:footnote></w:footnotes>',
        "word/numbering.xml": f'<w:numbering {w}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="2"><w:abstractNumId w:val="7"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="4"/></w:lvlOverride></w:num></w:numbering>',
    })
    assert [c[:2] for c in layout.docx_comments(raw)] == [("5", None), ("6", "5")]
    assert layout.docx_notes(raw) == [("footnote", "1", "")]
    assert layout.docx_numbering(raw) == [(2, 0, "decimal", None, 4)]


def test_signatures():
    sig = "<Signature><SignatureValue>xx</SignatureValue><X509Data><X509SubjectName> CN=A </X509SubjectName><X509Certificate>yy</X509Certificate></X509Data><SignedSignatureProperties><Value>2023</Value>{}</SignedSignatureProperties></Signature>"
    raw = pack({"_xmlsignatures/sig1.xml": sig.format("<SigningTime>2024</SigningTime>"), "_xmlsignatures/sig2.xml": sig.format(""), "word/document.xml": "<d/>"})
    assert [r[1:] for r in layout.signatures(raw)] == [("CN=A", "2024", True, "unverified"), ("CN=A", "2023", True, "unverified")]


def test_open_documents():
    raw = pack({
        "content.xml": '<c xmlns:t="urn:t" xmlns:o="urn:o"><t:p>x<t:note t:id="n1" t:note-class="endnote"><t:note-citation>1</t:note-citation><t:note-body><t:p>see</t:p></t:note-body></t:note></t:p><o:annotation><creator>me</creator><date>2024</date><t:p>a</t:p><t:p>b</t:p></o:annotation></c>',
        "styles.xml": '<s xmlns:y="urn:y"><y:header><p>top</p></y:header></s>', "meta.xml": "<d><meta><title>T</title></meta></d>",
    })
    assert layout.odt_notes(raw) == [("endnote", "n1", "see"), ("header", "header1", "top")]
    assert layout.odt_comments(raw) == [("0", None, "me", "2024", "a\nb")]
    assert layout.properties(raw) == [("title", "T")]


def test_tables_of_files(spark):
    bad = [("a", "xlsx", b""), ("b", "docx", b"PK\x03\x04x"), ("c", "odt", None), ("d", "xlsx", pack(BOOK)), ("e", "txt", b"x"), ("f", "docx", pack({"word/document.xml": "<w><p><r><t>é</t></r></p></w>"}))]
    files = spark.createDataFrame(bad, "path string, format string, content binary")
    assert {r["workbook_id"] for r in layout.read_layout(files).collect()} == {"d"} == {r["workbook_id"] for r in layout.read_formats(files).collect()}
    assert [(r["path"], r["text"], r["bold"]) for r in layout.read_runs(files).collect()] == [("f", "é", False)]
    for read in (layout.read_comments, layout.read_notes, layout.read_numbering, layout.read_sections, layout.read_properties, layout.read_signatures):
        assert read(files).collect() == []
        assert read(files.limit(0)).collect() == []


def peak_of(work):
    tracemalloc.start()
    out = work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_cells_are_read_without_the_tree_of_a_sheet():
    cells = [("S", r, c, "number", float(r), None, None, None, f"=B{r + 1}*2" if c else None) for r in range(5000) for c in range(3)]
    for write, read in ((office.write_xlsx, office.read_xlsx), (office.write_ods, office.read_ods)):
        back, peak = peak_of(lambda write=write, read=read: read(write(cells)))
        assert back == cells
        assert peak < 400 * len(cells)


def test_tables_inside_cells_of_open_documents():
    raw = pack({"content.xml": '<c xmlns:t="t" xmlns:o="o"><t:table t:name="A"><t:table-row><t:table-cell o:value-type="float" o:value="1"/><t:table-cell><t:table t:name="B"><t:table-row><t:table-cell o:value-type="float" o:value="2"/></t:table-row></t:table></t:table-cell></t:table-row>'
                '<t:table-row><t:table-cell o:value-type="float" o:value="3"/></t:table-row></t:table></c>'})  # fmt: skip
    assert [(c[0], c[1], c[2], c[4]) for c in office.read_ods(raw)] == [("A", 0, 0, 1.0), ("A", 1, 0, 2.0), ("A", 2, 0, 3.0), ("B", 0, 0, 2.0)]


def test_a_file_that_breaks_late_gives_its_error_alone(spark):
    raw = pack(BOOK | {"xl/worksheets/sheet1.xml": BOOK["xl/worksheets/sheet1.xml"].replace("</mergeCells>", "")})
    got = office.read_workbooks(spark.createDataFrame([("a", "xlsx", raw), ("b", "xlsx", pack(BOOK))], "path string, format string, content binary")).collect()
    assert [(r["workbook_id"], r["kind"]) for r in got if r["workbook_id"] == "a"] == [("a", "error")]
    assert len([r for r in got if r["workbook_id"] == "b"]) == 3


def test_layouts_and_formats_are_read_without_the_tree_of_a_sheet():
    n = 4000
    heights = [("S", "row", r, None, r, None, 12.5) for r in range(n)]
    formats = [("S", r, r % 2, "0.00", "Serif", 10.0, r % 2 == 0, False, None, None, None, None, False) for r in range(n)]
    raw = layout.write_styled_xlsx([], heights, formats)
    for read, want in ((layout.xlsx_layout, heights), (layout.xlsx_formats, formats)):
        back, peak = peak_of(lambda read=read: read(raw))
        assert back == want
        assert peak < 900 * n


def test_styled_workbooks_are_written_row_by_row():
    n = 4000

    def rows():
        for r in range(n):
            yield "layout", ("S", "row", r, None, r, None, 12.5)
            yield "formats", ("S", r, 1, "0.00", "Serif", 10.0, r % 2 == 0, False, None, None, None, None, False)
            yield "cells", ("S", r, 2, "text", None, f"t{r}", None, None, None)
        yield from (("layout", ("S", "merge", r, 1, r, 3, None)) for r in range(n))

    raw, peak = peak_of(lambda: layout.write_styled_sorted(rows()))
    assert [c[5] for c in office.read_xlsx(raw) if c[3] == "text"] == [f"t{r}" for r in range(n)]
    assert len(layout.xlsx_formats(raw)) == n and len(layout.xlsx_layout(raw)) == 2 * n
    assert peak < 700 * n


def test_styled_workbooks_of_tables(spark):
    book = [("b", "S", 1, 0, "text", None, "x", None, None, None), ("b", "R", 0, 2, "number", 2.0, None, None, None, None), ("c", "S", 0, 0, "boolean", None, None, True, None, None)]
    lay = [("b", "S", "merge", 1, 0, 2, 1, None), ("b", "S", "row", 3, None, 3, None, 9.0), ("b", "S", "column", None, 1, None, 1, 5.0), ("b", "S", "pane", 1, 1, 1, 1, None), ("b", "S", "other", 1, 1, 1, 1, None), ("b", "Q", "merge", 0, 0, 0, 1, None)]
    fmt = [("b", "S", 1, 0, "0.0", None, 8.0, True, False, None, None, None, None, False), ("b", "S", 5, 4, "General", None, None, False, True, None, None, None, None, False)]
    made = layout.write_styled_workbooks(spark.createDataFrame(book, office.CELLS), spark.createDataFrame(lay, layout.LAYOUT), spark.createDataFrame(fmt, layout.FORMATS))
    files = made.selectExpr("workbook_id as path", "'xlsx' as format", "content")
    assert sorted(tuple(r) for r in office.read_workbooks(files).where("kind <> 'empty'").collect()) == sorted(book)
    assert sorted(map(repr, (tuple(r) for r in layout.read_layout(files).collect()))) == sorted(map(repr, [x for x in lay if x[2] != "other"]))
    assert sorted(map(repr, (tuple(r) for r in layout.read_formats(files).collect()))) == sorted(map(repr, fmt))


def test_setup_of_documents_in_one_pass(spark):
    numbering, sections = [(1, 0, "decimal", "%1.", 1), (2, 0, "bullet", "-", 3)], [(0, 612.0, 792.0, 72.0, None, None, 90.0, 2, "continuous")]
    raw = layout.write_rich_docx([], numbering=numbering, sections=sections, props=[("title", "T")])
    files = spark.createDataFrame([("a", "docx", raw), ("b", "docx", b"x"), ("c", "docx", None), ("d", "xlsx", pack(BOOK))], "path string, format string, content binary")
    got = {r["path"]: tuple([tuple(x) for x in c] for c in r[1:]) for r in layout.read_setup(files).collect()}
    assert got == {"a": (numbering, sections, [("title", "T")]), "b": ([], [], []), "c": ([], [], [])}


def test_many_small_documents_give_few_batches():
    import pyarrow as pa

    from sheetwright.sources import batches

    form = batches.arrow_schema("a string, b int")
    made = list(batches.batches_of(((str(i), i) for i in range(25_000)), form))
    assert [b.num_rows for b in made] == [10_000, 10_000, 5_000]
    again = list(batches.groups_of(pa.RecordBatch.from_pydict({"k": k, "v": k}) for k in (["a", "a", "b"], ["b", "b"], ["b", "c"])))
    assert [[b.num_rows for b in g] for g in again] == [[2], [1, 2, 1], [1]]


def test_batches_of_large_texts_are_passed_on_by_their_bytes():
    from sheetwright.sources import batches

    form = batches.arrow_schema(layout.NOTES)
    raw = layout.write_rich_docx([], notes=[("footnote", str(i), "x" * 100_000) for i in range(10)])
    files = [(str(i), "docx", raw if i != 5 else b"x") for i in range(40)]
    made = list(batches.read_batches(iter(files), form, {"docx": layout.docx_notes}, office._BROKEN))
    assert [r for b in made for r in zip(*b.to_pydict().values(), strict=True)] == [(p, *x) for p, _, c in files if c == raw for x in layout.docx_notes(c)]
    assert max(b.nbytes for b in made) < 6 << 20
    small = [(str(i), "docx", layout.write_rich_docx([], notes=[("endnote", "1", "y")])) for i in range(30)]
    assert [b.num_rows for b in batches.read_batches(iter(small), form, {"docx": layout.docx_notes}, office._BROKEN)] == [30]


@pytest.mark.parametrize("read", [layout.read_runs, layout.read_comments])
def test_documents_meet_in_one_shuffle_and_travel_as_arrow_batches(spark, sf_dir, read):
    plan = read(plans._documents(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan
    assert plan.count("MapInArrow") == 2 and plan.count("Exchange hashpartitioning") == 1


def calls_of(work):
    p = cProfile.Profile()
    out = p.runcall(work)
    return out, pstats.Stats(p).total_calls


def test_small_documents_are_written_and_read_in_few_calls():
    n = 8
    runs = [(i, k, f"a & b {i}.\n" * 3, k == 0, False, False, False, "Sans", 10.5, None, (None, "Insert", "Delete")[i % 3], "user", None) for i in range(n) for k in range(2)]
    comments = [(str(i), "0" if i else None, "user", None, f"a < b {i}.\n" * 3) for i in range(n)]
    notes = [(("footnote", "endnote")[i % 2], str(i), f"user {i}") for i in range(n)]
    raw, written = calls_of(lambda: layout.write_rich_docx(runs, comments, notes, [(1, 0, "decimal", "%1.", 1)], [(0, 612.0, 792.0, None, None, None, None, 1, "continuous")], [("title", "T")]))
    back, read = calls_of(lambda: layout.docx_comments(raw))
    assert back == comments
    assert written < 160 * n and read < 160 * n


def test_small_files_are_as_zipfile_writes_them(monkeypatch):
    entries = {"mimetype": "x" * 9, "a/é.xml": "é" * 50_000, "empty": ""}
    raw = office._zip(entries, ("mimetype",))
    z = zipfile.ZipFile(io.BytesIO(raw))
    assert z.testzip() is None and {n: z.read(n).decode() for n in z.namelist()} == entries
    assert [(i.compress_type, i.date_time[:3]) for i in z.infolist()] == [(0, (2000, 1, 1)), (8, (2000, 1, 1)), (8, (2000, 1, 1))]
    assert len(zipfile.ZipFile(io.BytesIO(office._zip({f"h{i}": "" for i in range(70_000)}))).namelist()) == 70_000
    monkeypatch.setattr(office, "MOST", 10)  # larger files are left to ZipFile
    assert office._zip(entries, ("mimetype",)) == raw


def test_values_of_columns_are_those_of_arrow():
    import pyarrow as pa

    from sheetwright.sources import batches

    columns = [(["é", None, ""], pa.string()), ([True, None, False], pa.bool_()), ([1, None], pa.int32()), ([1, 2**40], pa.int64()), ([0.5, float("inf")], pa.float64()), ([None, 0.5], pa.float64()), ([b"a", None], pa.binary()), ([], pa.string())]
    for some, form in columns:
        got = batches.values_of(pa.array(some, form))
        assert got == some and list(map(type, got)) == list(map(type, some))
