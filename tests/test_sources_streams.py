"""Readers, writers and streams."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sheetwright.operators import oplog
from sheetwright.sources import delimited, detect, markup, office
from sheetwright.streaming import sessions

CSV = [
    ('a,"b, c",d', [["a", "b, c", "d"]]), ('"say ""hi"""', [['say "hi"']]), ('"two\nlines",x', [["two\nlines", "x"]]), ("a,,c\r\nd", [["a", "", "c"], ["d"]]), ("a\rb", [["a"], ["b"]]), ('"open,x\ny', [["open,x\ny"]]), ("a,", [["a", ""]]), ("", []), ("a\n", [["a"]]),
]


@pytest.mark.parametrize(("text", "want"), CSV)
def test_csv(text, want):
    assert delimited.parse_rows(text) == want


def test_decoding():
    assert delimited.decode_bytes(b"\xef\xbb\xbfa") == "a"
    assert delimited.decode_bytes("é".encode("utf-16")) == "é"
    assert delimited.decode_bytes(b"\xe9") == "é"


def test_csv_files(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"'), ("x", "y")], "p string, q string")
    delimited.write_csv(df, str(tmp_path / "o"))
    assert sorted(map(tuple, delimited.read_csv(spark, str(tmp_path / "o"), header=True).collect())) == [("a,b", 'q"'), ("x", "y")]
    stream = delimited.stream_csv(spark, str(tmp_path / "o"), "p string, q string")
    got = []
    assert sessions.flush_batches(stream, lambda b, _: got.extend(b.collect())).awaitTermination(90)
    assert len(got) == 2


def test_detection(spark, tmp_path):
    (tmp_path / "t.docx").write_bytes(office.write_docx([(0, "paragraph", 0, "x")]))
    (tmp_path / "noext").write_bytes(office.write_xlsx([("S", 0, 0, "number", 1.0, None, None, None, None)]))
    (tmp_path / "p").write_bytes(b"%PDF-1.7")
    (tmp_path / "c.txt").write_bytes(b"a,b\n1,2\n")
    (tmp_path / "old").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"x")
    got = {r["path"].rpartition("/")[2]: r["format"] for r in detect.read_files(spark, str(tmp_path)).collect()}
    assert got == {"t.docx": "docx", "noext": "xlsx", "p": "pdf", "c.txt": "txt", "old": "doc"}


def test_hostile_files(spark):
    bad = [("a", "docx", b""), ("b", "docx", b"PK\x03\x04junk"), ("c", "odt", office.write_docx([(0, "paragraph", 0, "x")])[:60]), ("d", "docx", _zip({"word/document.xml": "<not"})), ("e", "txt", b"\xff")]
    df = spark.createDataFrame(bad, "path string, format string, content binary")
    got = [tuple(r) for r in office.read_documents(df).collect()]
    assert [(r[0], r[2]) for r in got[:4]] == [(x, "error") for x in "abcd"] and got[4:] == [("e", 0, "paragraph", 0, "ÿ")]
    books = spark.createDataFrame([("x", "xlsx", b"nope"), ("y", "ods", b"")], "path string, format string, content binary")
    assert {r["kind"] for r in office.read_workbooks(books).collect()} == {"error"}


def _zip(entries):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for k, v in entries.items():
            z.writestr(k, v)
    return buf.getvalue()


def test_open_formulas():
    assert office.from_open_formula("of:=SUM([.A1:.B2];[$Sheet2.C3])") == "=SUM(A1:B2,Sheet2!C3)"
    assert office.to_open_formula("=SUM(A1:B2,Sheet2!C3)") == "of:=SUM([.A1:.B2];[$Sheet2.C3])"
    assert office.serial_to_iso(office.iso_to_serial("2024-02-29")) == "2024-02-29"


def test_office_round_trips():
    cells = [("S", 0, 0, "number", 1.5, None, None, None, None), ("S", 0, 1, "text", None, "a<&\"b", None, None, None), ("S 2", 3, 2, "boolean", None, None, True, None, None)]
    assert office.read_xlsx(office.write_xlsx(cells)) == cells
    assert office.read_ods(office.write_ods(cells)) == cells
    blocks = [(0, "heading", 2, "T & U"), (1, "paragraph", 0, ""), (2, "bullet", 1, "b"), (3, "row", 0, "p\tq"), (4, "paragraph", 0, "end")]
    assert office.read_docx(office.write_docx(blocks)) == blocks
    assert office.read_odt(office.write_odt(blocks)) == blocks


def test_markup():
    assert markup.inline_runs("a **b** [c](u) `d`") == [("plain", "a ", None), ("bold", "b", None), ("plain", " ", None), ("link", "c", "u"), ("plain", " ", None), ("code", "d", None)]
    assert markup.html_table("<p>no</p>") == []
    assert markup.html_table("<table><tr><td>x<table><tr><td>in</td></tr></table></td></tr></table>")[0][:2] == (0, 0)


def _t(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def test_anchored_windows(spark):
    rows = [(1, "a", _t(0)), (2, "a", _t(50)), (3, "a", _t(59)), (4, "a", _t(61)), (5, "b", _t(61)), (6, "a", _t(120)), (7, "a", _t(121))]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp")
    got = {r["id"]: r["nth"] for r in sessions.anchored_windows(df, "k", "ts", 60, ["id"]).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1, 5: 1, 6: 2, 7: 1}
    assert sorted(r["id"] for r in sessions.over_limit(df, "k", "ts", 2, 60, ["id"]).collect()) == [3]


def test_session_stream_matches_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    rows = [(u, _t(100 * i * (1 + u))) for u in (1, 2, 3) for i in range(8)] + [(9, _t(100_000))]
    df = spark.createDataFrame(rows, "u int, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = sessions.session_windows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "u", "ts", watermark="1 minute")
    q = stream.writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    want = sessions.session_windows(df.where("u < 9"), "u", "ts")
    assert sorted(map(tuple, spark.table("sess").collect())) == sorted(map(tuple, want.collect()))


def test_causal_stream(spark, tmp_path):
    ops = [("d", 1, 2, {1: 1}, "b"), ("d", 2, 3, {1: 2}, "c"), ("d", 1, 1, None, "a"), ("d", 1, 1, None, "a"), ("d", 3, 9, {2: 8}, "never")]
    df = spark.createDataFrame(ops, "doc_id string, replica long, lamport long, deps map<long,long>, value string")
    df.write.parquet(str(tmp_path / "in"))
    out = sessions.causal_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("causal").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert [r["value"] for r in spark.table("causal").collect()] == ["a", "b", "c"]


def test_limited_stream(spark, tmp_path):
    rows = [(i, "k", _t(i)) for i in range(5)] + [(9, "k", _t(70))]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = sessions.limited_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "ts", 2, 60)
    q = out.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert sorted(r["id"] for r in spark.table("limited").collect()) == [0, 1, 9]


def test_hooks(spark):
    seen = []
    sessions.run_hooks(spark.range(3), [lambda d: d.where("id > 0")], lambda d: seen.append(d.count()), [lambda d: seen.append("after")])
    assert seen == [2, "after"]


def test_message_errors(spark):
    df = spark.createDataFrame([('{"type":"op"}',), ("{",), ("{}",), ('{"type":"x"}',), ('{"type":"op","p":"' + "y" * 300_000 + '"}',)], "m string")
    assert [r[0] for r in df.select(oplog.message_errors("m").alias("e")).collect()] == [None, "bad_json", "no_type", "unknown_type", "too_large"]
    assert df.where(F.col("m").isNull()).count() == 0


def test_broken_files_say_so(spark):
    files = spark.createDataFrame([("a.xlsx", "xlsx", b"no"), ("b.ods", "ods", b"PK\x03\x04cut"), ("c.docx", "docx", b""), ("d.txt", "txt", b"x\ny")], "path string, format string, content binary")
    assert sorted((r["workbook_id"], r["kind"], bool(r["err"]), r["row"]) for r in office.read_workbooks(files).collect()) == [("a.xlsx", "error", True, None), ("b.ods", "error", True, None)]
    assert sorted((r["path"], r["kind"]) for r in office.read_documents(files).collect()) == [("c.docx", "error"), ("d.txt", "paragraph"), ("d.txt", "paragraph")]
    got = {r["path"]: r for r in office.convert(files, "docx").collect()}
    assert got["c.docx"]["content"] is None and "BadZipFile" in got["c.docx"]["err"]
    back = office.convert(spark.createDataFrame([("d", "docx", bytes(got["d.txt"]["content"]))], "path string, format string, content binary"), "txt").first()
    assert bytes(back["content"]) == b"x\ny" and back["err"] is None


def test_first_lines_are_split_once(spark):
    from pyspark.sql import functions as F

    from sheetwright.sources import detect

    texts = {"a,b\n" * 10: True, "a,b\r\n" * 11: True, "a,b\n" * 9 + "c": True, "a,b\n" * 5 + "\n" * 5: False, "a,b\n" * 10 + "\n" * 90: True, "a,b": False, "\r\n": False, "": False, None: False}
    df = spark.createDataFrame([(t, v) for t, v in texts.items()], "t string, v boolean").withColumn("got", detect.looks_like_csv(F.col("t")))
    assert df.where("not got <=> v").collect() == []
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_text_tables_take_their_lines_once(spark):
    from sheetwright.sources import delimited

    df = spark.createDataFrame([(1, 'a,b\r\n"1,2",3\n'), (2, "x|y\n|-|-|\n1|2"), (3, "p\tq"), (4, None), (5, "a;b\n;")], "id int, t string")
    out = delimited.text_table(df, "id", "t")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0, ["a", "b"], True), (1, 1, ["1,2", "3"], False), (2, 0, ["x", "y"], True), (2, 1, ["1", "2"], False), (5, 0, ["a", "b"], False), (5, 1, ["", ""], False)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(t#") == 1
