"""The sheet's editor, edits of documents and a replica's log on small tables."""

import random
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from sheetwright.operators import edits, oplog, sheetops
from sheetwright.sources import office


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(
    ("text", "want"),
    [("1+2*3", 7.0), ("(1+2)*3", 9.0), ("-(2)-+3", -5.0), ("0.1+0.2", 0.3), ("1/3", 0.3333333333), ("1/0", None), ("1/0+1", None), ("2**3", None), ("1.2.3", 1.2), (".", None), ("", None), ("a+1", None), ("(1", 1.0), ("1)", None), ("1 2", 12.0), ("٣+1", None)],
)
def test_arithmetic(text, want):
    got = sheetops.arithmetic(text)
    assert got is None if want is None else got == pytest.approx(want, abs=1e-12)


def test_finding_and_replacing(spark):
    df = spark.createDataFrame([("s", 0, 0, "A.b"), ("s", 0, 1, "axB"), ("s", 1, 0, None), ("s", 1, 1, "")], "sheet string, row int, col int, value string")
    assert rows(sheetops.find_cells(df, "a.B").select("row", "col")) == [(0, 0)]
    assert rows(sheetops.find_cells(df, "")) == []
    assert rows(sheetops.replace_cells(df, "a.", "$1\\").select("value", "changed")) == sorted([("$1\\b", True), ("axB", False), (None, False), ("", False)], key=repr)


def test_shared_sheet(spark):
    m = lambda **k: k or None
    ops = [
        (1, "ssSetCell", 0, 0, "old", m(b="1")), (2, "ssFormat", 0, 0, None, m(c="2")), (3, "ssSync", 1, 1, "kept", m(x="1")), (3, "ssSync", 1, 2, "gone", None),
        (4, "ssFormat", 1, 1, None, m(x="2", y="3")), (5, "ssSetCell", 1, 2, "", None), (6, "ssFormat", 5, 5, None, m(z="1")), (7, "ssSetCell", 2, 2, "v", m(q="1")), (8, "ssSetCell", 2, 2, "w", None),
    ]
    df = spark.createDataFrame([("d", a, k, "s", r, c, v, s) for a, k, r, c, v, s in ops], "doc_id string, arrival int, action string, sheet string, row int, col int, value string, style map<string,string>")
    for some in (df, df.orderBy(F.rand(3))):
        got = {(r["row"], r["col"]): (r["value"], r["style"]) for r in sheetops.shared_sheet(some).collect()}
        assert got == {(1, 1): ("kept", {"x": "2", "y": "3"}), (5, 5): ("", {"z": "1"}), (2, 2): ("w", {})}


def test_every_operation_has_an_inverse():
    r = random.Random(2)
    model = edits.new_model()
    node = lambda i, t, p="", kids=(): {"id": i, "type": t, "parent": p, "kids": list(kids)}
    edits.run_transaction(model, [{"kind": "InsertNode", "parent": "root", "index": 0, "nodes": [node("b", "Body")]}])
    done = 0
    for k in range(600):
        texts = [i for i, n in model["nodes"].items() if n["type"] == "Text"]
        paragraphs = [i for i, n in model["nodes"].items() if n["type"] == "Paragraph"]
        target, place = r.choice([*texts, "nowhere"]), r.randint(0, 4)
        op = r.choice(
            [
                {"kind": "InsertNode", "parent": "b", "index": place, "nodes": [node(f"p{k}", "Paragraph", "b", [f"r{k}"]), node(f"r{k}", "Run", f"p{k}", [f"t{k}"]), {**node(f"t{k}", "Text", f"r{k}"), "text": "abc"}]},
                {"kind": "DeleteNode", "target": r.choice([*paragraphs, "root"])}, {"kind": "MoveNode", "target": r.choice([*paragraphs, "b"]), "parent": r.choice(["b", "root"]), "index": place},
                {"kind": "InsertText", "target": target, "offset": place, "text": "xy"}, {"kind": "DeleteText", "target": target, "offset": place, "length": 2},
                {"kind": "SetAttributes", "target": "b", "attrs": {f"k{place}": str(k)}}, {"kind": "RemoveAttributes", "target": "b", "keys": [f"k{place}"]},
                {"kind": "SetMetadata", "key": f"m{place}", "value": r.choice([None, str(k)])}, {"kind": "SetStyle", "key": f"s{place}", "value": {"a": str(k)}}, {"kind": "RemoveStyle", "key": f"s{place}"}, {"kind": "Nothing"},
            ]
        )
        before = repr(model)
        try:
            back = edits.apply_op(model, op)
        except ValueError:
            assert repr(model) == before
            continue
        after = repr(model)
        again = edits.apply_op(model, back)
        assert eval(repr(model)) == eval(before)
        edits.apply_op(model, again)
        assert eval(repr(model)) == eval(after)
        done += 1
    assert done > 200


def test_transactions_and_history():
    s = edits.Session(cap=3)
    say = lambda k: [{"kind": "SetMetadata", "key": "k", "value": k}]
    for k in "abcd":
        s.run(say(k))
    with pytest.raises(ValueError):
        s.run([*say("z"), {"kind": "RemoveStyle", "key": "none"}])
    assert s.model["meta"] == {"k": "d"}
    assert [s.undo(), s.undo(), s.undo(), s.undo()] == [True, True, True, False] and s.model["meta"] == {"k": "a"}
    assert s.redo() and s.model["meta"] == {"k": "b"}
    s.run(say("x"), "typing")
    s.run(say("y"), "typing")
    assert not s.redo() and s.undo() and s.model["meta"] == {"k": "b"}


def test_replica_logs(spark):
    known = spark.createDataFrame([("d", 1, 5), ("d", 2, 9)], "doc_id string, replica int, lamport int")
    new = spark.createDataFrame([("d", 3, 0, "abc"), ("d", 3, 1, None), ("d", 3, 2, "x"), ("e", 3, 0, "")], "doc_id string, replica int, seq int, value string")
    assert rows(oplog.stamp_local(new, known).select("doc_id", "seq", "lamport")) == [("d", 0, 10), ("d", 1, 13), ("d", 2, 14), ("e", 0, 1)]
    ratio = oplog.compression_ratio(spark.createDataFrame([("a",), ("a",), ("b",)], "doc_id string"), spark.createDataFrame([("a",), ("c",)], "doc_id string"))
    assert rows(ratio) == [("a", 0.5), ("b", 0.0), ("c", 1.0)]
    hooks = spark.createDataFrame([(1, "register", "x", "u1"), (2, "remove", "x", None), (3, "register", "x", "u2"), (4, "register", "y", "u3"), (5, "remove", "z", None)], "seq int, action string, id string, url string")
    assert rows(oplog.registered_hooks(hooks)) == [(3, "x", "u2"), (4, "y", "u3")]


def test_preserved_parts(spark):
    raw = office.write_xlsx([("S", 0, 0, "number", 1.0, None, None, None, None)])
    out = BytesIO(raw)
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("xl/charts/chart1.xml", "<c/>")
        z.writestr("xl/worksheets/sheet9.xml", "<s/>")
    files = spark.createDataFrame([("a", out.getvalue()), ("b", b"no"), ("c", raw)], "path string, content binary")
    got = {(r["path"], r["name"]): bytes(r["content"]) for r in office.preserved_parts(files).collect()}
    assert got[("a", "xl/charts/chart1.xml")] == b"<c/>" and ("a", "xl/worksheets/sheet9.xml") in got and not [k for k in got if k[0] == "b"]
