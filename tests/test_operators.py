"""Operators on small tables: nulls, ties, blanks and the semantics that the query tables don't reach."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from sheetwright.functions import cells
from sheetwright.operators import doctree, lookup, oplog, pages, tableops, text


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_filters_with_blanks(spark):
    df = spark.createDataFrame([(1, "5"), (2, ""), (3, None), (4, "x"), (5, "-1")], "id int, v string")
    assert rows(tableops.filter_number(df, "v", "lt", 1).select("id")) == [(2,), (3,), (5,)]
    assert rows(tableops.filter_number(df, "v", "gt", 1).select("id")) == [(1,)]
    assert rows(tableops.filter_values(df, {"v": ["", "x"]}).select("id")) == [(2,), (3,), (4,)]


def test_top_keeps_ties(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5, 5, 4, 4, 3, None])], "id int, v int")
    assert rows(tableops.filter_top(df, "v", 3).select("id")) == [(0,), (1,), (2,), (3,)]
    assert rows(tableops.filter_top(df.limit(0), "v", 3)) == []


def test_dedupe_by_text(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, None), (4, None)], "ord int, v double")
    assert rows(tableops.remove_duplicates(df, ["v"], ["ord"]).select("ord")) == [(1,), (3,)]
    assert rows(tableops.duplicate_count(df, ["v"])) == [(2,)]


def test_pivot_counts_blank_values_as_zero(spark):
    df = spark.createDataFrame([("a", "x", None), ("a", "y", 2.0), ("b", "x", 4.0)], "r string, c string, v double")
    assert rows(tableops.pivot(df, "r", "v", "count", "c")) == [("a", 1, 1), ("b", 1, 0)]
    assert rows(tableops.pivot(df, "r", "v", "average", "c", ["x", "y"])) == [("a", 0.0, 2.0), ("b", 4.0, 0.0)]


def test_numbered_is_the_order(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "v int")
    assert rows(tableops.numbered(df, ["v"])) == sorted(((i, i + 1) for i in range(101)), key=repr)


def test_cells_move(spark):
    c = spark.createDataFrame([(0, 0, "a"), (1, 0, "b"), (2, 0, "c")], "row int, col int, value string")
    assert rows(tableops.delete_rows(tableops.insert_rows(c, 1, 2), 0)) == [(2, 0, "b"), (3, 0, "c")]
    assert rows(tableops.transpose_cells(c).select("row", "col")) == [(0, 0), (0, 1), (0, 2)]
    assert rows(tableops.regions(spark.createDataFrame([(1, 0, "x"), (2, 0, "x"), (3, 0, ""), (7, 0, "y")], "row int, col int, value string"))) == [(1, 2, 2), (7, 7, 1)]


@pytest.mark.parametrize("by", [(), ("g",)])
def test_asof_by_brute_force(spark, by):
    left = [(i, i % 3, float(i % 17)) for i in range(60)]
    right = [(100 + j, j % 3, float(3 * (j % 6) + 1)) for j in range(12)]
    a = spark.createDataFrame(left, "id int, g int, k double")
    b = spark.createDataFrame(right, "rid int, g int, k double")
    for way in ("backward", "forward"):
        got = {r["id"]: r["rid"] for r in lookup.lookup_asof(a, "k", b, "k", ["rid"], by, ["rid"], way).collect()}
        for i, g, k in left:
            ok = [(rk if way == "backward" else -rk, rid) for rid, rg, rk in right if (not by or rg == g) and (rk <= k if way == "backward" else rk >= k)]
            assert got[i] == (max(ok)[1] if ok else None)


def test_lookup_takes_the_first(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1, "late", 2), (1, "early", 1), (None, "n", 0)], "k int, v string, o int")
    assert rows(lookup.lookup_exact(a, "k", b, "k", ["v"], ["o"])) == [(1, "early"), (2, None), (None, None)]


def test_rules_and_validation(spark):
    df = spark.createDataFrame([(1, "x", 5.0), (2, None, None), (3, "longer", 50.0)], "id int, t string, n double")
    found = tableops.validate(df, [{"type": "number", "col": "n", "min": 1, "max": 10}, {"type": "textLength", "col": "t", "max": 3}, {"type": "list", "col": "t", "values": ["x"]}], ["id"])
    assert rows(found) == [(2, "0:n:number", ""), (2, "2:t:list", ""), (3, "0:n:number", "50"), (3, "1:t:textLength", "longer"), (3, "2:t:list", "longer")]
    style = tableops.conditional_style(df, [{"type": "lessThan", "col": "n", "a": 1, "style": "low"}, {"type": "textContains", "col": "t", "a": "LONG", "style": "long"}])
    assert rows(df.select("id", style.alias("s"))) == [(1, None), (2, "low"), (3, "long")]


def test_number_texts(spark):
    df = spark.createDataFrame([(5.0,), (0.1,), (12345678.5,), (1e7,), (-0.5,), (None,)], "x double")
    assert [r[0] for r in df.select(cells.number_text(F.col("x"))).collect()] == ["5", "0.1", "12345678.5", "10000000", "-0.5", None]
    t = spark.createDataFrame([("1d",), ("0x1p3",), ("5.",), (".5",), ("+7",), ("1e3",), ("",), (None,)], "t string")
    assert [r[0] for r in t.select(cells.number_of(F.col("t"))).collect()] == [None, None, 5.0, 0.5, 7.0, 1000.0, None, None]


def test_text_operators(spark):
    df = spark.createDataFrame([(1, "The then the. THE"), (2, None), (3, "")], "id int, t string")
    assert rows(text.find(df, "id", "t", "the", whole_word=True)) == [(1, 3, 0)]
    assert rows(text.find(df, "id", "t", "a.c")) == []
    assert rows(df.where("id = 1").select(text.replace_all(F.col("t"), "the", "$1", whole_word=True))) == [("$1 then $1. $1",)]
    lines = spark.createDataFrame([("INTRODUCTION",), ("ABC",), ("1) the scope",), ("1. the scope",), ("A plain sentence.",), ("My notes:",), ("The Art Of War",), ("The Art of War",), ("Stop. Go On",), ("",), (None,), ("Chapter One. And More",), ("  PART II  ",), ("A " * 16,), ("One",)], "t string")
    assert [r[0] for r in lines.select(text.heading_level(F.col("t"))).collect()] == [1, 0, 2, 0, 0, 3, 2, 0, 0, 0, 0, 0, 1, 0, 0]


def test_tree_round_trip_and_text(spark):
    source = "# One\npara\n1. a\n1. b\n- c\n---\n## Two"
    nodes = doctree.from_text(spark.createDataFrame([("d", source)], "k string, t string"), "k", "t")
    assert doctree.render_text(nodes).first()["text"] == source.replace("1. b", "2. b")
    assert doctree.plain_text(nodes).first()["text"] == "One\npara\na\nb\nc\nTwo"


def test_style_cycles_end(spark):
    s = spark.createDataFrame([("a", "b", {"x": "1"}), ("b", "a", {"x": "2", "y": "3"})], "style_id string, parent_id string, attrs map<string,string>")
    assert {r["style_id"]: r["attrs"] for r in doctree.resolve_styles(s).collect()} == {"a": {"x": "1", "y": "3"}, "b": {"x": "2", "y": "3"}}


def test_threads_stay_in_their_document(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 0), (2, 0, None), (2, 1, 0), (2, 2, 0), (2, 3, 1), (3, 0, None), (None, 0, None), (None, 1, 0)], "doc_id long, comment_id long, parent_id long")
    got = rows(doctree.comment_threads(df))
    assert got == sorted([(1, 0, None, 1), (1, 1, 0, 0), (2, 0, None, 2), (2, 1, 0, 1), (2, 2, 0, 0), (2, 3, 1, 0), (3, 0, None, 0), (None, 0, None, 1), (None, 1, 0, 0)], key=repr)


def test_text_queries_keep_every_document(spark, tmp_path):
    from sheetwright.plans import registry

    texts = {"1": "plain\nlines", "2": "# One\npara\n1. a\n2. b\n- c\n---\n## Two", "3": "a\n\nb\n", "4": "\nx", "5": None, "6": ""}
    spark.createDataFrame([(int(k), v) for k, v in texts.items()], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert rows(registry.QUERIES["text_roundtrip"](spark, str(tmp_path))) == [(k, md5(v or "")) for k, v in sorted(texts.items())]
    plain = {"1": "plain\nlines", "2": "One\npara\na\nb\nc\nTwo", "3": "a\nb\n", "4": "x", "5": "", "6": ""}
    assert rows(registry.QUERIES["plain_text"](spark, str(tmp_path))) == [(k, md5(v)) for k, v in sorted(plain.items())]


def test_scalar_queries_read_whole_texts(spark, tmp_path):
    from sheetwright.plans import registry

    run = lambda name: rows(registry.QUERIES[name](spark, str(tmp_path)))
    long = "word " * 20
    spark.createDataFrame([(1, long + "  \u00a0 end\t\n", "en", "s"), (2, None, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r[:2] for r in run("fn_trim_case")] == [(1, long + "end"), (2, "")]
    said = [(1, 0, "123456789"), (1, 1, "12345 apples"), (1, 2, "=A1"), (1, 3, "FALSE"), (1, 4, "plain words,\nINTRODUCTION\n\n2.1 Scope"), (1, 5, None)]
    spark.createDataFrame(said, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r[2] for r in run("type_infer")] == ["number", "boolean", "formula", "boolean", "number", "boolean"]
    assert [r[2:] for r in run("auto_heading") if r[1] >= 4] == [(0, 0), (1, 1), (2, 0), (3, 0), (0, 0)]


def test_text_replicas_converge():
    ops = [("InsertText", 1, 1, None, "h"), ("InsertText", 2, 1, (1, 1), "i"), ("InsertText", 2, 2, (1, 1), "X"), ("InsertText", 3, 2, (2, 2), "Y"), ("DeleteText", 4, 1, (2, 1), None)]
    want = oplog.text_replica(ops)
    assert want == "hXY"
    for order in itertools.permutations(ops):
        assert oplog.text_replica([*order, order[0]]) == want


@pytest.mark.parametrize(
    ("ops", "want"),
    [
        ([(1, 1, None, "x", None), (2, 2, None, "y", None)], "xy"),
        ([(1, 1, None, "a", None), (2, 1, (1, 1), "c", None), (3, 1, (1, 1), "x", (2, 1)), (4, 2, (1, 1), "y", (2, 1))], "axyc"),
        ([(1, 1, None, "a", None), (3, 1, (1, 1), "b", (2, 1)), (2, 1, (1, 1), "c", None)], "abc"),
        ([(1, 1, None, "b", None), (2, 1, None, "a", (1, 1))], "ab"),
    ],
)
def test_concurrent_inserts(ops, want):
    for order in itertools.permutations(ops):
        assert oplog.text_replica([("InsertText", *o) for o in order]) == want


def test_random_histories_converge_to_what_their_writers_saw():
    """Two replicas append to a common text; whatever the order of delivery, each one's run stays whole and in order."""
    r = random.Random(5)
    for _ in range(60):
        base = [(k + 1, 1, (k, 1) if k else None, c, None) for k, c in enumerate("base")]
        runs = []
        for replica in (2, 3):
            word = "".join(r.choice("abcdefg" if replica == 2 else "TUVWXYZ") for _ in range(r.randint(1, 10)))
            runs.append((word, [(5 + k, replica, (4 + k, replica) if k else (4, 1), c, None) for k, c in enumerate(word)]))
        ops = [("InsertText", *o) for o in [*base, *runs[0][1], *runs[1][1]]]
        texts = set()
        for _ in range(6):
            r.shuffle(ops)
            texts.add(oplog.text_replica(ops + ops[:3]))
        assert len(texts) == 1
        out = texts.pop()
        assert out.startswith("base") and "".join(c for c in out[4:] if c.islower()) == runs[0][0] and "".join(c for c in out[4:] if c.isupper()) == runs[1][0]


def test_long_texts_are_replayed_quickly():
    ops = [("InsertText", k + 1, 1, (k, 1) if k else None, "a") for k in range(200_000)]
    assert len(oplog.text_replica(ops)) == 200_000


def test_children_stand_in_the_order_of_their_ops(spark):
    ops = [("d", 1, 10, "InsertNode", "c3", "r"), ("d", 1, 1, "InsertNode", "c1", "r"), ("d", 1, 5, "InsertNode", "c2", "r"), ("d", 2, 12, "MoveNode", "c1", "r"), ("d", 2, 11, "InsertNode", "k", "c1")]
    got = oplog.converge_tree(spark.createDataFrame(ops, "doc_id string, replica int, lamport int, kind string, target string, value string"))
    assert rows(got.select("node_id", "parent_id", "pos")) == [("c1", "r", 2), ("c2", "r", 0), ("c3", "r", 1), ("k", "c1", 0)]


def test_deep_trees_and_styles(spark):
    n = 300
    chain = spark.createDataFrame([("d", k, k - 1 if k else None) for k in range(n)], "doc_id string, node_id int, parent_id int")
    up = doctree.ancestors(chain)
    assert up.count() == n * (n - 1) // 2 and up.where("node_id = 299 and ancestor_id = 0").first()["distance"] == 299
    styles = spark.createDataFrame([(k, k - 1 if k else None, {"base": "yes"} if k == 0 else {}) for k in range(n)], "style_id int, parent_id int, attrs map<string,string>")
    assert doctree.resolve_styles(styles).where("attrs['base'] = 'yes'").count() == n
    ring = spark.createDataFrame([("d", k, (k + 1) % 5) for k in range(5)] + [("d", 9, 0)], "doc_id string, node_id int, parent_id int")
    assert doctree.ancestors(ring).where("node_id = 0").count() == 4 and doctree.ancestors(ring).where("node_id = 9").count() == 5


@pytest.mark.parametrize(
    ("address", "private"),
    [("127.0.0.1", True), ("http://10.1.2.3:80/x", True), ("172.32.0.1", False), ("255.255.255.255", True), ("224.0.0.1", True), ("203.0.113.9", True), ("8.8.8.8", False), ("01.2.3.4", False), ("::1", True), ("::", True), ("fe80::1", True), ("fd00::1", True),
     ("ff02::1", True), ("::ffff:10.0.0.1", True), ("::ffff:8.8.8.8", False), ("2001:db8::1", False), ("localhost", True), ("https://a.local/x", True), ("metadata.google.internal", True), ("internal.example.com", False), ("0:0:0:0:0:0:0:1", True)],
)
def test_private_addresses(spark, address, private):
    assert spark.range(1).select(pages.is_private_host(F.lit(address))).first()[0] is private


def test_file_names(spark):
    raw = ["../../etc/pass wd", "a<b>.txt", "..", "", " x\\y.doc ", "a\tb", "a:b|c"]
    got = spark.createDataFrame([(x,) for x in raw], "x string").select(pages.safe_filename(F.col("x"))).collect()
    assert [r[0] for r in got] == ["pass wd", "a_b_.txt", "document", "document", "y.doc", "a_b", "a_b_c"]


def test_texts_among_numbers(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "x"), ("a", ""), ("b", "10"), ("b", "9"), ("b", None)], "g string, v string")
    assert rows(tableops.pivot(df, "g", "v", "sum")) == [("a", 1.0), ("b", 19.0)]
    assert rows(tableops.pivot(df, "g", "v", "count")) == [("a", 2), ("b", 3)]
    assert rows(tableops.filter_top(df, "v", 1)) == [("b", "10")]
    assert rows(tableops.nice_scale(df, "v").select("lo", "hi")) == [(1.0, 10.0)]
    assert tableops.pie_shares(df, "g", "v").agg(F.sum("share")).first()[0] == pytest.approx(1)
    keys = spark.createDataFrame([("b",), ("zz",)], "k string")
    near = lookup.lookup_asof(keys, "k", spark.createDataFrame([("a", 1), ("c", 2)], "k string, t int"), "k", ["t"], direction="forward")
    assert rows(near) == [("b", 2), ("zz", None)]


def test_messages(spark):
    said = ['{"type":"sync"}', '{"type":"ack"}', '{"action":"peer-join"}', '{"action":"x"}', '{"type":1}', '{"type":null,"action":"op"}', "[]", "{", '"op"', "x" * 300_000]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, body string").select(oplog.message_errors("body")).collect()
    assert [r[0] for r in got] == [None, "unknown_type", None, "unknown_action", "no_type", None, "no_type", "bad_json", "no_type", "too_large"]


def test_null_keys_share_a_window(spark):
    from sheetwright.streaming import sessions

    df = spark.createDataFrame([(None, k) for k in range(4)] + [(1, k) for k in range(2)], "u long, k int").withColumn("ts", F.timestamp_seconds(F.col("k") + 0.5))
    assert rows(sessions.anchored_windows(df, "u", "ts", 60, ["k"]).select("k", "nth")) == sorted([(0, 1), (1, 2), (2, 3), (3, 4), (0, 1), (1, 2)])


def test_tree_moves_never_make_cycles():
    ops = [(1, 1, "InsertNode", "a", None), (2, 1, "InsertNode", "b", None), (3, 1, "MoveNode", "a", "b"), (3, 2, "MoveNode", "b", "a")]
    for order in itertools.permutations(ops):
        assert oplog.tree_replica(list(order)) == {"a": "b", "b": None}


def test_history():
    h = oplog.History("ab")
    h.run([("insert", 1, "X"), ("delete", 0, 1)])
    assert h.text == "Xb"
    assert h.undo() and h.text == "ab"
    assert h.redo() and h.text == "Xb"
    assert not h.redo()
    with pytest.raises(ValueError, match="delete"):
        h.run([("insert", 0, "!"), ("delete", 9, 1)])
    assert h.text == "Xb"


def test_vectors(spark):
    v = lambda *r: spark.createDataFrame([("d", a, b) for a, b in r], "doc_id string, replica long, lamport long")
    rel = lambda a, b: oplog.compare_vectors(a, b).first()["relation"]
    assert rel(v((1, 5)), v((1, 5))) == "equal"
    assert rel(v((1, 5), (2, 1)), v((1, 5))) == "dominates"
    assert rel(v((1, 1)), v((1, 5))) == "dominated"
    assert rel(v((1, 9)), v((2, 1))) == "concurrent"


def test_store(spark, tmp_path):
    import datetime

    from sheetwright.operators.store import Store, expand_names

    t = lambda h: datetime.datetime(2024, 1, 1, h)
    s = Store(spark, str(tmp_path / "store"))
    cols = "id string, name string, updated_at timestamp, content string"
    s.put(spark.createDataFrame([("a", "A", t(1), "one"), ("b", "B", t(2), "two"), ("c", "C", t(3), "x")], cols))
    s.put(spark.createDataFrame([("a", "A2", t(4), "new")], cols))
    s.delete(spark.createDataFrame([("c",)], "id string"), "2024-01-01 05:00:00")
    assert rows(s.current().select("id", "name", "content")) == [("a", "A2", "new"), ("b", "B", "two")]
    assert [tuple(r) for r in s.listed(1, 1).select("id", "total").collect()] == [("b", 2)]
    assert s.get(["c"]).count() == 0
    assert expand_names("=x+\"x\"+SUM(y)", {"x": "=y*2", "Y": "A1:A3"}) == '=A1:A3*2+"x"+SUM(A1:A3)'
    assert expand_names("=a", {"a": "b", "b": "a"}) == "=a"


def test_kept_blocks_move_together(spark):
    from sheetwright.operators.pages import paginate_blocks

    df = spark.createDataFrame([("d", 0, 6.0, False), ("d", 1, 3.0, True), ("d", 2, 3.0, False), ("d", 3, 99.0, False), ("e", 0, 1.0, True)], "doc_id string, ord int, height double, keep_next boolean")
    assert rows(paginate_blocks(df, 10)) == [("d", 0, 1), ("d", 1, 2), ("d", 2, 2), ("d", 3, 3), ("e", 0, 1)]


def test_display_rounds_the_binary_value_and_halves_to_even(spark):
    values = [9725.0, 198500.0, 9735.0, 1.005, 0.125, -0.375, 1.245e-5, 0.0, -0.0, 9.995e9, 123456789.0, 1e-120, None]
    values += [m * 10.0**k * sign for m in range(1005, 9999, 370) for k in (-9, -4, -3, 0, 3, 14) for sign in (1, -1)] + [1.245e20, 1.245e30, 7.625, 1234567.125, 98765.375, 20.00625]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    rows = df.select("i", text.display(F.col("v"), "scientific").alias("s"), text.display(F.col("v") / 100, "percentage").alias("p")).orderBy("i").collect()
    assert [r["s"] for r in rows] == [None if v is None else f"{v:.2e}" for v in values]
    assert [r["p"] for r, v in zip(rows, values, strict=True) if v is None or abs(v) < 2**53] == [None if v is None else f"{v / 100 * 100:.2f}%" for v in values if v is None or abs(v) < 2**53]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),)], "v double").select(text.display(F.col("v"), "scientific").alias("s")).collect()
    assert [r["s"] for r in odd] == ["NaN", "Infinity"]
