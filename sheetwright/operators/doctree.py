"""Document trees as rows: nodes(doc_id, node_id, parent_id, pos, path, depth, type, text, attrs).

`path`, the positions from the root, is made once; document order is then a sort, subtrees are path prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import drop_table, shared_table

#: Which node types may hold which.
ALLOWED = {
    "Document": ["Body", "Header", "Footer", "CommentBody", "FootnoteBody", "EndnoteBody"],
    "Body": ["Section", "Paragraph", "Table", "Image", "TableOfContents", "PageBreak", "ColumnBreak"],
    "Section": ["Paragraph", "Table", "Image", "TableOfContents"],
    "TableOfContents": ["Paragraph"],
    "Paragraph": [
        "Run", "LineBreak", "PageBreak", "ColumnBreak", "Tab", "Image", "Drawing", "Field", "Equation", "BookmarkStart", "BookmarkEnd", "CommentStart", "CommentEnd", "FootnoteRef", "EndnoteRef",
    ],
    "Run": ["Text"],
    "Table": ["TableRow"],
    "TableRow": ["TableCell"],
    "TableCell": ["Paragraph", "Table"],
    "Header": ["Paragraph", "Table"],
    "Footer": ["Paragraph", "Table"],
    "CommentBody": ["Paragraph"],
    "FootnoteBody": ["Paragraph"],
    "EndnoteBody": ["Paragraph"],
}


def from_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """The nodes of plain texts: a Body with a Paragraph for each line; `# ` lines are headings, `- ` and `1. ` lines list items."""
    lines = df.select(F.col(key).cast("string").alias("doc_id"), F.posexplode(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1)).alias("pos", "raw"))
    hashes = F.char_length(F.regexp_extract("raw", r"^(#{1,6}) ", 1))
    indent = (F.char_length(F.regexp_extract("raw", r"^( *)(?:- |\d+\. )", 1)) / 2).cast("int")
    bullet, number = F.col("raw").rlike(r"^ *- "), F.col("raw").rlike(r"^ *\d+\. ")
    kind = F.when(F.col("raw") == "---", "PageBreak").otherwise("Paragraph")
    style = F.when(hashes > 0, F.concat(F.lit("Heading"), hashes.cast("string")))
    attrs = F.map_from_entries(
        F.filter(
            F.array(
                F.struct(F.lit("StyleId").alias("k"), style.alias("v")),
                F.struct(F.lit("ListFormat").alias("k"), F.when(bullet, "bullet").when(number, "decimal").alias("v")),
                F.struct(F.lit("ListLevel").alias("k"), F.when(bullet | number, indent.cast("string")).alias("v")),
            ),
            lambda e: e["v"].isNotNull(),
        )
    )
    body = lines.select("doc_id").distinct().select("doc_id", F.lit("0").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("pos"), F.array(F.lit(0)).alias("path"), F.lit(0).alias("depth"), F.lit("Body").alias("type"), F.lit(None).cast("string").alias("text"), F.expr("cast(map() as map<string,string>)").alias("attrs"))
    clean = F.regexp_replace("raw", r"^(#{1,6} | *- | *\d+\. )", "")
    rows = lines.select("doc_id", F.concat(F.lit("0."), F.col("pos").cast("string")).alias("node_id"), F.lit("0").alias("parent_id"), "pos", F.array(F.lit(0), F.col("pos")).alias("path"), F.lit(1).alias("depth"), kind.alias("type"), F.when(kind == "Paragraph", clean).alias("text"), attrs.alias("attrs"))
    return body.unionByName(rows)


def children(nodes: DataFrame, parent: str) -> DataFrame:
    return nodes.where(F.col("parent_id") == parent).orderBy("doc_id", "pos")


def within(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, root_id, node_id, ...): the descendants of roots(doc_id, root_id), themselves left out."""
    tops = nodes.join(roots, (nodes.doc_id == roots.doc_id) & (nodes.node_id == roots.root_id), "left_semi").select("doc_id", F.col("node_id").alias("root_id"), F.col("path").alias("_root"))
    # a node knows its ancestors' paths, so this is a join by equality
    ups = nodes.withColumn("_up", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda n: F.slice("path", 1, n)))).where(F.size("_up") < F.size("path"))
    return ups.join(tops, (ups.doc_id == tops.doc_id) & (F.col("_up") == F.col("_root"))).select(ups.doc_id, "root_id", "node_id", "parent_id", "type", "path", "depth", "text")


def is_descendant(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(doc_id, node_id, ancestor_id) with `below`: whether the node lies under the other; false if one isn't there, or both are the same."""
    paths = nodes.groupBy("doc_id", "node_id").agg(F.min("path").alias("path"))
    low = paths.select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_n"), F.col("path").alias("_low"))
    top = paths.select(F.col("doc_id").alias("_e"), F.col("node_id").alias("_m"), F.col("path").alias("_top"))
    both = pairs.join(low, (F.col("doc_id") == F.col("_d")) & (F.col("node_id") == F.col("_n")), "left").join(top, (F.col("doc_id") == F.col("_e")) & (F.col("ancestor_id") == F.col("_m")), "left")
    below = (F.size("_low") > F.size("_top")) & (F.slice("_low", 1, F.greatest(F.size("_top"), F.lit(0))) == F.col("_top"))
    return both.select(*[F.col(f"`{c}`") for c in pairs.columns], F.coalesce(below, F.lit(False)).alias("below"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, ancestor_id, distance) for trees without paths, of any depth.

    By doubling: each round joins what is known up to a distance with itself, so rounds grow with the logarithm of the
    depth; each round is a table in the shared folder.  In a cycle every other node is an ancestor, once.
    """
    known = shared_table(nodes.where("parent_id is not null and parent_id <> node_id").select("doc_id", "node_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("distance")), "ancestors")
    reach, size = 1, known.count()
    while True:
        far = known.where(F.col("distance") == reach).withColumnRenamed("ancestor_id", "_via")
        up = known.select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_n"), "ancestor_id", F.col("distance").alias("_more"))
        more = far.join(up, (F.col("doc_id") == F.col("_d")) & (F.col("_via") == F.col("_n"))).select("doc_id", "node_id", "ancestor_id", (F.col("distance") + F.col("_more")).alias("distance"))
        grown = known.unionByName(more.where("ancestor_id <> node_id")).groupBy("doc_id", "node_id", "ancestor_id").agg(F.min("distance").alias("distance"))
        grown = shared_table(grown, "ancestors")
        now = grown.count()
        drop_table(known)
        known = grown
        if now == size:
            return known
        reach, size = 2 * reach, now


def plain_text(nodes: DataFrame) -> DataFrame:
    """(doc_id, text): texts in document order; a paragraph begins a line unless nothing or a line end is before it."""
    piece = F.when(F.col("type") == "LineBreak", "\n").when(F.col("type") == "Tab", "\t").when(F.col("type").isin("Text", "Paragraph"), F.coalesce("text", F.lit(""))).otherwise("")
    ordered = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("path", F.col("type").alias("t"), piece.alias("s")))).alias("p"))
    joined = F.aggregate("p", F.lit(""), lambda a, x: F.concat(a, F.when((x["t"] == "Paragraph") & (a != "") & ~a.endswith("\n"), "\n").otherwise(""), x["s"]))
    return ordered.select("doc_id", joined.alias("text"))


def headings(nodes: DataFrame, max_level: int = 9) -> DataFrame:
    """(doc_id, node_id, level, text, path) of heading paragraphs, those within tables left out."""
    level = F.regexp_extract(F.coalesce(F.try_element_at("attrs", F.lit("StyleId")), F.lit("")), r"^Heading(\d+)$", 1)
    rows = nodes.where(F.col("type") == "Paragraph").withColumn("level", level.try_cast("int")).where(F.col("level").between(1, max_level))
    cells = nodes.where("type = 'TableCell'").select("doc_id", F.col("node_id").alias("root_id"))
    inside = within(nodes, cells).select("doc_id", "node_id").distinct()
    return rows.join(inside, ["doc_id", "node_id"], "left_anti").select("doc_id", "node_id", "level", "text", "path")


def toc_entries(nodes: DataFrame, max_level: int = 3) -> DataFrame:
    """(doc_id, entry, style, text): a table of contents."""
    w = Window.partitionBy("doc_id").orderBy("path")
    return headings(nodes, max_level).select("doc_id", F.row_number().over(w).alias("entry"), F.concat(F.lit("TOC"), F.col("level").cast("string")).alias("style"), "text")


def list_counters(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, level, counter): numbers of decimal list items, counted by level; any other paragraph starts them again."""
    fmt = F.try_element_at("attrs", F.lit("ListFormat"))
    rows = nodes.where("type in ('Paragraph', 'PageBreak')").withColumn("_f", fmt).withColumn("level", F.coalesce(F.try_element_at("attrs", F.lit("ListLevel")).cast("int"), F.lit(0)))
    doc = Window.partitionBy("doc_id").orderBy("path")
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_f").isNull(), 1).otherwise(0)).over(doc))
    items = rows.where("_f = 'decimal'")
    return items.select("doc_id", "node_id", "level", F.row_number().over(Window.partitionBy("doc_id", "_run", "level").orderBy("path")).alias("counter"))


def render_text(nodes: DataFrame) -> DataFrame:
    """(doc_id, text): the inverse of from_text()."""
    style = F.try_element_at("attrs", F.lit("StyleId"))
    fmt = F.try_element_at("attrs", F.lit("ListFormat"))
    joined = nodes.join(list_counters(nodes).select("doc_id", "node_id", "counter"), ["doc_id", "node_id"], "left").where("type in ('Paragraph', 'PageBreak')")
    indent = F.repeat(F.lit("  "), F.coalesce(F.try_element_at("attrs", F.lit("ListLevel")).cast("int"), F.lit(0)))
    mark = (
        F.when(style.rlike(r"^Heading\d$"), F.concat(F.repeat(F.lit("#"), F.substring(style, 8, 1).cast("int")), F.lit(" ")))
        .when(fmt == "bullet", F.concat(indent, F.lit("- ")))
        .when(fmt == "decimal", F.concat(indent, F.col("counter").cast("string"), F.lit(". ")))
        .otherwise("")
    )
    line = F.when(F.col("type") == "PageBreak", "---").otherwise(F.concat(mark, F.coalesce("text", F.lit(""))))
    return joined.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("s")))), lambda x: x["s"]), "\n").alias("text"))


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))


def body_paragraphs(nodes: DataFrame) -> DataFrame:
    """Paragraphs outside tables, headers and footers."""
    out = nodes.where("type in ('TableCell', 'Header', 'Footer')").select("doc_id", F.col("node_id").alias("root_id"))
    inside = within(nodes, out).select("doc_id", "node_id").distinct()
    return nodes.where("type = 'Paragraph'").join(inside, ["doc_id", "node_id"], "left_anti")


def hierarchy_errors(nodes: DataFrame, allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """Nodes whose parent may not hold them."""
    table = F.create_map(*[x for k, v in (allowed or ALLOWED).items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("type").alias("parent_type"))
    both = nodes.join(up, ["doc_id", "parent_id"])
    return both.where(~F.coalesce(F.array_contains(F.try_element_at(table, F.col("parent_type")), F.col("type")), F.lit(False))).select("doc_id", "node_id", "type", "parent_type")


def revision(nodes: DataFrame) -> Column:
    return F.try_element_at("attrs", F.lit("RevisionType"))


def tracked_changes(nodes: DataFrame) -> DataFrame:
    attr = lambda k: F.try_element_at("attrs", F.lit(k))
    return nodes.where(revision(nodes).isNotNull()).select("doc_id", "node_id", revision(nodes).alias("kind"), attr("RevisionAuthor").alias("author"), attr("RevisionDate").alias("date"))


def settle_changes(nodes: DataFrame, accept: bool) -> DataFrame:
    """Accept: deleted nodes and what they hold go; reject: inserted ones.  Revision marks go, changed formats stay as they are."""
    gone = nodes.where(revision(nodes) == ("Delete" if accept else "Insert")).select("doc_id", F.col("node_id").alias("root_id"))
    below = within(nodes, gone).select("doc_id", "node_id").unionByName(gone.withColumnRenamed("root_id", "node_id")).distinct()
    kept = nodes.join(below, ["doc_id", "node_id"], "left_anti")
    return kept.withColumn("attrs", F.map_filter("attrs", lambda k, v: ~k.startswith("Revision")))


def resolve_styles(styles: DataFrame) -> DataFrame:
    """(style_id, attrs): attributes with those inherited, however far up; the nearest style's value counts, a cycle is passed once."""
    own = styles.select("style_id", F.col("style_id").alias("from_id"), F.lit(0).alias("depth"))
    ups = ancestors(styles.select(F.lit(0).alias("doc_id"), F.col("style_id").alias("node_id"), "parent_id")).select(F.col("node_id").alias("style_id"), F.col("ancestor_id").alias("from_id"), F.col("distance").alias("depth"))
    held = styles.select(F.col("style_id").alias("from_id"), F.explode("attrs").alias("key", "value"))
    near = own.unionByName(ups).join(held, "from_id").groupBy("style_id", "key").agg(F.min_by("value", "depth").alias("value"))
    found = near.groupBy("style_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attrs"))
    return styles.select("style_id").join(found, "style_id", "left").select("style_id", F.coalesce("attrs", F.expr("cast(map() as map<string,string>)")).alias("attrs"))


def merge_attrs(left: Column, right: Column) -> Column:
    """Both maps, the right one's values first."""
    return F.map_zip_with(left, right, lambda k, a, b: F.coalesce(b, a))


def selection(nodes: DataFrame, first: list[int], last: list[int]) -> DataFrame:
    """Nodes between two places in document order, both included."""
    lit = [F.array(*map(F.lit, p)) for p in (first, last)]
    return nodes.where(F.col("path").between(*lit))


def comment_threads(comments: DataFrame) -> DataFrame:
    """(doc_id, comment_id, parent_id, replies): replies point at a comment of their own document."""
    r = comments.where("parent_id is not null").groupBy(F.col("doc_id").alias("_d"), F.col("parent_id").alias("_p")).agg(F.count(F.lit(1)).alias("replies"))
    return comments.join(r, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("comment_id") == F.col("_p")), "left").select("doc_id", "comment_id", "parent_id", F.coalesce("replies", F.lit(0)).alias("replies"))


def numbering(items: DataFrame, abstract: DataFrame, overrides: DataFrame) -> DataFrame:
    """items(num_id, level) with the format of their level, that of an override first."""
    a = abstract.select("num_id", "level", F.col("format").alias("_a"))
    o = overrides.select("num_id", "level", F.col("format").alias("_o"))
    return items.join(a, ["num_id", "level"], "left").join(o, ["num_id", "level"], "left").select(*items.columns, F.coalesce("_o", "_a").alias("format"))
