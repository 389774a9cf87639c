"""Operation logs of replicated documents: ops(doc_id, replica, lamport, deps, kind, target, key, value, offset, arrival).

An op's identity is (lamport, replica), ordered in that way; the larger one wins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OP_ID = ("lamport", "replica")


def last_writer(ops: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """The value of the largest op id by key; a map-side maximum, whatever the order of arrival."""
    return ops.groupBy(*by).agg(F.max_by(value, F.struct(*OP_ID)).alias(value))


def attributes(ops: DataFrame) -> DataFrame:
    """(doc_id, target, key, value) after sets and removals; a key whose last op removes it is gone."""
    rows = ops.where(F.col("kind").isin("SetAttributes", "RemoveAttributes"))
    last = rows.groupBy("doc_id", "target", "key").agg(F.max_by(F.struct("kind", "value"), F.struct(*OP_ID)).alias("w"))
    return last.where("w.kind = 'SetAttributes'").select("doc_id", "target", "key", F.col("w.value").alias("value"))


def state_vector(ops: DataFrame) -> DataFrame:
    """(doc_id, replica, lamport): the largest stamp seen of each replica."""
    return ops.groupBy("doc_id", "replica").agg(F.max("lamport").alias("lamport"))


def changes_since(ops: DataFrame, sv: DataFrame) -> DataFrame:
    """Ops that a state vector doesn't cover; unknown replicas count as 0."""
    s = sv.select("doc_id", "replica", F.col("lamport").alias("_seen"))
    return ops.join(s, ["doc_id", "replica"], "left").where(F.col("lamport") > F.coalesce("_seen", F.lit(0))).drop("_seen")


def merge_vectors(a: DataFrame, b: DataFrame) -> DataFrame:
    """The larger stamp of each replica."""
    return a.unionByName(b).groupBy("doc_id", "replica").agg(F.max("lamport").alias("lamport"))


def vector_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, replica, from_lamport, to_lamport): where a is ahead of b."""
    y = b.select("doc_id", "replica", F.col("lamport").alias("_b"))
    both = a.join(y, ["doc_id", "replica"], "left").withColumn("_b", F.coalesce("_b", F.lit(0)))
    return both.where("lamport > _b").select("doc_id", "replica", F.col("_b").alias("from_lamport"), F.col("lamport").alias("to_lamport"))


def compare_vectors(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, relation): equal, dominates, dominated or concurrent."""
    x, y = (v.select("doc_id", "replica", F.col("lamport").alias(n)) for v, n in ((a, "x"), (b, "y")))
    both = x.join(y, ["doc_id", "replica"], "full").withColumns({"x": F.coalesce("x", F.lit(0)), "y": F.coalesce("y", F.lit(0))})
    g = both.groupBy("doc_id").agg(F.bool_and(F.col("x") >= F.col("y")).alias("ge"), F.bool_and(F.col("x") <= F.col("y")).alias("le"))
    return g.select("doc_id", F.when(F.col("ge") & F.col("le"), "equal").when(F.col("ge"), "dominates").when(F.col("le"), "dominated").otherwise("concurrent").alias("relation"))


def once(ops: DataFrame) -> DataFrame:
    """Redelivered ops counted once."""
    return ops.dropDuplicates(["doc_id", "replica", "lamport"])


def compress(ops: DataFrame, byte_length: bool = True) -> DataFrame:
    """Runs of inserts that continue each other as one: same replica and node, next stamp, next offset.

    A stamp run is as long as the text has characters; offsets continue by its bytes (byte_length) or its characters.  Where
    ops have left_lamport and left_replica, the next insert must also stand right of the run's last character.
    """
    w = Window.partitionBy("doc_id", "replica", "target").orderBy("lamport")
    n = F.char_length("value")
    span = F.octet_length("value") if byte_length else n
    rows = ops.where("kind = 'InsertText'").withColumns({"_l": F.lag(F.col("lamport") + n).over(w), "_o": F.lag(F.col("offset") + span).over(w)})
    follows = (F.col("lamport") == F.col("_l")) & (F.col("offset") == F.col("_o"))
    if {"left_lamport", "left_replica"} <= set(ops.columns):
        follows &= F.col("left_lamport").eqNullSafe(F.col("_l") - 1) & F.col("left_replica").eqNullSafe(F.col("replica"))
    new = F.when(follows, 0).otherwise(1)
    rows = rows.withColumn("_run", F.sum(new).over(w))
    g = rows.groupBy("doc_id", "replica", "target", "_run").agg(
        F.min("lamport").alias("lamport"), F.min_by("offset", "lamport").alias("offset"), F.count(F.lit(1)).alias("merged"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lamport", "value"))), lambda x: x["value"]), "").alias("value")
    )
    return g.drop("_run")


def collectable(tombstones: DataFrame, vectors: DataFrame) -> DataFrame:
    """Tombstones that every peer has seen: stamps at most the smallest that any peer's vector has for their replica."""
    peers = vectors.groupBy("doc_id").agg(F.count_distinct("peer").alias("_n"))
    low = vectors.groupBy("doc_id", "replica").agg(F.min("lamport").alias("_min"), F.count_distinct("peer").alias("_k")).join(peers, "doc_id").where("_k = _n").select("doc_id", "replica", "_min")
    return tombstones.join(low, ["doc_id", "replica"]).where("lamport <= _min").drop("_min")


def excess(tombstones: DataFrame, keep: int) -> DataFrame:
    """The oldest tombstones beyond `keep` a document."""
    w = Window.partitionBy("doc_id").orderBy(F.col("lamport").desc(), F.col("replica").desc())
    return tombstones.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > keep).drop("_n")


def size_estimate(ops: DataFrame) -> DataFrame:
    """(doc_id, bytes): 100 an op, 48 a deletion, 16 a replica."""
    return ops.groupBy("doc_id").agg((F.count(F.lit(1)) * 100 + F.count_if(F.col("kind").startswith("Delete")) * 48 + F.count_distinct("replica") * 16).alias("bytes"))


def room_versions(ops: DataFrame, room: str, order: list[str]) -> DataFrame:
    """ops with `version`, counted up from 1 in each room."""
    return ops.withColumn("version", F.row_number().over(Window.partitionBy(room).orderBy(*order)).cast("long"))


def retained(versioned: DataFrame, room: str, arrival: str, now: Column, hours: int = 1, most: int = 10_000, drop: int = 5_000) -> DataFrame:
    """What a room's log keeps: ops of the last hour; of more than `most`, all but the oldest `drop`."""
    recent = versioned.where(F.col(arrival) >= now - F.expr(f"interval {hours} hours"))
    sizes = recent.groupBy(room).agg(F.count(F.lit(1)).alias("_n"), F.min("version").alias("_v"))
    # versions of a room have no gaps from the oldest kept one on
    return recent.join(sizes, room).where((F.col("_n") <= most) | (F.col("version") >= F.col("_v") + drop)).drop("_n", "_v")


def catch_up(versioned: DataFrame, version: int) -> DataFrame:
    return versioned.where(F.col("version") > version)


#: What a message may ask for, by its type or, without one, by its action.
MESSAGE_TYPES = ("op", "join", "awareness", "awareness-batch", "sync", "sync-req", "fullSync", "requestFullSync", "requestCatchup")
MESSAGE_ACTIONS = ("op", "insert", "delete", "format", "structural", "ssSetCell", "ssFormat", "ssSync", "ssCursor", "peer-join", "peer-leave")


def message_errors(body: str, limit: int = 256 * 1024) -> Column:
    """null for a sound message, else too_large, bad_json, unknown_type, unknown_action or no_type; only texts name a type or an action."""
    v = F.try_parse_json(body)
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    kind, action = text("$.type"), text("$.action")
    return (
        F.when(F.octet_length(body) > limit, "too_large").when(v.isNull(), "bad_json").when(kind.isin(list(MESSAGE_TYPES)), None).when(kind.isNotNull(), "unknown_type")
        .when(action.isin(list(MESSAGE_ACTIONS)), None).when(action.isNotNull(), "unknown_action").otherwise("no_type")
    )


def relay(messages: DataFrame, peers: DataFrame) -> DataFrame:
    """(message, peer): to every peer of the room but the sender, or to the one it is meant for."""
    p = peers.select("room", F.col("peer").alias("to"))
    return messages.join(p, "room").where((F.col("to") != F.col("sender")) & (F.col("target").isNull() | (F.col("target") == F.col("to"))))


def latest_cursors(cursors: DataFrame) -> DataFrame:
    """(doc_id, replica, state): the cursor of the largest sequence number; null states have left."""
    last = cursors.groupBy("doc_id", "replica").agg(F.max_by(F.struct("state"), "seq").alias("w"), F.max("seq").alias("seq"))
    return last.where("w.state is not null").select("doc_id", "replica", "seq", F.col("w.state").alias("state"))


def last_cell_writes(ops: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Sheet cells after set operations: the last to arrive wins."""
    return ops.groupBy("doc_id", "sheet", "row", "col").agg(F.max_by("value", arrival).alias("value"))


# --- kernels for what is sequential: one document in a task


def text_replica(rows: list[tuple]) -> str:
    """A text from inserts (kind, lamport, replica, left origin, character, right origin) and deletes, in any order.

    Inserts are integrated by ascending op id, so the result doesn't depend on the order of delivery.  One is looked for a
    place from its left origin up to its right origin: it goes past characters of the same left origin, whose ids are
    smaller, and past those whose left origin lies further left, and stops at the first other one.  Deletes leave
    tombstones.  An origin that isn't there counts as the text's begin or end.
    """
    inserts = {(r[1], r[2]): (r[3], r[4], r[5] if len(r) > 5 else None) for r in rows if r[0] != "DeleteText"}
    gone = {r[3] for r in rows if r[0] == "DeleteText"}
    after: dict = {None: None}  # None is what stands before the first character, and what ends the text
    left_of: dict = {}
    for op in sorted(inserts):
        left, _, right = inserts[op]
        left = left if left in left_of else None
        right = right if right in left_of else None
        place, passed = left, set()
        at = after[left]
        while at is not None and at != right and left_of[at] not in passed:
            passed.add(at)
            place, at = at, after[at]
        after[op], after[place] = after[place], op
        left_of[op] = left
    out, at = [], after[None]
    while at is not None:
        if at not in gone:
            out.append(inserts[at][1])
        at = after[at]
    return "".join(out)


def _texts(pdf: pd.DataFrame) -> pd.DataFrame:
    def origin(lamport, replica) -> tuple | None:
        return None if pd.isna(lamport) else (int(lamport), int(replica))

    right = "right_lamport" in pdf.columns
    rows = [(r.kind, int(r.lamport), int(r.replica), origin(r.left_lamport, r.left_replica), r.value, origin(r.right_lamport, r.right_replica) if right else None) for r in pdf.itertuples(index=False)]
    return pd.DataFrame([(pdf["doc_id"].iloc[0], pdf["target"].iloc[0], text_replica(rows))], columns=["doc_id", "target", "text"])


def converge_text(ops: DataFrame) -> DataFrame:
    """(doc_id, target, text) of ops with left_lamport, left_replica and, if there are any, right_lamport, right_replica: each text node in a task."""
    return ops.groupBy("doc_id", "target").applyInPandas(_texts, "doc_id string, target string, text string")


def tree_replica(rows: list[tuple]) -> dict:
    """{node: parent}, children in order, after (lamport, replica, kind, node, parent): inserts, deletes and moves in op-id order.

    Children stand in the order of the ops that placed them.

    The last move wins; one that would put a node below itself is dropped; deleted nodes and what they hold are gone.
    """
    parent: dict = {}
    gone = set()
    for _, _, kind, node, up in sorted(set(rows), key=lambda r: (r[0], r[1])):
        if kind == "DeleteNode":
            gone.add(node)
        elif kind == "InsertNode":
            parent.setdefault(node, up)
        elif node in parent:
            at, cyclic = up, False
            while at is not None and not cyclic:
                cyclic = at == node
                at = parent.get(at)
            if not cyclic:
                del parent[node]
                parent[node] = up

    def alive(n) -> bool:
        while n is not None:
            if n in gone:
                return False
            n = parent.get(n)
        return True

    return {n: p for n, p in parent.items() if alive(n)}


def _trees(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = [(int(r.lamport), int(r.replica), r.kind, r.target, None if pd.isna(r.value) else r.value) for r in pdf.itertuples(index=False)]
    seen: dict = {}
    out = []
    for n, p in tree_replica(rows).items():
        out.append((pdf["doc_id"].iloc[0], n, p, seen.get(p, 0)))
        seen[p] = seen.get(p, 0) + 1
    return pd.DataFrame(out, columns=["doc_id", "node_id", "parent_id", "pos"])


def converge_tree(ops: DataFrame) -> DataFrame:
    """(doc_id, node_id, parent_id, pos) after tree ops, pos counting siblings from 0; each document in a task."""
    return ops.groupBy("doc_id").applyInPandas(_trees, "doc_id string, node_id string, parent_id string, pos int")


def apply_edits(text: str, edits: list[tuple]) -> tuple[str, list[tuple]]:
    """(text, inverse edits) after ("insert", at, s) and ("delete", at, n); a bad edit undoes all (ValueError)."""
    back: list[tuple] = []
    for kind, at, x in edits:
        if at < 0 or at > len(text) or kind == "delete" and at + x > len(text):
            raise ValueError(f"{kind} at {at}")
        if kind == "insert":
            text = text[:at] + x + text[at:]
            back.append(("delete", at, len(x)))
        else:
            back.append(("insert", at, text[at : at + x]))
            text = text[:at] + text[at + x :]
    return text, back[::-1]


class History:
    """Undo and redo over edits of a text, of a bounded depth."""

    def __init__(self, text: str = "", cap: int = 100) -> None:
        self.text, self.cap, self.undone = text, cap, []
        self.done: list[list[tuple]] = []

    def run(self, edits: list[tuple]) -> str:
        self.text, back = apply_edits(self.text, edits)
        self.done = [*self.done, back][-self.cap :]
        self.undone = []
        return self.text

    def _move(self, source: list, to: list) -> bool:
        if not source:
            return False
        self.text, back = apply_edits(self.text, source.pop())
        to.append(back)
        return True

    def undo(self) -> bool:
        return self._move(self.done, self.undone)

    def redo(self) -> bool:
        return self._move(self.undone, self.done)


def _replay(pdf: pd.DataFrame) -> pd.DataFrame:
    h = History()
    for r in pdf.sort_values("seq").itertuples(index=False):
        try:
            if r.kind == "undo":
                h.undo()
            elif r.kind == "redo":
                h.redo()
            else:
                h.run([(r.kind, int(r.offset), r.value if r.kind == "insert" else int(r.length))])
        except ValueError:
            continue
    return pd.DataFrame([(pdf["doc_id"].iloc[0], h.text)], columns=["doc_id", "text"])


def replay(edits: DataFrame) -> DataFrame:
    """(doc_id, text) after edits(doc_id, seq, kind, offset, length, value) with undo and redo; bad edits change nothing."""
    return edits.groupBy("doc_id").applyInPandas(_replay, "doc_id string, text string")


# --- what a replica does with its log


def stamp_local(edits: DataFrame, known: DataFrame) -> DataFrame:
    """edits(doc_id, replica, seq, value ...) with `lamport`: stamps go on after the largest known(doc_id, replica, lamport) of the document.

    An edit takes as many stamps as its text has characters, one at least, and bears the first of them.
    """
    clock = known.groupBy("doc_id").agg(F.max("lamport").alias("_clock"))
    size = F.greatest(F.coalesce(F.char_length("value"), F.lit(1)), F.lit(1))
    w = Window.partitionBy("doc_id", "replica").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(w), F.lit(0))
    return edits.join(clock, "doc_id", "left").withColumn("lamport", (F.coalesce("_clock", F.lit(0)) + before + 1).cast("long")).drop("_clock")


def resolve(ops: DataFrame) -> dict[str, DataFrame]:
    """Each kind of op to what it is resolved by: texts, tree, attributes, metadata and styles, by name."""
    styles = ops.where("kind in ('SetStyle', 'RemoveStyle')").groupBy("doc_id", "key").agg(F.max_by(F.struct("kind", "value"), F.struct(*OP_ID)).alias("w"))
    return {
        "text": converge_text(ops.where("kind in ('InsertText', 'DeleteText')")),
        "tree": converge_tree(ops.where("kind in ('InsertNode', 'DeleteNode', 'MoveNode')")),
        "attributes": attributes(ops),
        "metadata": last_writer(ops.where("kind = 'SetMetadata'"), ["doc_id", "key"]).where("value is not null"),
        "styles": styles.where("w.kind = 'SetStyle'").select("doc_id", "key", F.col("w.value").alias("value")),
    }


def fork(ops: DataFrame, doc: str, copy: str) -> DataFrame:
    """The log of a copy of one document: the same ops, so the same state vector; its own replica has none yet."""
    return ops.where(F.col("doc_id") == doc).withColumn("doc_id", F.lit(copy))


def compacted(ops: DataFrame, threshold: int) -> DataFrame:
    """(doc_id, replica, lamport, kind, target, value, offset): logs of `threshold` ops or more with runs of inserts merged, others as they are."""
    columns = ["doc_id", "replica", "lamport", "kind", "target", "value", "offset"]
    size = ops.groupBy("doc_id").agg((F.count(F.lit(1)) >= threshold).alias("_long"))
    marked = ops.join(size, "doc_id")
    merged = compress(marked.where("_long")).withColumn("kind", F.lit("InsertText"))
    return marked.where("not _long or kind <> 'InsertText'").select(*columns).unionByName(merged.select(*columns))


def compression_ratio(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, ratio): ops after by ops before, 1 where there were none."""
    a, b = (df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(n)) for df, n in ((before, "_a"), (after, "_b")))
    return a.join(b, "doc_id", "full").select("doc_id", F.when(F.col("_a").isNull(), 1.0).otherwise(F.coalesce("_b", F.lit(0)) / F.col("_a")).alias("ratio"))


def registered_hooks(commands: DataFrame) -> DataFrame:
    """Registrations (seq, id, ...) of commands(seq, action, id, ...) that no later removal of their id takes back."""
    gone = commands.where("action = 'remove'").groupBy(F.col("id").alias("_id")).agg(F.max("seq").alias("_gone"))
    kept = commands.where("action = 'register'").join(gone, F.col("id") == F.col("_id"), "left").where("_gone is null or seq > _gone")
    return kept.drop("_id", "_gone", "action")
