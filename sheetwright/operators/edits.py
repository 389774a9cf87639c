"""Edits of document models: ten kinds of operations, each with its inverse, in transactions; one document in a task.

A model is {"nodes": {id: node}, "meta": {key: value}, "styles": {id: attributes}}; a node has type, parent, kids (ids in
order), text and attrs.  An operation is a dict with `kind` and what that needs; ids are texts.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame

from .doctree import ALLOWED


def new_model() -> dict:
    return {"nodes": {"root": {"type": "Document", "parent": None, "kids": [], "text": "", "attrs": {}}}, "meta": {}, "styles": {}}


def _node(model: dict, at: str) -> dict:
    if at not in model["nodes"]:
        raise ValueError(f"no node {at}")
    return model["nodes"][at]


def _below(model: dict, at: str) -> list[str]:
    """The node and what it holds, in document order."""
    out, stack = [], [at]
    while stack:
        out.append(stack.pop())
        stack += model["nodes"][out[-1]]["kids"][::-1]
    return out


def _place(model: dict, parent: str, index: int, kind: str) -> None:
    up = _node(model, parent)
    if kind not in ALLOWED.get(up["type"], []):
        raise ValueError(f"{up['type']} holds no {kind}")
    if not 0 <= index <= len(up["kids"]):
        raise ValueError(f"no place {index} in {parent}")


def apply_op(model: dict, op: dict) -> dict:
    """Change the model and return the inverse operation; ValueError, and nothing changed, if the operation doesn't fit."""
    kind, target = op["kind"], op.get("target")
    if kind == "InsertNode":
        nodes = op["nodes"]  # the node first, then what it holds
        top = nodes[0]
        _place(model, op["parent"], op["index"], top["type"])
        if any(n["id"] in model["nodes"] for n in nodes):
            raise ValueError(f"node {top['id']} is there already")
        for n in nodes:
            model["nodes"][n["id"]] = {"type": n["type"], "parent": op["parent"] if n is top else n["parent"], "kids": list(n.get("kids", [])), "text": n.get("text", ""), "attrs": dict(n.get("attrs", {}))}
        model["nodes"][op["parent"]]["kids"].insert(op["index"], top["id"])
        return {"kind": "DeleteNode", "target": top["id"]}
    if kind == "DeleteNode":
        node = _node(model, target)
        if node["parent"] is None:
            raise ValueError("the root stays")
        up = model["nodes"][node["parent"]]["kids"]
        index = up.index(target)
        held = [{"id": i, **model["nodes"][i]} for i in _below(model, target)]
        up.remove(target)
        for n in held:
            del model["nodes"][n["id"]]
        return {"kind": "InsertNode", "parent": node["parent"], "index": index, "nodes": held}
    if kind == "MoveNode":
        node = _node(model, target)
        if node["parent"] is None or op["parent"] in _below(model, target):
            raise ValueError(f"{target} can't move below {op['parent']}")
        old = model["nodes"][node["parent"]]["kids"]
        back = {"kind": "MoveNode", "target": target, "parent": node["parent"], "index": old.index(target)}
        old.remove(target)
        try:
            _place(model, op["parent"], op["index"], node["type"])
        except ValueError:
            old.insert(back["index"], target)
            raise
        model["nodes"][op["parent"]]["kids"].insert(op["index"], target)
        node["parent"] = op["parent"]
        return back
    if kind in ("InsertText", "DeleteText"):
        node = _node(model, target)
        text, at = node["text"], op["offset"]
        size = op["length"] if kind == "DeleteText" else 0
        if node["type"] != "Text" or at < 0 or size < 0 or at + size > len(text):
            raise ValueError(f"no text at {at} in {target}")
        if kind == "InsertText":
            node["text"] = text[:at] + op["text"] + text[at:]
            return {"kind": "DeleteText", "target": target, "offset": at, "length": len(op["text"])}
        node["text"] = text[:at] + text[at + size :]
        return {"kind": "InsertText", "target": target, "offset": at, "text": text[at : at + size]}
    if kind in ("SetAttributes", "RemoveAttributes"):
        attrs = _node(model, target)["attrs"]
        keys = list(op["attrs"] if kind == "SetAttributes" else op["keys"])
        back = {"kind": "_Attributes", "target": target, "old": {k: attrs.get(k) for k in keys}}
        for k in keys:
            attrs.pop(k, None)
        attrs.update(op.get("attrs", {}) if kind == "SetAttributes" else {})
        return back
    if kind == "_Attributes":  # the inverse of both
        attrs = _node(model, target)["attrs"]
        back = {"kind": "_Attributes", "target": target, "old": {k: attrs.get(k) for k in op["old"]}}
        for k, v in op["old"].items():
            attrs.pop(k, None)
            if v is not None:
                attrs[k] = v
        return back
    if kind in ("SetMetadata", "SetStyle", "RemoveStyle"):
        where = model["meta" if kind == "SetMetadata" else "styles"]
        key, value = (op["key"], op.get("value")) if kind != "RemoveStyle" else (op["key"], None)
        if kind == "RemoveStyle" and key not in where:
            raise ValueError(f"no style {key}")
        old = where.pop(key, None)
        if value is not None:
            where[key] = value
        if kind == "SetMetadata":
            return {"kind": "SetMetadata", "key": key, "value": old}
        return {"kind": "RemoveStyle", "key": key} if old is None else {"kind": "SetStyle", "key": key, "value": old}
    raise ValueError(f"no operation {kind}")


def run_transaction(model: dict, ops: list[dict]) -> list[dict]:
    """All operations or none; the inverses, in the order that undoes them."""
    back: list[dict] = []
    try:
        for op in ops:
            back.insert(0, apply_op(model, op))
    except (ValueError, KeyError, TypeError):
        for op in back:
            apply_op(model, op)
        raise
    return back


class Session:
    """Transactions with undo and redo, the last `cap` of them; transactions of one non-null label in a row undo as one."""

    def __init__(self, model: dict | None = None, cap: int = 100) -> None:
        self.model, self.cap = model or new_model(), cap
        self.done: list[tuple[str | None, list[dict]]] = []
        self.undone: list[list[dict]] = []

    def run(self, ops: list[dict], label: str | None = None) -> None:
        back = run_transaction(self.model, ops)
        if label is not None and self.done and self.done[-1][0] == label:
            back = [*back, *self.done.pop()[1]]
        self.done = [*self.done, (label, back)][-self.cap :]
        self.undone = []

    def undo(self) -> bool:
        if not self.done:
            return False
        self.undone.append(run_transaction(self.model, self.done.pop()[1]))
        return True

    def redo(self) -> bool:
        if not self.undone:
            return False
        self.done.append((None, run_transaction(self.model, self.undone.pop())))
        return True


def _edited(pdf: pd.DataFrame) -> pd.DataFrame:
    s = Session()
    for r in pdf.sort_values("seq").itertuples(index=False):
        if r.action in ("undo", "redo"):
            getattr(s, r.action)()
            continue
        try:
            s.run(json.loads(r.ops))
        except (ValueError, KeyError, TypeError):
            continue  # a bad transaction changes nothing
    rows, doc = [], pdf["doc_id"].iloc[0]
    for at in _below(s.model, "root"):
        n = s.model["nodes"][at]
        rows.append((doc, at, n["parent"], s.model["nodes"][n["parent"]]["kids"].index(at) if n["parent"] else 0, n["type"], n["text"], n["attrs"]))
    return pd.DataFrame(rows, columns=["doc_id", "node_id", "parent_id", "pos", "type", "text", "attrs"])


def edited_documents(edits: DataFrame) -> DataFrame:
    """(doc_id, node_id, parent_id, pos, type, text, attrs) after edits(doc_id, seq, action, ops).

    action is `run`, with a JSON list of operations as one transaction, `undo` or `redo`; every document begins as a root.
    """
    return edits.groupBy("doc_id").applyInPandas(_edited, "doc_id string, node_id string, parent_id string, pos int, type string, text string, attrs map<string,string>")
