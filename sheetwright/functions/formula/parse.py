"""Formula text to a tree of tuples.

Nodes: ("num", x), ("str", s), ("bool", b), ("err", code), ("ref", sheet, col, row), ("range", sheet, (c, r), (c, r)),
("field", name), ("name", s), ("neg", n), ("pct", n), ("bin", op, l, r), ("call", NAME, [args]).
Columns and rows count from 0.
"""

from __future__ import annotations

import re


class FormulaError(ValueError):
    """The text is no formula."""


_TOKEN = re.compile(
    r"""\s*(?:
      (?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
    | (?P<str>"(?:[^"]|"")*")
    | (?P<err>\#(?:DIV/0!|VALUE!|REF!|NAME\?|NUM!|N/A|NULL!))
    | (?P<field>\[[^\]]+\])
    | (?P<sheet>'(?:[^']|'')+'!|[A-Za-z_][A-Za-z0-9_.]*!)
    | (?P<ref>\$?[A-Za-z]{1,3}\$?[1-9][0-9]*(?![A-Za-z0-9_(]))
    | (?P<name>[A-Za-z_][A-Za-z0-9_.]*)
    | (?P<op><>|<=|>=|[-+*/^&=<>%(),:;])
    )""",
    re.X,
)
_REF = re.compile(r"\$?([A-Za-z]+)\$?([0-9]+)")
ERRORS = ("#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#NULL!")


def column_index(letters: str) -> int:
    """A -> 0, Z -> 25, AA -> 26."""
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def column_letters(index: int) -> str:
    """The inverse of column_index()."""
    out = ""
    index += 1
    while index:
        index, r = divmod(index - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(text: str) -> tuple[int, int]:
    m = _REF.fullmatch(text)
    return column_index(m[1]), int(m[2]) - 1


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"unexpected {text[at]!r} at {at}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str) -> None:
        self.t, self.i = tokens(text), 0

    def peek(self) -> tuple[str, str]:
        return self.t[self.i] if self.i < len(self.t) else ("end", "")

    def take(self) -> tuple[str, str]:
        got = self.peek()
        self.i += 1
        return got

    def expect(self, value: str) -> None:
        if self.take()[1] != value:
            raise FormulaError(f"expected {value!r}")

    def binary(self, ops: tuple[str, ...], below) -> tuple:
        left = below()
        while self.peek()[0] == "op" and self.peek()[1] in ops:
            op = self.take()[1]
            left = ("bin", op, left, below())
        return left

    def comparison(self) -> tuple:
        return self.binary(("=", "<>", "<", ">", "<=", ">="), self.concat)

    def concat(self) -> tuple:
        return self.binary(("&",), self.sum)

    def sum(self) -> tuple:
        return self.binary(("+", "-"), self.product)

    def product(self) -> tuple:
        return self.binary(("*", "/"), self.power)

    def power(self) -> tuple:
        left = self.unary()
        if self.peek() == ("op", "^"):
            self.take()
            return ("bin", "^", left, self.power())
        return left

    def unary(self) -> tuple:
        if self.peek() in (("op", "-"), ("op", "+")):
            sign = self.take()[1]
            inner = self.percent()
            return ("neg", inner) if sign == "-" else inner
        return self.percent()

    def percent(self) -> tuple:
        node = self.primary()
        while self.peek() == ("op", "%"):
            self.take()
            node = ("pct", node)
        return node

    def reference(self, sheet: str | None) -> tuple:
        kind, value = self.take()
        if kind != "ref":
            raise FormulaError("expected a cell")
        first = _cell(value)
        if self.peek() == ("op", ":"):
            self.take()
            kind, value = self.take()
            if kind != "ref":
                raise FormulaError("expected a cell")
            return ("range", sheet, first, _cell(value))
        return ("ref", sheet, *first)

    def primary(self) -> tuple:
        kind, value = self.peek()
        if kind == "sheet":
            self.take()
            name = value[:-1]
            return self.reference(name[1:-1].replace("''", "'") if name.startswith("'") else name)
        if kind == "ref":
            return self.reference(None)
        self.take()
        if kind == "num":
            return ("num", float(value))
        if kind == "str":
            return ("str", value[1:-1].replace('""', '"'))
        if kind == "err":
            return ("err", value)
        if kind == "field":
            return ("field", value[1:-1])
        if kind == "name":
            upper = value.upper()
            if self.peek() == ("op", "("):
                self.take()
                args: list[tuple] = []
                if self.peek() != ("op", ")"):
                    args.append(self.comparison())
                    while self.peek()[1] in (",", ";"):
                        self.take()
                        args.append(self.comparison())
                self.expect(")")
                return ("call", upper, args)
            return ("bool", upper == "TRUE") if upper in ("TRUE", "FALSE") else ("name", value)
        if (kind, value) == ("op", "("):
            node = self.comparison()
            self.expect(")")
            return node
        raise FormulaError(f"unexpected {value!r}")


def parse(text: str) -> tuple:
    """The tree of a formula, with or without its leading equals sign."""
    p = _Parser(text[1:] if text.startswith("=") else text)
    node = p.comparison()
    if p.peek()[0] != "end":
        raise FormulaError(f"unexpected {p.peek()[1]!r}")
    return node


def references(node: tuple) -> list[tuple]:
    """All ref and range nodes below."""
    if node[0] in ("ref", "range"):
        return [node]
    below = node[2] if node[0] == "call" else [x for x in node[1:] if isinstance(x, tuple)] if node[0] in ("bin", "neg", "pct") else []
    return [r for x in below for r in references(x)]


def shift(text: str, rows: int, cols: int) -> str:
    """The formula as it reads when filled `rows` down and `cols` right: references move, but for parts locked by $."""

    def moved(m: re.Match) -> str:
        lock_c, letters, lock_r, row = m.groups()
        c = column_index(letters) + (0 if lock_c else cols)
        r = int(row) + (0 if lock_r else rows)
        return f"{lock_c}{column_letters(c)}{lock_r}{r}" if c >= 0 and r >= 1 else "#REF!"

    parts = re.split(r'("(?:[^"]|"")*")', text)
    return "".join(p if i % 2 else re.sub(r"(?<![A-Za-z0-9_.])(\$?)([A-Za-z]{1,3})(\$?)([1-9][0-9]*)(?![A-Za-z0-9_(])", moved, p) for i, p in enumerate(parts))
