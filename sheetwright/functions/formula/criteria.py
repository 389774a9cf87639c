"""The criteria language of COUNTIF and its kin, for Spark columns and for single values."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def to_number(text: str) -> float | None:
    t = text.strip()
    return float(t) if _NUMBER.fullmatch(t) else None


def ascii_lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def wildcard_regex(pattern: str) -> str:
    """`*` is any run, `?` one character; nothing escapes them."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def split(criterion: str) -> tuple[str, str | float]:
    """(operator, operand): operators >= <= <> > < with a number, ne and eq with text, like with wildcards."""
    for op in (">=", "<=", "<>", ">", "<", "="):
        if criterion.startswith(op):
            rest = criterion[len(op) :]
            n = to_number(rest)
            if n is not None:
                return op, n
            if op in ("<>", "="):
                return ("ne" if op == "<>" else "eq"), rest
            break
    n = to_number(criterion)
    if n is not None:
        return "=", n
    return ("like" if re.search(r"[*?]", criterion) else "eq"), criterion


def matches(value, text: str, number: float | None, criterion: str) -> bool:
    """For one value whose text and number (blank 0, text without a number None) are given."""
    op, x = split(criterion)
    if op == "ne":
        return ascii_lower(text) != ascii_lower(x)
    if op == "eq":
        return ascii_lower(text) == ascii_lower(x)
    if op == "like":
        return re.match(wildcard_regex(ascii_lower(x)), ascii_lower(text)) is not None
    if number is None or math.isnan(number):
        return op == "<>"
    return {"=": abs(number - x) < EPSILON, "<>": abs(number - x) >= EPSILON, ">": number > x, "<": number < x, ">=": number >= x, "<=": number <= x}[op]


def predicate(col: Column, criterion: str, numeric: bool) -> Column:
    """A Boolean column; blanks are 0 for numeric criteria and '' for text ones."""
    from ..cells import fold_ascii, number_of, number_text

    op, x = split(criterion)
    if op in ("ne", "eq", "like"):
        text = fold_ascii(F.coalesce(number_text(col) if numeric else col.cast("string"), F.lit("")))
        if op == "like":
            return text.rlike(wildcard_regex(ascii_lower(x)))
        return text != ascii_lower(x) if op == "ne" else text == ascii_lower(x)
    n = F.coalesce(col.cast("double"), F.lit(0.0)) if numeric else F.when(col.isNull(), 0.0).otherwise(number_of(col))
    near = F.abs(n - x) < EPSILON
    test = {"=": near, "<>": ~near, ">": n > x, "<": n < x, ">=": n >= x, "<=": n <= x}[op]
    return F.coalesce(test, F.lit(op == "<>"))
