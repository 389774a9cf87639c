"""The cell-graph kernel: one workbook's formulas evaluated in dependency order, in Python.

Values: None (empty), float, str, bool, Date (a serial) or Err.  Errors in ranges are dropped by aggregates, Booleans
count as numbers there but for COUNT, blanks are 0 in numeric criteria; see the tests for each rule.
"""

from __future__ import annotations

import datetime
import math
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import pyarrow as pa

from ...sources.batches import arrow_schema, batches_of, groups_of, rows_of
from .criteria import EPSILON, ascii_lower, matches, to_number
from .parse import FormulaError, parse, references


class Err(str):
    """An error value such as #N/A."""


class Date(float):
    """A date serial."""


DIV, VALUE, REF, NAME, NUM, NA = (Err(x) for x in ("#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A"))


def text_of(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, float):
        if math.isfinite(v) and v == math.floor(v) and abs(v) < 1e15:
            return str(int(v))
        out = repr(float(v))
        return format(float(v), "f") if "e" in out else out
    return str(v)


def number_of(v) -> float | Err:
    if v is None:
        return 0.0
    if isinstance(v, Err):
        return v
    if isinstance(v, (bool, int, float)):
        return float(v)
    n = to_number(v)
    return VALUE if n is None else n


def bool_of(v) -> bool | Err:
    if v is None:
        return False
    if isinstance(v, Err):
        return VALUE
    if isinstance(v, bool):
        return v
    if isinstance(v, Date):
        return VALUE
    if isinstance(v, float):
        return v != 0
    up = v.strip().upper()
    return up == "TRUE" if up in ("TRUE", "FALSE") else VALUE


def equal(a, b) -> bool:
    num = (float, bool, int, type(None))
    if isinstance(a, num) and isinstance(b, num):
        return abs(float(a or 0) - float(b or 0)) < EPSILON
    return ascii_lower(text_of(a)) == ascii_lower(text_of(b))


def order(a, b) -> int:
    num = (float, bool, int, type(None))
    if isinstance(a, num) and isinstance(b, num):
        x, y = float(a or 0), float(b or 0)
        return 0 if abs(x - y) < EPSILON else -1 if x < y else 1
    x, y = ascii_lower(text_of(a)), ascii_lower(text_of(b))
    return (x > y) - (x < y)


EPOCH = datetime.date(1899, 12, 30)


def to_serial(day: datetime.date) -> int:
    n = (day - EPOCH).days
    return n if n >= 61 else n - 1


def from_serial(n: float) -> tuple[int, int, int]:
    n = math.floor(n)
    if n == 60:
        return 1900, 2, 29
    d = EPOCH + datetime.timedelta(days=n + (1 if n < 60 else 0))
    return d.year, d.month, d.day


def finite(x: float) -> float | Err:
    return x if math.isfinite(x) else NUM


class Range(list):
    """Rows of values."""

    def flat(self) -> list:
        return [v for row in self for v in row]


class Engine:
    """Evaluates trees; `cell(sheet, col, row)` looks a value up, unknown sheets raise KeyError."""

    def __init__(self, cell: Callable, now: datetime.datetime | None = None) -> None:
        self.cell = cell
        self.now = now or datetime.datetime.now(datetime.UTC)

    def value(self, node: tuple):
        out = self.eval(node)
        return VALUE if isinstance(out, Range) else out

    def eval(self, n: tuple):
        kind = n[0]
        if kind in ("num", "str", "bool"):
            return n[1]
        if kind == "err":
            return Err(n[1])
        if kind == "ref":
            try:
                return self.cell(n[1], n[2], n[3])
            except KeyError:
                return REF
        if kind == "range":
            (c1, r1), (c2, r2) = n[2], n[3]
            try:
                return Range([self.cell(n[1], c, r) for c in range(min(c1, c2), max(c1, c2) + 1)] for r in range(min(r1, r2), max(r1, r2) + 1))
            except KeyError:
                return REF
        if kind == "neg" or kind == "pct":
            x = number_of(self.value(n[1]))
            return x if isinstance(x, Err) else -x if kind == "neg" else x / 100
        if kind == "bin":
            return self.binary(n[1], self.value(n[2]), self.value(n[3]))
        if kind == "call":
            f = FUNCTIONS.get(n[1])
            return f(self, n[2]) if f else NAME
        return NAME

    @staticmethod
    def binary(op: str, a, b):
        for v in (a, b):
            if isinstance(v, Err):
                return v
        if op == "&":
            return text_of(a) + text_of(b)
        if op in ("=", "<>", "<", ">", "<=", ">="):
            if op in ("=", "<>"):
                return equal(a, b) == (op == "=")
            c = order(a, b)
            return {"<": c < 0, ">": c > 0, "<=": c <= 0, ">=": c >= 0}[op]
        x, y = number_of(a), number_of(b)
        for v in (x, y):
            if isinstance(v, Err):
                return v
        if op == "/":
            return DIV if y == 0 else x / y
        if op == "^":
            try:
                out = x**y
                return float("nan") if isinstance(out, complex) else out
            except (OverflowError, ZeroDivisionError):
                return float("inf")
        return x + y if op == "+" else x - y if op == "-" else x * y

    def numbers(self, args: list[tuple]) -> list[float] | Err:
        """What aggregates take: numbers, dates and Booleans of ranges; single arguments coerced."""
        out: list[float] = []
        for a in args:
            v = self.eval(a)
            if isinstance(v, Range):
                out += [float(x) for x in v.flat() if isinstance(x, (float, bool, int)) and not isinstance(x, Err)]
            elif a[0] == "ref":
                if isinstance(v, (float, bool, int)):
                    out.append(float(v))
            else:
                x = number_of(v)
                if isinstance(x, Err):
                    return x
                out.append(x)
        return out

    def values(self, args: list[tuple]) -> list:
        out: list = []
        for a in args:
            v = self.eval(a)
            out += v.flat() if isinstance(v, Range) else [v]
        return out


FUNCTIONS: dict[str, Callable] = {}


def function(*names: str) -> Callable:
    def put(f: Callable) -> Callable:
        for n in names:
            FUNCTIONS[n] = f
        return f

    return put


def aggregate(name: str, empty, f: Callable) -> None:
    def run(e: Engine, args: list[tuple]):
        x = e.numbers(args)
        return x if isinstance(x, Err) else f(x) if x else empty

    FUNCTIONS[name] = run


aggregate("SUM", 0.0, math.fsum)
aggregate("AVERAGE", DIV, lambda x: math.fsum(x) / len(x))
aggregate("MIN", 0.0, min)
aggregate("MAX", 0.0, max)


@function("COUNT")
def _count(e: Engine, args: list[tuple]):
    return float(sum(isinstance(v, (float, int)) and not isinstance(v, bool) for v in e.values(args)))


@function("COUNTA")
def _counta(e: Engine, args: list[tuple]):
    return float(sum(v is not None for v in e.values(args)))


@function("IF")
def _if(e: Engine, args: list[tuple]):
    if not 1 <= len(args) <= 3:
        return VALUE
    c = bool_of(e.value(args[0]))
    if isinstance(c, Err):
        return VALUE
    at = 1 if c else 2
    return e.value(args[at]) if at < len(args) else c


def _logic(stop: bool) -> Callable:
    def run(e: Engine, args: list[tuple]):
        if not args:
            return VALUE
        for a in args:
            b = bool_of(e.value(a))
            if isinstance(b, Err):
                return VALUE
            if b == stop:
                return stop
        return not stop

    return run


FUNCTIONS["AND"], FUNCTIONS["OR"] = _logic(False), _logic(True)


@function("NOT")
def _not(e: Engine, args: list[tuple]):
    b = bool_of(e.value(args[0])) if len(args) == 1 else VALUE
    return VALUE if isinstance(b, Err) else not b


@function("IFERROR")
def _iferror(e: Engine, args: list[tuple]):
    if len(args) != 2:
        return VALUE
    v = e.value(args[0])
    return e.value(args[1]) if isinstance(v, Err) else v


def same(a, b) -> bool:
    """As lookups compare: texts by letters, anything else by the numbers that it stands for."""
    if isinstance(a, str) and isinstance(b, str):
        return ascii_lower(a) == ascii_lower(b)
    x, y = number_of(a), number_of(b)
    return not isinstance(x, Err) and not isinstance(y, Err) and abs(x - y) < EPSILON


def rank(a, b) -> int:
    """As lookups order: by number if both stand for one (a blank for 0), else as texts."""
    x, y = number_of(a), number_of(b)
    if isinstance(x, Err) or isinstance(y, Err):
        x, y = ascii_lower(text_of(a)), ascii_lower(text_of(b))
    return (x > y) - (x < y)


def _approx(keys: list, v) -> int:
    """The last place whose key is at most v, scanning up to the first greater one; -1 if none."""
    found = -1
    for i, k in enumerate(keys):
        if not same(k, v) and rank(k, v) > 0:
            break
        found = i
    return found


def _lookup(transpose: bool) -> Callable:
    def run(e: Engine, args: list[tuple]):
        if not 3 <= len(args) <= 4:
            return VALUE
        v, table = e.value(args[0]), e.eval(args[1])
        if isinstance(v, Err):
            return v
        if not isinstance(table, Range):
            return table if isinstance(table, Err) else VALUE
        rows = [list(x) for x in zip(*table, strict=True)] if transpose else table
        at = e.value(args[2])
        if not isinstance(at, float) or isinstance(at, Date) or at < 1:
            return VALUE
        at = int(at)
        if at > len(rows[0]):
            return REF
        near = bool_of(e.value(args[3])) if len(args) == 4 else True
        near = isinstance(near, Err) or near  # what is neither true nor false asks for the nearest
        keys = [r[0] for r in rows]
        i = _approx(keys, v) if near else next((i for i, k in enumerate(keys) if same(k, v)), -1)
        return NA if i < 0 else rows[i][int(at) - 1]

    return run


FUNCTIONS["VLOOKUP"], FUNCTIONS["HLOOKUP"] = _lookup(False), _lookup(True)


@function("INDEX")
def _index(e: Engine, args: list[tuple]):
    if not 2 <= len(args) <= 3:
        return VALUE
    table = e.eval(args[0])
    if not isinstance(table, Range):
        return table if isinstance(table, Err) else VALUE
    r = number_of(e.value(args[1]))
    c = number_of(e.value(args[2])) if len(args) == 3 else 1.0
    if isinstance(r, Err) or isinstance(c, Err) or r < 1 or c < 1:
        return VALUE
    return table[int(r) - 1][int(c) - 1] if r <= len(table) and c <= len(table[0]) else REF


@function("MATCH")
def _match(e: Engine, args: list[tuple]):
    if not 2 <= len(args) <= 3:
        return VALUE
    v, table = e.value(args[0]), e.eval(args[1])
    if isinstance(v, Err):
        return v
    if not isinstance(table, Range):
        return table if isinstance(table, Err) else VALUE
    kind = e.value(args[2]) if len(args) == 3 else 1.0
    kind = int(kind) if isinstance(kind, float) and not isinstance(kind, Date) else 1
    if kind not in (-1, 0, 1):
        return VALUE
    keys = [row[0] for row in table] if len(table) > 1 else list(table[0])
    if kind == 0:
        i = next((i for i, k in enumerate(keys) if same(k, v)), -1)
    else:
        i = -1
        for at, k in enumerate(keys):
            if kind * rank(k, v) > 0:
                break
            i = at
    return NA if i < 0 else float(i + 1)


def texts(least: int, most: int, f: Callable) -> Callable:
    """A function of single values; errors go through."""

    def run(e: Engine, args: list[tuple]):
        if not least <= len(args) <= most:
            return VALUE
        v = [e.value(a) for a in args]
        bad = next((x for x in v if isinstance(x, Err)), None)
        return bad if bad is not None else f(*v)

    return run


def _side(left: bool) -> Callable:
    def f(s, n=1.0):
        n = number_of(n)
        if isinstance(n, Err) or n < 0:
            return VALUE
        t, k = text_of(s), int(n)
        return t[:k] if left else t[max(0, len(t) - k) :]

    return f


def _mid(s, start, n):
    start, n = number_of(start), number_of(n)
    if isinstance(start, Err) or isinstance(n, Err) or start < 1 or n < 0:
        return VALUE
    return text_of(s)[int(start) - 1 : int(start) - 1 + int(n)]


def _find(fold: bool) -> Callable:
    def f(needle, hay, start=1.0):
        start = number_of(start)
        if isinstance(start, Err) or start < 1:
            return VALUE
        a, b = text_of(needle), text_of(hay)
        if fold:
            a, b = ascii_lower(a), ascii_lower(b)
        at = b.encode().find(a.encode(), int(start) - 1)  # positions are bytes
        return VALUE if at < 0 else float(at + 1)

    return f


def _substitute(t, old, new, nth=None):
    t, old, new = text_of(t), text_of(old), text_of(new)
    if not old:
        return t
    if nth is None:
        return t.replace(old, new)
    n = number_of(nth)
    if isinstance(n, Err) or n < 1:
        return VALUE
    parts = t.split(old)
    n = int(n)
    return t if len(parts) <= n else old.join(parts[:n]) + new + old.join(parts[n:])


def _grouped(x: float, digits: int) -> str:
    return format(x, f",.{digits}f")


FORMATS = {"0": "{:.0f}", "0.0": "{:.1f}", "0.00": "{:.2f}", "0.000": "{:.3f}", "#,##0": "{:,.0f}", "#,##0.00": "{:,.2f}"}
PERCENTS = {"0%": 0, "0.0%": 1, "0.00%": 2}


def _text(v, fmt):
    x = number_of(v)
    if isinstance(x, Err):
        return text_of(v)
    f = text_of(fmt)
    if f in FORMATS:
        return FORMATS[f].format(x)
    if f in PERCENTS:
        return f"{x * 100:.{PERCENTS[f]}f}%"
    if f == "0.00E+00":
        m, e = f"{x:.2e}".split("e")
        return f"{m}E{int(e)}"
    return text_of(x)


def _value(t):
    s = text_of(t).strip()
    pct = s.endswith("%")
    n = to_number((s[:-1] if pct else s).lstrip("$").replace(",", ""))
    return VALUE if n is None else n / 100 if pct else n


for _name, _low, _high, _f in (
    ("LEFT", 1, 2, _side(True)), ("RIGHT", 1, 2, _side(False)), ("MID", 3, 3, _mid), ("LEN", 1, 1, lambda s: float(len(text_of(s)))), ("TRIM", 1, 1, lambda s: " ".join(text_of(s).split())),
    ("CONCATENATE", 0, 255, lambda *v: "".join(map(text_of, v))), ("UPPER", 1, 1, lambda s: text_of(s).upper()), ("LOWER", 1, 1, lambda s: text_of(s).lower()),
    ("FIND", 2, 3, _find(False)), ("SEARCH", 2, 3, _find(True)), ("SUBSTITUTE", 3, 4, _substitute), ("TEXT", 2, 2, _text), ("VALUE", 1, 1, _value),
):
    FUNCTIONS[_name] = texts(_low, _high, _f)


def numeric(least: int, most: int, f: Callable, bad: Err | None = None) -> Callable:
    """A function of numbers; overflow and domain errors are #NUM!."""

    def run(*v):
        x = [number_of(a) for a in v]
        wrong = next((a for a in x if isinstance(a, Err)), None)
        if wrong is not None:
            return bad or wrong
        try:
            out = f(*x)
        except (ValueError, OverflowError, ZeroDivisionError):
            return NUM
        return out if isinstance(out, Err) else NUM if isinstance(out, complex) else finite(float(out))

    return texts(least, most, run)


def round_half_away(x: float, d: float) -> float:
    f = 10.0 ** int(d)
    y = x * f
    low = math.floor(abs(y))
    return math.copysign(low + (abs(y) - low >= 0.5), y) / f


def _log(x: float, b: float = 10.0):
    return NUM if x <= 0 or b <= 0 or abs(b - 1) < EPSILON else math.log(x) / math.log(b)


def _step(up: bool) -> Callable:
    def f(x: float, s: float = 1.0):
        if s == 0 or x > 0 > s:
            return NUM
        return (math.ceil(x / s) if up else math.floor(x / s)) * s

    return f


for _name, _low, _high, _f, _bad in (
    ("ROUND", 2, 2, round_half_away, None), ("ABS", 1, 1, abs, None), ("INT", 1, 1, math.floor, None), ("MOD", 2, 2, lambda n, d: DIV if d == 0 else n - d * math.floor(n / d), None),
    ("POWER", 2, 2, lambda b, p: b**p, None), ("SQRT", 1, 1, math.sqrt, None), ("SIN", 1, 1, math.sin, None), ("COS", 1, 1, math.cos, None), ("TAN", 1, 1, math.tan, None), ("ASIN", 1, 1, math.asin, None),
    ("ACOS", 1, 1, math.acos, None), ("ATAN", 1, 1, math.atan, None), ("LOG", 1, 2, _log, NUM), ("LOG10", 1, 1, math.log10, None), ("LN", 1, 1, math.log, None), ("EXP", 1, 1, math.exp, None),
    ("CEILING", 1, 2, _step(True), None), ("FLOOR", 1, 2, _step(False), None),
):
    FUNCTIONS[_name] = numeric(_low, _high, _f, _bad)


def _date(y: float, m: float, d: float):
    y, m, d = int(y), int(m), int(d)
    y += 2000 if 0 <= y <= 29 else 1900 if 30 <= y <= 99 else 0
    y, m = y + (m - 1) // 12, (m - 1) % 12 + 1
    if not 1900 <= y <= 9999 or d < 0:
        return NUM
    return Date(to_serial(datetime.date(y, m, 1)) + d - 1)


FUNCTIONS["DATE"] = texts(3, 3, lambda *v: next((x for x in map(number_of, v) if isinstance(x, Err)), None) or _date(*map(number_of, v)))
for _name, _at in (("YEAR", 0), ("MONTH", 1), ("DAY", 2)):
    FUNCTIONS[_name] = numeric(1, 1, lambda n, at=_at: NUM if n < 0 else from_serial(n)[at])
FUNCTIONS["NOW"] = lambda e, args: Date((e.now - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)).total_seconds() / 86400 + 25569)
FUNCTIONS["TODAY"] = lambda e, args: Date(math.floor(FUNCTIONS["NOW"](e, args)))


def _if_family(kind: str) -> Callable:
    def run(e: Engine, args: list[tuple]):
        if kind == "count" and len(args) < 2 or kind != "count" and not 2 <= len(args) <= 3:
            return VALUE
        area = e.eval(args[0])
        area = area.flat() if isinstance(area, Range) else [area]
        crit = text_of(e.value(args[1]))
        hit = []
        for i, v in enumerate(area):
            n = number_of(v) if not isinstance(v, Err) else VALUE
            if matches(v, text_of(v), None if isinstance(n, Err) else n, crit):
                hit.append(i)
        if kind == "count":
            return float(len(hit))
        source = e.eval(args[2]) if len(args) == 3 else None
        source = area if source is None else source.flat() if isinstance(source, Range) else [source]
        x = [float(source[i]) for i in hit if i < len(source) and isinstance(source[i], (float, bool, int))]
        return math.fsum(x) if kind == "sum" else math.fsum(x) / len(x) if x else DIV

    return run


FUNCTIONS["COUNTIF"] = FUNCTIONS["COUNTIFS"] = _if_family("count")
FUNCTIONS["SUMIF"] = FUNCTIONS["SUMIFS"] = _if_family("sum")
FUNCTIONS["AVERAGEIF"] = _if_family("avg")


# --- recalculation


def dependencies(tree: tuple, sheet: str) -> set[tuple[str, int, int]]:
    """The cells that a formula reads."""
    out = set()
    for r in references(tree):
        s = r[1] or sheet
        if r[0] == "ref":
            out.add((s, r[2], r[3]))
        else:
            (c1, r1), (c2, r2) = r[2], r[3]
            out |= {(s, c, w) for c in range(min(c1, c2), max(c1, c2) + 1) for w in range(min(r1, r2), max(r1, r2) + 1)}
    return out


class _Cycle(Exception):
    """Formulas that need each other."""


def _grid(cells: dict) -> dict:
    """(sheet, col) -> row -> what `cells`, keyed by (sheet, col, row), holds."""
    out: dict = {}
    for (s, c, r), v in cells.items():
        out.setdefault((s, c), {})[r] = v
    return out


def _evaluate(values: dict, formulas: dict, now: datetime.datetime | None = None) -> dict:
    """New values of all formulas; all three are (sheet, col) -> row -> value or text.  A tree is held only until its formula has a value."""
    sheets = {k[0] for k in values} | {k[0] for k in formulas}
    out: dict = {k: {} for k in formulas}
    own = None

    def cell(sheet, col, row):
        if sheet is not None and sheet not in sheets:
            raise KeyError(sheet)
        at = sheet or own, col
        new = out.get(at)
        if new and row in new:
            return new[row]
        old = values.get(at)
        return old.get(row) if old else None

    def waiting(tree: tuple, sheet: str) -> set:
        """The formulas without a value that a tree reads."""
        found = set()
        for r in references(tree):
            (c1, r1), (c2, r2) = (r[2:4], r[2:4]) if r[0] == "ref" else r[2:4]
            lo, hi = min(r1, r2), max(r1, r2)
            for c in range(min(c1, c2), max(c1, c2) + 1):
                at = r[1] or sheet, c
                texts = formulas.get(at)
                if texts:
                    new = out[at]
                    few = range(lo, hi + 1) if hi - lo < len(texts) else texts
                    found.update((at, w) for w in few if lo <= w <= hi and w in texts and w not in new)
        return found

    engine = Engine(cell, now)
    for at, texts in formulas.items():
        for row in texts:
            todo, trees = [(at, row)], {}
            while todo:
                place, r = k = todo[-1]
                if r in out[place]:
                    todo.pop()
                    continue
                tree = trees.pop(k, None)
                if tree is None:
                    try:
                        tree = parse(formulas[place][r])
                    except FormulaError:
                        out[place][r] = NAME
                        continue
                    needs = waiting(tree, place[0])
                    if k in needs or not needs.isdisjoint(trees):
                        raise _Cycle
                    if needs:
                        trees[k] = tree
                        todo.extend(needs)
                        continue
                own = place[0]
                try:
                    out[place][r] = engine.value(tree)
                except RecursionError:
                    out[place][r] = VALUE
    return out


def recalculate(values: dict, formulas: dict[tuple[str, int, int], str], strict_cycle: bool = False, now: datetime.datetime | None = None) -> dict:
    """New values of all formula cells.  values and formulas are keyed by (sheet, col, row).

    A cycle anywhere makes every formula cell #REF!; with strict_cycle only those of the cycle and what depends on it.
    """
    try:
        new = _evaluate(_grid(values), _grid(formulas), now)
    except _Cycle:
        return _beside_cycles(values, formulas, now) if strict_cycle else dict.fromkeys(formulas, REF)
    return {(s, c, r): new[s, c][r] for s, c, r in formulas}


def _beside_cycles(values: dict, formulas: dict[tuple[str, int, int], str], now: datetime.datetime | None) -> dict:
    """recalculate() with strict_cycle where there are cycles."""
    trees, out = {}, {}
    for key, text in formulas.items():
        try:
            trees[key] = parse(text)
        except FormulaError:
            out[key] = NAME
    needs = {k: {d for d in dependencies(t, k[0]) if d in trees} for k, t in trees.items()}
    users = defaultdict(set)
    for k, ds in needs.items():
        for d in ds:
            users[d].add(k)
    missing = {k: len(d) for k, d in needs.items()}
    ready = deque(sorted(k for k, n in missing.items() if not n))
    done = []
    while ready:
        k = ready.popleft()
        done.append(k)
        for u in sorted(users[k]):
            missing[u] -= 1
            if not missing[u]:
                ready.append(u)
    sheets = {k[0] for k in values} | {k[0] for k in formulas}
    current = dict(values) | out
    for k in done:

        def cell(sheet, col, row, own=k[0]):
            if sheet is not None and sheet not in sheets:
                raise KeyError(sheet)
            return current.get((sheet or own, col, row))

        try:
            current[k] = out[k] = Engine(cell, now).value(trees[k])
        except RecursionError:
            current[k] = out[k] = VALUE
    return {k: out.get(k, REF) for k in formulas}


_CELLS = "workbook_id string, sheet string, row int, col int, kind string, num double, txt string, bool boolean, err string, formula string"


def _typed(v) -> tuple:
    if v is None:
        return "empty", None, None, None, None
    if isinstance(v, Err):
        return "error", None, None, None, str(v)
    if isinstance(v, bool):
        return "boolean", None, None, v, None
    if isinstance(v, Date):
        return "date", float(v), None, None, None
    if isinstance(v, float):
        return "number", v, None, None, None
    return "text", None, v, None, None


def _workbook(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of a workbook with its formulas computed."""
    values: dict = {}
    formulas: dict = {}
    for _, sheet, row, col, kind, num, txt, flag, err, formula in rows_of(parts):
        at = sheet, col
        if formula:
            formulas.setdefault(at, {})[row] = formula
        elif kind == "number":
            values.setdefault(at, {})[row] = float("nan") if num is None else num
        elif kind == "date":
            values.setdefault(at, {})[row] = Date(float("nan") if num is None else num)
        elif kind == "boolean":
            values.setdefault(at, {})[row] = bool(flag)
        elif kind == "error":
            values.setdefault(at, {})[row] = Err(err)
        elif kind == "text":
            values.setdefault(at, {})[row] = txt
    try:
        new = _evaluate(values, formulas)
    except _Cycle:
        new = {at: dict.fromkeys(texts, REF) for at, texts in formulas.items()}
    del values, formulas
    for book, sheet, row, col, *kind, formula in rows_of(parts):
        got = new.get((sheet, col))
        yield book, sheet, row, col, *(_typed(got[row]) if got and row in got else kind), formula


def recalculate_frame(cells):
    """A cells DataFrame with formula cells computed, workbook by workbook in parallel; a workbook fits a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of((r for parts in groups_of(batches) for r in _workbook(parts)), arrow_schema(_CELLS))

    return cells.select(*[c.split()[0] for c in _CELLS.split(", ")]).repartition("workbook_id").sortWithinPartitions("workbook_id").mapInArrow(run, _CELLS)
