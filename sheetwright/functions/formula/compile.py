"""Formulas over table columns compiled to Spark columns.

A compiled formula is a value column and an error column (null where there is none).  `[name]` is a column of the
table; aggregates take whole columns and compile to Spark aggregates.  Types are the declared ones: numbers, texts,
Booleans, dates (as serials).
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import cells
from . import criteria
from .parse import parse

DIV, VALUE, REF, NAME, NUM, NA = "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A"


@dataclass
class Compiled:
    kind: str  # num, txt, bool
    value: Column
    err: Column | None = None
    name: str | None = None  # a bare column of the table
    whole: bool = False  # null only where there is an error, never for a blank

    def error(self) -> Column:
        return F.lit(None).cast("string") if self.err is None else self.err


def _first(*errs: Column | None) -> Column | None:
    some = [e for e in errs if e is not None]
    return F.coalesce(*some) if len(some) > 1 else some[0] if some else None


def _guard(kind: str, value: Column, err: Column | None) -> Compiled:
    return Compiled(kind, value if err is None else F.when(err.isNull(), value), err)


def number(x: Compiled) -> Compiled:
    if x.whole:
        return x
    if x.kind == "num":
        return Compiled("num", F.coalesce(x.value, F.lit(0.0)) if x.err is None else F.when(x.err.isNull(), F.coalesce(x.value, F.lit(0.0))), x.err)
    if x.kind == "bool":
        return _guard("num", F.coalesce(x.value, F.lit(False)).cast("double"), x.err)
    n = F.when(x.value.isNull(), 0.0).otherwise(cells.number_of(x.value))
    return _guard("num", n, _first(x.err, F.when(n.isNull(), VALUE)))


def text(x: Compiled) -> Compiled:
    if x.kind == "txt":
        return Compiled("txt", F.coalesce(x.value, F.lit("")), x.err)
    t = cells.number_text(x.value) if x.kind == "num" else F.when(x.value, "TRUE").otherwise("FALSE")
    return Compiled("txt", F.when(x.value.isNull(), "").otherwise(t), x.err)


def boolean(x: Compiled) -> Compiled:
    """Errors and texts that are neither TRUE nor FALSE are #VALUE!."""
    bad = None if x.err is None else F.when(x.err.isNotNull(), VALUE)
    if x.kind == "bool":
        return Compiled("bool", F.coalesce(x.value, F.lit(False)), bad)
    if x.kind == "num":
        return Compiled("bool", F.coalesce(x.value != 0, F.lit(False)), bad)
    up = F.upper(F.trim(x.value))
    v = F.when(x.value.isNull(), False).when(up == "TRUE", True).when(up == "FALSE", False)
    return _guard("bool", v, _first(bad, F.when(v.isNull(), VALUE)))


def _like(kind: str, x: Compiled) -> Compiled:
    return {"num": number, "txt": text, "bool": boolean}[kind](x)


def _bare(x: Compiled) -> Compiled:
    return Compiled("num", number(Compiled(x.kind, x.value)).value)


class Compiler:
    def __init__(self, schema: T.StructType) -> None:
        self.schema = {f.name: f.dataType for f in schema.fields}

    def field(self, name: str) -> Compiled:
        if name not in self.schema:
            return Compiled("txt", F.lit(None).cast("string"), F.lit(REF))
        c, t = F.col(f"`{name}`"), self.schema[name]
        if isinstance(t, T.BooleanType):
            return Compiled("bool", c, name=name)
        if isinstance(t, T.NumericType):
            return Compiled("num", c.cast("double"), name=name)
        if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            whole = cells.date_serial(c).cast("double")
            if isinstance(t, T.DateType):
                return Compiled("num", whole, name=name)
            part = (F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)) / F.lit(86400.0)
            return Compiled("num", whole + part, name=name)
        return Compiled("txt", c.cast("string"), name=name)

    def of(self, n: tuple) -> Compiled:
        kind = n[0]
        if kind == "num":
            return Compiled("num", F.lit(n[1]))
        if kind == "str":
            return Compiled("txt", F.lit(n[1]))
        if kind == "bool":
            return Compiled("bool", F.lit(n[1]))
        if kind == "err":
            return Compiled("txt", F.lit(None).cast("string"), F.lit(n[1]))
        if kind == "field":
            return self.field(n[1])
        if kind in ("neg", "pct"):
            x = number(self.of(n[1]))
            return Compiled("num", -x.value if kind == "neg" else x.value / 100, x.err)
        if kind == "bin":
            return self.binary(n[1], self.of(n[2]), self.of(n[3]))
        if kind == "call":
            f = getattr(self, "f_" + n[1].lower(), None)
            if f is None:
                return Compiled("txt", F.lit(None).cast("string"), F.lit(NAME))
            try:
                return f(*n[2])
            except TypeError as e:
                if "positional argument" not in str(e):
                    raise
                return Compiled("txt", F.lit(None).cast("string"), F.lit(VALUE))
        return Compiled("txt", F.lit(None).cast("string"), F.lit(NAME))

    def binary(self, op: str, a: Compiled, b: Compiled) -> Compiled:
        if op == "&":
            x, y = text(a), text(b)
            return _guard("txt", F.concat(x.value, y.value), _first(x.err, y.err))
        if op in ("=", "<>", "<", ">", "<=", ">="):
            if "txt" in (a.kind, b.kind):
                x, y = (cells.fold_ascii(text(v).value) for v in (a, b))
                test = {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
                if a.kind != b.kind:  # a blank cell of a text column is 0 beside a number
                    blank = (a if a.kind == "txt" else b).value.isNull()
                    zero = Compiled("num", F.lit(0.0))
                    test = F.when(blank, self.binary(op, zero if a.kind == "txt" else _bare(a), zero if b.kind == "txt" else _bare(b)).value).otherwise(test)
            else:
                x, y = number(a).value, number(b).value
                near = F.abs(x - y) < criteria.EPSILON
                test = {"=": near, "<>": ~near, "<": ~near & (x < y), ">": ~near & (x > y), "<=": near | (x < y), ">=": near | (x > y)}[op]
            return _guard("bool", test, _first(a.err, b.err))
        x, y = number(a), number(b)
        err = _first(x.err, y.err)
        if op == "/":
            err = _first(err, F.when(y.value == 0, DIV))
            return Compiled("num", x.value / F.when(y.value != 0, y.value), err, whole=True)
        v = {"+": lambda: x.value + y.value, "-": lambda: x.value - y.value, "*": lambda: x.value * y.value, "^": lambda: F.pow(x.value, y.value)}[op]()
        return Compiled("num", v, err, whole=True)

    # --- logic

    def f_if(self, c, t=("bool", True), f=("bool", False)):
        cond, yes, no = boolean(self.of(c)), self.of(t), self.of(f)
        if yes.kind != no.kind:  # mixed branches read as text
            yes, no = text(yes), text(no)
        v = F.when(cond.value, yes.value).otherwise(no.value)
        err = F.when(cond.value, yes.error()).otherwise(no.error()) if yes.err is not None or no.err is not None else None
        return _guard(yes.kind, v, _first(cond.err, err))

    def _all(self, args, stop: bool):
        out: Column | None = None
        err: Column | None = None
        for a in reversed(args):
            x = boolean(self.of(a))
            if out is None:
                out, err = x.value, x.err
                continue
            err = _first(x.err, None if err is None else F.when(x.value != F.lit(stop), err))
            out = x.value | out if stop else x.value & out
        return _guard("bool", out, err)

    def f_and(self, a, *more):
        return self._all((a, *more), False)

    def f_or(self, a, *more):
        return self._all((a, *more), True)

    def f_not(self, a):
        x = boolean(self.of(a))
        return Compiled("bool", ~x.value, x.err)

    def f_iferror(self, a, b):
        x, y = self.of(a), self.of(b)
        if x.err is None:
            return x
        if x.kind != y.kind:
            x, y = text(x), text(y)
        v = F.when(x.err.isNull(), x.value).otherwise(y.value)
        return Compiled(x.kind, v, None if y.err is None else F.when(x.err.isNotNull(), y.err))

    # --- text

    def _texts(self, *args):
        xs = [text(self.of(a)) for a in args]
        return [x.value for x in xs], _first(*(x.err for x in xs))

    def _count(self, n):
        x = number(self.of(n))
        return F.floor(x.value).cast("int"), _first(x.err, F.when(x.value < 0, VALUE))

    def f_left(self, s, n=("num", 1.0)):
        (t,), e = self._texts(s)
        k, bad = self._count(n)
        return _guard("txt", F.left(t, k), _first(e, bad))

    def f_right(self, s, n=("num", 1.0)):
        (t,), e = self._texts(s)
        k, bad = self._count(n)
        return _guard("txt", F.right(t, k), _first(e, bad))

    def f_mid(self, s, start, n):
        (t,), e = self._texts(s)
        at, k = number(self.of(start)), self._count(n)
        return _guard("txt", F.substring(t, F.floor(at.value).cast("int"), k[0]), _first(e, at.err, F.when(at.value < 1, VALUE), k[1]))

    def f_len(self, s):
        (t,), e = self._texts(s)
        return _guard("num", F.char_length(t).cast("double"), e)

    def f_trim(self, s):
        (t,), e = self._texts(s)
        return _guard("txt", F.trim(F.regexp_replace(t, r"(?U)\s+", " ")), e)

    def f_concatenate(self, *args):
        ts, e = self._texts(*args)
        return _guard("txt", F.concat(*ts) if ts else F.lit(""), e)

    def f_upper(self, s):
        (t,), e = self._texts(s)
        return _guard("txt", F.upper(t), e)

    def f_lower(self, s):
        (t,), e = self._texts(s)
        return _guard("txt", F.lower(t), e)

    def _find(self, needle, hay, start, fold):
        (a, b), e = self._texts(needle, hay)
        if fold:
            a, b = cells.fold_ascii(a), cells.fold_ascii(b)
        s = number(self.of(start))
        # starts and positions are bytes: the search runs over the bytes read as Latin-1 letters
        wide = [F.decode(F.encode(x, "UTF-8"), "ISO-8859-1") for x in (a, b)]
        at = F.call_function("locate", wide[0], wide[1], F.floor(s.value).cast("int"))
        err = _first(e, s.err, F.when(s.value < 1, VALUE), F.when(at == 0, VALUE))
        return _guard("num", at.cast("double"), err)

    def f_find(self, needle, hay, start=("num", 1.0)):
        return self._find(needle, hay, start, False)

    def f_search(self, needle, hay, start=("num", 1.0)):
        return self._find(needle, hay, start, True)

    def f_substitute(self, t, old, new, nth=None):
        (s, o, w), e = self._texts(t, old, new)
        if nth is None:
            return _guard("txt", F.when(o == "", s).otherwise(F.call_function("replace", s, o, w)), e)
        n = number(self.of(nth))
        k = F.floor(n.value).cast("int")
        head = F.call_function("substring_index", s, o, k)
        hits = (F.char_length(s) - F.char_length(F.call_function("replace", s, o, F.lit("")))) / F.char_length(o)
        swapped = F.concat(head, w, F.substring(s, F.char_length(head) + F.char_length(o) + 1, F.lit(2**31 - 1)))
        return _guard("txt", F.when(o == "", s).when(hits >= k, swapped).otherwise(s), _first(e, n.err, F.when(n.value < 1, VALUE)))

    def f_text(self, v, fmt):
        x, n = self.of(v), number(self.of(v))
        pattern = fmt[1] if fmt[0] == "str" else ""
        digits = {"0": 0, "0.0": 1, "0.00": 2, "0.000": 3, "#,##0": 0, "#,##0.00": 2, "0%": 0, "0.0%": 1, "0.00%": 2}.get(pattern)
        if digits is not None:
            scaled = n.value * 100 if pattern.endswith("%") else n.value
            if pattern.startswith("#"):
                shown = F.format_number(scaled, digits)
            else:
                shown = F.call_function("format_number", scaled, F.lit("0" + ("." + "0" * digits if digits else "")))
            shown = F.concat(shown, F.lit("%")) if pattern.endswith("%") else shown
        elif pattern == "0.00E+00":
            parts = F.split(F.format_string("%.2e", n.value), "e")
            shown = F.concat(F.get(parts, F.lit(0)), F.lit("E"), F.get(parts, F.lit(1)).cast("int").cast("string"))
        else:
            shown = cells.number_text(n.value)
        shown = shown if n.err is None else F.when(n.err.isNull(), shown).otherwise(text(x).value)
        return _guard("txt", shown, x.err)

    def f_value(self, t):
        (s,), e = self._texts(t)
        s = F.trim(s)
        pct = s.endswith("%")
        bare = F.regexp_replace(F.regexp_replace(F.when(pct, F.regexp_replace(s, "%$", "")).otherwise(s), r"^\$+", ""), ",", "")
        n = cells.number_of(bare)
        return _guard("num", F.when(pct, n / 100).otherwise(n), _first(e, F.when(n.isNull(), VALUE)))

    # --- numbers

    def _numbers(self, *args):
        xs = [number(self.of(a)) for a in args]
        return [x.value for x in xs], _first(*(x.err for x in xs))

    def _finite(self, v: Column, e: Column | None) -> Compiled:
        """v, or #NUM! where it is no finite number; nested values are null where they are errors, so v needs no second test."""
        return self._defined(F.when(F.abs(v) <= sys.float_info.max, v), e)

    def _defined(self, v: Column, e: Column | None) -> Compiled:
        bad = F.when(v.isNull(), NUM)
        return Compiled("num", v, bad if e is None else F.coalesce(e, bad), whole=True)

    def f_round(self, x, d):
        (a, k), e = self._numbers(x, d)
        f = F.pow(F.lit(10.0), F.signum(k) * F.floor(F.abs(k)))
        return Compiled("num", cells.round_product(a, f), e, whole=True)

    def f_abs(self, x):
        (a,), e = self._numbers(x)
        return Compiled("num", F.abs(a), e, whole=True)

    def f_int(self, x):
        (a,), e = self._numbers(x)
        return Compiled("num", F.floor(a).cast("double"), e, whole=True)

    def f_mod(self, n, d):
        (a, b), e = self._numbers(n, d)
        return _guard("num", cells.modulo(a, b), _first(e, F.when(b == 0, DIV)))

    def f_power(self, b, p):
        (x, y), e = self._numbers(b, p)
        return self._finite(F.pow(x, y), e)

    def f_sqrt(self, x):
        (a,), e = self._numbers(x)
        return Compiled("num", F.when(a >= 0, F.sqrt(a)), _first(e, F.when(a < 0, NUM)), whole=True)

    def _step(self, x, s, f):
        (a, b), e = self._numbers(x, s)
        bad = F.when((b == 0) | ((a > 0) & (b < 0)), NUM)
        return _guard("num", f(a / F.when(b != 0, b)).cast("double") * b, _first(e, bad))

    def f_ceiling(self, x, s=("num", 1.0)):
        return self._step(x, s, F.ceil)

    def f_floor(self, x, s=("num", 1.0)):
        return self._step(x, s, F.floor)

    def f_log(self, x, b=("num", 10.0)):
        (a, c), e = self._numbers(x, b)
        ok = (a > 0) & (c > 0) & (F.abs(c - 1) >= criteria.EPSILON)
        v = F.when(ok, F.ln(a) / F.ln(c))
        bad = F.when(v.isNull(), NUM)
        return Compiled("num", v, bad if e is None else F.when(e.isNotNull(), NUM).otherwise(bad), whole=True)

    def f_log10(self, x):
        (a,), e = self._numbers(x)
        return self._finite(F.when(a > 0, F.log10(a)), e)

    def f_ln(self, x):
        (a,), e = self._numbers(x)
        return self._finite(F.when(a > 0, F.ln(a)), e)

    def f_exp(self, x):
        (a,), e = self._numbers(x)
        return self._finite(F.exp(a), e)

    # --- dates

    def f_date(self, y, m, d):
        (a, b, c), e = self._numbers(y, m, d)
        year, month, day = (F.floor(v).cast("int") for v in (a, b, c))
        year = year + F.when((year >= 0) & (year <= 29), 2000).when((year >= 30) & (year <= 99), 1900).otherwise(0)
        first = F.add_months(F.call_function("make_date", year, F.lit(1), F.lit(1)), month - 1)
        return _guard("num", (cells.date_serial(first) + day - 1).cast("double"), _first(e, F.when((F.year(first) < 1900) | (day < 0), NUM)))

    def _part(self, x, f, leap):
        (a,), e = self._numbers(x)
        v = F.when(F.floor(a) == 60, float(leap)).otherwise(f(cells.serial_date(a)).cast("double"))
        return _guard("num", v, _first(e, F.when(a < 0, NUM)))

    def f_year(self, x):
        return self._part(x, F.year, 1900)

    def f_month(self, x):
        return self._part(x, F.month, 2)

    def f_day(self, x):
        return self._part(x, F.day, 29)

    def f_now(self):
        return Compiled("num", F.unix_micros(F.current_timestamp()) / F.lit(86400e6) + 25569)

    def f_today(self):
        return Compiled("num", cells.date_serial(F.current_date()).cast("double"))

    # --- aggregates over columns

    def _columns(self, args):
        return [self.of(a) for a in args]

    def _sums(self, args) -> list[Column]:
        return [x.value.cast("double") for x in self._columns(args) if x.kind in ("num", "bool")]

    def f_sum(self, *args):
        parts = [F.coalesce(F.sum(c), F.lit(0.0)) for c in self._sums(args)]
        return Compiled("num", sum(parts[1:], parts[0]) if parts else F.lit(0.0))

    def f_average(self, *args):
        cs = self._sums(args)
        n = sum((F.count(c) for c in cs[1:]), F.count(cs[0])) if cs else F.lit(0)
        total = sum((F.coalesce(F.sum(c), F.lit(0.0)) for c in cs), F.lit(0.0))
        return _guard("num", total / F.when(n != 0, n), F.when(n == 0, DIV))

    def f_min(self, *args):
        cs = [F.min(c) for c in self._sums(args)]
        return Compiled("num", F.coalesce(F.least(*cs) if len(cs) > 1 else cs[0], F.lit(0.0)) if cs else F.lit(0.0))

    def f_max(self, *args):
        cs = [F.max(c) for c in self._sums(args)]
        return Compiled("num", F.coalesce(F.greatest(*cs) if len(cs) > 1 else cs[0], F.lit(0.0)) if cs else F.lit(0.0))

    def f_count(self, *args):
        cs = [F.count(x.value) for x in self._columns(args) if x.kind == "num"]
        return Compiled("num", sum(cs[1:], cs[0]).cast("double") if cs else F.lit(0.0))

    def f_counta(self, *args):
        cs = [F.count(x.value) for x in self._columns(args)]
        return Compiled("num", sum(cs[1:], cs[0]).cast("double"))

    def _test(self, area, crit) -> Column:
        x = self.of(area)
        if crit[0] not in ("str", "num", "bool"):
            raise ValueError("a criterion must be a constant")
        c = str(crit[1]) if crit[0] != "num" else repr(crit[1]).removesuffix(".0")
        return criteria.predicate(x.value.cast("double") if x.kind == "bool" else x.value, c, x.kind != "txt")

    def f_countif(self, area, crit, *ignored):
        return Compiled("num", F.count_if(self._test(area, crit)).cast("double"))

    f_countifs = f_countif

    def f_sumif(self, area, crit, source=None):
        x = number(self.of(source or area)) if self.of(source or area).kind != "txt" else Compiled("num", F.lit(None).cast("double"))
        return Compiled("num", F.coalesce(F.sum(F.when(self._test(area, crit), x.value)), F.lit(0.0)))

    f_sumifs = f_sumif

    def f_averageif(self, area, crit, source=None):
        raw = self.of(source or area)
        v = F.avg(F.when(self._test(area, crit), raw.value.cast("double") if raw.kind != "txt" else F.lit(None).cast("double")))
        return _guard("num", v, F.when(v.isNull(), DIV))


def _trig(name: str) -> None:
    f = getattr(F, name)

    def run(self, x):
        (a,), e = self._numbers(x)
        return self._defined(F.nanvl(f(a), F.lit(None).cast("double")), e)

    setattr(Compiler, "f_" + name, run)


for _name in ("sin", "cos", "tan", "asin", "acos", "atan"):
    _trig(_name)


def compile_formula(formula: str, schema: T.StructType) -> Compiled:
    """The formula over a table of that schema."""
    return Compiler(schema).of(parse(formula))


def with_formulas(df: DataFrame, formulas: dict[str, str], errors: bool = True) -> DataFrame:
    """df with a column for each formula, and `<name>_err` with its error if errors is set; one projection."""
    made = {k: compile_formula(f, df.schema) for k, f in formulas.items()}
    cols = [c.value.alias(k) for k, c in made.items()] + ([c.error().alias(f"{k}_err") for k, c in made.items()] if errors else [])
    return df.select("*", *cols)


def aggregate_formulas(df: DataFrame, formulas: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """One row a group with a column for each aggregate formula; formulas over one table share one pass."""
    made = {k: compile_formula(f, df.schema) for k, f in formulas.items()}
    return df.groupBy(*(by or [])).agg(*[c.value.alias(k) for k, c in made.items()])


__all__ = ["DIV", "NA", "NAME", "NUM", "REF", "VALUE", "Compiled", "Compiler", "aggregate_formulas", "compile_formula", "with_formulas"]
