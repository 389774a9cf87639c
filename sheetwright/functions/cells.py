"""Typed cells: coercions, number texts, A1 addresses and date serials as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def fold_ascii(text: Column) -> Column:
    """Lower case of A-Z alone, as comparisons fold it."""
    return F.translate(text, _UPPER, _LOWER)


def number_of(text: Column) -> Column:
    """The number that a text reads as, else null; forms that only Java knows are no numbers."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def number_text(x: Column) -> Column:
    """A double's text: no '.0', no exponent."""
    d = x.cast("double")
    whole = (d == F.floor(d)) & (F.abs(d) < 9.0e15)
    return F.when(whole, d.cast("long").cast("string")).otherwise(F.call_function("format_number", d, F.lit("0.####################")))


def round_half_away(x: Column, digits: int) -> Column:
    """Rounds the binary product, halves away from zero: 1.005 at two digits is 1."""
    return round_product(x, F.lit(float(10.0**digits)))


def round_product(x: Column, f: Column) -> Column:
    a = F.abs(x * f)
    low = F.floor(a)
    return F.signum(x) * (low + F.when(a - low >= 0.5, 1).otherwise(0)) / f


def modulo(n: Column, d: Column) -> Column:
    """Sign of the divisor; null for a zero divisor."""
    safe = F.when(d != 0, d)
    return n - safe * F.floor(n / safe)


def column_number(letters: Column) -> Column:
    """A -> 0, AA -> 26."""
    chars = F.split(F.upper(letters), "")
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1


def column_letters(index: Column) -> Column:
    """0 -> A, 26 -> AA; up to three letters."""
    n = index.cast("int")

    def digit(k: Column) -> Column:
        return F.char(k + 65)

    one = digit(n)
    two = F.concat(digit((n / 26).cast("int") - 1), digit(n % 26))
    m = n - 702
    three = F.concat(digit((m / 676).cast("int")), digit((m / 26).cast("int") % 26), digit(m % 26))
    return F.when(n < 26, one).when(n < 702, two).otherwise(three)


def date_serial(day: Column) -> Column:
    """Days of the 1900 system with its extra 29 February 1900: right from 1 March 1900, one less before."""
    d = F.datediff(day.cast("date"), F.lit("1899-12-30").cast("date"))
    return F.when(d < 61, d - 1).otherwise(d)


def serial_date(serial: Column) -> Column:
    """The date of a serial; 60, the day that never was, is 28 February 1900."""
    n = F.floor(serial).cast("int")
    return F.date_add(F.lit("1899-12-30").cast("date"), F.when(n < 60, n + 1).when(n == 60, F.lit(60)).otherwise(n))


def serial_time(serial: Column) -> Column:
    """HH:MM:SS of a serial's fraction."""
    s = F.round((serial - F.floor(serial)) * 86400).cast("long") % 86400
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("int"), ((s % 3600) / 60).cast("int"), (s % 60).cast("int"))


def infer_type(text: Column) -> Column:
    """formula, boolean, number, string or empty, as a cell's entry is read."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t == "", "empty").when(t.startswith("=") | t.startswith("{="), "formula").when(F.lower(t).isin("true", "false"), "boolean").when(t.rlike(NUMBER), "number").otherwise("string")
    )


def escape_formula(text: Column) -> Column:
    """An apostrophe before texts that a sheet would run."""
    return F.when(text.rlike(r"^[=\-+@|\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
