"""A sheet's editor as DataFrame operations: range aggregates, arithmetic, finding and replacing, pasting, filling, shared edits."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.formula.parse import shift
from .doctree import merge_attrs
from .tableops import numbered


def range_aggregates(cells_df: DataFrame, by: Sequence[str] = ("sheet",)) -> DataFrame:
    """(by ..., sum, average, count, min, max) of cells(row, col, value): texts that stand for numbers count.

    Without a number the average is null (the sheet shows #DIV/0!), sum, min and max are 0.
    """
    n = cells.number_of(F.col("value").cast("string"))
    none = F.lit(0.0)
    return cells_df.groupBy(*by).agg(F.coalesce(F.sum(n), none).alias("sum"), F.avg(n).alias("average"), F.count(n).alias("count"), F.coalesce(F.min(n), none).alias("min"), F.coalesce(F.max(n), none).alias("max"))


def arithmetic(text: str) -> float | None:
    """The value of an expression of numbers, + - * / and brackets, without the noise beyond ten places; None is #VALUE!.

    A number ends at its second point, a bracket may stay open; dividing by zero and anything left over are errors.
    """
    if not re.fullmatch(r"[\d\s+\-*/.()]+", text, re.ASCII):
        return None
    s = re.sub(r"\s+", "", text)
    at = 0

    def peek() -> str:
        return s[at] if at < len(s) else ""

    def total() -> float:
        nonlocal at
        left = product()
        while peek() and peek() in "+-":
            sign = s[at]
            at += 1
            right = product()
            left = left + right if sign == "+" else left - right
        return left

    def product() -> float:
        nonlocal at
        left = factor()
        while peek() and peek() in "*/":
            sign = s[at]
            at += 1
            right = factor()
            left = left * right if sign == "*" else left / right if right else math.nan
        return left

    def factor() -> float:
        nonlocal at
        if peek() and peek() in "+-":
            sign = s[at]
            at += 1
            return -factor() if sign == "-" else factor()
        if peek() == "(":
            at += 1
            inner = total()
            at += peek() == ")"
            return inner
        digits = re.compile(r"[0-9.]*").match(s, at)[0]
        at += len(digits)
        number = re.match(r"\d*\.?\d*", digits)[0]
        return float(number) if number.strip(".") else math.nan

    try:
        value = total()
    except RecursionError:
        return None
    if at < len(s) or not math.isfinite(value) or not math.isfinite(value * 1e10):
        return value if at == len(s) and math.isfinite(value) else None
    return math.floor(value * 1e10 + 0.5) / 1e10


def evaluate_arithmetic(text: Column) -> Column:
    """arithmetic() of a column, null for what is no expression."""

    @F.pandas_udf("double")
    def evaluated(s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or t != t else arithmetic(t) for t in s], index=s.index, dtype="float64")

    v = evaluated(text)
    return F.when(~F.isnan(v), v)


def find_cells(cells_df: DataFrame, query: str, value: str = "value") -> DataFrame:
    """cells(sheet, row, col, value) that show the query, whatever its case; an empty query finds nothing."""
    return cells_df.where(F.lit(query != "") & F.contains(F.lower(F.coalesce(F.col(value).cast("string"), F.lit(""))), F.lit(query.lower())))


def replace_cells(cells_df: DataFrame, query: str, new: str, value: str = "value") -> DataFrame:
    """cells with every occurrence of the query replaced, whatever its case, and `changed`."""
    if not query:
        return cells_df.withColumn("changed", F.lit(False))
    pattern = "(?iu)" + re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", query)
    text = F.col(value).cast("string")
    out = F.regexp_replace(text, F.lit(pattern), F.lit(re.sub(r"([\\$])", r"\\\1", new)))
    return cells_df.withColumn("changed", F.coalesce(out != text, F.lit(False))).withColumn(value, out)


def paste(copied: DataFrame, mode: str, row: int = 0, col: int = 0) -> DataFrame:
    """Copied cells(row, col, value, formula, style) as they land at (row, col).

    values: what cells show; formulas: their formulas, of others the value; formatting: the style alone; transpose: as
    formulas, rows and columns swapped.
    """
    if mode not in ("values", "formulas", "formatting", "transpose"):
        raise ValueError(f"no paste of {mode}")
    r, c = (F.col("col"), F.col("row")) if mode == "transpose" else (F.col("row"), F.col("col"))
    place = [(r + row).alias("row"), (c + col).alias("col")]
    if mode == "formatting":
        return copied.where("style is not null").select(*place, "style")
    shown = F.coalesce(F.col("value").cast("string"), F.lit(""))
    return copied.select(*place, (shown if mode == "values" else F.coalesce("formula", shown)).alias("value"))


def fill_formulas(df: DataFrame, order: Sequence[str], formula: str, across: bool = False) -> DataFrame:
    """df with `formula`: the one given in the first row by `order`, its unlocked references moved on from row to row."""

    @F.pandas_udf("string")
    def moved(n: pd.Series) -> pd.Series:
        return pd.Series([shift(formula, 0, int(k) - 1) if across else shift(formula, int(k) - 1, 0) for k in n], index=n.index, dtype=object)

    return numbered(df, order).withColumn("formula", moved("ord")).drop("ord")


def shared_sheet(ops: DataFrame) -> DataFrame:
    """(doc_id, sheet, row, col, value, style) after ops(doc_id, arrival, action, sheet, row, col, value, style): the last to arrive wins.

    ssSync brings whole sheets (a row for each cell, of one arrival) and forgets all before.  ssSetCell replaces a cell,
    its style too; an empty value deletes it.  ssFormat adds to a cell's style and makes an empty cell where there is none.
    """
    cell = ["doc_id", "sheet", "row", "col"]
    synced = ops.where("action = 'ssSync'").groupBy("doc_id").agg(F.max("arrival").alias("_sync"))
    live = ops.join(synced, "doc_id", "left").where("_sync is null or arrival >= _sync").drop("_sync")
    base = live.where("action in ('ssSync', 'ssSetCell') and row is not null").groupBy(*cell).agg(F.max_by(F.struct("value", "style"), "arrival").alias("w"), F.max("arrival").alias("_at"))
    later = live.where("action = 'ssFormat'").join(base.drop("w"), cell, "left").where("_at is null or arrival > _at").select(*cell, "arrival", F.explode("style").alias("k", "v"))
    formats = later.groupBy(*cell, "k").agg(F.max_by("v", "arrival").alias("v")).groupBy(*cell).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("f"))
    both = base.join(formats, cell, "full").where("f is not null or coalesce(w.value, '') <> ''")
    empty = F.expr("cast(map() as map<string,string>)")
    kept = F.when(F.coalesce("w.value", F.lit("")) != "", F.col("w.style"))
    return both.select(*cell, F.coalesce("w.value", F.lit("")).alias("value"), merge_attrs(F.coalesce(kept, empty), F.coalesce("f", empty)).alias("style"))
