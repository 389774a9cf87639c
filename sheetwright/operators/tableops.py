"""Sheet table operators on DataFrames: filters, sorting, duplicates, pivots, reshaping, rules and validation.

Row order is never implied: operators that need one take `order`, columns that order the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..sources.shared import shared_table


def cell_text(df: DataFrame, name: str) -> Column:
    """A column as the text that its cells show; blanks are ''."""
    c = F.col(f"`{name}`")
    t = df.schema[name].dataType
    if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
        c = cells.number_text(c)
    elif isinstance(t, T.BooleanType):
        c = F.upper(c.cast("string"))
    return F.coalesce(c.cast("string"), F.lit(""))


# --- filters


def filter_values(df: DataFrame, allowed: dict[str, Sequence[str]]) -> DataFrame:
    """Rows whose cells, as texts, are among the allowed ones in every column named; '' allows blanks."""
    return df.where(reduce(Column.__and__, [_among(df, c, list(v)) for c, v in allowed.items()], F.lit(True)))


def _among(df: DataFrame, name: str, texts: list[str]) -> Column:
    """A test on the bare column where its type allows, so that it reaches the scan."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, T.StringType):
        test = c.isin(texts)
    elif isinstance(kind, T.IntegralType):
        test = c.isin([int(t) for t in texts if t.lstrip("-").isdigit() and str(int(t)) == t])
    else:
        return cell_text(df, name).isin(texts)
    return F.coalesce(test, F.lit(False)) | c.isNull() if "" in texts else test


def filter_text(df: DataFrame, name: str, mode: str, needle: str) -> DataFrame:
    """contains, notContains, startsWith or endsWith, whatever the case."""
    t, n = F.lower(cell_text(df, name)), needle.lower()
    return df.where({"contains": t.contains(n), "notContains": ~t.contains(n), "startsWith": t.startswith(n), "endsWith": t.endswith(n)}[mode])


def numeric(df: DataFrame, name: str) -> Column:
    """A cell as a number: blanks are 0, other texts null."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.when(F.coalesce(F.trim(c), F.lit("")) == "", 0.0).otherwise(cells.number_of(c))
    return F.coalesce(c.cast("double"), F.lit(0.0))


def _number(df: DataFrame, name: str) -> Column:
    """The column as a double; null for blanks and texts that are no number."""
    c = F.col(f"`{name}`")
    return cells.number_of(c) if isinstance(df.schema[name].dataType, T.StringType) else c.cast("double")


def filter_number(df: DataFrame, name: str, mode: str, a: float, b: float | None = None) -> DataFrame:
    """gt, lt (strict) or between (inclusive)."""
    plain = F.col(f"`{name}`")
    covers_zero = {"gt": a < 0, "lt": a > 0, "between": b is not None and a <= 0 <= b}[mode]
    # where no blank can pass, the bare column lets the test reach the scan
    c = numeric(df, name) if covers_zero or isinstance(df.schema[name].dataType, T.StringType) else plain
    return df.where({"gt": lambda: c > a, "lt": lambda: c < a, "between": lambda: (c >= a) & (c <= b)}[mode]())


def filter_top(df: DataFrame, name: str, n: int = 10) -> DataFrame:
    """Rows whose value is among the n largest, ties all kept; duplicates take up places.

    The n-th largest value comes from a bounded top-n per task, not from a sort of the table.
    """
    top = df.select(_number(df, name).alias("_v")).where("_v is not null").orderBy(F.col("_v").desc()).limit(n).agg(F.min("_v").alias("_least"))
    return df.join(F.broadcast(top), _number(df, name) >= F.col("_least"), "left_semi")  # one row


def filter_date(df: DataFrame, name: str, mode: str, a: str, b: str | None = None) -> DataFrame:
    """before, after (strict) or between (inclusive)."""
    c = F.col(f"`{name}`")
    kind = df.schema[name].dataType
    lit = [F.lit(x).cast(kind) for x in (a, b) if x is not None]
    return df.where({"before": lambda: c < lit[0], "after": lambda: c > lit[0], "between": lambda: (c >= lit[0]) & (c <= lit[1])}[mode]())


# --- order, limits, duplicates


def sort_key(df: DataFrame, name: str) -> list[Column]:
    """Numbers by value before texts by lower case."""
    c = F.col(f"`{name}`")
    if not isinstance(df.schema[name].dataType, T.StringType):
        return [c]
    n = cells.number_of(c)
    return [n.isNull(), n, F.lower(c)]


def sort_rows(df: DataFrame, keys: Sequence[tuple[str, str]], order: Sequence[str]) -> DataFrame:
    """Sorted by (column, asc|desc) keys; equal rows stay in the given order."""
    by = [k.desc() if way == "desc" else k.asc() for name, way in keys for k in sort_key(df, name)]
    return df.orderBy(*by, *order)


def remove_duplicates(df: DataFrame, names: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row by `order` of each combination of cell texts."""
    keys = [cell_text(df, c) for c in names]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def duplicate_count(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """How many rows repeat an earlier combination."""
    groups = df.groupBy(*[cell_text(df, c).alias(f"_{i}") for i, c in enumerate(names)]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def distinct_values(df: DataFrame, name: str, order: str, blank: str = "(Blanks)") -> DataFrame:
    """Each cell text once with the first place at which it stands."""
    t = cell_text(df, name)
    return df.groupBy(F.when(t == "", blank).otherwise(t).alias("value")).agg(F.min(order).alias("first_at"))


def paginate(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One page with `total`, the number of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # one row


def last_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """What a ring buffer of n rows holds."""
    return df.orderBy(*order).limit(n)


# --- pivots and reshaping


def pivot(df: DataFrame, row: str, value: str, how: str, column: str | None = None, column_values: Sequence[str] | None = None) -> DataFrame:
    """Cross table of sum, count or average; blank values count as 0, what is no number is left out, absent combinations show 0.

    Giving the column values saves the pass that finds them.
    """
    v = numeric(df, value)
    agg = {"sum": F.sum(v), "count": F.count(v), "average": F.avg(v)}[how]
    groups = df.groupBy(cell_text(df, row).alias(row))
    if column is None:
        return groups.agg(agg.alias(how))
    keyed = df.select(cell_text(df, row).alias(row), cell_text(df, column).alias("_c"), F.col(f"`{value}`"))
    return keyed.groupBy(row).pivot("_c", list(column_values) if column_values else None).agg(agg).na.fill(0)


def chart_series(df: DataFrame, label: str, series: Sequence[str]) -> DataFrame:
    """(label, series, value) of a block whose first column holds labels; what is no number is 0."""
    numbers = df.select(F.col(label).cast("string").alias("label"), *[F.coalesce(numeric(df, s), F.lit(0.0)).alias(s) for s in series])
    return numbers.unpivot("label", list(series), "series", "value")


def pie_shares(df: DataFrame, label: str, value: str) -> DataFrame:
    """Each label's share of the total; negative values and blanks are 0; no rows when the total is 0."""
    v = F.greatest(F.coalesce(_number(df, value), F.lit(0.0)), F.lit(0.0))
    total = df.agg(F.sum(v).alias("_total"))
    joined = df.select(F.col(label).alias("label"), v.alias("value")).join(F.broadcast(total), F.col("_total") > 0)  # one row
    return joined.select("label", "value", (F.col("value") / F.col("_total")).alias("share"))


def nice_scale(df: DataFrame, value: str) -> DataFrame:
    """Axis from the values' range: a step of 1, 2 or 5 times a power of ten, about a fifth of it."""
    v = _number(df, value)
    r = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    rough = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / 5).otherwise(F.lit(1.0))
    power = F.pow(F.lit(10.0), F.floor(F.log10(rough)))
    lead = rough / power
    step = power * F.when(lead <= 1, 1).when(lead <= 2, 2).when(lead <= 5, 5).otherwise(10)
    return r.withColumn("step", step).withColumn("axis_min", F.floor(F.col("lo") / F.col("step")) * F.col("step")).withColumn("axis_max", F.ceil(F.col("hi") / F.col("step")) * F.col("step"))


def sparkline(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The values of a group in order, scaled to 0 to 1; 0.5 where all are equal."""
    v = _number(df, value)
    pts = F.array_sort(F.collect_list(F.struct(*order, v.alias("_v"))))
    g = df.groupBy(*by).agg(pts.alias("_p"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    scaled = F.transform("_p", lambda p: F.when(F.col("_hi") > F.col("_lo"), (p["_v"] - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5))
    return g.select(*by, scaled.alias("points"))


def to_cells(df: DataFrame, names: Sequence[str], row: str) -> DataFrame:
    """(row, col, value): a table as cells; `row` numbers its rows."""
    return df.select(F.col(row).alias("row"), *[cell_text(df, c).alias(str(i)) for i, c in enumerate(names)]).unpivot("row", [str(i) for i in range(len(names))], "col", "value").withColumn("col", F.col("col").cast("int"))


def transpose_cells(cells_df: DataFrame) -> DataFrame:
    """(row, col, ...) with both swapped."""
    rest = [c for c in cells_df.columns if c not in ("row", "col")]
    return cells_df.select(F.col("col").alias("row"), F.col("row").alias("col"), *rest)


def insert_rows(cells_df: DataFrame, at: int, n: int = 1, axis: str = "row") -> DataFrame:
    """Cells at or after `at` move on by n."""
    return cells_df.withColumn(axis, F.when(F.col(axis) >= at, F.col(axis) + n).otherwise(F.col(axis)))


def delete_rows(cells_df: DataFrame, at: int, n: int = 1, axis: str = "row") -> DataFrame:
    """Cells in [at, at+n) go, later ones move up."""
    kept = cells_df.where((F.col(axis) < at) | (F.col(axis) >= at + n))
    return kept.withColumn(axis, F.when(F.col(axis) >= at + n, F.col(axis) - n).otherwise(F.col(axis)))


def merge_owner(cells_df: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells with the top-left cell that owns them, by merges(r1, c1, r2, c2): a few rectangles a sheet."""
    inside = (cells_df.row >= merges.r1) & (cells_df.row <= merges.r2) & (cells_df.col >= merges.c1) & (cells_df.col <= merges.c2)
    out = cells_df.join(merges, inside, "left")
    return out.select(*[cells_df[c] for c in cells_df.columns], F.coalesce(merges.r1, cells_df.row).alias("owner_row"), F.coalesce(merges.c1, cells_df.col).alias("owner_col"))


def regions(cells_df: DataFrame) -> DataFrame:
    """(first_row, last_row, rows): runs of rows that hold any cell, as islands between empty rows."""
    rows = numbered(cells_df.where("value <> ''").select("row").distinct(), ["row"])
    # consecutive numbers less their rank are constant within a run
    runs = rows.withColumn("_g", F.col("row") - F.col("ord"))
    return runs.groupBy("_g").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.count(F.lit(1)).alias("rows")).drop("_g")


def dimensions(cells_df: DataFrame, by: Sequence[str] = ("sheet",)) -> DataFrame:
    return cells_df.groupBy(*by).agg((F.max("col") + 1).alias("cols"), (F.max("row") + 1).alias("rows"))


def fill_numbers(df: DataFrame, order: Sequence[str], start: float, by: float) -> DataFrame:
    """A series filled down: start, start + by, ... in the rows' order (numbered without sorting all rows in one task)."""
    return numbered(df, order).withColumn("fill", F.lit(float(start)) + (F.col("ord") - 1) * F.lit(float(by))).drop("ord")


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df with `ord`, 1, 2, ... by `order`: ranges are sorted apart and offset by the sizes of those before."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    local = parts.withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33))
    local = shared_table(local, "numbered")  # range bounds are drawn anew each time a plan runs, so it runs once
    sizes = local.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    return local.join(F.broadcast(before), "_p").withColumn("ord", F.col("_b") + F.col("_i") + 1).drop("_p", "_i", "_b")  # one row a partition


def append_sheets(sheets: dict[str, DataFrame]) -> DataFrame:
    """Sheets one below the other, with their names in `sheet`; missing columns are blank."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("sheet", F.lit(k)) for k, df in sheets.items()])


def shared_strings(df: DataFrame, name: str) -> DataFrame:
    """(value, id): each distinct text once, numbered from 0 in the order of the texts."""
    return numbered(df.select(F.col(name).alias("value")).where("value is not null").distinct(), ["value"]).select("value", (F.col("ord") - 1).alias("id"))


def dedupe_media(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, media_id): rows of equal content get the smallest key; contents are compared by SHA-256."""
    h = df.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("_h"))
    return h.join(h.groupBy("_h").agg(F.min(key).alias("media_id")), "_h").select(key, "media_id")


# --- rules


def rule_test(df: DataFrame, rule: dict) -> Column:
    """greaterThan, lessThan, equalTo, between or textContains on a column."""
    name, kind = rule["col"], rule["type"]
    n = numeric(df, name)
    if kind == "textContains":
        return F.lower(cell_text(df, name)).contains(str(rule["a"]).lower())
    if kind == "equalTo":
        return cell_text(df, name) == str(rule["a"])
    a = float(rule["a"])
    return {"greaterThan": lambda: n > a, "lessThan": lambda: n < a, "between": lambda: (n >= a) & (n <= float(rule["b"]))}[kind]()


def conditional_style(df: DataFrame, rules: Sequence[dict]) -> Column:
    """The style of the first rule that holds, else null."""
    out: Column | None = None
    for r in rules:
        test, style = F.coalesce(rule_test(df, r), F.lit(False)), F.lit(r["style"])
        out = F.when(test, style) if out is None else out.when(test, style)
    return out if out is not None else F.lit(None).cast("string")


def color_scale(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(v - min) / (max - min) within the group, 0.5 where all are equal, and its red, green, blue."""
    lo_hi = df.groupBy(*by).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    joined = df.join(lo_hi, list(by)) if by else df.join(F.broadcast(lo_hi))  # one row without groups
    ratio = F.when(F.col("_hi") > F.col("_lo"), (F.col(value).cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)
    out = joined.withColumn("ratio", ratio).drop("_lo", "_hi")
    return out.withColumn("red", cells.round_half_away(F.col("ratio") * 255, 0).cast("int")).withColumn("green", cells.round_half_away((1 - F.col("ratio")) * 255, 0).cast("int")).withColumn("blue", F.lit(100))


def validate(df: DataFrame, rules: Sequence[dict], key: Sequence[str]) -> DataFrame:
    """(key..., rule, value) of the cells that break a rule: list, number, textLength or custom (an SQL condition)."""
    tests = []
    for i, r in enumerate(rules):
        name, kind = r["col"], r["type"]
        t = cell_text(df, name)
        if kind == "list":
            ok = t.isin([str(v) for v in r["values"]])
        elif kind == "number":
            n = cells.number_of(t)
            ok = n.isNotNull() & (n >= float(r.get("min", "-inf"))) & (n <= float(r.get("max", "inf")))
        elif kind == "textLength":
            ok = F.char_length(t).between(int(r.get("min", 0)), int(r.get("max", 2**31 - 1)))
        else:
            ok = F.expr(r["condition"])
        tests.append(F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(f"{i}:{name}:{kind}").alias("rule"), t.alias("value"))))
    return df.select(*key, F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("v")).select(*key, "v.rule", "v.value")
