"""Lookups as joins: exact ones by key, approximate ones as as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_table


def lookup_exact(df: DataFrame, key: str, table: DataFrame, table_key: str, take: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with columns of the first table row (by `order`) of an equal key; null where there is none."""
    best = table.groupBy(F.col(table_key).alias("_k")).agg(F.min_by(F.struct(*take), F.struct(*order)).alias("_t"))
    return df.join(best, df[key] == F.col("_k"), "left").select(*[df[c] for c in df.columns], *[F.col(f"_t.{c}").alias(c) for c in take])


def lookup_asof(df: DataFrame, key: str, table: DataFrame, table_key: str, take: Sequence[str], by: Sequence[str] = (), order: Sequence[str] = (), direction: str = "backward") -> DataFrame:
    """df with columns of the last table row whose key is at most df's key (backward) or of the nearest at least it (forward).

    Of equal keys the last by `order` counts.  Both sides are laid in one sequence and the last table row seen is carried
    along; `by` columns split the sequence.  Without `by`, keys are cut into ranges of about equal size, each range is
    swept apart and starts from the last table row of the ranges before, so no task sees all rows.
    """
    spark = df.sparkSession
    back = direction == "backward"
    k = F.col(f"`{key}`")
    # of equal keys on the table's side one row stays: the sequence needs no more
    once = table.groupBy(*by, F.col(table_key).alias("_k")).agg(F.max_by(F.struct(*take), F.struct(*(order or take))).alias("_t"))
    left = df.select(*[F.col(f"`{b}`") for b in by], k.alias("_k"), F.lit(1).alias("_s"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.lit(None).cast(once.schema["_t"].dataType).alias("_t"))
    right = once.select(*by, F.col("_k").cast(left.schema["_k"].dataType).alias("_k"), F.lit(0).alias("_s"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), "_t")
    both = left.unionByName(right)
    first = F.col("_k").asc() if back else F.col("_k").desc()
    sweep = [first, F.col("_s").asc()]
    if by:
        w = Window.partitionBy(*by).orderBy(*sweep).rowsBetween(Window.unboundedPreceding, 0)
        swept = both.withColumn("_t", F.last("_t", ignorenulls=True).over(w))
    else:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # range bounds are drawn anew each time a plan runs, so it runs once
        parts = shared_table(both.repartitionByRange(n, first).withColumn("_p", F.spark_partition_id()), "asof")
        w = Window.partitionBy("_p").orderBy(*sweep).rowsBetween(Window.unboundedPreceding, 0)
        ends = parts.where("_s = 0").groupBy("_p").agg((F.max_by if back else F.min_by)("_t", "_k").alias("_e"))
        ids = spark.range(n).select(F.col("id").cast("int").alias("_p"))
        carry = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        heads = ids.join(ends, "_p", "left").select("_p", F.last("_e", ignorenulls=True).over(carry).alias("_h"))  # one row a range
        swept = parts.withColumn("_t", F.last("_t", ignorenulls=True).over(w)).join(F.broadcast(heads), "_p").withColumn("_t", F.coalesce("_t", "_h"))
    return swept.where("_s = 1").select("_row.*", *[F.col(f"_t.{c}").alias(c) for c in take])


def match_position(df: DataFrame, key: str, vector: DataFrame, value: str, position: str, kind: int = 0) -> DataFrame:
    """df with `position`, 1-based: 0 first equal, 1 last at most (ascending vector), -1 last at least (descending vector)."""
    if kind == 0:
        return lookup_exact(df, key, vector, value, [position], [position])
    return lookup_asof(df, key, vector, value, [position], order=[position], direction="backward" if kind > 0 else "forward")


def index_rows(df: DataFrame, position: str, at: Sequence[int]) -> DataFrame:
    """Rows at 1-based places."""
    return df.where(F.col(position).isin(list(at)))


def route(events: DataFrame, kind: str, hooks: DataFrame) -> DataFrame:
    """(event, hook) for active hooks(id, events, active) that ask for the event's kind or for '*'.

    Hooks are unfolded to (id, kind) first, so both joins are by equality.
    """
    asked = hooks.where("active").select(F.col("id").alias("hook_id"), F.explode("events").alias("_want")).distinct()
    every = asked.where("_want = '*'").select("hook_id").distinct()
    some = asked.join(every, "hook_id", "left_anti").where("_want <> '*'")
    kinds = events.select(F.col(kind).alias("_want")).distinct()
    wide = kinds.join(every).unionByName(some.select("_want", "hook_id"))  # hooks times kinds, both few
    return events.join(wide, events[kind] == wide["_want"]).drop("_want")


def allowed(df: DataFrame, role: str, levels: dict[str, int], need: str) -> Column:
    """Whether a role is at or over the level needed; unknown roles are not."""
    mapping = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, F.col(role)) >= levels[need], F.lit(False))
