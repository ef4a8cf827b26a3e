"""Ordered state without one task per series: a series is cut into parts along its order, a part is sorted in one task, and what
crosses parts is one row a part, combined in the order of the parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Years of a daily series, and hours of a sub-daily one, that one task orders: many readings may share a stamp.
PART_YEARS, PART_HOURS = 10, 6


def by_years(day: Column) -> Column:
    return F.floor(F.year(day) / PART_YEARS)


def by_hours(stamp: Column) -> Column:
    return F.floor((F.datediff(F.to_date(stamp), F.lit("1970-01-01").cast("date")) * 24 + F.hour(stamp)) / PART_HOURS)


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join by names in which null keys meet; the keys are those of the left side."""
    own = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= left[k].eqNullSafe(own[f"_k{i}"])
    return left.join(own, same, how).drop(*[f"_k{i}" for i in range(len(keys))])


def lag_in_parts(df: DataFrame, keys: list[str], part: Column, order: str | Column, value: Column, name: str) -> DataFrame:
    """The previous row's value in order within keys. part must not decrease along order. Rows are sorted within (keys, part) only;
    the last value of each part, one row a part, stands before the rows of the next part that has some, so that the rows move once."""
    order = F.col(order) if isinstance(order, str) else order
    df = df.withColumns({"_part": part, "_value": value})
    tails = df.groupBy(*keys, "_part").agg(F.max_by("_value", order).alias("_value"))
    carried = tails.select(*keys, "_part", F.lag("_value").over(Window.partitionBy(*keys).orderBy("_part")).alias("_value"), F.lit(False).alias("_own"))
    both = df.withColumn("_own", F.lit(True)).unionByName(carried, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_part").orderBy("_own", order)
    return both.withColumn(name, F.lag("_value").over(inside)).where("_own").drop("_part", "_value", "_own")


def islands(df: DataFrame, keys: list[str], part: Column, order: str, value: Column, starts: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """Numbers islands from 1 in order within keys: a row begins one if it is the first or starts(previous value, own value) holds. A part tells
    its first and last value and the islands that begin after its first row; whether its first row begins one, and how many began before it, follows from
    those of the earlier parts."""
    new = lambda before, own: (before.isNull() | F.coalesce(starts(before, own), F.lit(True))).cast("bigint")
    df = df.withColumns({"_part": part, "_value": F.struct(value.alias("v"))})
    inside = Window.partitionBy(*keys, "_part").orderBy(order)
    df = df.withColumns({"_first": F.row_number().over(inside) == 1, "_before": F.lag("_value").over(inside)})
    df = df.withColumn("_new", F.when(F.col("_first"), F.lit(0)).otherwise(new(F.col("_before"), F.col("_value"))))
    parts = df.groupBy(*keys, "_part").agg(F.min_by("_value", order).alias("_head"), F.max_by("_value", order).alias("_tail"), F.sum("_new").alias("_later"))
    along = Window.partitionBy(*keys).orderBy("_part")
    parts = parts.withColumn("_begins", new(F.lag("_tail").over(along), F.col("_head")))
    base = parts.select(*keys, "_part", (F.sum(F.col("_begins") + F.col("_later")).over(along) - F.col("_later")).alias("_base"))
    out = joined(df.withColumn("_run", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))), base, [*keys, "_part"], "inner")
    return out.withColumn(name, F.col("_base") + F.col("_run")).drop("_part", "_value", "_first", "_before", "_new", "_run", "_base")
