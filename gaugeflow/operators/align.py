"""Nearest one-to-one alignment within a tolerance, separated top events, and their sensitivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .parts import by_hours, lag_in_parts


def nearest_candidates(left: DataFrame, right: DataFrame, tolerance_s: int, keys: list[str] = (), carried: list[str] = ()) -> DataFrame:
    """left(keys, carried, stamp, value) and right(keys, stamp, value): pairs at most tolerance apart. Time is cut in bins of the tolerance; a left row meets the
    bins around its own, so the interval join is an equi-join."""
    sec = F.unix_micros(F.col("stamp").cast("timestamp")) if dict(left.dtypes)["stamp"] != "timestamp_ntz" else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("stamp"))
    width = tolerance_s * 1_000_000
    around = F.explode(F.array(*[F.floor(F.col("_a") / width) + d for d in (-1, 0, 1)]))
    a = left.select(*keys, *carried, F.col("stamp").alias("left_stamp"), F.col("value").alias("left_value"), sec.alias("_a")).withColumn("_bin", around)
    b = right.select(*keys, F.col("stamp").alias("right_stamp"), F.col("value").alias("right_value"), sec.alias("_b")).withColumn("_bin", F.floor(F.col("_b") / width))
    off = F.col("_a") - F.col("_b")
    return a.join(b, [*keys, "_bin"]).where(F.abs(off) <= width).select(*keys, *carried, "left_stamp", "left_value", "right_stamp", "right_value", off.alias("offset_us"))


def _round(open_: DataFrame, keys: list[str]) -> DataFrame:
    """Open pairs that are the best of both their stamps win, and the other pairs of those stamps lose. Pairs meet by stamp, never by key alone."""
    sides = [Window.partitionBy(*keys, side) for side in ("left_stamp", "right_stamp")]
    mine, still = F.struct(F.abs("offset_us"), "left_stamp", "right_stamp"), F.col("_won").isNull()
    best = open_
    for k, side in enumerate(sides):
        best = best.withColumn(f"_best{k}", F.min(F.when(still, mine)).over(side))
    won = best.withColumn("_won", F.when(still & (mine == F.col("_best0")) & (mine == F.col("_best1")), True).otherwise(F.col("_won"))).drop("_best0", "_best1")
    for side in reversed(sides):
        won = won.withColumn("_won", F.when(F.col("_won").isNull() & F.coalesce(F.bool_or("_won").over(side), F.lit(False)), False).otherwise(F.col("_won")))
    return won


def one_to_one(candidates: DataFrame, keys: list[str], rounds: int = 3) -> DataFrame:
    """Greedy choice by (absolute offset, left time, right time), no stamp used twice within keys; stamps are unique within keys on each side. In rounds: a pair that is the best of both
    its stamps is what the greedy order would take, whatever else it takes; then those stamps are spent. The best pair left always
    wins, so rounds end; each `rounds` of them the open pairs are written and the settled ones leave."""
    cur, settled = candidates.withColumn("_won", F.lit(None).cast("boolean")), None
    while True:
        for _ in range(rounds):
            cur = _round(cur, list(keys))
        cur = kept(cur.where("_won is null or _won"), "matches")
        won = cur.where("_won").drop("_won")
        settled = won if settled is None else settled.unionByName(won)
        cur = cur.where("_won is null")
        if cur.isEmpty():
            return settled


def separated_top(df: DataFrame, k: int = 3, min_days: int = 7, keys: list[str] = ()) -> DataFrame:
    """The k largest values (earliest day among equals) whose days are at least min_days apart: k steps, each the best row left of
    each group, found by an aggregate, and an anti-join of the days around it."""
    rest = df.select(*keys, "day", "value")
    picked = None
    for rank in range(1, k + 1):
        best = rest.groupBy(*keys).agg(F.max_by(F.struct("day", "value"), F.struct("value", -F.datediff("day", F.lit("1970-01-01").cast("date")))).alias("b")).select(*keys, F.col("b.day").alias("day"), F.col("b.value").alias("value"), F.lit(rank).alias("rank"))
        picked = best.where("day is not null") if picked is None else picked.unionByName(best.where("day is not null"))
        if rank < k:
            near = best.select(*keys, F.explode(F.sequence(F.date_sub("day", min_days - 1), F.date_add("day", min_days - 1))).alias("day"))
            rest = rest.join(near, [*keys, "day"], "left_anti")
    return picked


def event_changes(obs: DataFrame, max_minutes: int = 20) -> DataFrame:
    """Change from the previous stamp of a sensor where it is 0 to max_minutes later in one segment; copies of a stamp all go."""
    d = F.timestamp_diff("MICROSECOND", F.col("_p.stamp"), F.col("stamp"))
    n = F.count("*").over(Window.partitionBy("sensor", "stamp"))
    seen = lag_in_parts(obs, ["sensor"], by_hours(F.col("stamp")), "stamp", F.struct("stamp", "value", "segment"), "_p")
    return (seen.withColumn("_n", n).where((d > 0) & (d <= max_minutes * 60_000_000) & (F.col("segment") == F.col("_p.segment")) & (F.col("_n") == 1))
            .withColumn("value", F.col("value") - F.col("_p.value")).drop("_p", "_n"))


def tolerance_stability(peaks: DataFrame, keys: list[str], tolerances: tuple[int, ...] = (8, 15), max_range: float = 0.10, max_lag_hours: float = 2.0) -> DataFrame:
    """peaks(keys, tolerance, correlation, lag_hours): stable if all tolerances are there, signs agree, and ranges are small."""
    return peaks.groupBy(*keys).agg(
        F.count("correlation").alias("n_tolerances"), (F.max("correlation") - F.min("correlation")).alias("correlation_range"), (F.max("lag_hours") - F.min("lag_hours")).alias("lag_range"),
        F.coalesce((F.count("correlation") == len(tolerances)) & (F.min(F.signum("correlation")) == F.max(F.signum("correlation")))
                   & (F.max("correlation") - F.min("correlation") <= max_range) & (F.max("lag_hours") - F.min("lag_hours") <= max_lag_hours), F.lit(False)).alias("stable"))
