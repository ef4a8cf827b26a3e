"""Daily series: exact-date changes, interval sums, contiguous runs, calendar grids and rolling origins.

A daily series has sensor, day, value, segment, eligible; lags are dates, never row offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import water_year
from .parts import by_years, islands, joined, lag_in_parts


def daily_changes(levels: DataFrame, same_water_year: bool = False, extra: Column | None = None) -> DataFrame:
    """Change from the previous row of the sensor. Eligible only if both days are, they are one day apart, in one segment (and
    water year, and both meet extra); other rows stay with their value."""
    df = levels.withColumn("_ok", F.col("eligible") & (F.lit(True) if extra is None else F.coalesce(extra, F.lit(False))))
    df = lag_in_parts(df, ["sensor"], by_years(F.col("day")), "day", F.struct("day", "value", "segment", "_ok"), "_p")
    ok = F.col("_ok") & F.col("_p._ok") & (F.datediff("day", "_p.day") == 1) & (F.col("segment") == F.col("_p.segment"))
    if same_water_year:
        ok &= water_year(F.col("day")) == water_year(F.col("_p.day"))
    return df.withColumns({"value": F.col("value") - F.col("_p.value"), "eligible": F.coalesce(ok, F.lit(False))}).drop("_p", "_ok")


def interval_daily(obs: DataFrame, min_count: int = 90, per_day: int = 96) -> DataFrame:
    """Daily sums of eligible intervals; eligible with min_count of them in exactly one segment. Days without any stay, with null."""
    ok = F.col("eligible")
    segments = F.collect_set(F.when(ok, F.col("segment")))
    n = F.count_if(ok)
    return obs.groupBy("sensor", F.to_date("stamp").alias("day")).agg(
        F.sum(F.when(ok, F.col("value"))).alias("value"), n.alias("coverage_count"), (n / F.lit(float(per_day))).alias("coverage_fraction"),
        F.when(F.size(segments) == 1, F.get(segments, 0)).otherwise("mixed_or_none").alias("segment"), ((n >= min_count) & (F.size(segments) == 1)).alias("eligible"))


def daily_analysis(levels: DataFrame, intervals: DataFrame, cumulative: tuple[str, ...] = (), same_water_year: tuple[str, ...] = (), match: Column | None = None) -> DataFrame:
    """levels(sensor, day, value, segment, eligible) and intervals, an interval_daily table, as one long table: levels, changes from the day before (cumulative sensors' only
    within a water year and where both days meet match), and interval sums. Nothing is interpolated or spliced."""
    columns = ["sensor", "day", "segment", "transformation", "value", "eligible", "coverage_count", "coverage_fraction"]
    is_cumulative = F.col("sensor").isin(*cumulative) if cumulative else F.lit(False)
    bare = levels.select("sensor", "day", "segment", "value", "eligible", F.lit(None).cast("bigint").alias("coverage_count"), F.lit(None).cast("double").alias("coverage_fraction"), *([match.alias("_match")] if match is not None else []))
    within = F.col("sensor").isin(*same_water_year) if same_water_year else F.lit(False)
    parts = [bare.withColumn("transformation", F.when(is_cumulative, "daily_cumulative_level").otherwise("daily_level"))]
    for some, name, water, extra in ((~is_cumulative & ~within, "daily_first_difference", False, None), (~is_cumulative & within, "daily_first_difference", True, None),
                                     (is_cumulative, "daily_cumulative_difference", True, None if match is None else F.col("_match"))):
        parts.append(daily_changes(bare.where(some), water, extra).withColumn("transformation", F.lit(name)))
    parts.append(intervals.withColumn("transformation", F.lit("interval_daily_total")))
    out = parts[0].select(*columns)
    for x in parts[1:]:
        out = out.unionByName(x.select(*columns))
    return out.withColumn("water_year", water_year(F.col("day")))


def month_pivot(df: DataFrame, sensors: list[str]) -> DataFrame:
    """Mean value of each sensor by month; every month from the first to the last has a row."""
    by = df.groupBy(F.to_date(F.date_trunc("month", "day")).alias("month")).pivot("sensor", sensors).agg(F.avg("value"))
    ends = df.agg(F.to_date(F.date_trunc("month", F.min("day"))).alias("a"), F.to_date(F.date_trunc("month", F.max("day"))).alias("b")).where("a is not null")
    every = ends.select(F.explode(F.sequence("a", "b", F.make_ym_interval(months=F.lit(1)))).alias("month"))
    return every.join(by, "month", "left")


def first_per_day(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each day, by an explicit order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "day").orderBy(*order))).where("_r = 1").drop("_r")


def drop_all_copies(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once; every copy of a repeated key goes."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")


def contiguous_runs(df: DataFrame, keys: list[str], min_days: int = 1) -> DataFrame:
    """Maximal runs of consecutive days within keys, numbered before the length filter. Days repeated within the keys are dropped first."""
    one = drop_all_copies(df, [*keys, "day"])
    runs = islands(one, keys, by_years(F.col("day")), "day", F.col("day"), lambda before, own: F.datediff(own["v"], before["v"]) != 1, "run_no")
    long = runs.groupBy(*keys, "run_no").agg(F.count("*").alias("run_days")).where(F.col("run_days") >= min_days)
    return joined(runs, long, [*keys, "run_no"], "inner")


def run_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.groupBy(*keys, "run_no").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_days"))


def longest_runs(runs: DataFrame, keys: list[str], min_days: int = 1) -> DataFrame:
    """The longest run per keys; among equals the first as text (run ids sort as strings)."""
    s = run_summary(runs, keys).where(F.col("n_days") >= min_days)
    best = Window.partitionBy(*keys).orderBy(F.desc("n_days"), F.concat(F.lit("r"), F.col("run_no").cast("string")))
    return s.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def calendar_grid(series: DataFrame, windows: DataFrame) -> DataFrame:
    """windows(window, sensor, start, stop): every day of [start, stop) with the series' eligible value, or null."""
    spine = windows.select("window", "sensor", F.explode(F.sequence("start", F.date_sub("stop", 1))).alias("day"))
    s = series.select("sensor", "day", F.when(F.col("eligible"), F.col("value")).alias("value"), F.when(F.col("eligible"), F.col("segment")).alias("segment"))
    return spine.join(s, ["sensor", "day"], "left")


def scheduled_origins(windows: DataFrame, every_days: int = 14) -> DataFrame:
    """windows(window, anchor, stop): anchor and every so many days after it, before stop."""
    return windows.select("window", F.explode(F.sequence("anchor", F.date_sub("stop", 1), F.make_dt_interval(days=F.lit(every_days)))).alias("origin"))


def core_flags(grid: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """grid with core_<h>: whether the day and the next h days all have values, in one segment and water year."""
    wy, new = water_year(F.col("day")), {}
    for h in horizons:
        order = Window.partitionBy("window", "sensor").orderBy("day").rowsBetween(0, h)
        ok = ((F.count("value").over(order) == h + 1) & (F.count("segment").over(order) == h + 1)
              & (F.min("segment").over(order) == F.max("segment").over(order)) & (F.min(wy).over(order) == F.max(wy).over(order)))
        new[f"core_{h}"] = F.coalesce(ok, F.lit(False))
    return grid.withColumns(new)


def core_origins(grid: DataFrame, horizon: int) -> DataFrame:
    """For each day of a grid: whether it and the next `horizon` days all have values, in one segment and water year."""
    return core_flags(grid, (horizon,)).withColumnRenamed(f"core_{horizon}", "core_eligible")


def date_clusters(df: DataFrame, keys: list[str], day: str = "day", within_days: int = 7) -> DataFrame:
    """Chained clusters: a new one begins where the gap to the previous member exceeds within_days."""
    days = df.select(*keys, day).distinct()
    numbered = islands(days, keys, by_years(F.col(day)), day, F.col(day), lambda before, own: F.datediff(own["v"], before["v"]) > within_days, "cluster")
    return joined(df, numbered, [*keys, day], "inner")


def climatology(df: DataFrame, min_years: int = 3) -> DataFrame:
    """Median and outer deciles by sensor and day of the water year."""
    start = F.make_date(water_year(F.col("day")) - 1, F.lit(10), F.lit(1))
    return (df.withColumn("wy_day", F.datediff("day", start) + 1).groupBy("sensor", "wy_day")
            .agg(F.count("value").alias("n"), F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
            .where(F.col("n") >= min_years).select("sensor", "wy_day", "n", F.col("q")[0].alias("q10"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q90")))


def monthly_eligible(df: DataFrame) -> DataFrame:
    return df.groupBy("sensor", F.to_date(F.date_trunc("month", "day")).alias("month")).agg(F.avg(F.col("eligible").cast("int")).alias("eligible_fraction"))
