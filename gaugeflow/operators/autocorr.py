"""Autocorrelation as joins over lags, and what follows from it: partial autocorrelations and Ljung-Box sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .parts import joined


def autocorrelations(df: DataFrame, keys: list[str], order: str, value: str, top: Column, fewest: int = 1) -> DataFrame:
    """(keys, n, lag, acf) for lag 0 to top, an expression over n: biased autocorrelations of the values that are not null, in order. Lag 0 is 1; other lags are null for a
    constant series, under fewest values, and beyond the series. The values are unfolded over lags and meet those that many places later."""
    there = df.where(F.col(value).isNotNull())
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    own = there.select(*keys, F.col(value).cast("double").alias("_v"), place.alias("_i"))
    about = own.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_v").alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).withColumn("_top", top)
    x = joined(own, about, keys, "inner").withColumn("_d", F.col("_v") - F.col("_m"))
    unfolded = x.where("_top >= 0").select(*keys, F.col("_d").alias("_x"), "_i", F.explode(F.sequence(F.lit(0), F.col("_top").cast("int"))).alias("lag")).withColumn("_i", F.col("_i") + F.col("lag"))
    sums = joined(unfolded, x.select(*keys, "_i", "_d"), [*keys, "_i"], "inner").groupBy(*keys, "lag").agg(F.sum(F.col("_x") * F.col("_d")).alias("_s"))
    every = about.where("_top >= 0").withColumn("lag", F.explode(F.sequence(F.lit(0), F.col("_top").cast("int"))))
    out = joined(every, sums, [*keys, "lag"])
    zero = joined(out, sums.where("lag = 0").select(*keys, F.col("_s").alias("_z")), keys)
    varies = (F.col("_lo") < F.col("_hi")) & (F.col("n") >= fewest)
    return zero.select(*keys, "n", "lag", F.when(F.col("lag") == 0, 1.0).when(varies, F.col("_s") / F.col("_z")).alias("acf"))


def _next(acc: Column, k: Column, r: Column) -> Column:
    """One step of Durbin and Levinson: the coefficients of order k from those of order k - 1."""
    back = F.aggregate(F.zip_with(acc["phi"], F.reverse(F.slice(r, F.lit(2), k - 1)), lambda p, x: p * x), F.lit(0.0), lambda s, v: s + v)
    last = (F.get(r, k) - back) / acc["v"]
    return F.transform(F.array(last), lambda a: F.struct(
        F.concat(F.zip_with(acc["phi"], F.reverse(acc["phi"]), lambda p, q: p - a * q), F.array(a)).alias("phi"), (acc["v"] * (1 - a * a)).alias("v"), F.concat(acc["out"], F.array(a)).alias("out")))[0]


def partial_autocorrelations(found: DataFrame, keys: list[str]) -> DataFrame:
    """autocorrelations() with pacf; null where an autocorrelation is."""
    r = F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda x: x["acf"])
    none = F.array().cast("array<double>")
    start = F.struct(none.alias("phi"), F.lit(1.0).alias("v"), F.array(F.lit(1.0)).alias("out"))
    lists = found.groupBy(*keys).agg(r.alias("_r"))
    whole = F.size("_r") == F.size(F.array_compact("_r"))
    steps = F.when(F.size("_r") > 1, F.sequence(F.lit(1), F.size("_r") - 1)).otherwise(F.array().cast("array<int>"))
    lists = lists.withColumn("_p", F.when(whole, F.aggregate(steps, start, lambda acc, k: _next(acc, k, F.col("_r")))["out"]))
    return joined(found, lists, keys).withColumn("pacf", F.get("_p", F.col("lag"))).drop("_r", "_p")


def ljung_box(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, ljung_box_lag, ljung_box) over lags 1 to min(most, n // 5); the sum is null where there is no such lag or no autocorrelation."""
    m = F.least(F.lit(most), F.floor(F.col("n") / 5)).cast("int")
    term = F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))
    s = found.groupBy(*keys).agg(F.max("n").alias("n"), F.max(m).alias("ljung_box_lag"), F.sum(F.when((F.col("lag") >= 1) & (F.col("lag") <= m), term)).alias("_s"))
    return s.select(*keys, "ljung_box_lag", F.when(F.col("ljung_box_lag") >= 1, F.col("n") * (F.col("n") + 2) * F.col("_s")).alias("ljung_box"))
