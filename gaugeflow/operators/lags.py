"""Lagged association of daily series: exact-date pairs, curves over lags, peaks, prewhitening, bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_corr


def lag_pairs(predictor: DataFrame, response: DataFrame, max_lag: int, keys: list[str] = ()) -> DataFrame:
    """predictor/response(keys, day, value): all pairs with day + lag = response day, lag 0..max_lag (a positive lag means
    that the predictor leads). One join: the predictor is unfolded over lags."""
    p = predictor.select(*keys, F.col("day").alias("predictor_day"), F.col("value").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"))
    p = p.withColumn("day", F.date_add("predictor_day", F.col("lag")))
    return p.join(response.select(*keys, "day", F.col("value").alias("y")), [*keys, "day"]).select(*keys, "lag", "predictor_day", F.col("day").alias("response_day"), "x", "y")


def lag_curve(pairs: DataFrame, keys: list[str] = ()) -> DataFrame:
    return pairs.groupBy(*keys, "lag").agg(F.count("*").alias("n_pairs"), safe_corr("x", "y").alias("correlation"))


def peak_lag(curve: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The lag of the largest absolute correlation; the smallest lag wins ties."""
    return curve.where("correlation is not null").groupBy(*keys).agg(
        F.max_by(F.struct("lag", "correlation", "n_pairs"), F.struct(F.abs("correlation"), -F.col("lag"))).alias("p")).select(*keys, "p.*")


def prewhiten(predictor: DataFrame, response: DataFrame, min_pairs: int = 20) -> DataFrame:
    """Filter both series with the predictor's AR(1) coefficient: phi is the ratio of sums over one-day pairs of the
    predictor about its mean over all its days. (day, x, y) of days whose own and previous values are there; none with too few pairs."""
    both = predictor.select("day", F.col("value").alias("x")).join(response.select("day", F.col("value").alias("y")), "day", "full_outer")
    mean = predictor.agg(F.avg("value").alias("m"))
    day = both.withColumns({"x1": F.col("x"), "y1": F.col("y")}).select(F.date_add("day", 1).alias("day"), "x1", "y1")
    lagged = both.join(day, "day").crossJoin(F.broadcast(mean))  # one row
    dx, dl = F.col("x") - F.col("m"), F.col("x1") - F.col("m")
    ok = F.col("x").isNotNull() & F.col("x1").isNotNull()
    phi = lagged.agg(F.count_if(ok).alias("n"), F.try_divide(F.sum(F.when(ok, dx * dl)), F.sum(F.when(ok, dl * dl))).alias("phi")).where(F.col("n") >= min_pairs)
    return (lagged.crossJoin(F.broadcast(phi)).select("day", "phi", (F.col("x") - F.col("phi") * F.col("x1")).alias("x"), (F.col("y") - F.col("phi") * F.col("y1")).alias("y"))
            .where("x is not null or y is not null"))


def bootstrap_intervals(pairs: DataFrame, keys: list[str], block: int = 30, draws: int = 500, seed: int = 170) -> DataFrame:
    """Moving-block bootstrap interval of the correlation of each group's ordered pairs."""
    from ..functions.kernels import block_bootstrap_corr

    def run(pdf):
        p = pdf.sort_values("predictor_day")
        lo, hi = block_bootstrap_corr(p["x"].to_numpy(float), p["y"].to_numpy(float), block, draws, seed)
        out = pdf.iloc[:1][list(keys)].copy()
        out["ci_low"], out["ci_high"] = lo, hi
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keys).schema)
    return pairs.groupBy(*keys).applyInPandas(run, f"{schema}, ci_low double, ci_high double")
