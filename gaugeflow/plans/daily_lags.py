"""Daily lag diagnostics: windows x pairs x preparations in one table of curves and one of peaks.

A configuration is a row: a window's pair under one preparation. All configurations go through the same few joins: the series fan out to the configurations
that use them, prewhitening filters those that ask for it, and the moments of each (configuration, lag) are one aggregation. Lags are dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_corr
from ..operators.lags import bootstrap_intervals, peak_lag
from ..operators.parts import by_years, lag_in_parts
from ..sources.scratch import kept

#: Fixed values: (method, predictor's transformation, response's, definition of rain), for a predictor that is rain and for any other.
RAIN = (("naive_levels", "daily_cumulative_level", "daily_level", "published_cumulative"),
        ("transformed", "daily_cumulative_difference", "daily_first_difference", "cumulative_daily_difference"),
        ("transformed", "interval_daily_total", "daily_first_difference", "15_minute_interval_sum"),
        ("prewhitened", "daily_cumulative_difference", "daily_first_difference", "cumulative_daily_difference"),
        ("prewhitened", "interval_daily_total", "daily_first_difference", "15_minute_interval_sum"))
OTHER = (("naive_levels", "daily_level", "daily_level", "not_applicable"), ("transformed", "daily_first_difference", "daily_first_difference", "not_applicable"),
         ("prewhitened", "daily_first_difference", "daily_first_difference", "not_applicable"))
KEYS = ["window", "predictor", "response", "method", "rain_definition"]
MIN_FIT = 20


def configurations(pairs: DataFrame, rain: list[str]) -> DataFrame:
    """pairs(window, start, stop, predictor, response): each with its preparations."""
    of = lambda rows: F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("method", "predictor_transformation", "response_transformation", "rain_definition"))]) for r in rows])
    return pairs.select("window", "start", "stop", "predictor", "response", F.inline(F.when(F.col("predictor").isin(*rain), of(RAIN)).otherwise(of(OTHER))))


def _side(series: DataFrame, configs: DataFrame, role: str, name: str) -> DataFrame:
    """The eligible days of the series that each configuration uses in a role; the first of repeated days, by value."""
    c = configs.select(*KEYS, "start", "stop", F.col(role).alias("sensor"), F.col(f"{role}_transformation").alias("transformation"))
    there = series.where(F.col("eligible") & F.col("value").isNotNull()).select("sensor", "transformation", "day", "value")
    return there.join(c, ["sensor", "transformation"]).where("day >= start and day < stop").groupBy(*KEYS, "day").agg(F.min("value").alias(name))


def prepared(series: DataFrame, configs: DataFrame) -> DataFrame:
    """(configuration, day, x, y, phi): both series of each configuration by day, prewhitened where asked. phi is the ratio of sums over the one-day pairs of the
    predictor about its mean over all its days, 0 where they do not vary; under MIN_FIT pairs there is neither series nor phi."""
    both = _side(series, configs, "predictor", "x").join(_side(series, configs, "response", "y"), [*KEYS, "day"], "full_outer")
    raw, white = both.where("method <> 'prewhitened'"), both.where("method = 'prewhitened'")
    steps = lag_in_parts(white, KEYS, by_years(F.col("day")), "day", F.struct("day", "x", "y"), "_p")
    next_ = F.datediff("day", "_p.day") == 1
    steps = steps.withColumns({"x1": F.when(next_, F.col("_p.x")), "y1": F.when(next_, F.col("_p.y"))}).drop("_p")
    mean = white.groupBy(*KEYS).agg(F.avg("x").alias("m"))
    dx, dl = F.col("x") - F.col("m"), F.col("x1") - F.col("m")
    ok = F.col("x").isNotNull() & F.col("x1").isNotNull()
    fit = steps.join(mean, KEYS).groupBy(*KEYS).agg(F.count_if(ok).alias("n"), F.sum(F.when(ok, dx * dl)).alias("a"), F.sum(F.when(ok, dl * dl)).alias("b")).where(F.col("n") >= MIN_FIT)
    fit = fit.select(*KEYS, F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(0.0).alias("phi"))
    filtered = steps.join(fit, KEYS).select(*KEYS, "day", (F.col("x") - F.col("phi") * F.col("x1")).alias("x"), (F.col("y") - F.col("phi") * F.col("y1")).alias("y"), "phi")
    return raw.select(*KEYS, "day", "x", "y", F.lit(None).cast("double").alias("phi")).unionByName(filtered.where("x is not null or y is not null"))


def lag_pairs(both: DataFrame, max_lag: int) -> DataFrame:
    """(configuration, lag, predictor_day, x, y) of all days with both; the predictor is unfolded over lags, the response is not."""
    x = both.where("x is not null").select(*KEYS, F.col("day").alias("predictor_day"), "x", F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"))
    x = x.withColumn("day", F.date_add("predictor_day", F.col("lag")))
    return x.join(both.where("y is not null").select(*KEYS, "day", "y"), [*KEYS, "day"]).select(*KEYS, "lag", "predictor_day", "x", "y")


def daily_lags(series: DataFrame, pairs: DataFrame, rain: list[str], max_lag: int = 30, draws: int | None = 500) -> tuple[DataFrame, DataFrame]:
    """(curves, peaks). curves: every configuration and lag with its pairs and correlation (null under three pairs or without variance). peaks: every configuration
    with a status (ok, no_series, insufficient_prewhitening_pairs, no_correlation), the lag of largest absolute correlation, the smallest among equals, and, where draws is given,
    the moving-block interval of the correlation there, conditional on the lag."""
    configs = kept(configurations(pairs, rain), "configurations")
    both = kept(prepared(series, configs), "prepared")
    matched = lag_pairs(both, max_lag)
    found = matched.groupBy(*KEYS, "lag").agg(F.count("*").alias("n_pairs"), safe_corr("x", "y").alias("correlation"))
    every = configs.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag))))
    sums = both.groupBy(*KEYS).agg(F.count("x").alias("n_x"), F.count("y").alias("n_y"), F.max("phi").alias("phi"))
    curves = kept(every.join(found, [*KEYS, "lag"], "left").join(sums.select(*KEYS, "phi"), KEYS, "left")
                  .select(*KEYS, "predictor_transformation", "response_transformation", "lag", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "correlation", "phi"), "curves")
    top = peak_lag(curves, KEYS)
    ends = [_side(series, configs, r, "v").groupBy(*KEYS).agg(F.count("*").alias(f"_{r}")) for r in ("predictor", "response")]
    out = configs.join(top, KEYS, "left").join(sums, KEYS, "left").join(ends[0], KEYS, "left").join(ends[1], KEYS, "left")
    status = (F.when(F.col("lag").isNotNull(), "ok").when(F.col("_predictor").isNull() | F.col("_response").isNull(), "no_series")
              .when((F.col("method") == "prewhitened") & F.col("phi").isNull(), "insufficient_prewhitening_pairs").otherwise("no_correlation"))
    out = out.select(*KEYS, "predictor_transformation", "response_transformation", F.col("start").alias("window_start"), F.col("stop").alias("window_stop"), status.alias("status"),
                     F.col("lag").alias("peak_lag"), F.col("correlation").alias("peak_correlation"), F.col("n_pairs").alias("peak_pairs"), "phi",
                     F.when(F.col("lag").isNotNull(), F.least(F.lit(30), F.greatest(F.lit(2), F.floor(F.col("n_pairs") / 4)))).cast("int").alias("block_length"))
    if draws is not None:
        at = matched.join(top.select(*KEYS, "lag"), [*KEYS, "lag"], "left_semi")
        out = out.join(bootstrap_intervals(at, KEYS, 30, draws), KEYS, "left")
    return curves, out
