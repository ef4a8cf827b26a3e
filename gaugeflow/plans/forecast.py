"""Parts of rolling-origin forecasts: baselines, conditional ARX and ARIMA fits, past-residual intervals, metrics. plans/rolling.py puts them in one run.

Every scheduled attempt is a row with a status; nothing after an origin is used at it. grid has window, sensor, day, value, segment,
rain (all days, missing kept). What is known at an origin comes from running sums along a window's days and from expanding quantiles; no origin meets its earlier
days row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import Z, adjusted_kurtosis, adjusted_skew, interval_score, water_year, wet_season
from ..operators.quantiles import expanding_quantiles

HORIZONS = (1, 2, 7)
MIN_DAYS, MIN_TARGETS, MIN_PAIRS, MIN_EQUATIONS, MIN_RESIDUALS = 365, 300, 30, 240, 30
#: Candidate orders: (p, q, seasonal p, period).
ARIMA = {"mean": (0, 0, 0, 7), "ar1": (1, 0, 0, 7), "ar2": (2, 0, 0, 7), "arma11": (1, 1, 0, 7), "sar1": (1, 0, 1, 7)}
#: Simplest first.
COMPLEXITY = ("zero_change", "persistence", "expanding_median", "prior_year", "mean", "ar1", "ar2", "arma11", "sar1", "arx")


def grid_order() -> Window:
    return Window.partitionBy("window", "sensor").orderBy("day")


def training_sums(grid: DataFrame) -> DataFrame:
    """grid with what can be added up to each day: days, values, and the mean absolute one-day change (MASE scale: at least MIN_PAIRS pairs of one segment and
    water year, above zero). One sort of each window's days."""
    order, wy = grid_order(), water_year(F.col("day"))
    pair = (F.lag("segment").over(order) == F.col("segment")) & (F.lag(wy).over(order) == wy)
    g = grid.withColumn("_step", F.when(pair, F.abs(F.col("value") - F.lag("value").over(order))))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumns({"training_days": F.count("*").over(so_far), "training_targets": F.count("value").over(so_far), "_n": F.count("_step").over(so_far), "_s": F.sum("_step").over(so_far)})
    return g.withColumn("mase_scale", F.when((F.col("_n") >= MIN_PAIRS) & (F.col("_s") > 0), F.col("_s") / F.col("_n"))).drop("_step", "_n", "_s")


def training_quantiles(grid: DataFrame, origins: DataFrame) -> DataFrame:
    """(window, sensor, origin): median and 95 % of |value| of the days up to each origin."""
    there = grid.select("window", "sensor", "day", "value", F.abs("value").alias("size"))
    at = origins.join(grid.select("window", "sensor").distinct(), "window")
    found = expanding_quantiles(there, at, ["window", "sensor"], "day", "origin", {"value": (0.5,), "size": (0.95,)})
    return found.select("window", "sensor", "origin", F.get("value_q", 0).alias("training_median"), F.get("size_q", 0).alias("high_movement"))


def training_stats(grid: DataFrame, origins: DataFrame) -> DataFrame:
    """origins(window, origin): training_sums and training_quantiles of the days up to each origin, which lies in the grid."""
    sums = training_sums(grid).select("window", "sensor", F.col("day").alias("origin"), "training_days", "training_targets", "mase_scale")
    return origins.join(sums, ["window", "origin"]).join(training_quantiles(grid, origins), ["window", "sensor", "origin"])


def baseline_attempts(grid: DataFrame, origins: DataFrame, core: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """core(window, origin, horizon, core_eligible). One row per window, origin, horizon and baseline."""
    stats = training_stats(grid, origins)
    at = grid.select("window", F.col("day").alias("origin"), F.col("value").alias("at_origin"))
    target = grid.select("window", F.col("day").alias("target_date"), F.col("value").alias("observed"))
    prior = grid.select("window", F.col("day").alias("prior_date"), F.col("value").alias("prior_value"))
    base = (stats.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("target_date", F.date_add("origin", F.col("horizon")))
            .withColumn("prior_date", F.when(~((F.month("target_date") == 2) & (F.day("target_date") == 29)), F.add_months("target_date", -12)))
            .join(core, ["window", "origin", "horizon"], "left").join(at, ["window", "origin"], "left").join(target, ["window", "target_date"], "left").join(prior, ["window", "prior_date"], "left"))
    guess = {"zero_change": F.lit(0.0), "persistence": F.col("at_origin"), "expanding_median": F.col("training_median"),
             "prior_year": F.when(F.col("prior_date") <= F.col("origin"), F.col("prior_value"))}
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), p.alias("guess")) for m, p in guess.items()]))
    status = (F.when(~F.coalesce("core_eligible", F.lit(False)), "ineligible_core_origin")
              .when((F.col("training_days") < MIN_DAYS) | (F.col("training_targets") < MIN_TARGETS), "insufficient_training")
              .when(F.col("m.guess").isNull(), "feature_unavailable").otherwise("ok"))
    return base.withColumn("m", models).withColumn("model", F.col("m.model")).withColumn("status", status).withColumn("prediction", F.when(F.col("status") == "ok", F.col("m.guess"))).transform(scored).drop("m", "at_origin", "prior_date", "prior_value", "training_median")


def scored(df: DataFrame) -> DataFrame:
    """Errors are observed minus predicted; movement is high strictly above the training threshold."""
    e = F.col("observed") - F.col("prediction")
    return df.withColumns({"error": e, "absolute_error": F.abs(e), "squared_error": e * e, "scaled_absolute_error": F.abs(e) / F.col("mase_scale"),
                           "high": F.abs("observed") > F.col("high_movement"), "season": F.when(wet_season(F.col("target_date")), "wet").otherwise("dry")})


def arx_sums(grid: DataFrame) -> DataFrame:
    """grid with (n, c0, phi, beta, sigma2, fit_status) of y on 1, the day before's y and the rain two days before, over the complete equations up to each day: normal equations of
    running sums about the window's means. Fewer than MIN_EQUATIONS or a singular system have no coefficients."""
    order, whole = grid_order(), Window.partitionBy("window", "sensor")
    g = grid.withColumns({"_y": F.col("value"), "_a": F.lag("value").over(order), "_b": F.lag("rain", 2).over(order)})
    there = F.col("_y").isNotNull() & F.col("_a").isNotNull() & F.col("_b").isNotNull()
    g = g.withColumns({c: F.when(there, F.col(c)) for c in ("_y", "_a", "_b")})
    g = g.withColumns({f"_c{c}": F.avg(f"_{c}").over(whole) for c in "yab"})
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    d = {c: F.col(f"_{c}") - F.col(f"_c{c}") for c in "yab"}
    g = g.withColumns({"_n": F.count("_y").over(so_far), **{f"_s{c}": F.sum(d[c]).over(so_far) for c in "yab"}, **{f"_s{c}": F.sum(d[c[0]] * d[c[1]]).over(so_far) for c in ("aa", "bb", "ab", "ay", "by", "yy")}})
    n = F.col("_n")
    mean = {c: F.try_divide(F.col(f"_s{c}"), n) for c in "yab"}
    co = {c: F.try_divide(F.col(f"_s{c}"), n) - mean[c[0]] * mean[c[1]] for c in ("aa", "bb", "ab", "ay", "by", "yy")}
    det = co["aa"] * co["bb"] - co["ab"] * co["ab"]
    ok = F.coalesce((n >= MIN_EQUATIONS) & (det > 1e-12 * co["aa"] * co["bb"]), F.lit(False))
    g = g.withColumns({"phi": F.when(ok, F.try_divide(co["ay"] * co["bb"] - co["by"] * co["ab"], det)), "beta": F.when(ok, F.try_divide(co["by"] * co["aa"] - co["ay"] * co["ab"], det))})
    return g.withColumns({
        "n": n, "c0": F.col("_cy") + mean["y"] - F.col("phi") * (F.col("_ca") + mean["a"]) - F.col("beta") * (F.col("_cb") + mean["b"]),
        "sigma2": n * (co["yy"] - F.col("phi") * co["ay"] - F.col("beta") * co["by"]) / (n - 3),
        "fit_status": F.when(n < MIN_EQUATIONS, "insufficient_training").when(~ok, "fit_failure").otherwise("ok"),
    }).drop("_n", *[f"_{x}{c}" for x in ("", "c", "s") for c in "yab"], *[f"_s{c}" for c in ("aa", "bb", "ab", "ay", "by", "yy")])


def arx_coefficients(grid: DataFrame, origins: DataFrame) -> DataFrame:
    """arx_sums at the origins that have equations: (window, sensor, origin, n, c0, phi, beta, sigma2, status)."""
    at = arx_sums(grid).where("n > 0").select("window", "sensor", F.col("day").alias("origin"), "n", "c0", "phi", "beta", "sigma2", F.col("fit_status").alias("status"))
    return origins.join(at, ["window", "origin"])


def arx_forecasts(coefficients: DataFrame, grid: DataFrame) -> DataFrame:
    """h = 1 from the origin's y and the day before's rain; h = 2 from the first forecast and the origin's rain; no h = 7. Variances
    are sigma2 and sigma2 (1 + phi^2); normal intervals."""
    at = grid.select("window", "sensor", F.col("day").alias("origin"), F.col("value").alias("y0"), F.col("rain").alias("r0"), F.lag("rain").over(grid_order()).alias("r1"))
    f = coefficients.join(at, ["window", "sensor", "origin"])
    one = F.col("c0") + F.col("phi") * F.col("y0") + F.col("beta") * F.col("r1")
    two = F.col("c0") + F.col("phi") * one + F.col("beta") * F.col("r0")
    none = F.lit(None).cast("double")
    rows = F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), p.alias("prediction"), v.alias("variance")) for h, p, v in (
        (1, one, F.col("sigma2")), (2, two, F.col("sigma2") * (1 + F.col("phi") * F.col("phi"))), (7, none, none))]))
    out = f.select("window", "origin", F.col("status").alias("fit_status"), rows)
    status = F.when(F.col("horizon") == 7, "feature_unavailable").when(F.col("fit_status") != "ok", F.col("fit_status")).when(F.col("prediction").isNull(), "feature_unavailable").otherwise("ok")
    sd = F.sqrt("variance")
    bounds = {f"{side}_{round(level * 100)}": F.col("prediction") + sign * z * sd for level, z in Z.items() for side, sign in (("lower", -1), ("upper", 1))}
    return out.withColumn("status", status).withColumns(bounds).drop("fit_status")


#: Origins that one task fits, one after the other.
ORIGINS_A_TASK = 4


def arima_attempts(grid: DataFrame, origins: DataFrame, specs: dict[str, tuple[int, int, int, int]] = ARIMA) -> DataFrame:
    """Fit each order at each origin on all earlier days, missing kept missing, and forecast the horizons. A window's values are one array in day order, sent once for
    each order and few origins. Without a fit (too few values, no convergence or no variance) there is no prediction; made tells that a forecast came of the fit."""
    from ..functions.kernels import arima_forecast

    names, extra = list(specs), ("min_ar_root", "min_ma_root", "level", "variance")
    days = grid.groupBy("window", "sensor").agg(F.sort_array(F.collect_list(F.struct("day", "value"))).alias("days")).select(
        "window", "sensor", F.get("days", 0)["day"].alias("first"), F.transform("days", lambda d: d["value"]).alias("values"))
    block = F.floor((F.row_number().over(Window.partitionBy("window").orderBy("origin")) - 1) / ORIGINS_A_TASK)
    tasks = (origins.select("window", "origin").withColumn("block", block).groupBy("window", "block").agg(F.sort_array(F.collect_list("origin")).alias("origins"))
             .withColumn("model", F.explode(F.array(*map(F.lit, names)))).join(days, "window"))

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for t in pdf.itertuples(index=False):
                values, rows = np.array(t.values, float), []
                for origin in t.origins:
                    past = values[: (origin - t.first).days + 1]
                    f = arima_forecast(past, specs[t.model], max(HORIZONS)) if np.isfinite(past).sum() >= MIN_TARGETS else None
                    for h in HORIZONS:
                        point = f["mean"][h - 1] if f else None
                        made = point is not None and bool(np.isfinite(point) and np.isfinite(f["sd"][h - 1]))
                        rows.append((t.window, t.sensor, origin, t.model, h, float(point) if made else None, float(f["sd"][h - 1]) if made else None, bool(f and f["converged"]), made, *(float(f[c]) if f else None for c in extra)))
                yield pd.DataFrame(rows, columns=["window", "sensor", "origin", "model", "horizon", "prediction", "sd", "converged", "made", *extra]).astype({"horizon": "int32"})

    n = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tasks.repartition(n, "window", "block", "model").mapInPandas(
        run, "window string, sensor string, origin date, model string, horizon int, prediction double, sd double, converged boolean, made boolean, min_ar_root double, min_ma_root double, level double, variance double")


def past_residual_intervals(attempts: DataFrame, keys: list[str], levels: tuple[float, ...] = (0.80, 0.95)) -> DataFrame:
    """Quantiles of the errors of earlier origins whose targets were known at this origin; at least MIN_RESIDUALS of them."""
    known = attempts.where("error is not null").select(*keys, F.greatest(F.col("target_date"), F.date_add("origin", 1)).alias("known"), "error")
    here = attempts.where("prediction is not null").select(*keys, "origin", "target_date", "prediction")
    q = tuple(x for level in levels for x in ((1 - level) / 2, (1 + level) / 2))
    found = expanding_quantiles(known, here, keys, "known", "origin", {"error": q})
    out = here.join(found.select(*keys, "origin", F.col("error_n").alias("n_calibration"), F.col("error_q").alias("q")), [*keys, "origin"], "left")
    ok = F.coalesce(F.col("n_calibration") >= MIN_RESIDUALS, F.lit(False))
    names = [f"{side}_{round(level * 100)}" for level in levels for side in ("lower", "upper")]
    return out.select(*keys, "origin", "target_date", "prediction", F.coalesce("n_calibration", F.lit(0)).alias("n_calibration"),
                      F.when(ok, "calibrated").otherwise("insufficient_past_calibration").alias("interval_status"), *[F.when(ok, F.col("prediction") + F.col("q")[i]).alias(n) for i, n in enumerate(names)])


def metric_columns() -> list[Column]:
    ok = F.col("status") == "ok"
    return [F.count("*").alias("n_attempts"), F.count_if("core_eligible").alias("n_core"), F.count_if(ok).alias("n_ok"), F.try_divide(F.count_if(ok).cast("double"), F.count_if("core_eligible").cast("double")).alias("coverage"),
            F.avg("absolute_error").alias("mae"), F.sqrt(F.avg("squared_error")).alias("rmse"), F.avg("error").alias("bias"), F.avg("scaled_absolute_error").alias("mase"),
            F.percentile("absolute_error", F.lit(0.5)).alias("median_ae"), F.percentile("absolute_error", F.lit(0.95)).alias("q95_ae")]


def validation_metrics(attempts: DataFrame, keys: list[str]) -> DataFrame:
    return attempts.groupBy(*keys).agg(*metric_columns())


def stratified_metrics(attempts: DataFrame, keys: list[str], strata: dict[str, Column]) -> DataFrame:
    """The same metrics by each stratum in turn, in one pass: attempts are unfolded over (dimension, level)."""
    levels = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("level")) for n, c in strata.items()]))
    return attempts.withColumn("_s", levels).select("*", "_s.*").groupBy(*keys, "dimension", "level").agg(*metric_columns())


def interval_diagnostics(attempts: DataFrame, keys: list[str], level: float) -> DataFrame:
    lo, hi, y = (F.col(c) for c in (f"lower_{round(level * 100)}", f"upper_{round(level * 100)}", "observed"))
    there = lo.isNotNull() & hi.isNotNull() & y.isNotNull()
    return attempts.groupBy(*keys).agg(
        F.count_if(there).alias("n_intervals"), F.avg(F.when(there, ((y >= lo) & (y <= hi)).cast("int"))).alias("coverage"),
        F.avg(F.when(there, hi - lo)).alias("width"), F.avg(F.when(there, interval_score(y, lo, hi, level))).alias("score"))


def interval_levels(attempts: DataFrame, keys: list[str], levels: tuple[float, ...] = tuple(Z)) -> DataFrame:
    """interval_diagnostics of every level, in one pass: attempts are unfolded over levels."""
    y = F.col("observed")
    rows = F.inline(F.array(*[F.struct(F.lit(v).alias("level"), F.col(f"lower_{round(v * 100)}").alias("_lo"), F.col(f"upper_{round(v * 100)}").alias("_hi")) for v in levels]))
    lo, hi = F.col("_lo"), F.col("_hi")
    there = lo.isNotNull() & hi.isNotNull() & y.isNotNull()
    penalty = 2.0 / (1.0 - F.col("level")) * (F.greatest(lo - y, F.lit(0.0)) + F.greatest(y - hi, F.lit(0.0)))
    return attempts.select(*keys, "observed", rows).groupBy(*keys, "level").agg(
        F.count_if(there).alias("n_intervals"), F.avg(F.when(there, ((y >= lo) & (y <= hi)).cast("int"))).alias("coverage"),
        F.avg(F.when(there, hi - lo)).alias("width"), F.avg(F.when(there, hi - lo + penalty)).alias("score"))


def coverage_failures(attempts: DataFrame, keys: list[str]) -> DataFrame:
    return attempts.groupBy(*keys, "status").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def residual_shape(attempts: DataFrame, keys: list[str]) -> DataFrame:
    return attempts.groupBy(*keys).agg(F.count("error").alias("n"), F.avg("error").alias("bias"), adjusted_skew(F.col("error")).alias("skew"), adjusted_kurtosis(F.col("error")).alias("kurtosis"))


def parameter_stability(parameters: DataFrame, keys: list[str]) -> DataFrame:
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return parameters.groupBy(*keys).agg(F.count("value").alias("n"), q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75"), F.min("value").alias("lowest"), F.max("value").alias("highest"), F.avg(F.col("converged").cast("int")).alias("converged_share"))


def paired_comparison(attempts: DataFrame, keys: list[str], reference: str = "zero_change") -> DataFrame:
    """Absolute error of each model less the reference's, over origins that both forecast."""
    ok = attempts.where("absolute_error is not null")
    ref = ok.where(F.col("model") == reference).select(*keys, "origin", F.col("absolute_error").alias("_ref"))
    return ok.where(F.col("model") != reference).join(ref, [*keys, "origin"]).groupBy(*keys, "model").agg(
        F.count("*").alias("n_pairs"), F.avg(F.col("absolute_error") - F.col("_ref")).alias("mean_difference"))
