"""One rolling-origin run: baselines, conditional ARX and ARIMA attempts in one table, their parameters, and decisions by stage.

windows(window, sensor, start, stop, anchor, selection_end, blank_from): origins up to selection_end are of the selection stage, later ones of the
evaluation, and all of a window without one are an external time check. Every scheduled attempt is a row with a status, whether or not it was
made: window x origin x horizon x model. Nothing after an origin is used at it, and evaluation never revises a selection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import Z
from ..operators import series
from ..sources.scratch import kept
from .forecast import ARIMA, COMPLEXITY, HORIZONS, MIN_DAYS, MIN_TARGETS, arima_attempts, arx_sums, grid_order, past_residual_intervals, scored, training_quantiles, training_sums

BASELINES = ("zero_change", "persistence", "expanding_median", "prior_year")
BOUNDS = tuple(f"{side}_{round(level * 100)}" for level in Z for side in ("lower", "upper"))


def model_specifications() -> list[tuple[str, str, int, str]]:
    """(model, family, complexity rank, what it is), simplest first."""
    said = {"zero_change": "no change", "persistence": "the origin's value", "expanding_median": "median of all earlier values", "prior_year": "the value a year before the target",
            "arx": "constant, the day before's value, the predictor two days before"}
    family = {**dict.fromkeys(BASELINES, "baseline"), "arx": "conditional_ARX"}
    return [(m, family.get(m, "ARIMA"), k, said.get(m) or "order p, q, seasonal p, period {}, {}, {}, {}; a constant".format(*ARIMA[m])) for k, m in enumerate(COMPLEXITY)]


def stage(origin: Column, selection_end: Column) -> Column:
    return F.when(selection_end.isNull(), "external_time_check").when(origin <= selection_end, "selection").otherwise("evaluation")


def evaluation_half(origin: Column, selection_end: Column, stop: Column) -> Column:
    """early up to the midpoint of the evaluation, which may be half a day; not_applicable in other stages."""
    begin = F.date_add(selection_end, 1)
    early = 2 * F.datediff(origin, begin) <= F.datediff(F.date_sub(stop, 1), begin)
    return F.when(stage(origin, selection_end) != "evaluation", "not_applicable").when(early, "early").otherwise("late")


def target_grid(levels: DataFrame, rain: DataFrame, windows: DataFrame) -> DataFrame:
    """series.calendar_grid with the predictor rain(day, rain); values and rain from blank_from to before anchor are null."""
    blank = F.coalesce((F.col("day") >= F.col("blank_from")) & (F.col("day") < F.col("anchor")), F.lit(False))
    grid = series.calendar_grid(levels, windows).join(rain, "day", "left").join(windows.select("window", "anchor", "blank_from"), "window")
    return grid.select("window", "sensor", "day", *[F.when(~blank, F.col(c)).alias(c) for c in ("value", "segment", "rain")])


def target_windows(grid: DataFrame, windows: DataFrame) -> DataFrame:
    """Of each window: calendar days, eligible values, the first and last of them."""
    there = F.col("value").isNotNull()
    found = grid.groupBy("window").agg(F.count_if(there).alias("n_eligible"), F.min(F.when(there, F.col("day"))).alias("first_eligible"), F.max(F.when(there, F.col("day"))).alias("last_eligible"))
    return windows.select("window", "sensor", "start", "stop", "anchor", "selection_end", F.datediff("stop", "start").alias("calendar_days")).join(found, "window")


def _frame(grid: DataFrame, windows: DataFrame) -> DataFrame:
    """Every window, origin and horizon with what is known at the origin and what was observed. All but the quantiles comes from one sort of each window's days:
    a calendar grid has every day, so that other dates are offsets."""
    order = grid_order()
    at = arx_sums(training_sums(series.core_flags(grid, HORIZONS))).withColumns({
        "origin": F.col("day"), "at_origin": F.col("value"), "r0": F.col("rain"), "r1": F.lag("rain").over(order),
        "ahead": F.struct(*[F.lead("value", h).over(order).alias(f"h{h}") for h in HORIZONS]),
        # a year before a target is 365 or 366 days; the day must be in the grid and not after the origin
        "year_ago": F.struct(*[F.lag("value", days - h).over(order).alias(f"d{days}_{h}") for h in HORIZONS for days in (365, 366)])})
    origins = series.scheduled_origins(windows)
    each = (origins.join(at, ["window", "origin"]).join(training_quantiles(grid, origins), ["window", "sensor", "origin"])
            .join(windows.select("window", "selection_end", "stop"), "window")
            .withColumn("stage", stage(F.col("origin"), F.col("selection_end"))).withColumn("half", evaluation_half(F.col("origin"), F.col("selection_end"), F.col("stop"))))
    rows = F.inline(F.array(*[F.struct(
        F.lit(h).alias("horizon"), F.col(f"core_{h}").alias("core_eligible"), F.col(f"ahead.h{h}").alias("observed"),
        F.col(f"year_ago.d365_{h}").alias("ago_365"), F.col(f"year_ago.d366_{h}").alias("ago_366")) for h in HORIZONS]))
    each = each.select("*", rows).withColumn("target_date", F.date_add("origin", F.col("horizon")))
    feb29 = (F.month("target_date") == 2) & (F.day("target_date") == 29)
    back = F.datediff("target_date", F.add_months("target_date", -12))
    enough = (F.col("training_days") >= MIN_DAYS) & (F.col("training_targets") >= MIN_TARGETS)
    return each.withColumns({"enough": enough, "prior_value": F.when(~feb29, F.when(back == 365, F.col("ago_365")).otherwise(F.col("ago_366")))})


def _arx_point(horizon: Column) -> Column:
    """One day ahead from the origin's value and the day before's rain, two days ahead from that forecast and the origin's rain."""
    one = F.col("c0") + F.col("phi") * F.col("at_origin") + F.col("beta") * F.col("r1")
    return F.when(horizon == 1, one).when(horizon == 2, F.col("c0") + F.col("phi") * one + F.col("beta") * F.col("r0"))


def attempt_status(model_kind: Column, horizon: Column, core_eligible: Column, enough: Column, fits: Column, made: Column, point: Column) -> Column:
    """Fixed values, in order: an ARX attempt at 7 days is feature_unavailable whatever its origin; then ineligible_core_origin and insufficient_training, which an ARX
    attempt has for too few equations too; ARIMA: fit_failure without a converged fit, forecast_failure with one that gave no forecast (made); feature_unavailable
    where a value that the forecast needs is missing; ok."""
    return (F.when((model_kind == "conditional_ARX") & (horizon == 7), "feature_unavailable").when(~core_eligible, "ineligible_core_origin").when(~enough, "insufficient_training")
            .when((model_kind == "conditional_ARX") & ~fits, "insufficient_training").when((model_kind == "ARIMA") & ~fits, "fit_failure")
            .when((model_kind == "ARIMA") & (~made | point.isNull()), "forecast_failure").when(point.isNull(), "feature_unavailable").otherwise("ok"))


def rolling_forecasts(grid: DataFrame, windows: DataFrame, arima: dict[str, tuple[int, int, int, int]] | None = None, arx: bool = True) -> tuple[DataFrame, DataFrame]:
    """(attempts, parameters) over target_grid's grid, written once in the scratch folder, so that what reads them reads tables. Statuses are
    attempt_status's. Bounds are the model's own for ARX and ARIMA, quantiles of known past errors for baselines. A baseline always counts as converged; a fit's warning tells
    that |phi| of ARX is 1 or more."""
    arima = ARIMA if arima is None else arima
    grid = kept(grid, "grid")
    keys, none = ["window", "origin", "horizon", "model"], F.lit(None).cast("double")
    frame = kept(_frame(grid, windows), "frame")
    kinds = {**dict.fromkeys(BASELINES, "baseline"), **dict.fromkeys(arima, "ARIMA"), **({"arx": "conditional_ARX"} if arx else {})}
    each = frame.select("*", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("family")) for m, k in kinds.items()])))
    fitted = ("prediction", "sd", "fit_converged", "made", "min_ar_root", "min_ma_root")
    fits = None
    if arima:
        fits = kept(arima_attempts(grid, frame.select("window", "origin", "enough", "core_eligible").groupBy("window", "origin").agg(F.bool_or(F.col("enough") & F.col("core_eligible")).alias("go")).where("go"), arima), "fits")
        each = each.join(fits.select(*keys, "prediction", "sd", F.col("converged").alias("fit_converged"), "made", "min_ar_root", "min_ma_root"), keys, "left")
    else:
        each = each.withColumns({c: F.lit(False) if c in ("fit_converged", "made") else none for c in fitted})
    horizon, baseline, is_arx = F.col("horizon"), F.col("family") == "baseline", F.col("family") == "conditional_ARX"
    no = F.lit(False)
    guess = {"zero_change": F.lit(0.0), "persistence": F.col("at_origin"), "expanding_median": F.col("training_median"), "prior_year": F.col("prior_value")}
    point = F.when(is_arx, _arx_point(horizon)).when(~baseline, F.col("prediction"))
    for m, p in guess.items():
        point = F.when(F.col("model") == m, p).otherwise(point)
    has_fit = F.when(is_arx, F.coalesce(F.col("fit_status") == "ok", no)).otherwise(F.coalesce(F.col("fit_converged"), no))
    status = attempt_status(F.col("family"), horizon, F.col("core_eligible"), F.col("enough"), has_fit, F.coalesce(F.col("made"), no), point)
    sd = F.when(is_arx, F.sqrt(F.greatest(F.col("sigma2"), F.lit(0.0)) * F.when(horizon == 2, 1 + F.col("phi") * F.col("phi")).otherwise(1.0))).otherwise(F.col("sd"))
    each = each.withColumns({"status": status, "_point": point, "_sd": sd})
    ok = F.col("status") == "ok"
    own = {f"{side}_{round(level * 100)}": F.when(ok & ~baseline, F.col("_point") + (-z if side == "lower" else z) * F.col("_sd")) for level, z in Z.items() for side in ("lower", "upper")}
    converged = F.when(baseline, True).when(is_arx, has_fit & F.col("enough") & F.col("core_eligible") & (horizon != 7)).otherwise(F.coalesce(F.col("fit_converged"), no))
    warned = is_arx & has_fit & F.col("enough") & F.col("core_eligible") & (horizon != 7) & (F.abs("phi") >= 1)
    out = each.withColumns({"prediction": F.when(ok, F.col("_point")), **own, "converged": converged,
                            "fit_warning": F.when(warned, "conditional_ar_coefficient_outside_unit_circle").otherwise("none")}).transform(scored)
    past = past_residual_intervals(out.where(baseline), ["window", "horizon", "model"]).select(*keys, F.col("interval_status").alias("past_status"), *[F.col(b).alias(f"past_{b}") for b in BOUNDS])
    out = out.join(past, keys, "left")
    interval = F.when(~ok, "no_forecast").when(baseline, F.coalesce("past_status", F.lit("no_forecast"))).otherwise("ok_model_based")
    out = out.withColumns({"interval_status": interval, **{b: F.coalesce(b, f"past_{b}") for b in BOUNDS}})
    columns = ["window", "sensor", "origin", "stage", "half", "horizon", "target_date", "model", "family", "core_eligible", "training_days", "training_targets", "status", "interval_status", "converged", "fit_warning", "min_ar_root", "min_ma_root",
               "observed", "prediction", "error", "absolute_error", "squared_error", "scaled_absolute_error", "high", "season", *BOUNDS]
    return kept(out.select(*columns), "attempts"), _parameters(frame, fits, arx)


def _parameters(frame: DataFrame, fits: DataFrame | None, arx: bool) -> DataFrame:
    """(window, origin, stage, model, parameter, value, converged) of every fit."""
    at = frame.where(F.col("horizon") == HORIZONS[0])
    of = lambda names: F.inline(F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(c).alias("value")) for n, c in names]))
    found = at.where((F.col("fit_status") == "ok") & F.col("enough") & F.lit(arx)).select("window", "origin", "stage", F.lit("arx").alias("model"), of((("constant", "c0"), ("ar.L1", "phi"), ("rain_lag2", "beta"))), F.lit(True).alias("converged"))
    if fits is not None:
        made = fits.where(F.col("horizon") == HORIZONS[0]).join(at.select("window", "origin", "stage"), ["window", "origin"])
        found = found.unionByName(made.where("level is not null").select(
            "window", "origin", "stage", "model", of((("level", "level"), ("sigma2", "variance"), ("min_ar_root", "min_ar_root"), ("min_ma_root", "min_ma_root"))), "converged"))
    return found


def selection_decisions(attempts: DataFrame, min_coverage: float = 0.80, min_common: int = 30, within: float = 1.05) -> DataFrame:
    """For each window with a selection stage and each horizon: among models with coverage, over the origins that all of them forecast, the simplest whose MAE is
    within 5 % of the best; zero change where there are too few. All of it from the selection stage; the evaluation, and the external windows of the same sensor, are only told.
    One aggregate by model and stage, one over common origins, and one that holds a key's few models side by side."""
    keys = ["window", "sensor", "horizon"]
    rank = F.element_at(F.create_map(*[x for i, m in enumerate(COMPLEXITY) for x in (F.lit(m), F.lit(i))]), F.col("model"))
    here, ok = F.col("stage") == "selection", F.col("status") == "ok"
    mean = lambda when: F.avg(F.when(when & ok, F.col("absolute_error")))
    cover = F.coalesce(F.try_divide(F.count_if(here & ok).cast("double"), F.count_if(here & F.col("core_eligible")).cast("double")), F.lit(0.0))
    outside = F.col("stage") == "external_time_check"
    by_model = attempts.groupBy(*keys, "model").agg(
        F.count_if(here).alias("n_selection"), (cover >= min_coverage).alias("able"), mean(here).alias("own_mae"), mean(F.col("stage") == "evaluation").alias("later_mae"),
        F.count_if(outside & ok).alias("n_external"), F.sum(F.when(outside & ok, F.col("absolute_error"))).alias("external_sum"))
    by_model = by_model.withColumns({
        "able": F.col("able") & (F.col("n_selection") > 0), "n_external": F.sum("n_external").over(Window.partitionBy("sensor", "horizon", "model")),
        "external_sum": F.sum("external_sum").over(Window.partitionBy("sensor", "horizon", "model"))})
    by_model = kept(by_model.where("n_selection > 0").withColumn("n_models", F.count_if("able").over(Window.partitionBy(*keys))), "by_model")
    full = (attempts.where(here & ok).join(by_model.where("able").select(*keys, "model", "n_models"), [*keys, "model"])
            .withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "origin"))).where("_n = n_models"))
    common = full.groupBy(*keys, "model").agg(F.avg("absolute_error").alias("mae"), F.count("*").alias("n_common"))
    models = by_model.join(common, [*keys, "model"], "left").withColumn("best", F.min("mae").over(Window.partitionBy(*keys)))
    near = F.col("mae") <= F.col("best") * within
    told = F.collect_list(F.struct("model", "later_mae", "n_external", "external_sum"))
    out = models.groupBy(*keys).agg(
        F.min_by(F.when(near, F.struct("model", "mae")), F.when(near, rank)).alias("simplest"), F.coalesce(F.max(F.when(near, F.col("n_common"))), F.lit(0)).alias("n_common"),
        F.max(F.when(F.col("able") & (F.col("model") == "zero_change"), F.col("own_mae"))).alias("zero_mae"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("able"), F.col("model")))), ";").alias("candidates"),
        F.min(F.when(F.col("later_mae").isNotNull(), F.struct(F.col("later_mae").alias("m"), "model"))).alias("later_best"), told.alias("_told"))
    enough = F.coalesce((F.col("n_common") >= min_common) & F.col("simplest.mae").isNotNull(), F.lit(False))
    retained = F.when(enough, F.col("simplest.model")).otherwise("zero_change")
    own = F.get(F.filter("_told", lambda x: x["model"] == F.col("retained")), 0)
    return out.withColumn("retained", retained).select(
        *keys, "retained", F.when(enough, "lowest_common_origin_mae_with_five_percent_complexity_tie_rule").otherwise("insufficient_common_selection_origins_retain_zero").alias("reason"),
        "candidates", "n_common", F.when(enough, F.col("simplest.mae")).otherwise(F.col("zero_mae")).alias("selection_mae"), own["later_mae"].alias("evaluation_mae"),
        F.coalesce("later_best.model", F.lit("none")).alias("evaluation_best"), F.col("later_best.m").alias("evaluation_best_mae"), F.coalesce(own["n_external"], F.lit(0)).alias("n_external"),
        F.try_divide(own["external_sum"], own["n_external"]).alias("external_mae"), F.lit(True).alias("evaluation_does_not_revise_selection"))
