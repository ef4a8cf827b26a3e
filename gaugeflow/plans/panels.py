"""What panels and summaries show: regimes, trimmed histograms, lag panels, retained models beside zero change, parameter paths, counts.

Each takes tables that other plans have made and gives the rows of one panel; nothing here changes a value that a calculation uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .forecast import metric_columns

BINS = 45


def level_regimes(series: DataFrame, sensors: list[str]) -> DataFrame:
    """Eligible daily levels by segment; a segment without any has no rows."""
    return series.where(F.col("sensor").isin(*sensors) & (F.col("transformation") == "daily_level") & F.col("eligible")).select("sensor", "segment", "day", "value")


def trimmed_histogram(df: DataFrame, keys: list[str], bins: int = BINS, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Counts of the values between two quantiles, ends included, in bins of equal width from the least to the largest of those values; the last bin holds its end,
    and empty bins stay. Groups whose values are all equal have one bin."""
    there = df.where("value is not null")
    q = there.groupBy(*keys).agg(F.percentile("value", F.array(F.lit(low), F.lit(high))).alias("_q"))
    shown = there.join(q, keys).where((F.col("value") >= F.col("_q")[0]) & (F.col("value") <= F.col("_q")[1]))
    ends = shown.groupBy(*keys).agg(F.min("value").alias("lowest"), F.max("value").alias("highest"), F.count("*").alias("n_shown"))
    n_bins = F.when(F.col("lowest") == F.col("highest"), 1).otherwise(bins)
    at = F.least(n_bins, F.floor((F.col("value") - F.col("lowest")) / ((F.col("highest") - F.col("lowest")) / bins)).cast("int") + 1)
    counts = shown.join(ends, keys).withColumn("bin", F.when(F.col("lowest") == F.col("highest"), 1).otherwise(at)).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(1), n_bins)))
    width = (F.col("highest") - F.col("lowest")) / bins
    return every.join(counts, [*keys, "bin"], "left").select(*keys, "bin", (F.col("lowest") + (F.col("bin") - 1) * width).alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n"), "n_shown")


def longest_example(runs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row with the largest n, then the first by order."""
    best = Window.partitionBy(*keys).orderBy(F.desc("n"), *order) if keys else None
    if best is None:
        return runs.orderBy(F.desc("n"), *order).limit(1)
    return runs.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def lag_panels(curves: DataFrame, rain: list[str], methods: tuple[str, ...] = ("transformed", "prewhitened")) -> DataFrame:
    """The lag curves from rain, one line for each method and definition of rain."""
    return curves.where(F.col("predictor").isin(*rain) & F.col("method").isin(*methods)).select(
        "window", "predictor", "response", F.concat_ws("; ", "method", F.replace(F.col("rain_definition"), F.lit("_"), F.lit(" "))).alias("line"), "lag", "correlation")


def mae_panels(attempts: DataFrame, keys: list[str], stages: tuple[str, ...] = ("evaluation", "external_time_check"), reference: str = "zero_change") -> DataFrame:
    """MAE by stage and model with its place in its panel, least first, and its ratio to the reference's; models without a forecast have no row."""
    m = attempts.where(F.col("stage").isin(*stages)).groupBy(*keys, "stage", "model").agg(*metric_columns()).where("mae is not null")
    panel = Window.partitionBy(*keys, "stage")
    zero = F.max(F.when(F.col("model") == reference, F.col("mae"))).over(panel)
    return m.select(*keys, "stage", "model", "coverage", "mae", F.row_number().over(panel.orderBy("mae", "model")).alias("place"), F.try_divide(F.col("mae"), zero).alias("ratio_to_reference"))


def retained_rows(rows: DataFrame, decisions: DataFrame, stage: str = "evaluation", reference: str = "zero_change") -> DataFrame:
    """Distinct rows(window, sensor, horizon, model, stage) of the retained model of each decision and of the reference, of windows that have a decision: two semi-joins
    as one, over what a decision asks for."""
    asked = decisions.select("window", "sensor", "horizon", F.col("retained").alias("model")).unionByName(
        decisions.select("window", "sensor", "horizon", F.lit(reference).alias("model"))).distinct()
    return rows.where(F.col("stage") == stage).join(asked, ["window", "sensor", "horizon", "model"], "left_semi").distinct()


def parameter_paths(parameters: DataFrame, choices: list[tuple[str, str, str]]) -> DataFrame:
    """Values by origin of chosen (window, model, parameter)."""
    wanted = F.lit(False)
    for window, model, parameter in choices:
        wanted |= (F.col("window") == window) & (F.col("model") == model) & (F.col("parameter") == parameter)
    return parameters.where(wanted).select("window", "model", "parameter", "origin", "value")


def method_settings(detections: DataFrame) -> DataFrame:
    """Detections with method and setting as one label."""
    return detections.withColumn("method_setting", F.concat_ws(": ", "method", "setting"))


def reading_counts(tests: DataFrame, keys: list[str], of: str) -> DataFrame:
    """How many rows of each key have each value of a column."""
    return tests.groupBy(*keys, of).agg(F.count("*").alias("n"))


def strata() -> dict[str, Column]:
    """The four dimensions by which later errors are told apart."""
    from ..functions.scalar import water_year

    return {"water_year": water_year(F.col("target_date")).cast("string"), "season": F.col("season"),
            "movement_subset": F.when(F.col("high"), "training_q95_high_movement").otherwise("not_training_q95_high_movement"), "evaluation_half": F.col("half")}


def stratified_errors(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Errors of successful attempts by each of the four dimensions, in one pass."""
    levels = F.inline(F.array(*[F.struct(F.lit(n).alias("dimension"), c.alias("level")) for n, c in strata().items()]))
    return attempts.where("status = 'ok'").select("*", levels).groupBy(*keys, "dimension", "level").agg(
        F.count("*").alias("n_forecasts"), F.avg("absolute_error").alias("mae"), F.sqrt(F.avg("squared_error")).alias("rmse"), F.avg("error").alias("bias"), F.avg("scaled_absolute_error").alias("mase"))
