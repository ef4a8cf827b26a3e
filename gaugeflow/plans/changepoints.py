"""Changepoint sensitivity: two detectors at several settings per contiguous run, clusters, support, and context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.regimes import nearest_context
from ..operators.series import date_clusters

SETTINGS = (1.0, 2.0, 4.0)
SPLITS = (1, 2, 3)


def detect(runs: DataFrame, keys: list[str], least: int = 30) -> DataFrame:
    """Mean shifts of each run's ordered values; one run is one group. The terminal index is not a candidate."""
    from ..functions.kernels import binary_segmentation, pelt

    head = runs.select(*keys).schema

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("day")
        x, n, rows = pdf["value"].to_numpy(float), len(pdf), []
        own = tuple(pdf[k].iloc[0] for k in keys)
        if n >= 2 * least:
            for k in SETTINGS:
                penalty = k * np.log(n) * np.var(x, ddof=1)
                rows += [("pelt", f"multiplier_{k:.12g}_penalty_{penalty:.12g}", i) for i in pelt(x, penalty, least)]
            for k in SPLITS:
                if n >= (k + 1) * least:
                    rows += [("binary", f"breaks_{k}", i) for i in binary_segmentation(x, k, least)]
        return pd.DataFrame([(*own, m, s, pdf["day"].iloc[i], i) for m, s, i in rows], columns=[*keys, "method", "setting", "candidate_day", "candidate_index"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in head)
    return runs.select(*keys, "day", "value").groupBy(*keys).applyInPandas(run, f"{schema}, method string, setting string, candidate_day date, candidate_index int")


def run_settings(runs: DataFrame, keys: list[str], least: int = 30) -> DataFrame:
    """Of each run: first and last day, length, and how many settings are tried on it."""
    n = F.count("*")
    splits = sum(((n >= (k + 1) * least).cast("int") for k in SPLITS[1:]), (n >= (SPLITS[0] + 1) * least).cast("int"))
    tried = F.when(n >= 2 * least, F.lit(len(SETTINGS)) + splits).otherwise(0)
    return runs.groupBy(*keys).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), n.alias("n_days"), tried.alias("n_settings"))


def run_summary(runs: DataFrame, detections: DataFrame, keys: list[str], least: int = 30) -> DataFrame:
    """run_settings with the number of raw detections, 0 where there are none."""
    found = detections.groupBy(*keys).agg(F.count("*").alias("n_detections"))
    return run_settings(runs, keys, least).join(found, keys, "left").withColumn("n_detections", F.coalesce("n_detections", F.lit(0)))


def first_split(runs: DataFrame, keys: list[str], least: int = 30) -> DataFrame:
    """The first split of binary segmentation as window sums alone: the index of largest gain in squared error."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy("day")
    whole = Window.partitionBy(*keys)
    c = runs.select(*keys, "day", (F.row_number().over(order) - 1).alias("i"), F.count("*").over(whole).alias("n"), F.sum("value").over(whole).alias("s"),
                    (F.sum("value").over(order) - F.col("value")).alias("left_sum"))
    gain = F.col("left_sum") ** 2 / F.col("i") + (F.col("s") - F.col("left_sum")) ** 2 / (F.col("n") - F.col("i")) - F.col("s") ** 2 / F.col("n")
    ok = c.where((F.col("i") >= least) & (F.col("n") - F.col("i") >= least)).withColumn("gain", gain)
    return ok.groupBy(*keys).agg(F.max_by(F.struct("day", "i", "gain"), F.struct("gain", -F.col("i"))).alias("x")).select(*keys, "x.*")


def summarize(detections: DataFrame, keys: list[str], contexts: DataFrame | None = None, within_days: int = 7) -> DataFrame:
    """Clusters of candidate days, their median day, and how many methods and settings support them."""
    c = date_clusters(detections, keys, "candidate_day", within_days)
    days = c.select(*keys, "cluster", "candidate_day").distinct().groupBy(*keys, "cluster").agg(
        F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.percentile(F.datediff("candidate_day", F.lit("1970-01-01").cast("date")), F.lit(0.5))).cast("int")).alias("day"))
    n_settings, n_methods = F.count_distinct("method", "setting"), F.count_distinct("method")
    out = c.groupBy(*keys, "cluster").agg(
        n_settings.alias("n_settings"), n_methods.alias("n_methods"), F.min("candidate_day").alias("first_day"), F.max("candidate_day").alias("last_day"),
        F.array_join(F.sort_array(F.collect_set(F.concat_ws(":", "method", "setting"))), ";").alias("support"), F.array_join(F.sort_array(F.collect_set("method")), ";").alias("methods"),
        F.when((n_settings >= 2) & (n_methods >= 2), "method_stable").when(n_settings >= 2, "within_method_only").otherwise("unstable").alias("stability")).join(days, [*keys, "cluster"])
    if contexts is None:
        return out
    near = nearest_context(out.select(F.col("day").alias("point")).distinct(), contexts, within_days).withColumnRenamed("point", "day")
    return out.join(near, "day", "left").withColumn("context", F.coalesce("context", F.lit("unexplained")))


def nearest_of_run(points: DataFrame, contexts: DataFrame, run: str, within_days: int) -> DataFrame:
    """points(run, point) and contexts(run, day, context, position): the nearest context of the run within the tolerance, the first declared, then the earliest among equals. An
    equi-join on the days around a point."""
    around = points.select(run, "point", F.explode(F.sequence(F.date_sub("point", within_days), F.date_add("point", within_days))).alias("day"))
    return around.join(contexts, [run, "day"]).groupBy(run, "point").agg(F.min_by(F.struct("day", "context"), F.struct(F.abs(F.datediff("day", "point")), "position", "day")).alias("c"))


#: Names that published tables hold.
LIMIT = "statistical_candidate_not_a_physical_slope_regime_claim"
RESET, EPISODE, STORM = "water_year_reset", "run_q95_displacement_episode", "selected_rain_event"


def candidates_in_context(detections: DataFrame, runs: DataFrame, starts: DataFrame | None = None, fixed: DataFrame | None = None, storms: DataFrame | None = None,
                          run_keys: tuple[str, ...] = ("window", "sensor", "segment", "water_year"), within_days: int = 7) -> DataFrame:
    """The clusters of each run with what stands near them. runs(run, run_keys, day, value) has the runs' days. A candidate is aligned with metadata if a start of its sensor's
    segments (starts: sensor, day, reason), a fixed date (fixed: day, context, position) or a first of October is within the tolerance, in this order among equally near ones; else with an
    event, if a storm (storms: day) or a day of its run whose |value| is above the run's 95 % quantile is; else unexplained. Columns that nothing fills hold `none` or
    `not_applicable`. Runs without detections have no row."""
    spark = runs.sparkSession
    found = summarize(detections, ["run"], None, within_days)
    about = runs.groupBy("run").agg(*[F.first(c).alias(c) for c in run_keys], F.percentile(F.abs("value"), F.lit(0.95)).alias("q95"))
    points = found.select("run", F.col("day").alias("point")).distinct()
    of_run = about.select("run", "sensor").join(points.select("run").distinct(), "run")
    none = spark.range(0).select(F.lit("").alias("run"), F.lit(None).cast("date").alias("day"), F.lit("").alias("context"), F.lit(0).alias("position")).limit(0)
    metadata, events = none, none
    if starts is not None:
        label = F.concat(F.lit("target_"), F.replace(F.col("reason"), F.lit(" "), F.lit("_")))
        place = F.datediff("day", F.lit("0001-01-01").cast("date")) - 10_000_000  # before all fixed ones, in order of time
        metadata = metadata.unionByName(of_run.join(starts.select("sensor", F.col("day"), label.alias("context"), place.alias("position")), "sensor").select("run", "day", "context", "position"))
    if fixed is not None:
        metadata = metadata.unionByName(of_run.select("run").crossJoin(fixed.select("day", "context", F.col("position").cast("int").alias("position"))))  # a few fixed dates for each run
    october = F.explode(F.array(*[F.make_date(F.year("point") + d, F.lit(10), F.lit(1)) for d in (-1, 0)]))
    metadata = metadata.unionByName(points.select("run", october.alias("day")).distinct().select("run", "day", F.lit(RESET).alias("context"), F.lit(1_000_000).alias("position")))
    if storms is not None:
        events = events.unionByName(of_run.select("run").crossJoin(storms.select("day", F.lit(STORM).alias("context"), F.lit(0).alias("position"))))  # a few storms for each run
    high = runs.select("run", "day", "value").join(about.select("run", "q95"), "run").where(F.abs("value") > F.col("q95"))
    events = events.unionByName(high.select("run", "day", F.lit(EPISODE).alias("context"), F.lit(1).alias("position")))
    m, e = (nearest_of_run(points, x, "run", within_days).withColumnRenamed("c", n) for x, n in ((metadata, "_m"), (events, "_e")))
    out = found.join(about, "run").withColumn("point", F.col("day")).join(m, ["run", "point"], "left").join(e, ["run", "point"], "left")
    best = F.coalesce("_m", "_e")
    return out.select(
        F.concat(F.col("run"), F.lit("__c"), F.lpad(F.col("cluster").cast("string"), 2, "0")).alias("candidate"), "run", *run_keys, F.col("point").alias("candidate_day"), "first_day", "last_day",
        "n_settings", "methods", "stability", F.when(F.col("_m").isNotNull(), "metadata_aligned").when(F.col("_e").isNotNull(), "event_aligned").otherwise("unexplained").alias("classification"),
        F.coalesce(F.date_format(best["day"], "yyyy-MM-dd"), F.lit("none")).alias("context_day"), F.coalesce(best["context"], F.lit("none")).alias("context"),
        F.coalesce(F.datediff("point", best["day"]).cast("string"), F.lit("not_applicable")).alias("offset_days"), F.lit(LIMIT).alias("limit"))
