"""Coverage, missingness, gap and distribution summaries over long observations or daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import minutes_between
from .parts import by_hours, lag_in_parts


def flag_counts(df: DataFrame) -> list[Column]:
    return [F.count_if(F.col(c)).alias(c.replace("flag_", "n_")) for c in df.columns if c.startswith("flag_")]


def coverage_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    present = F.col("value").isNotNull()
    return df.groupBy(*keys).agg(
        F.count_distinct("member").alias("n_members"), F.count("*").alias("n_rows"), F.count("stamp").alias("n_parsed"),
        F.count("value").alias("n_present"), F.count_if(~present).alias("n_absent"), F.round(100 * F.avg(present.cast("int")), 6).alias("pct_present"),
        F.min("stamp").alias("first_stamp"), F.max("stamp").alias("last_stamp"), F.sum("missing_before").alias("missing_intervals"),
        F.array_join(F.sort_array(F.collect_set(F.date_format("stamp", "mm"))), ";").alias("minute_phases"), *flag_counts(df))


def missingness_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Expected stamps in the span against distinct ones; blank and eligible shares of rows."""
    g = df.groupBy(*keys).agg(
        F.min("stamp").alias("a"), F.max("stamp").alias("b"), F.count_distinct("stamp").alias("n_stamps"), F.count("*").alias("n_rows"),
        F.count_if("flag_missing_value").alias("n_blank"), F.count_if("eligible").alias("n_eligible"), F.max("expected_min").alias("e"))
    expected = (F.floor(minutes_between(F.col("a"), F.col("b")) / F.col("e")) + 1).cast("bigint")
    return g.select(
        *keys, expected.alias("n_expected"), F.greatest(F.lit(0), expected - F.col("n_stamps")).cast("bigint").alias("n_missing_stamps"), "n_rows", "n_blank", "n_eligible",
        F.round(100 * F.col("n_eligible") / F.col("n_rows"), 6).alias("pct_eligible"))


def gap_lengths(df: DataFrame, keys: list[str]) -> DataFrame:
    """Histogram of missing intervals between distinct, ordered stamps."""
    d = df.where("stamp is not null").select(*keys, "stamp", "expected_min").distinct()
    d = lag_in_parts(d, keys, by_hours(F.col("stamp")), "stamp", F.col("stamp"), "_p")
    step = minutes_between(F.col("_p"), F.col("stamp"))
    return (d.withColumn("missing", (F.floor(step / F.col("expected_min")) - 1).cast("bigint")).where("missing > 0")
            .groupBy(*keys, "missing").agg(F.count("*").alias("n_gaps")))


def distribution_summary(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Moments, quantiles (linear), interquartile range and median absolute deviation; the deviation is a second pass."""
    q = F.percentile(value, F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95))))
    first = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("lowest"), F.max(value).alias("highest"), q.alias("q"))
    far = df.join(first.select(*keys, F.col("q")[2].alias("_m")), keys).groupBy(*keys).agg(F.percentile(F.abs(F.col(value) - F.col("_m")), F.lit(0.5)).alias("mad"))
    return first.join(far, keys).select(
        *keys, "n", "mean", "sd", "lowest", "highest", *[F.col("q")[i].alias(n) for i, n in enumerate(("q05", "q25", "median", "q75", "q95"))],
        (F.col("q")[3] - F.col("q")[1]).alias("iqr"), "mad")


def compatibility_summary(df: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates(set_id, sensor): common window (latest start to earliest end) and stamps that all sensors of the set have."""
    c = candidates.withColumn("size", F.count("*").over(Window.partitionBy("set_id")))
    obs = df.where("stamp is not null").join(c, "sensor").select("set_id", "size", "sensor", "stamp").distinct()
    per = obs.groupBy("set_id", "size", "sensor").agg(F.min("stamp").alias("a"), F.max("stamp").alias("b"))
    window = per.groupBy("set_id", "size").agg(F.count("*").alias("n_present"), F.max("a").alias("common_start"), F.min("b").alias("common_end"))
    common = obs.groupBy("set_id", "size", "stamp").agg(F.count("*").alias("n")).where("n = size").groupBy("set_id").agg(F.count("*").alias("n_common"))
    return window.join(common, "set_id", "left").select(
        "set_id", (F.col("n_present") == F.col("size")).alias("all_present"), "common_start", "common_end", F.coalesce("n_common", F.lit(0)).cast("bigint").alias("n_common"),
        F.when(F.col("n_present") < F.col("size"), "sensor_absent").when(F.coalesce("n_common", F.lit(0)) > 0, "exact_common").when(F.col("common_start") <= F.col("common_end"), "needs_tolerance").otherwise("no_overlap").alias("alignment"))


def recomputed_daily(obs: DataFrame, daily: DataFrame, cumulative: bool, tolerance: float = 1e-12) -> DataFrame:
    """daily(sensor, day, value) against the day's maximum (cumulative) or median of obs(sensor, stamp, value), by sensor."""
    how = F.max("value") if cumulative else F.percentile("value", F.lit(0.5))
    again = obs.where("value is not null").groupBy("sensor", F.to_date("stamp").alias("day")).agg(how.alias("again"))
    both = daily.where("value is not null").join(again, ["sensor", "day"])
    diff = F.abs(F.col("value") - F.col("again"))
    return both.groupBy("sensor").agg(
        F.count("*").alias("n_days"), F.count_if(diff <= tolerance).alias("n_match"), F.count_if(diff > tolerance).alias("n_differ"), F.round(F.max(diff), 12).alias("max_diff"))


def preferred_rows(df: DataFrame, product: str, sensors: list[str], rain: list[str], rain_role: str = "interval_precipitation") -> DataFrame:
    """Rows of the product and sensors in the role that stands for the sensor: daily rain its maximum and other daily sensors their median; 15-minute rain in rain_role, which
    analyses take by interval and coverage tables cumulatively, and other sensors their observations."""
    is_rain = F.col("sensor").isin(*rain) if rain else F.lit(False)
    of_rain, other = ("daily_rainfall_maximum", "daily_median") if product == "daily" else (rain_role, "15_minute_observation")
    return df.where((F.col("product") == product) & F.col("sensor").isin(*sensors) & (F.col("role") == F.when(is_rain, of_rain).otherwise(other)))


def daily_relationship(fine: DataFrame, daily: DataFrame, rain: list[str], tolerance: float = 1e-12) -> DataFrame:
    """fine(sensor, role, stamp, value) aggregated by day as documented, rain by its maximum in both roles and other sensors by their median, against daily(sensor, day, value, order), of which
    the first row of a day that has a value counts. One row for each sensor in both, and role."""
    is_rain = F.col("sensor").isin(*rain) if rain else F.lit(False)
    tested = F.when(is_rain, F.col("role").isin("interval_precipitation", "cumulative_precipitation")).otherwise(F.col("role") == "15_minute_observation")
    again = fine.where(tested & F.col("value").isNotNull() & F.col("stamp").isNotNull()).groupBy("sensor", "role", F.to_date("stamp").alias("day")).agg(
        F.max("value").alias("_top"), F.percentile("value", F.lit(0.5)).alias("_middle")).withColumn("again", F.when(is_rain, F.col("_top")).otherwise(F.col("_middle")))
    own = daily.groupBy("sensor", "day").agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("order"))).alias("value"), F.count("*").alias("_rows"))
    per = own.groupBy("sensor").agg(F.count("*").alias("n_daily_days"), F.coalesce(F.sum(F.when(F.col("_rows") > 1, F.col("_rows"))), F.lit(0)).alias("n_duplicate_rows"))
    counts = again.groupBy("sensor", "role").agg(F.count("*").alias("n_fine_days"))
    diff, same = F.abs(F.col("value") - F.col("again")), F.abs(F.col("value") - F.col("again")) <= tolerance
    both = again.join(own.where("value is not null"), ["sensor", "day"]).groupBy("sensor", "role").agg(
        F.count("*").alias("n_comparable"), F.count_if(same).alias("n_match"), F.count_if(~same).alias("n_mismatch"), F.round(F.max(diff), 12).alias("max_difference"),
        F.array_join(F.transform(F.sort_array(F.collect_set(F.when(~same, F.year("day")))), lambda y: y.cast("string")), ";").alias("_years"))
    zero = F.lit(0).cast("bigint")
    return counts.join(per, "sensor").join(both, ["sensor", "role"], "left").select(
        "sensor", F.when(is_rain, "daily_rainfall_maximum").otherwise("daily_median").alias("daily_role"), "role", F.when(is_rain, "maximum").otherwise("median").alias("aggregation"), "n_daily_days", "n_fine_days",
        F.coalesce("n_comparable", zero).alias("n_comparable"), F.coalesce("n_match", zero).alias("n_match"), F.coalesce("n_mismatch", zero).alias("n_mismatch"),
        F.coalesce(F.nullif("_years", F.lit("")), F.lit("none")).alias("mismatch_years"), "max_difference", "n_duplicate_rows")


def semantics_match(daily: DataFrame, fine: DataFrame, rain: list[str], tolerance: float = 1e-12) -> DataFrame:
    """daily(sensor, day, value) with daily_semantics_match: rain equals the day's largest cumulative value; false where either is missing. Other sensors match by definition."""
    top = fine.where((F.col("role") == "cumulative_precipitation") & F.col("stamp").isNotNull()).groupBy("sensor", F.to_date("stamp").alias("day")).agg(F.max("value").alias("_top"))
    same = F.coalesce(F.abs(F.col("value") - F.col("_top")) <= tolerance, F.lit(False))
    is_rain = F.col("sensor").isin(*rain) if rain else F.lit(False)
    return daily.join(top, ["sensor", "day"], "left").withColumn("daily_semantics_match", ~is_rain | same).drop("_top")
