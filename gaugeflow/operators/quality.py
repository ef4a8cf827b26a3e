"""Quality flags of long observations. Nothing is dropped or changed: rows gain columns.

Input columns: member, row_no (source order), product, sensor, role, stamp (timestamp_ntz or null), value_text, expected_min.
Within a member, order is source order; each step is one window over (member) or (product, sensor, role).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import NONFINITE_TOKENS, SENTINELS, minutes_between, parse_number, water_year
from .parts import by_hours, lag_in_parts

#: Source rows of a member that one task orders.
PART_ROWS = 200_000
#: Flags that make a level unfit for analysis.
FATAL = (
    "flag_timestamp_parse_failure", "flag_duplicate_timestamp", "flag_missing_value", "flag_nonfinite_value", "flag_malformed_value",
    "flag_sentinel_candidate", "flag_documented_maintenance_or_outage", "flag_out_of_order_timestamp", "flag_documented_instrument_error")
OUTSIDE = "outside_documented_operation"


def _on(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def _copies(*keys: str) -> Column:
    """Rows with the same keys and stamp; those without a stamp, whose number tells nothing, stay apart."""
    return F.count("*").over(Window.partitionBy(*keys, "stamp", F.when(F.col("stamp").isNull(), F.col("row_no"))))


def time_flags(df: DataFrame) -> DataFrame:
    """Steps from the immediately previous source row; unparsed stamps break the chain."""
    df = lag_in_parts(df, ["member"], F.floor(F.col("row_no") / PART_ROWS), "row_no", F.struct("stamp"), "_prev")
    delta = minutes_between(F.col("_prev.stamp"), F.col("stamp"))
    d, e = F.col("delta_min"), F.col("expected_min")
    return (df.withColumn("delta_min", delta).drop("_prev").withColumns({
        "water_year": water_year(F.col("stamp")),
        "missing_before": F.greatest(F.when(d > e, F.floor(d / e) - 1).otherwise(0), F.lit(0)).cast("bigint"),
        "flag_timestamp_parse_failure": F.col("stamp").isNull(),
        "flag_duplicate_timestamp_in_member": F.col("stamp").isNotNull() & (_copies("member") > 1),
        "flag_off_grid_timestamp": F.coalesce((d > 0) & (F.pmod(d, e) != 0), F.lit(False)),
        "flag_irregular_timestamp_step": F.coalesce(d != e, F.lit(False)),
        "flag_gap_before": F.coalesce(d > e, F.lit(False)),
        "flag_out_of_order_timestamp": F.coalesce(d < 0, F.lit(False)),
    }))


def cross_member_duplicates(df: DataFrame) -> DataFrame:
    return df.withColumn("flag_duplicate_timestamp", F.col("stamp").isNotNull() & (_copies("product", "sensor", "role") > 1))


def value_flags(df: DataFrame) -> DataFrame:
    text = F.trim("value_text")
    df = df.withColumns({"value": parse_number(F.col("value_text")), "_bad": F.lower(text).isin(*NONFINITE_TOKENS)})
    number, bad = F.col("value"), F.col("_bad") | F.coalesce(F.abs("value") == float("inf"), F.lit(False))
    return df.withColumns({
        "flag_missing_value": F.coalesce(text == "", F.lit(False)),
        "flag_nonfinite_value": F.coalesce(bad, F.lit(False)),
        "flag_malformed_value": F.coalesce((text != "") & number.isNull() & ~bad, F.lit(False)),
        "flag_sentinel_candidate": F.coalesce(number.isin(*SENTINELS), F.lit(False)),
    }).drop("_bad")


def range_flags(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges(sensor, lo, hi): strictly outside; a null bound is open."""
    r = ranges.select("sensor", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    out = df.join(r, "sensor", "left")
    return out.withColumn("flag_metadata_range_concern", F.coalesce(F.col("value") < F.col("_lo"), F.lit(False)) | F.coalesce(F.col("value") > F.col("_hi"), F.lit(False))).drop("_lo", "_hi")


def with_previous(df: DataFrame) -> DataFrame:
    """_p: value and water_year of the previous row of (product, sensor, role) in time, then source, order, in cumulative series. Rows of other series stay where they are."""
    order = F.struct(F.col("stamp").isNull().alias("none"), "stamp", "row_no", "member", *(["position"] if "position" in df.columns else []))
    part = F.coalesce(by_hours(F.col("stamp")), F.lit(2**31) + F.floor(F.col("row_no") / PART_ROWS))  # unparsed stamps come last, in source order
    gone = F.coalesce("is_cumulative", F.lit(False))
    before = lag_in_parts(df.where(gone), ["product", "sensor", "role"], part, order, F.struct("value", "water_year"), "_p")
    return before.unionByName(df.where(~gone), allowMissingColumns=True)


def change_flags(df: DataFrame) -> DataFrame:
    """Changes since the previous row, of rows with_previous."""
    df = df.withColumns({f: F.lit(False) for f in ("flag_documented_change_boundary", "flag_documented_maintenance_or_outage") if f not in df.columns})
    gone, wy = F.coalesce("is_cumulative", F.lit(False)), F.col("_p.water_year")
    df = df.withColumns({"value_change": F.when(gone, F.col("value") - F.col("_p.value")), "flag_water_year_boundary": F.coalesce(gone & (wy != F.col("water_year")), F.lit(False))}).drop("_p")
    boundary, negative = F.col("flag_water_year_boundary"), F.coalesce(F.col("value_change") < 0, F.lit(False))
    return df.withColumns({
        "flag_water_year_reset": boundary & negative,
        "flag_negative_increment": negative,
        "flag_unexplained_negative_increment": negative & ~(boundary | _on("flag_documented_change_boundary") | _on("flag_documented_maintenance_or_outage") | _on("flag_gap_before")),
    })


def cumulative_flags(df: DataFrame) -> DataFrame:
    return df.transform(with_previous).transform(change_flags)


def level_eligibility(df: DataFrame) -> DataFrame:
    """eligible: stamp and value present, no fatal flag, inside a segment. Range concern is kept aside, not fatal."""
    fatal = [f for f in FATAL if f in df.columns]
    clean = reduce(lambda a, b: a & b, [~_on(f) for f in fatal], F.col("stamp").isNotNull() & F.col("value").isNotNull())
    if "segment" in df.columns:
        clean &= F.coalesce(F.col("segment") != OUTSIDE, F.lit(True))
    concern = _on("flag_metadata_range_concern") if "flag_metadata_range_concern" in df.columns else F.lit(False)
    return df.withColumn("eligible", clean).withColumn("retains_range_concern", F.col("eligible") & concern)


def archive_profile(df: DataFrame, more: bool = False) -> DataFrame:
    """Per member: other rules than time_flags. The previous stamp is the last parsed one, and duplicates are repeats only. more: also parse failures,
    irregular steps, missing intervals, and the first and last stamp_text."""
    parsed = lag_in_parts(df.where("stamp is not null"), ["member"], F.floor(F.col("row_no") / PART_ROWS), "row_no", F.col("stamp"), "_p")
    df = parsed.withColumn("_d", minutes_between(F.col("_p"), F.col("stamp"))).unionByName(df.where("stamp is null"), allowMissingColumns=True)
    e = F.col("expected_min")
    others = [] if not more else [
        (F.count("*") - F.count("stamp")).alias("n_parse_failures"), F.count_if(F.col("_d") != e).alias("n_irregular"),
        F.coalesce(F.sum(F.when(F.col("_d") > e, F.greatest(F.floor(F.col("_d") / e) - 1, F.lit(0)))), F.lit(0)).cast("bigint").alias("n_missing_intervals"),
        F.min_by("stamp_text", "row_no").alias("first_text"), F.max_by("stamp_text", "row_no").alias("last_text")]
    return df.groupBy("member").agg(
        *others,
        F.count("*").alias("n_rows"), F.count("stamp").alias("n_parsed"),
        (F.count("stamp") - F.count_distinct("stamp")).alias("n_repeated"),
        F.count_if(F.col("_d") < 0).alias("n_out_of_order"), F.count_if(F.col("_d") > e).alias("n_gaps"),
        F.count_if((F.col("_d") > 0) & (F.pmod(F.col("_d"), e) != 0)).alias("n_off_grid"),
        F.min("stamp").alias("first_stamp"), F.max("stamp").alias("last_stamp"),
        F.array_join(F.sort_array(F.collect_set(F.date_format("stamp", "mm"))), ";").alias("minute_phases"))


def flagged(df: DataFrame) -> DataFrame:
    """The whole chain without regime tables; order matters, as cumulative flags read the others."""
    return df.transform(time_flags).transform(cross_member_duplicates).transform(value_flags).transform(cumulative_flags)
