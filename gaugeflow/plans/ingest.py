"""Monitoring archives to flagged long observations: the whole reader, and profiles of archive members.

Flags of time are found on source rows, before fields are unfolded; regimes (segments, operating days, documented intervals, ranges) are one row a sensor,
so that one small join brings them all and no row meets more of them than its sensor has. Nothing is dropped, clipped or filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import is_cumulative, measurement_role, parse_stamp, to_utc
from ..operators import quality
from ..operators.parts import joined
from ..sources import monitoring
from ..sources.scratch import kept

#: How stamps of a product are written, and the minutes between them.
STYLE = {"15_minute": "M/d/yyyy H:mm", "daily": "M/d/yyyy"}
EXPECTED = {"15_minute": 15.0, "daily": 1440.0}


def regime_table(operating: DataFrame, starts: DataFrame | None = None, intervals: DataFrame | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """One row a sensor of operating(sensor, first_day, last_day), with its segments starts(sensor, segment, start, reason) by start, its
    intervals(sensor, name, start, stop, position) in declared order, and its ranges(sensor, lo, hi)."""
    out = operating.select("sensor", "first_day", "last_day")
    if starts is not None:
        s = F.array_sort(F.collect_list(F.struct("start", "segment", "reason"))).alias("segments")
        out = out.join(starts.groupBy("sensor").agg(s), "sensor", "left")
    if intervals is not None:
        s = F.array_sort(F.collect_list(F.struct("position", "start", "stop", "name"))).alias("intervals")
        out = out.join(intervals.groupBy("sensor").agg(s), "sensor", "left")
    return out if ranges is None else out.join(ranges.select("sensor", "lo", "hi"), "sensor", "left")


def _last(found: Column, field: str) -> Column:
    return F.try_element_at(found, F.lit(-1))[field]


def with_regimes(obs: DataFrame, regimes: DataFrame, named: dict[str, str] | None = None) -> DataFrame:
    """segment, event_text and the documented flags. The segment is the last to have started; before all and outside operating days (last day included)
    there is none. On a segment's first date its reason is the event text, and the names of intervals that hold the stamp are appended. named: flags of single intervals."""
    out = obs.join(regimes, "sensor", "left")
    stamp, day = F.col("stamp"), F.to_date("stamp")
    new: dict[str, Column] = {}
    segment, reason, names = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    if "segments" in regimes.columns:
        segment = _last(F.filter("segments", lambda s: s["start"] <= stamp), "segment")
        reason = _last(F.filter("segments", lambda s: F.to_date(s["start"]) == day), "reason")
    if "intervals" in regimes.columns:
        names = F.transform(F.filter("intervals", lambda i: (i["start"] <= stamp) & (stamp < i["stop"])), lambda i: i["name"])
    out = out.withColumns({"_segment": segment, "_reason": reason, "_names": names})  # found once, read several times below
    reason, names = F.col("_reason"), F.col("_names")
    outside = F.coalesce(day < F.col("first_day"), F.lit(False)) | F.coalesce(day > F.col("last_day"), F.lit(False))
    new["segment"] = F.when(outside, quality.OUTSIDE).otherwise(F.coalesce("_segment", F.lit(quality.OUTSIDE)))
    new["flag_documented_change_boundary"] = reason.isNotNull()
    new["flag_documented_maintenance_or_outage"] = F.coalesce(F.size(names) > 0, F.lit(False))
    new["event_text"] = F.array_join(F.concat(F.when(reason.isNull(), F.array().cast("array<string>")).otherwise(F.array(reason)), F.coalesce(names, F.array().cast("array<string>"))), ";")
    for flag, name in (named or {}).items():
        new[flag] = F.coalesce(F.array_contains(names, name), F.lit(False))
    if "lo" in regimes.columns:
        new["flag_metadata_range_concern"] = F.coalesce(F.col("value") < F.col("lo"), F.lit(False)) | F.coalesce(F.col("value") > F.col("hi"), F.lit(False))
    return out.withColumns(new).drop("first_day", "last_day", "segments", "intervals", "lo", "hi", "_segment", "_reason", "_names")


def by_product(product: Column, of: dict[str, Column]) -> Column:
    first, *rest = of.items()
    out = F.when(product == first[0], first[1])
    for name, value in rest:
        out = out.when(product == name, value)
    return out


def stamped(rows: DataFrame) -> DataFrame:
    """Source rows with their stamp (fixed local time, null where the text is none of its product) and the minutes expected between them."""
    product = F.col("product")
    return rows.withColumns({
        "stamp": by_product(product, {p: parse_stamp(F.col("stamp_text"), s) for p, s in STYLE.items()}),
        "expected_min": by_product(product, {p: F.lit(m) for p, m in EXPECTED.items()})})


def member_fields(rows: DataFrame, rain: list[str] = (), extensometers: list[str] = ()) -> DataFrame:
    """The fields of each member with what they measure, as its first row has them; all its rows have the same."""
    out = rows.where(F.col("row_no") == monitoring.FIRST_ROW).select("member", "product", F.posexplode("fields").alias("_at", "_f")).select("member", "product", "_at", "_f.*").drop("value_text")
    out = out.withColumn("role", measurement_role(F.col("product"), F.col("sensor"), F.col("ordinal"), list(rain)))
    return out.withColumn("is_cumulative", is_cumulative(F.col("role"), F.col("sensor"), list(extensometers))).drop("product")


def with_repeats(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """_again: the (sensor, role) that the rows of the product with the row's stamp hold more than once between them, counted before fields are unfolded;
    rows without a stamp have none."""
    counts = rows.where("stamp is not null").groupBy("product", "stamp", "member").agg(F.count("*").alias("_n"))
    kinds = counts.join(F.broadcast(fields.select("member", F.struct("sensor", "role").alias("_kind"))), "member").groupBy("product", "stamp", "_kind").agg(F.sum("_n").alias("_n"))
    again = kinds.where("_n > 1").groupBy("product", "stamp").agg(F.collect_list("_kind").alias("_again"), F.lit(None).cast("bigint").alias("_none"))
    rows = rows.withColumn("_none", F.when(F.col("stamp").isNull(), F.col("row_no")))  # deals out the rows without a stamp
    return joined(rows, again, ["product", "stamp", "_none"]).drop("_none")


def monitoring_observations(spark: SparkSession, path: str, sensors: list[str], regimes: DataFrame, rain: list[str] = (), extensometers: list[str] = (),
                            named: dict[str, str] | None = None, range_bytes: int = monitoring.RANGE_BYTES) -> DataFrame:
    """The observations of the sensors in an archive or a folder of archives, one row a source row and field, with provenance and all flags. rain: sensors
    whose column may stand twice (interval, then cumulative). A sensor without a row in regimes is an error. Source rows are read once and written, and again with their flags
    of time; of the unfolded ones only those of cumulative series move."""
    known = {r.sensor for r in regimes.select("sensor").where(F.col("sensor").isin(*sensors)).distinct().collect()}
    if unknown := sorted(set(sensors) - known):
        raise ValueError(f"no operating days of sensors {unknown}")
    rows = monitoring.read_rows(spark, path, sensors, rain, range_bytes)
    rows = kept(stamped(rows.withColumn("member", F.concat_ws("/", "archive", "member"))), "archive_rows")
    fields = member_fields(rows, rain, extensometers)
    rows = rows.withColumn("_values", F.col("fields.value_text")).drop("fields")
    rows = kept(with_repeats(rows.transform(quality.time_flags), fields), "archive_flags")
    long = rows.withColumn("stamp_utc", to_utc(F.col("stamp"))).join(F.broadcast(fields), "member").withColumns({
        "value_text": F.get("_values", F.col("_at")),
        "flag_duplicate_timestamp": F.coalesce(F.array_contains("_again", F.struct("sensor", "role")), F.lit(False))}).drop("_values", "_again", "_at")
    known_before = long.transform(quality.value_flags).transform(quality.with_previous)
    return with_regimes(known_before, regimes, named).transform(quality.change_flags)


def member_profiles(spark: SparkSession, path: str, range_bytes: int = monitoring.RANGE_BYTES) -> DataFrame:
    """One row a member: what its archive's directory says, its header, and counts over its rows, whose reading holds its CRC-32."""
    about = monitoring.members(spark, path)
    rows = kept(stamped(monitoring.read_rows(spark, path, [], [], range_bytes, every=True).withColumn("member", F.concat_ws("/", "archive", "member"))), "archive_rows")
    counts = quality.archive_profile(rows, more=True)
    none, zero = F.lit("not_available"), F.lit(0).cast("bigint")
    out = about.withColumn("member", F.concat_ws("/", "archive", "member")).join(counts, "member", "left")
    return out.withColumn("n_columns", F.size("columns")).withColumns({
        **{c: F.coalesce(c, none) for c in ("first_text", "last_text")}, "minute_phases": F.coalesce("minute_phases", F.lit("")),
        **{c: F.coalesce(c, zero) for c in counts.columns if c.startswith("n_")}})
