"""Instrument regimes: as-of segments, half-open intervals, operating dates. Dimensions are small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality import OUTSIDE


def segment_bounds(starts: DataFrame) -> DataFrame:
    """starts(sensor, segment, start): each segment with the next one's start, half open."""
    return starts.withColumn("stop", F.lead("start").over(Window.partitionBy("sensor").orderBy("start")))


def assign_segments(obs: DataFrame, starts: DataFrame, operating: DataFrame | None = None, when: str = "stamp") -> DataFrame:
    """The segment whose start is the latest at or before the row's time. Before the first start, or outside
    operating(sensor, first_day, last_day inclusive), a row is outside documented operation."""
    b = segment_bounds(starts).select(F.col("sensor").alias("_s"), F.col("segment"), F.col("start").alias("_a"), F.col("stop").alias("_b"))
    out = obs.join(b, (obs["sensor"] == b["_s"]) & (obs[when] >= b["_a"]) & (b["_b"].isNull() | (obs[when] < b["_b"])), "left").drop("_s", "_a", "_b")
    segment = F.coalesce("segment", F.lit(OUTSIDE))
    if operating is not None:
        o = operating.select("sensor", F.col("first_day").alias("_f"), F.col("last_day").alias("_l"))
        out = out.join(o, "sensor", "left")
        day = F.to_date(F.col(when))
        gone = F.coalesce(day < F.col("_f"), F.lit(False)) | F.coalesce(day >= F.date_add("_l", 1), F.lit(False))
        segment = F.when(gone, OUTSIDE).otherwise(segment)
    return out.withColumn("segment", segment).drop("_f", "_l")


def change_boundaries(obs: DataFrame, starts: DataFrame, when: str = "stamp") -> DataFrame:
    """Flag rows on a segment's first date; its reason replaces any earlier event text."""
    s = starts.select("sensor", F.to_date("start").alias("_day"), F.col("segment").alias("_reason")).groupBy("sensor", "_day").agg(F.max("_reason").alias("_reason"))
    out = obs.withColumn("_day", F.to_date(when)).join(s, ["sensor", "_day"], "left")
    return out.withColumns({"flag_documented_change_boundary": F.col("_reason").isNotNull(), "event_text": F.coalesce("_reason", F.lit("none"))}).drop("_day", "_reason")


def interval_events(obs: DataFrame, intervals: DataFrame, key: list[str], when: str = "stamp") -> DataFrame:
    """intervals(sensor, name, start, stop, position): rows inside any half-open interval are flagged, and the names are appended in declared order."""
    i = intervals.select(F.col("sensor").alias("_s"), "name", F.col("start").alias("_a"), F.col("stop").alias("_b"), "position")
    found = (obs.select(*key, "sensor", when).join(i, (F.col("sensor") == F.col("_s")) & (F.col(when) >= F.col("_a")) & (F.col(when) < F.col("_b")))
             .groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]).alias("_names")))
    out = obs.join(found, key, "left")
    base = F.col("event_text") if "event_text" in obs.columns else F.lit("none")
    text = F.when(F.col("_names").isNull(), base).otherwise(F.array_join(F.concat(F.when(base == "none", F.array().cast("array<string>")).otherwise(F.array(base)), F.col("_names")), ";"))
    return out.withColumns({"flag_documented_maintenance_or_outage": F.col("_names").isNotNull(), "event_text": text}).drop("_names")


def nearest_context(points: DataFrame, contexts: DataFrame, tolerance_days: int = 7) -> DataFrame:
    """points(point) and contexts(context, day, position): the nearest context in days within the tolerance, the first
    declared winning ties. An equi-join on the days around each point, so nothing is crossed."""
    around = points.select("point", F.explode(F.sequence(F.date_sub("point", tolerance_days), F.date_add("point", tolerance_days))).alias("day")).distinct()
    best = around.join(contexts, "day").groupBy("point").agg(F.min_by(F.struct("context", "day"), F.struct(F.abs(F.datediff("day", "point")), "position")).alias("c"))
    return points.join(best, "point", "left").select(*points.columns, F.col("c.context").alias("context"), F.datediff("point", F.col("c.day")).alias("offset_days"))
