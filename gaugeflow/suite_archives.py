"""Queries over archives that are written from the driver's tables and read back through the archive source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import ingest
from .sources import monitoring
from .sources.scratch import scratch_folder
from .suite import query, table

SENSORS, RAIN, EXTENSOMETERS = ["R1", "E2", "P3", "P4"], ["R1"], ["E2"]
NAMED = {"flag_topple": "topple"}
_HEADER = "date_time_PST,rain_R1,rain_R1,disp_E2,press_P3,press_P4,other_X9"
_OPERATING = "(VALUES ('R1', NULL, NULL), ('E2', DATE '2024-01-03', DATE '2024-01-25'), ('P3', NULL, NULL), ('P4', DATE '2024-01-02', NULL)) AS t(sensor, first_day, last_day)"
_STARTS = """(VALUES ('R1', 'r1', TIMESTAMP '1990-10-01 00:00:00', 'installed'), ('E2', 'e1', TIMESTAMP '2024-01-01 00:00:00', 'installed'), ('E2', 'e2', TIMESTAMP '2024-01-15 12:00:00', 'moved'),
 ('P3', 'p1', TIMESTAMP '2024-01-04 00:00:00', 'installed')) AS t(sensor, segment, start, reason)"""
_INTERVALS = """(VALUES ('P3', 'cleaning', TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-07 00:00:00', 2), ('P3', 'outage', TIMESTAMP '2024-01-04 00:00:00', TIMESTAMP '2024-01-08 00:00:00', 1),
 ('E2', 'topple', TIMESTAMP '2024-01-10 00:00:00', TIMESTAMP '2024-01-11 00:00:00', 1)) AS t(sensor, name, start, stop, position)"""
_RANGES = "(VALUES ('P3', 10.0, 90.0), ('E2', NULL, 50.0)) AS t(sensor, lo, hi)"


def archive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as 15-minute archives, one a station with two members, and orders by day as a daily one: (archive, member, line_no, line), where
    line_no ascends within a member, lowest in its first four lines."""
    e, r = table(spark, sf_dir, "events"), F.col("event_id") % 41
    kind = F.col("event_type")
    text = (F.when(r == 3, "").when(r == 5, "NaN").when(r == 7, "x1").when(r == 11, "-9999").when(r == 13, " 1e2 ").when(r == 17, "1d")
            .otherwise(F.get_json_object("props", "$.k")))
    of = lambda name, value: F.coalesce(F.when(kind == name, value), F.lit(""))
    stamp = F.when(F.col("event_id") % 97 == 0, "bad").otherwise(F.date_format("ts", "M/d/yyyy H:mm"))
    station = F.element_at(F.array(*map(F.lit, ("middle", "toe", "upper"))), (F.col("user_id") % 3 + 1).cast("int"))
    fine = e.select(
        F.concat(F.lit("events_"), station, F.lit("_15_minute.zip")).alias("archive"),
        F.concat(F.lit("Station_"), station, F.lit("_WY2024_"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b"), F.lit(".csv")).alias("member"), F.col("event_id").alias("_order"),
        F.concat_ws(",", stamp, of("purchase", text), of("purchase", (F.col("event_id") % 500).cast("string")), of("view", text), of("click", text), of("error", text), F.lit("x")).alias("line"))
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.floor(F.sum("o_totalprice")).cast("string").alias("v"), F.count("*").cast("string").alias("n"))
    daily = days.select(F.lit("orders_daily.zip").alias("archive"), F.lit("Station_toe_all.csv").alias("member"), F.datediff("day", F.lit("1970-01-01").cast("date")).cast("bigint").alias("_order"),
                        F.concat_ws(",", F.date_format("day", "M/d/yyyy"), "n", "v").alias("line"))
    rows = fine.unionByName(daily)
    place = F.coalesce("_order", F.lit(2**63 - 1))
    header = F.when(F.col("archive") == "orders_daily.zip", "date,rain_R1,press_P3").otherwise(_HEADER)
    top = rows.select("archive", "member").distinct().select("archive", "member", F.posexplode(F.array(F.lit("﻿A network"), F.lit("no warranty"), F.lit("made from events"), header)).alias("at", "line"))
    return rows.select("archive", "member", place.alias("line_no"), "line").unionByName(top.select("archive", "member", (F.col("at") + F.lit(-(2**63))).cast("bigint").alias("line_no"), "line"))


def archives(spark: SparkSession, sf_dir: str) -> str:
    folder = scratch_folder(spark, "archives")
    monitoring.write_archives(archive_lines(spark, sf_dir), folder)
    return folder


def regimes(spark: SparkSession) -> DataFrame:
    """The sensors' documented regimes."""
    of = lambda columns, values: spark.sql(f"SELECT {columns} FROM {values}")
    return ingest.regime_table(
        of("sensor, CAST(first_day AS DATE) first_day, CAST(last_day AS DATE) last_day", _OPERATING), of("sensor, segment, CAST(start AS TIMESTAMP_NTZ) start, reason", _STARTS),
        of("sensor, name, CAST(start AS TIMESTAMP_NTZ) start, CAST(stop AS TIMESTAMP_NTZ) stop, position", _INTERVALS), of("sensor, CAST(lo AS DOUBLE) lo, CAST(hi AS DOUBLE) hi", _RANGES))


_SOURCE = """ev AS (
  SELECT event_id, event_type AS kind, ['middle', 'toe', 'upper'][user_id % 3 + 1] AS station, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS half,
    CASE WHEN event_id % 97 = 0 THEN 'bad' ELSE strftime(ts, '%-m/%-d/%Y %-H:%M') END AS stamp_text, CASE WHEN event_id % 97 <> 0 THEN date_trunc('minute', ts) END AS stamp,
    CASE event_id % 41 WHEN 3 THEN '' WHEN 5 THEN 'NaN' WHEN 7 THEN 'x1' WHEN 11 THEN '-9999' WHEN 13 THEN ' 1e2 ' WHEN 17 THEN '1d' ELSE props->>'$.k' END AS txt FROM events),
days AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(CAST(floor(sum(o_totalprice)) AS BIGINT) AS VARCHAR) AS v, CAST(count(*) AS VARCHAR) AS n FROM orders GROUP BY 1),
src AS (
  SELECT 'events_' || station || '_15_minute.zip' AS archive, 'events_' || station || '_15_minute.zip/Station_' || station || '_WY2024_' || half || '.csv' AS member, station, '15_minute' AS product, 15.0::DOUBLE AS e, event_id AS ord,
    stamp_text, stamp, kind, txt, CAST(event_id % 500 AS VARCHAR) AS total, NULL AS v, NULL AS n FROM ev
  UNION ALL SELECT 'orders_daily.zip', 'orders_daily.zip/Station_toe_all.csv', 'toe', 'daily', 1440.0, day - DATE '1970-01-01', strftime(day, '%-m/%-d/%Y'), CAST(day AS TIMESTAMP), NULL, NULL, NULL, v, n FROM days),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY ord) + 4 AS row_no FROM src)"""
_READ = f"""WITH {_SOURCE},
stepped AS (
  SELECT *, date_diff('microsecond', lag(stamp) OVER (PARTITION BY member ORDER BY row_no), stamp) / 60000000.0 AS d,
    stamp IS NOT NULL AND count(*) OVER (PARTITION BY member, stamp) > 1 AS dup_in FROM rows_),
cols(product, position, sensor, ordinal, role, wanted) AS (VALUES
  ('15_minute', 2, 'R1', 1, 'interval_precipitation', 'purchase'), ('15_minute', 3, 'R1', 2, 'cumulative_precipitation', 'purchase'), ('15_minute', 4, 'E2', 1, '15_minute_observation', 'view'),
  ('15_minute', 5, 'P3', 1, '15_minute_observation', 'click'), ('15_minute', 6, 'P4', 1, '15_minute_observation', 'error'),
  ('daily', 2, 'R1', 1, 'daily_rainfall_maximum', 'n'), ('daily', 3, 'P3', 1, 'daily_median', 'v')),
long AS (
  SELECT s.*, position, sensor, ordinal, role, CASE WHEN wanted = 'n' THEN n WHEN wanted = 'v' THEN v WHEN kind <> wanted THEN '' WHEN position = 3 THEN total ELSE txt END AS value_text,
    role IN ('cumulative_precipitation', 'daily_rainfall_maximum') OR sensor = 'E2' AS grows FROM stepped s JOIN cols USING (product)),
val AS (
  SELECT *, CASE WHEN regexp_full_match(lower(trim(value_text)), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN CAST(trim(value_text) AS DOUBLE) END AS value,
    stamp IS NOT NULL AND count(*) OVER (PARTITION BY product, sensor, role, stamp) > 1 AS dup, year(stamp) + CAST(month(stamp) >= 10 AS INT) AS wy FROM long),
op AS (SELECT * FROM {_OPERATING}), st AS (SELECT * FROM {_STARTS}), iv AS (SELECT * FROM {_INTERVALS}), rg AS (SELECT * FROM {_RANGES}),
regime AS (
  SELECT val.*, CASE WHEN coalesce(CAST(stamp AS DATE) < first_day, false) OR coalesce(CAST(stamp AS DATE) > last_day, false) THEN 'outside_documented_operation'
      ELSE coalesce((SELECT arg_max(segment, start) FROM st WHERE st.sensor = val.sensor AND start <= stamp), 'outside_documented_operation') END AS segment,
    (SELECT arg_max(reason, start) FROM st WHERE st.sensor = val.sensor AND CAST(start AS DATE) = CAST(stamp AS DATE)) AS reason,
    (SELECT string_agg(name, ';' ORDER BY position) FROM iv WHERE iv.sensor = val.sensor AND stamp >= start AND stamp < stop) AS names,
    coalesce(value < lo, false) OR coalesce(value > hi, false) AS concern
  FROM val JOIN op USING (sensor) LEFT JOIN rg USING (sensor)),
grown AS (SELECT *, lag(value) OVER w AS v1, lag(wy) OVER w AS wy1 FROM regime WINDOW w AS (PARTITION BY product, sensor, role ORDER BY stamp IS NULL, stamp, row_no, member, position))"""


@query(f"""{_READ} SELECT archive, product, station, member, row_no, stamp_text, position, sensor, ordinal, role, value, strftime(stamp + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS utc, wy AS water_year, round(d, 6) AS delta_min,
  CAST(CASE WHEN d > e THEN greatest(floor(d / e) - 1, 0) ELSE 0 END AS BIGINT) AS missing_before, stamp IS NULL AS flag_timestamp_parse_failure, dup_in AS flag_duplicate_timestamp_in_member, dup AS flag_duplicate_timestamp,
  coalesce(d > 0 AND d % e <> 0, false) AS flag_off_grid_timestamp, coalesce(d <> e, false) AS flag_irregular_timestamp_step, coalesce(d > e, false) AS flag_gap_before, coalesce(d < 0, false) AS flag_out_of_order_timestamp,
  trim(value_text) = '' AS flag_missing_value, lower(trim(value_text)) = 'nan' AS flag_nonfinite_value, trim(value_text) <> '' AND value IS NULL AND lower(trim(value_text)) <> 'nan' AS flag_malformed_value,
  coalesce(value IN (-9999, -999, -99.99, 999, 9999), false) AS flag_sentinel_candidate, concern AS flag_metadata_range_concern, segment, reason IS NOT NULL AS flag_documented_change_boundary,
  names IS NOT NULL AS flag_documented_maintenance_or_outage, coalesce(names LIKE '%topple%', false) AS flag_topple, concat_ws(';', reason, names) AS event_text, CASE WHEN grows THEN value - v1 END AS value_change,
  coalesce(grows AND wy <> wy1, false) AS flag_water_year_boundary, coalesce(grows AND wy <> wy1 AND value < v1, false) AS flag_water_year_reset, coalesce(grows AND value < v1, false) AS flag_negative_increment,
  coalesce(grows AND value < v1, false) AND NOT (coalesce(wy <> wy1, false) OR reason IS NOT NULL OR names IS NOT NULL OR coalesce(d > e, false)) AS flag_unexplained_negative_increment FROM grown""")
def so_archive_flags(spark, sf_dir):
    """The whole reader over the archives: roles, ordinals, regimes and every flag of each field of each source row."""
    found = ingest.monitoring_observations(spark, archives(spark, sf_dir), SENSORS, regimes(spark), RAIN, EXTENSOMETERS, NAMED)
    flags = [c for c in found.columns if c.startswith("flag_")]
    return found.select("archive", "product", "station", "member", "row_no", "stamp_text", "position", "sensor", "ordinal", "role", "value", F.date_format("stamp_utc", "yyyy-MM-dd HH:mm").alias("utc"),
                        "water_year", F.round("delta_min", 6).alias("delta_min"), "missing_before", "segment", "event_text", "value_change", *flags)


@query(f"""WITH {_SOURCE},
gone AS (SELECT *, date_diff('microsecond', last_value(stamp IGNORE NULLS) OVER (PARTITION BY member ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), stamp) / 60000000.0 AS d FROM rows_)
SELECT archive, member, any_value(product) AS product, any_value(station) AS station, CASE WHEN archive LIKE 'events%' THEN '2024' ELSE 'not_applicable' END AS water_year_label, 'made from events' AS preamble,
  CASE WHEN archive LIKE 'events%' THEN 'date_time_PST' ELSE 'date' END AS time_column, CASE WHEN archive LIKE 'events%' THEN 7 ELSE 3 END AS n_columns,
  CASE WHEN archive LIKE 'events%' THEN 'date_time_PST;rain_R1;rain_R1;disp_E2;press_P3;press_P4;other_X9' ELSE 'date;rain_R1;press_P3' END AS columns, count(*) AS n_rows, arg_min(stamp_text, row_no) AS first_text, arg_max(stamp_text, row_no) AS last_text,
  count(*) - count(stamp) AS n_parse_failures, count(stamp) - count(DISTINCT stamp) AS n_repeated, count(*) FILTER (d < 0) AS n_out_of_order, count(*) FILTER (d <> e) AS n_irregular, count(*) FILTER (d > 0 AND d % e <> 0) AS n_off_grid,
  count(*) FILTER (d > e) AS n_gaps, CAST(coalesce(sum(greatest(floor(d / e) - 1, 0)) FILTER (d > e), 0) AS BIGINT) AS n_missing_intervals,
  coalesce((SELECT string_agg(m, ';' ORDER BY m) FROM (SELECT DISTINCT strftime(x.stamp, '%M') AS m FROM rows_ x WHERE x.member = gone.member AND x.stamp IS NOT NULL)), '') AS minute_phases
FROM gone GROUP BY archive, member""")
def so_member_profiles(spark, sf_dir):
    """What can be told of each member by SQL over the rows it was written from; sizes and digests are held by tests."""
    p = ingest.member_profiles(spark, archives(spark, sf_dir))
    return p.select("archive", "member", "product", "station", "water_year_label", "preamble", "time_column", "n_columns", F.array_join("columns", ";").alias("columns"), "n_rows", "first_text", "last_text",
                    "n_parse_failures", "n_repeated", "n_out_of_order", "n_irregular", "n_off_grid", "n_gaps", "n_missing_intervals", "minute_phases")
