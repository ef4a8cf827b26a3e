"""The library's operators on the driver's tables, each with the SQL that DuckDB runs for the same rows.

Sensors are event types (irregular observations) and order priorities (daily levels); orders and line items by date give
a daily predictor and response.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import align, coverage, lags, quality, regimes, series
from .plans import changepoints, contracts, exploratory, forecast, rolling, synthesis

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- inputs -------------------------------------------------------------------------------------

def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations: stamps to the minute, every 15 expected; the JSON number as text, some texts made blank,
    non-finite, malformed or sentinel."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    r = F.col("event_id") % 41
    text = F.when(r == 3, "").when(r == 5, "NaN").when(r == 7, "x1").when(r == 11, "-9999").when(r == 13, " 1e2 ").when(r == 17, "1d").otherwise(k)
    return e.select(
        F.col("event_type").alias("member"), F.col("event_id").alias("row_no"), F.lit("15_minute").alias("product"), F.col("event_type").alias("sensor"), F.lit("observation").alias("role"),
        F.date_trunc("minute", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz").alias("stamp"), text.alias("value_text"), F.lit(15.0).alias("expected_min"),
        (F.col("event_type") == "purchase").alias("is_cumulative"))


_OBS = """obs AS (SELECT event_type AS member, event_id AS row_no, event_type AS sensor, date_trunc('minute', ts) AS stamp,
 CASE event_id % 41 WHEN 3 THEN '' WHEN 5 THEN 'NaN' WHEN 7 THEN 'x1' WHEN 11 THEN '-9999' WHEN 13 THEN ' 1e2 ' WHEN 17 THEN '1d' ELSE props->>'$.k' END AS value_text,
 15.0::DOUBLE AS e, event_type = 'purchase' AS is_cumulative FROM events)"""
_STEP = """step AS (SELECT *, date_diff('microsecond', lag(stamp) OVER (PARTITION BY member ORDER BY row_no), stamp) / 60000000.0 AS d FROM obs)"""
_VALUE = """val AS (SELECT *, CASE WHEN regexp_full_match(lower(trim(value_text)), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN CAST(trim(value_text) AS DOUBLE) END AS value,
 lower(trim(value_text)) IN ('nan','+nan','-nan','inf','+inf','-inf','infinity') AS bad FROM step)"""
_FLAGS = f"""WITH {_OBS}, {_STEP}, {_VALUE}, flagged AS (SELECT *, coalesce(d > e, false) AS gap,
 stamp IS NOT NULL AND count(*) OVER (PARTITION BY member, stamp) > 1 AS dup, trim(value_text) = '' AS blank,
 trim(value_text) <> '' AND value IS NULL AND NOT bad AS malformed, coalesce(value IN (-9999,-999,-99.99,999,9999), false) AS sentinel,
 CASE WHEN d > e THEN greatest(floor(d / e) - 1, 0) ELSE 0 END::BIGINT AS missing_before FROM val)"""


def daily_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders by priority and day: the day's total as level; years as segments."""
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_orderpriority").alias("sensor"), F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"), F.count("*").alias("n"))
            .withColumns({"segment": F.when(F.col("day") < "1998-01-01", "a").otherwise("b"), "eligible": F.col("value") < 900000}))


_DAILY = """daily AS (SELECT *, CASE WHEN day < DATE '1998-01-01' THEN 'a' ELSE 'b' END AS segment, value < 900000 AS eligible FROM (
 SELECT o_orderpriority AS sensor, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS value, count(*) AS n FROM orders GROUP BY ALL))"""
_WY = "(year({0}) + CAST(month({0}) >= 10 AS INT))"


def predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


def response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))


_PAIR = """p AS (SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1),
 r AS (SELECT CAST(l_shipdate AS DATE) AS day, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1)"""


# -- quality ------------------------------------------------------------------------------------

@query(f"""{_FLAGS} SELECT row_no, member, round(d, 6) AS delta_min, missing_before, stamp IS NULL AS flag_timestamp_parse_failure, dup AS flag_duplicate_timestamp_in_member,
 coalesce(d > 0 AND d % e <> 0, false) AS flag_off_grid_timestamp, coalesce(d <> e, false) AS flag_irregular_timestamp_step, gap AS flag_gap_before, coalesce(d < 0, false) AS flag_out_of_order_timestamp,
 {_WY.format('stamp')} AS water_year FROM flagged""")
def qc_time_flags(spark, sf_dir):
    cols = ["flag_timestamp_parse_failure", "flag_duplicate_timestamp_in_member", "flag_off_grid_timestamp", "flag_irregular_timestamp_step", "flag_gap_before", "flag_out_of_order_timestamp"]
    return quality.time_flags(observations(spark, sf_dir)).select("row_no", "member", F.round("delta_min", 6).alias("delta_min"), "missing_before", *cols, "water_year")


@query(f"""{_FLAGS} SELECT row_no, value, blank AS flag_missing_value, bad AS flag_nonfinite_value, malformed AS flag_malformed_value, sentinel AS flag_sentinel_candidate FROM flagged""")
def qc_value_flags(spark, sf_dir):
    return quality.value_flags(observations(spark, sf_dir)).select("row_no", "value", "flag_missing_value", "flag_nonfinite_value", "flag_malformed_value", "flag_sentinel_candidate")


@query(f"""{_FLAGS}, c AS (SELECT *, lag(value) OVER w AS v1, {_WY.format('stamp')} AS wy, lag({_WY.format('stamp')}) OVER w AS wy1 FROM flagged WINDOW w AS (PARTITION BY sensor ORDER BY stamp NULLS LAST, row_no))
 SELECT row_no, CASE WHEN is_cumulative THEN value - v1 END AS value_change, coalesce(is_cumulative AND wy <> wy1, false) AS flag_water_year_boundary,
 coalesce(is_cumulative AND value < v1, false) AS flag_negative_increment, coalesce(is_cumulative AND wy <> wy1 AND value < v1, false) AS flag_water_year_reset,
 coalesce(is_cumulative AND value < v1, false) AND NOT coalesce(is_cumulative AND wy <> wy1, false) AND NOT gap AS flag_unexplained_negative_increment FROM c""")
def qc_cumulative_flags(spark, sf_dir):
    df = quality.flagged(observations(spark, sf_dir).withColumns({"flag_documented_change_boundary": F.lit(False), "flag_documented_maintenance_or_outage": F.lit(False)}))
    return df.select("row_no", "value_change", "flag_water_year_boundary", "flag_negative_increment", "flag_water_year_reset", "flag_unexplained_negative_increment")


_RANGES = "(VALUES ('click', 10.0, 90.0), ('view', NULL, 50.0), ('error', 5.0, NULL)) AS t(sensor, lo, hi)"


@query(f"""{_FLAGS} SELECT row_no, coalesce(value < lo, false) OR coalesce(value > hi, false) AS flag_metadata_range_concern,
 value IS NOT NULL AND NOT dup AND NOT blank AND NOT bad AND NOT malformed AND NOT sentinel AND NOT coalesce(d < 0, false) AS eligible
 FROM flagged LEFT JOIN {_RANGES} USING (sensor)""")
def qc_range_and_eligibility(spark, sf_dir):
    df = quality.flagged(observations(spark, sf_dir))
    ranges = spark.sql(f"SELECT sensor, CAST(lo AS DOUBLE) lo, CAST(hi AS DOUBLE) hi FROM {_RANGES}")
    return quality.level_eligibility(quality.range_flags(df, ranges)).select("row_no", "flag_metadata_range_concern", "eligible")


@query(f"""WITH {_OBS}, s AS (SELECT *, date_diff('microsecond', last_value(stamp IGNORE NULLS) OVER (PARTITION BY member ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), stamp) / 60000000.0 AS d FROM obs)
 SELECT member, count(*) AS n_rows, count(stamp) AS n_parsed, count(stamp) - count(DISTINCT stamp) AS n_repeated, count(*) FILTER (d < 0) AS n_out_of_order, count(*) FILTER (d > e) AS n_gaps,
 count(*) FILTER (d > 0 AND d % e <> 0) AS n_off_grid, strftime(min(stamp), '%Y-%m-%d %H:%M') AS first_stamp, strftime(max(stamp), '%Y-%m-%d %H:%M') AS last_stamp FROM s GROUP BY member""")
def qc_archive_profile(spark, sf_dir):
    p = quality.archive_profile(observations(spark, sf_dir))
    return p.drop("minute_phases").withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm") for c in ("first_stamp", "last_stamp")})


_STARTS = "(VALUES ('click','c1',TIMESTAMP '2024-01-05 00:00:00'), ('click','c2',TIMESTAMP '2024-01-15 12:00:00'), ('view','v1',TIMESTAMP '2023-12-01 00:00:00'), ('error','e1',TIMESTAMP '2024-01-10 00:00:00')) AS t(sensor, segment, start)"


@query(f"""WITH {_OBS}, st AS (SELECT * FROM {_STARTS}) SELECT row_no, CASE WHEN o.sensor = 'view' AND CAST(o.stamp AS DATE) > DATE '2024-01-20' THEN 'outside_documented_operation' ELSE coalesce(st.segment, 'outside_documented_operation') END AS segment
 FROM obs o ASOF LEFT JOIN st ON o.sensor = st.sensor AND o.stamp >= st.start""")
def qc_segments_asof(spark, sf_dir):
    starts = spark.sql(f"SELECT sensor, segment, CAST(start AS TIMESTAMP_NTZ) start FROM {_STARTS}")
    operating = spark.sql("SELECT 'view' sensor, CAST(NULL AS DATE) first_day, DATE '2024-01-20' last_day")
    return regimes.assign_segments(observations(spark, sf_dir), starts, operating).select("row_no", "segment")


_INTERVALS = "(VALUES ('click','cleaning',TIMESTAMP '2024-01-03 00:00:00',TIMESTAMP '2024-01-06 00:00:00',2), ('click','outage',TIMESTAMP '2024-01-05 00:00:00',TIMESTAMP '2024-01-07 00:00:00',1), ('error','outage',TIMESTAMP '2024-01-20 00:00:00',TIMESTAMP '2024-01-21 00:00:00',1)) AS t(sensor, name, start, stop, position)"


@query(f"""WITH {_OBS} SELECT o.row_no, count(i.name) > 0 AS flag_documented_maintenance_or_outage, coalesce(string_agg(i.name, ';' ORDER BY i.position), 'none') AS event_text
 FROM obs o LEFT JOIN {_INTERVALS.replace('AS t', 'AS i')} ON o.sensor = i.sensor AND o.stamp >= i.start AND o.stamp < i.stop GROUP BY o.row_no""")
def qc_interval_events(spark, sf_dir):
    i = spark.sql(f"SELECT sensor, name, CAST(start AS TIMESTAMP_NTZ) start, CAST(stop AS TIMESTAMP_NTZ) stop, position FROM {_INTERVALS}")
    return regimes.interval_events(observations(spark, sf_dir), i, ["row_no"]).select("row_no", "flag_documented_maintenance_or_outage", "event_text")


# -- coverage -----------------------------------------------------------------------------------

@query(f"""{_FLAGS} SELECT sensor, count(DISTINCT member) AS n_members, count(*) AS n_rows, count(value) AS n_present, count(*) - count(value) AS n_absent, round(100 * avg(CAST(value IS NOT NULL AS INT)), 6) AS pct_present,
 CAST(sum(missing_before) AS BIGINT) AS missing_intervals, count(*) FILTER (gap) AS n_gap_before, count(*) FILTER (blank) AS n_missing_value, count(*) FILTER (malformed) AS n_malformed_value FROM flagged GROUP BY sensor""")
def ag_coverage(spark, sf_dir):
    return coverage.coverage_summary(quality.flagged(observations(spark, sf_dir)), ["sensor"]).select("sensor", "n_members", "n_rows", "n_present", "n_absent", "pct_present", "missing_intervals", "n_gap_before", "n_missing_value", "n_malformed_value")


@query(f"""{_FLAGS}, g AS (SELECT sensor, min(stamp) a, max(stamp) b, count(DISTINCT stamp) n_stamps, count(*) n_rows, count(*) FILTER (blank) n_blank,
 count(*) FILTER (value IS NOT NULL AND NOT dup AND NOT blank AND NOT bad AND NOT malformed AND NOT sentinel AND NOT coalesce(d < 0, false)) n_eligible FROM flagged GROUP BY sensor)
 SELECT sensor, CAST(floor(date_diff('microsecond', a, b) / 60000000.0 / 15) + 1 AS BIGINT) AS n_expected, CAST(greatest(0, floor(date_diff('microsecond', a, b) / 60000000.0 / 15) + 1 - n_stamps) AS BIGINT) AS n_missing_stamps,
 n_rows, n_blank, n_eligible, round(100 * n_eligible / n_rows, 6) AS pct_eligible FROM g""")
def ag_missingness(spark, sf_dir):
    return coverage.missingness_summary(quality.level_eligibility(quality.flagged(observations(spark, sf_dir))), ["sensor"])


@query(f"""WITH {_OBS}, u AS (SELECT DISTINCT sensor, stamp FROM obs), s AS (SELECT sensor, CAST(floor(date_diff('microsecond', lag(stamp) OVER (PARTITION BY sensor ORDER BY stamp), stamp) / 60000000.0 / 15) - 1 AS BIGINT) AS missing FROM u)
 SELECT sensor, missing, count(*) AS n_gaps FROM s WHERE missing > 0 GROUP BY ALL""")
def ag_gap_lengths(spark, sf_dir):
    return coverage.gap_lengths(observations(spark, sf_dir), ["sensor"])


@query(f"""WITH {_DAILY}, q AS (SELECT sensor, segment, count(value) n, avg(value) mean, stddev_samp(value) sd, min(value) lowest, max(value) highest, quantile_cont(value, 0.05) q05, quantile_cont(value, 0.25) q25, quantile_cont(value, 0.5) median,
 quantile_cont(value, 0.75) q75, quantile_cont(value, 0.95) q95 FROM daily GROUP BY ALL), m AS (SELECT sensor, segment, quantile_cont(abs(value - median), 0.5) mad FROM daily JOIN q USING (sensor, segment) GROUP BY ALL)
 SELECT sensor, segment, n, round(mean, 4) mean, round(sd, 4) sd, round(lowest, 4) lowest, round(highest, 4) highest, round(q05, 4) q05, round(q25, 4) q25, round(median, 4) median, round(q75, 4) q75, round(q95, 4) q95, round(q75 - q25, 4) iqr, round(mad, 4) mad FROM q JOIN m USING (sensor, segment)""")
def ag_distribution(spark, sf_dir):
    d = coverage.distribution_summary(daily_levels(spark, sf_dir), ["sensor", "segment"])
    return d.select("sensor", "segment", "n", *[F.round(c, 4).alias(c) for c in ("mean", "sd", "lowest", "highest", "q05", "q25", "median", "q75", "q95", "iqr", "mad")])


@query(f"""WITH {_OBS}, c AS (SELECT * FROM (VALUES ('pair','click'),('pair','view'),('gone','click'),('gone','absent')) t(set_id, sensor)), n AS (SELECT set_id, count(*) size FROM c GROUP BY 1),
 o AS (SELECT DISTINCT set_id, sensor, stamp FROM obs JOIN c USING (sensor)), w AS (SELECT set_id, count(*) k, max(a) s, min(b) e FROM (SELECT set_id, sensor, min(stamp) a, max(stamp) b FROM o GROUP BY ALL) GROUP BY 1),
 x AS (SELECT set_id, count(*) m FROM (SELECT set_id, stamp FROM o JOIN n USING (set_id) GROUP BY set_id, stamp, size HAVING count(*) = size) GROUP BY 1)
 SELECT set_id, k = size AS all_present, coalesce(m, 0) AS n_common, CASE WHEN k < size THEN 'sensor_absent' WHEN coalesce(m, 0) > 0 THEN 'exact_common' WHEN s <= e THEN 'needs_tolerance' ELSE 'no_overlap' END AS alignment
 FROM w JOIN n USING (set_id) LEFT JOIN x USING (set_id)""")
def ag_compatibility(spark, sf_dir):
    c = spark.sql("SELECT * FROM VALUES ('pair','click'),('pair','view'),('gone','click'),('gone','absent') AS t(set_id, sensor)")
    return coverage.compatibility_summary(observations(spark, sf_dir), c).drop("common_start", "common_end")


# -- series -------------------------------------------------------------------------------------

@query(f"""WITH {_DAILY}, c AS (SELECT *, lag(day) OVER w d1, lag(value) OVER w v1, lag(segment) OVER w s1, lag(eligible) OVER w e1 FROM daily WINDOW w AS (PARTITION BY sensor ORDER BY day))
 SELECT sensor, day, round(value - v1, 2) AS value, coalesce(eligible AND e1 AND day - d1 = 1 AND segment = s1 AND {_WY.format('day')} = {_WY.format('d1')}, false) AS eligible FROM c""")
def wn_daily_changes(spark, sf_dir):
    return series.daily_changes(daily_levels(spark, sf_dir), same_water_year=True).select("sensor", "day", F.round("value", 2).alias("value"), "eligible")


_RUNS = f"""WITH {_DAILY}, g AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY sensor, segment ORDER BY day) = 1 THEN 0 ELSE 1 END AS gap FROM daily WHERE eligible),
 n AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY sensor, segment ORDER BY day) AS BIGINT) AS run_no FROM g), s AS (SELECT sensor, segment, run_no, min(day) first_day, max(day) last_day, count(*) n_days FROM n GROUP BY ALL)"""


@query(f"{_RUNS} SELECT * FROM s WHERE n_days >= 3")
def wn_contiguous_runs(spark, sf_dir):
    keys = ["sensor", "segment"]
    return series.run_summary(series.contiguous_runs(daily_levels(spark, sf_dir).where("eligible"), keys, 3), keys)


@query(f"{_RUNS} SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY sensor, segment ORDER BY n_days DESC, 'r' || run_no) = 1")
def wn_longest_runs(spark, sf_dir):
    keys = ["sensor", "segment"]
    return series.longest_runs(series.contiguous_runs(daily_levels(spark, sf_dir).where("eligible"), keys), keys)


@query(f"""{_FLAGS} SELECT sensor, CAST(stamp AS DATE) AS day, sum(CASE WHEN ok THEN value END) AS value, count(*) FILTER (ok) AS coverage_count, round(count(*) FILTER (ok) / 96.0, 6) AS coverage_fraction, count(*) FILTER (ok) >= 20 AS eligible
 FROM (SELECT *, value IS NOT NULL AND NOT dup AND NOT blank AND NOT bad AND NOT malformed AND NOT sentinel AND NOT coalesce(d < 0, false) AS ok FROM flagged) GROUP BY ALL""")
def ag_interval_daily(spark, sf_dir):
    df = quality.level_eligibility(quality.flagged(observations(spark, sf_dir))).withColumn("segment", F.lit("s"))
    return series.interval_daily(df, min_count=20).select("sensor", "day", "value", "coverage_count", F.round("coverage_fraction", 6).alias("coverage_fraction"), "eligible")


_WINDOWS = "(VALUES ('w1', '1-URGENT', DATE '1995-01-01', DATE '1998-06-01', DATE '1996-10-01'), ('w2', '5-LOW', DATE '1995-01-01', DATE '2000-01-01', DATE '1998-01-05')) AS t(window, sensor, start, stop, anchor)"
_GRID = f"""w AS (SELECT * FROM {_WINDOWS.replace('t(window', 't(win')}), grid AS (SELECT w.win, w.sensor, CAST(x.day AS DATE) AS day, CASE WHEN d.eligible THEN d.value END AS value, CASE WHEN d.eligible THEN d.segment END AS segment
 FROM w, LATERAL (SELECT unnest(generate_series(w.start, w.stop - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day) x LEFT JOIN daily d ON d.sensor = w.sensor AND d.day = CAST(x.day AS DATE))"""


def _windows(spark):
    return spark.sql(f"SELECT `window`, sensor, start, stop, anchor FROM {_WINDOWS.replace('t(window', 't(`window`')}")


def _grid(spark, sf_dir):
    return series.calendar_grid(daily_levels(spark, sf_dir), _windows(spark))


@query(f"""WITH {_DAILY}, {_GRID} SELECT win AS "window", count(*) AS n_days, count(value) AS n_values, min(day) AS first_day, max(day) AS last_day, round(sum(value), 1) AS total FROM grid GROUP BY 1""")
def fc_calendar_grid(spark, sf_dir):
    return _grid(spark, sf_dir).groupBy("window").agg(F.count("*").alias("n_days"), F.count("value").alias("n_values"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.round(F.sum("value"), 1).alias("total"))


_ORIGINS = """origins AS (SELECT w.win, CAST(x.o AS DATE) AS origin FROM w, LATERAL (SELECT unnest(generate_series(w.anchor, w.stop - INTERVAL 1 DAY, INTERVAL 14 DAY)) AS o) x)"""


@query(f"""WITH {_DAILY}, w AS (SELECT sensor AS win, min(day) + 400 AS anchor, max(day) + 1 AS stop FROM daily GROUP BY 1), {_ORIGINS} SELECT win AS "window", origin FROM origins""")
def fc_scheduled_origins(spark, sf_dir):
    """Windows that begin 400 days after each sensor's first day and end with its last."""
    ends = daily_levels(spark, sf_dir).groupBy(F.col("sensor").alias("window")).agg(F.date_add(F.min("day"), 400).alias("anchor"), F.date_add(F.max("day"), 1).alias("stop"))
    return series.scheduled_origins(ends.where("anchor < stop"))


_CORE = f"""core AS (SELECT win, day AS origin, coalesce(count(value) OVER f = 2 AND count(segment) OVER f = 2 AND min(segment) OVER f = max(segment) OVER f AND min({_WY.format('day')}) OVER f = max({_WY.format('day')}) OVER f, false) AS core_eligible
 FROM grid WINDOW f AS (PARTITION BY win ORDER BY day ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING))"""


@query(f"""WITH {_DAILY}, {_GRID}, {_ORIGINS}, {_CORE} SELECT win AS "window", origin, core_eligible FROM origins JOIN core USING (win, origin)""")
def fc_core_origins(spark, sf_dir):
    core = series.core_origins(_grid(spark, sf_dir), 1).select("window", F.col("day").alias("origin"), "core_eligible")
    return series.scheduled_origins(_windows(spark)).join(core, ["window", "origin"])


_STATS = f"""stats AS (SELECT o.win, o.origin, count(*) AS training_days, count(g.value) AS training_targets, quantile_cont(g.value, 0.5) AS training_median, quantile_cont(abs(g.value), 0.95) AS high_movement,
 CASE WHEN count(g.step) >= 30 AND avg(g.step) > 0 THEN avg(g.step) END AS mase_scale FROM origins o JOIN (SELECT *, CASE WHEN lag(segment) OVER q = segment AND lag({_WY.format('day')}) OVER q = {_WY.format('day')} THEN abs(value - lag(value) OVER q) END AS step
 FROM grid WINDOW q AS (PARTITION BY win ORDER BY day)) g ON g.win = o.win AND g.day <= o.origin GROUP BY ALL)"""


@query(f"""WITH {_DAILY}, {_GRID}, {_ORIGINS}, {_STATS} SELECT win AS "window", origin, training_days, training_targets, round(training_median, 4) AS training_median, round(high_movement, 4) AS high_movement, round(mase_scale, 4) AS mase_scale FROM stats""")
def fc_training_stats(spark, sf_dir):
    s = forecast.training_stats(_grid(spark, sf_dir), series.scheduled_origins(_windows(spark)))
    return s.select("window", "origin", "training_days", "training_targets", *[F.round(c, 4).alias(c) for c in ("training_median", "high_movement", "mase_scale")])


def _attempts(spark, sf_dir):
    grid, origins = _grid(spark, sf_dir), series.scheduled_origins(_windows(spark))
    core = series.core_origins(grid, 1).select("window", F.col("day").alias("origin"), F.lit(1).alias("horizon"), "core_eligible")
    return forecast.baseline_attempts(grid, origins, core, (1,))


_ATTEMPTS = f"""WITH {_DAILY}, {_GRID}, {_ORIGINS}, {_CORE}, {_STATS}, base AS (SELECT s.*, c.core_eligible, s.origin + 1 AS target_date, t.value AS observed, a.value AS at_origin,
 CASE WHEN month(s.origin + 1) = 2 AND day(s.origin + 1) = 29 THEN NULL ELSE (SELECT x.value FROM grid x WHERE x.win = s.win AND x.day = CAST(s.origin + 1 - INTERVAL 12 MONTH AS DATE)) END AS prior_value
 FROM stats s JOIN core c USING (win, origin) LEFT JOIN grid a ON a.win = s.win AND a.day = s.origin LEFT JOIN grid t ON t.win = s.win AND t.day = s.origin + 1),
 models AS (SELECT *, 'zero_change' AS model, 0.0 AS guess FROM base UNION ALL SELECT *, 'persistence', at_origin FROM base UNION ALL SELECT *, 'expanding_median', training_median FROM base UNION ALL SELECT *, 'prior_year', prior_value FROM base),
 st AS (SELECT *, CASE WHEN NOT core_eligible THEN 'ineligible_core_origin' WHEN training_days < 365 OR training_targets < 300 THEN 'insufficient_training' WHEN guess IS NULL THEN 'feature_unavailable' ELSE 'ok' END AS status FROM models),
 att AS (SELECT *, CASE WHEN status = 'ok' THEN guess END AS prediction, observed - CASE WHEN status = 'ok' THEN guess END AS error FROM st)"""


@query(f"""{_ATTEMPTS} SELECT win AS "window", origin, model, status, round(prediction, 4) AS prediction, round(error, 4) AS error, round(abs(error) / mase_scale, 6) AS scaled_absolute_error, abs(observed) > high_movement AS high,
 CASE WHEN month(target_date) IN (10,11,12,1,2,3,4) THEN 'wet' ELSE 'dry' END AS season FROM att""")
def fc_baseline_attempts(spark, sf_dir):
    return _attempts(spark, sf_dir).select("window", "origin", "model", "status", F.round("prediction", 4).alias("prediction"), F.round("error", 4).alias("error"), F.round("scaled_absolute_error", 6).alias("scaled_absolute_error"), "high", "season")


@query(f"""{_ATTEMPTS} SELECT win AS "window", model, count(*) AS n_attempts, count(*) FILTER (core_eligible) AS n_core, count(*) FILTER (status = 'ok') AS n_ok, round(count(*) FILTER (status = 'ok') / nullif(count(*) FILTER (core_eligible), 0), 8) AS coverage,
 round(avg(abs(error)), 4) AS mae, round(sqrt(avg(error * error)), 4) AS rmse, round(avg(error), 4) AS bias, round(quantile_cont(abs(error), 0.5), 4) AS median_ae, round(quantile_cont(abs(error), 0.95), 4) AS q95_ae FROM att GROUP BY ALL""")
def fc_validation_metrics(spark, sf_dir):
    m = forecast.validation_metrics(_attempts(spark, sf_dir), ["window", "model"])
    return m.select("window", "model", "n_attempts", "n_core", "n_ok", F.round("coverage", 8).alias("coverage"), *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "bias", "median_ae", "q95_ae")])


@query(f"""{_ATTEMPTS}, u AS (SELECT *, 'season' AS dimension, CASE WHEN month(target_date) IN (10,11,12,1,2,3,4) THEN 'wet' ELSE 'dry' END AS level FROM att UNION ALL SELECT *, 'water_year', CAST({_WY.format('target_date')} AS VARCHAR) FROM att)
 SELECT model, dimension, level, count(*) AS n_attempts, count(*) FILTER (status = 'ok') AS n_ok, round(avg(abs(error)), 4) AS mae FROM u GROUP BY ALL""")
def fc_stratified_metrics(spark, sf_dir):
    m = forecast.stratified_metrics(_attempts(spark, sf_dir), ["model"], {"season": F.col("season"), "water_year": S.water_year(F.col("target_date"))})
    return m.select("model", "dimension", "level", "n_attempts", "n_ok", F.round("mae", 4).alias("mae"))


@query(f"""{_ATTEMPTS} SELECT model, status, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY model), 8) AS share FROM att GROUP BY model, status""")
def fc_coverage_failures(spark, sf_dir):
    return forecast.coverage_failures(_attempts(spark, sf_dir), ["model"]).withColumn("share", F.round("share", 8))


@query(f"""{_ATTEMPTS}, cal AS (SELECT h.win, h.model, h.origin, count(*) n, quantile_cont(p.error, 0.1) lo, quantile_cont(p.error, 0.9) hi FROM att h JOIN att p ON p.win = h.win AND p.model = h.model AND p.origin < h.origin AND p.target_date <= h.origin AND p.error IS NOT NULL WHERE h.prediction IS NOT NULL GROUP BY ALL)
 SELECT h.win AS "window", h.model, h.origin, coalesce(n, 0) AS n_calibration, CASE WHEN coalesce(n, 0) >= 30 THEN 'calibrated' ELSE 'insufficient_past_calibration' END AS interval_status,
 CASE WHEN n >= 30 THEN round(h.prediction + lo, 4) END AS lower_80, CASE WHEN n >= 30 THEN round(h.prediction + hi, 4) END AS upper_80 FROM att h LEFT JOIN cal USING (win, model, origin) WHERE h.prediction IS NOT NULL""")
def fc_past_residual_intervals(spark, sf_dir):
    p = forecast.past_residual_intervals(_attempts(spark, sf_dir), ["window", "model"])
    return p.select("window", "model", "origin", "n_calibration", "interval_status", F.round("lower_80", 4).alias("lower_80"), F.round("upper_80", 4).alias("upper_80"))


@query(f"""{_ATTEMPTS} SELECT a.win AS "window", a.model, count(*) AS n_pairs, round(avg(abs(a.error) - abs(z.error)), 4) AS mean_difference FROM att a JOIN att z ON z.win = a.win AND z.origin = a.origin AND z.model = 'zero_change' AND z.error IS NOT NULL WHERE a.model <> 'zero_change' AND a.error IS NOT NULL GROUP BY ALL""")
def fc_paired_comparison(spark, sf_dir):
    return forecast.paired_comparison(_attempts(spark, sf_dir), ["window"]).withColumn("mean_difference", F.round("mean_difference", 4))


@query(f"""{_ATTEMPTS} SELECT model, count(error) AS n, round(avg(error), 4) AS bias, CASE WHEN count(error) >= 3 THEN round(skewness(error), 6) END AS skew, CASE WHEN count(error) >= 4 THEN round(kurtosis(error), 6) END AS kurtosis FROM att GROUP BY model""")
def fc_residual_shape(spark, sf_dir):
    return forecast.residual_shape(_attempts(spark, sf_dir), ["model"]).select("model", "n", F.round("bias", 4).alias("bias"), F.round("skew", 6).alias("skew"), F.round("kurtosis", 6).alias("kurtosis"))


@query(f"""WITH {_DAILY}, {_PAIR}, {_GRID}, {_ORIGINS}, g AS (SELECT grid.*, p.value AS rain FROM grid LEFT JOIN p USING (day)),
equations AS (
  SELECT * FROM (SELECT win, day, value AS y, lag(value) OVER q AS a, lag(rain, 2) OVER q AS b FROM g WINDOW q AS (PARTITION BY win ORDER BY day)) WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
sums AS (
  SELECT o.win, o.origin, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy, var_pop(y) AS yy
  FROM origins o JOIN equations e ON e.win = o.win AND e.day <= o.origin GROUP BY ALL),
fit AS (SELECT *, n >= 240 AND aa * bb - ab * ab > 1e-12 * aa * bb AS fits FROM sums),
coef AS (SELECT *, CASE WHEN fits THEN (ay * bb - byy * ab) / (aa * bb - ab * ab) END AS phi, CASE WHEN fits THEN (byy * aa - ay * ab) / (aa * bb - ab * ab) END AS beta FROM fit),
f AS (
  SELECT c.*, my - phi * ma - beta * mb + phi * g0.value + beta * g1.rain AS one, g0.rain AS r0, n * (yy - phi * ay - beta * byy) / (n - 3) AS v
  FROM coef c JOIN g g0 ON g0.win = c.win AND g0.day = c.origin LEFT JOIN g g1 ON g1.win = c.win AND g1.day = c.origin - 1),
u AS (
  SELECT *, 1 AS horizon, one AS p, v AS variance FROM f UNION ALL SELECT *, 2, my - phi * ma - beta * mb + phi * one + beta * r0, v * (1 + phi * phi) FROM f UNION ALL SELECT *, 7, NULL, NULL FROM f)
SELECT win AS "window", origin, horizon, CASE WHEN horizon = 7 THEN 'feature_unavailable' WHEN n < 240 THEN 'insufficient_training' WHEN NOT fits THEN 'fit_failure' WHEN p IS NULL THEN 'feature_unavailable' ELSE 'ok' END AS status,
 round(p, 1) AS prediction, round(sqrt(variance), 1) AS sd, round(p - 1.2815515655446004 * sqrt(variance), 1) AS lower_80, round(p + 1.959963984540054 * sqrt(variance), 1) AS upper_95 FROM u""")
def fc_arx(spark, sf_dir):
    grid = _grid(spark, sf_dir).join(predictor(spark, sf_dir).withColumnRenamed("value", "rain"), "day", "left")
    f = forecast.arx_forecasts(forecast.arx_coefficients(grid, series.scheduled_origins(_windows(spark))), grid)
    return f.select("window", "origin", "horizon", "status", F.round("prediction", 1).alias("prediction"), F.round(F.sqrt("variance"), 1).alias("sd"), *[F.round(c, 1).alias(c) for c in ("lower_80", "upper_95")])


# -- one rolling run ----------------------------------------------------------------------------

_STAGED = """(VALUES
  ('w1', '1-URGENT', DATE '1994-01-01', DATE '1998-06-01', DATE '1995-10-01', DATE '1997-09-30', CAST(NULL AS DATE)),
  ('w2', '5-LOW', DATE '1994-01-01', DATE '1998-08-01', DATE '1995-03-06', DATE '1997-01-31', CAST(NULL AS DATE)),
  ('x1', '1-URGENT', DATE '1994-01-01', DATE '1998-08-01', DATE '1998-05-10', CAST(NULL AS DATE), DATE '1998-04-20')) AS t({0}, sensor, start, stop, anchor, selection_end, blank_from)"""
_ROLL = f"""WITH {_DAILY}, {_PAIR}, w AS (SELECT * FROM {_STAGED.format('win')}),
grid AS (
  SELECT w.win, w.sensor, CAST(x.day AS DATE) AS day,
    CASE WHEN NOT coalesce(x.day >= w.blank_from AND x.day < w.anchor, false) AND d.eligible THEN d.value END AS value,
    CASE WHEN NOT coalesce(x.day >= w.blank_from AND x.day < w.anchor, false) AND d.eligible THEN d.segment END AS segment,
    CASE WHEN NOT coalesce(x.day >= w.blank_from AND x.day < w.anchor, false) THEN r.value END AS rain
  FROM w, LATERAL (SELECT unnest(generate_series(w.start, w.stop - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day) x
  LEFT JOIN daily d ON d.sensor = w.sensor AND d.day = CAST(x.day AS DATE) LEFT JOIN r ON r.day = CAST(x.day AS DATE)),
origins AS (SELECT w.win, CAST(x.o AS DATE) AS origin FROM w, LATERAL (SELECT unnest(generate_series(w.anchor, w.stop - INTERVAL 1 DAY, INTERVAL 14 DAY)) AS o) x),
hz AS (SELECT unnest([1, 2, 7]) AS horizon),
core AS (
  SELECT o.win, o.origin, h.horizon, count(g.value) = h.horizon + 1 AND count(g.segment) = h.horizon + 1 AND min(g.segment) = max(g.segment)
    AND min({_WY.format('g.day')}) = max({_WY.format('g.day')}) AS c
  FROM origins o, hz h JOIN grid g ON g.win = o.win AND g.day BETWEEN o.origin AND o.origin + h.horizon GROUP BY o.win, o.origin, h.horizon),
{_STATS},
frame AS (
  SELECT s.*, w.sensor, h.horizon, s.origin + h.horizon AS target_date, coalesce(core.c, false) AS core_eligible, t.value AS observed, a.value AS at_origin, b.value AS prior_value,
    training_days >= 365 AND training_targets >= 300 AS enough,
    CASE WHEN w.selection_end IS NULL THEN 'external_time_check' WHEN s.origin <= w.selection_end THEN 'selection' ELSE 'evaluation' END AS stage,
    CASE WHEN w.selection_end IS NULL OR s.origin <= w.selection_end THEN 'not_applicable'
      WHEN 2 * (s.origin - (w.selection_end + 1)) <= (w.stop - 1) - (w.selection_end + 1) THEN 'early' ELSE 'late' END AS half
  FROM stats s JOIN w USING (win) CROSS JOIN hz h LEFT JOIN core ON core.win = s.win AND core.origin = s.origin AND core.horizon = h.horizon
  LEFT JOIN grid t ON t.win = s.win AND t.day = s.origin + h.horizon LEFT JOIN grid a ON a.win = s.win AND a.day = s.origin
  LEFT JOIN grid b ON b.win = s.win AND b.day = CAST((s.origin + h.horizon) - INTERVAL 12 MONTH AS DATE) AND b.day <= s.origin
    AND NOT (month(s.origin + h.horizon) = 2 AND day(s.origin + h.horizon) = 29)),
equations AS (
  SELECT * FROM (SELECT win, day, value AS y, lag(value) OVER q AS a, lag(rain, 2) OVER q AS b FROM grid WINDOW q AS (PARTITION BY win ORDER BY day))
  WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
sums AS (
  SELECT o.win, o.origin, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy, var_pop(y) AS yy
  FROM origins o JOIN equations e ON e.win = o.win AND e.day <= o.origin GROUP BY ALL),
coef AS (
  SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS phi, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS beta FROM sums WHERE n >= 240 AND aa * bb - ab * ab > 1e-12 * aa * bb),
arx AS (
  SELECT c.win, c.origin, my - phi * ma - beta * mb AS c0, phi, beta, n * (yy - phi * ay - beta * byy) / (n - 3) AS sigma2, g0.value AS y0, g0.rain AS r0, g1.rain AS r1
  FROM coef c JOIN grid g0 ON g0.win = c.win AND g0.day = c.origin LEFT JOIN grid g1 ON g1.win = c.win AND g1.day = c.origin - 1),
made AS (
  SELECT win, origin, 1 AS horizon, c0 + phi * y0 + beta * r1 AS p, sigma2 AS v FROM arx
  UNION ALL SELECT win, origin, 2, c0 + phi * (c0 + phi * y0 + beta * r1) + beta * r0, sigma2 * (1 + phi * phi) FROM arx),
models AS (
  SELECT *, 'zero_change' AS model, 0.0 AS guess, NULL AS v FROM frame UNION ALL SELECT *, 'persistence', at_origin, NULL FROM frame
  UNION ALL SELECT *, 'expanding_median', training_median, NULL FROM frame UNION ALL SELECT *, 'prior_year', prior_value, NULL FROM frame
  UNION ALL SELECT f.*, 'arx', m.p, m.v FROM frame f LEFT JOIN made m USING (win, origin, horizon)),
said AS (
  SELECT *, CASE WHEN model = 'arx' AND horizon = 7 THEN 'feature_unavailable' WHEN NOT core_eligible THEN 'ineligible_core_origin' WHEN NOT enough THEN 'insufficient_training'
    WHEN model = 'arx' AND NOT EXISTS (SELECT 1 FROM coef c WHERE c.win = models.win AND c.origin = models.origin) THEN 'insufficient_training'
    WHEN guess IS NULL THEN 'feature_unavailable' ELSE 'ok' END AS status FROM models),
att AS (SELECT *, CASE WHEN status = 'ok' THEN guess END AS prediction, observed - CASE WHEN status = 'ok' THEN guess END AS error FROM said),
cal AS (
  SELECT h.win, h.model, h.horizon, h.origin, count(*) AS n_cal, quantile_cont(p.error, 0.1) AS lo, quantile_cont(p.error, 0.9) AS hi
  FROM att h JOIN att p ON p.win = h.win AND p.model = h.model AND p.horizon = h.horizon AND p.origin < h.origin AND p.target_date <= h.origin AND p.error IS NOT NULL
  WHERE h.prediction IS NOT NULL AND h.model <> 'arx' GROUP BY ALL),
att2 AS (
  SELECT att.*, CASE WHEN status <> 'ok' THEN 'no_forecast' WHEN model = 'arx' THEN 'ok_model_based' WHEN coalesce(n_cal, 0) >= 30 THEN 'calibrated' ELSE 'insufficient_past_calibration' END AS interval_status,
    CASE WHEN status = 'ok' AND model = 'arx' THEN prediction - 1.2815515655446004 * sqrt(v) WHEN n_cal >= 30 THEN prediction + lo END AS lower_80,
    CASE WHEN status = 'ok' AND model = 'arx' THEN prediction + 1.2815515655446004 * sqrt(v) WHEN n_cal >= 30 THEN prediction + hi END AS upper_80
  FROM att LEFT JOIN cal USING (win, model, horizon, origin))"""


def _staged(spark, sf_dir):
    windows = spark.sql("SELECT * FROM " + _STAGED.format("`window`"))
    return rolling.target_grid(daily_levels(spark, sf_dir), response(spark, sf_dir).withColumnRenamed("value", "rain"), windows), windows


def _rolling(spark, sf_dir, arima=None):
    return rolling.rolling_forecasts(*_staged(spark, sf_dir), arima={} if arima is None else arima)


def _shown(c: str) -> str:
    """Sums of squares leave ARX figures fewer sure digits."""
    return f"CASE WHEN model = 'arx' THEN round({c}, 1) ELSE round({c}, 4) END AS {c}"


@query(f"""{_ROLL} SELECT win AS "window", sensor, origin, stage, half, horizon, model, core_eligible, training_days, training_targets, status, interval_status, {_shown('prediction')}, {_shown('error')}, {_shown('lower_80')}, {_shown('upper_80')}, abs(observed) > high_movement AS high, CASE WHEN month(target_date) IN (10,11,12,1,2,3,4) THEN 'wet' ELSE 'dry' END AS season FROM att2""")
def fc_attempts(spark, sf_dir):
    a, _ = _rolling(spark, sf_dir)
    return a.select("window", "sensor", "origin", "stage", "half", "horizon", "model", "core_eligible", "training_days", "training_targets", "status", "interval_status",
                    *[F.when(F.col("model") == "arx", F.round(c, 1)).otherwise(F.round(c, 4)).alias(c) for c in ("prediction", "error", "lower_80", "upper_80")], "high", "season")


_DECIDED = f"""{_ROLL}, sel AS (SELECT * FROM att WHERE stage = 'selection'),
able AS (SELECT win, horizon, model FROM sel GROUP BY ALL HAVING coalesce(count(*) FILTER (status = 'ok') / nullif(count(*) FILTER (core_eligible), 0), 0) >= 0.8),
able_of AS (SELECT win, horizon, count(*) AS n_models, string_agg(model, ';' ORDER BY model) AS candidates FROM able GROUP BY ALL),
common AS (SELECT win, horizon, origin FROM sel JOIN able USING (win, horizon, model) JOIN able_of USING (win, horizon) WHERE status = 'ok' GROUP BY win, horizon, origin, n_models HAVING count(*) = n_models),
mae AS (SELECT win, horizon, model, avg(abs(error)) AS mae, count(*) AS n_common FROM sel JOIN able USING (win, horizon, model) JOIN common USING (win, horizon, origin) GROUP BY ALL),
ranks(model, k) AS (VALUES ('zero_change', 0), ('persistence', 1), ('expanding_median', 2), ('prior_year', 3), ('arx', 9)),
near AS (SELECT *, min(mae) OVER (PARTITION BY win, horizon) AS best FROM mae),
pick AS (SELECT win, horizon, arg_min(model, k) AS model, arg_min(mae, k) AS mae, max(n_common) AS n_common FROM near JOIN ranks USING (model) WHERE mae <= best * 1.05 GROUP BY ALL),
zero AS (SELECT win, horizon, avg(abs(error)) AS mae FROM sel JOIN able USING (win, horizon, model) WHERE model = 'zero_change' AND status = 'ok' GROUP BY ALL),
base AS (SELECT win, sensor, horizon, coalesce(p.n_common, 0) AS n_common, coalesce(candidates, '') AS candidates, CASE WHEN p.n_common >= 30 AND p.mae IS NOT NULL THEN p.model ELSE 'zero_change' END AS retained,
  CASE WHEN p.n_common >= 30 AND p.mae IS NOT NULL THEN p.mae ELSE z.mae END AS selection_mae, coalesce(p.n_common >= 30 AND p.mae IS NOT NULL, false) AS enough
  FROM (SELECT DISTINCT win, sensor, horizon FROM sel) LEFT JOIN able_of USING (win, horizon) LEFT JOIN pick p USING (win, horizon) LEFT JOIN zero z USING (win, horizon)),
later AS (SELECT win, horizon, model, avg(abs(error)) AS m FROM att WHERE stage = 'evaluation' AND status = 'ok' GROUP BY ALL),
best AS (SELECT win, horizon, first(model ORDER BY m, model) AS model, min(m) AS m FROM later GROUP BY ALL),
outside AS (SELECT sensor, horizon, model, count(*) AS n, avg(abs(error)) AS m FROM att WHERE stage = 'external_time_check' AND status = 'ok' GROUP BY ALL)"""


@query(f"""{_DECIDED}
SELECT b.win AS "window", b.sensor, b.horizon, retained, CASE WHEN enough THEN 'lowest_common_origin_mae_with_five_percent_complexity_tie_rule' ELSE 'insufficient_common_selection_origins_retain_zero' END AS reason,
 candidates, n_common, round(selection_mae, 2) AS selection_mae, round(l.m, 2) AS evaluation_mae, coalesce(e.model, 'none') AS evaluation_best, round(e.m, 2) AS evaluation_best_mae, coalesce(o.n, 0) AS n_external, round(o.m, 2) AS external_mae, true AS evaluation_does_not_revise_selection
FROM base b LEFT JOIN later l ON l.win = b.win AND l.horizon = b.horizon AND l.model = b.retained LEFT JOIN best e ON e.win = b.win AND e.horizon = b.horizon LEFT JOIN outside o ON o.sensor = b.sensor AND o.horizon = b.horizon AND o.model = b.retained""")
def fc_selection(spark, sf_dir):
    d = rolling.selection_decisions(_rolling(spark, sf_dir)[0])
    return d.select("window", "sensor", "horizon", "retained", "reason", "candidates", "n_common", "evaluation_best", "n_external", "evaluation_does_not_revise_selection",
                    *[F.round(c, 2).alias(c) for c in ("selection_mae", "evaluation_mae", "evaluation_best_mae", "external_mae")])


@query(f"""{_ROLL}, par AS (SELECT 'constant' AS parameter, c0 AS value FROM arx0 UNION ALL SELECT 'ar.L1', phi FROM arx0 UNION ALL SELECT 'rain_lag2', beta FROM arx0)
 SELECT 'arx' AS model, parameter, count(value) AS n, round(quantile_cont(value, 0.25), 5) AS q25, round(quantile_cont(value, 0.5), 5) AS median, round(quantile_cont(value, 0.75), 5) AS q75, 1.0 AS converged_share FROM par GROUP BY ALL""".replace(", par AS (", ", arx0 AS (SELECT my - phi * ma - beta * mb AS c0, phi, beta FROM coef), par AS (", 1))
def fc_parameter_stability(spark, sf_dir):
    p = forecast.parameter_stability(_rolling(spark, sf_dir)[1], ["model", "parameter"])
    return p.select("model", "parameter", "n", *[F.round(c, 5).alias(c) for c in ("q25", "median", "q75")], "converged_share")


@query(f"""{_ROLL}, there AS (SELECT *, lower_80 IS NOT NULL AND upper_80 IS NOT NULL AND observed IS NOT NULL AS t FROM att2)
 SELECT model, horizon, count(*) FILTER (t) AS n_intervals, round(avg(CASE WHEN t THEN CAST(observed BETWEEN lower_80 AND upper_80 AS INT) END), 8) AS coverage, round(avg(CASE WHEN t THEN upper_80 - lower_80 END), 1) AS width,
  round(avg(CASE WHEN t THEN upper_80 - lower_80 + 10 * greatest(lower_80 - observed, 0) + 10 * greatest(observed - upper_80, 0) END), 1) AS score FROM there GROUP BY ALL""")
def fc_interval_diagnostics(spark, sf_dir):
    d = forecast.interval_diagnostics(_rolling(spark, sf_dir)[0], ["model", "horizon"], 0.80)
    return d.select("model", "horizon", "n_intervals", F.round("coverage", 8).alias("coverage"), F.round("width", 1).alias("width"), F.round("score", 1).alias("score"))


@query(f"""{_ROLL} SELECT w.win AS "window", w.sensor, start, stop, anchor, selection_end, CAST(stop - start AS INT) AS calendar_days, count(value) AS n_eligible, min(day) FILTER (value IS NOT NULL) AS first_eligible, max(day) FILTER (value IS NOT NULL) AS last_eligible
 FROM w JOIN grid USING (win) GROUP BY ALL""")
def fc_target_windows(spark, sf_dir):
    return rolling.target_windows(*_staged(spark, sf_dir))


@query(f"""{_ROLL} SELECT t.model, t.family, t.complexity, count(att.model) AS n_attempts, count(*) FILTER (att.status = 'ok') AS n_ok FROM (VALUES ('zero_change', 'baseline', 0), ('persistence', 'baseline', 1), ('expanding_median', 'baseline', 2), ('prior_year', 'baseline', 3),
 ('mean', 'ARIMA', 4), ('ar1', 'ARIMA', 5), ('ar2', 'ARIMA', 6), ('arma11', 'ARIMA', 7), ('sar1', 'ARIMA', 8), ('arx', 'conditional_ARX', 9)) AS t(model, family, complexity) LEFT JOIN att USING (model) GROUP BY ALL""")
def fc_model_specifications(spark, sf_dir):
    """The ten specifications with what the rolling run without ARIMA made of each."""
    made = _rolling(spark, sf_dir)[0].groupBy("model").agg(F.count("*").alias("n_attempts"), F.count_if(F.col("status") == "ok").alias("n_ok"))
    specs = spark.createDataFrame([r[:3] for r in rolling.model_specifications()], "model string, family string, complexity int")
    return specs.join(made, "model", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_attempts", "n_ok")})


# -- lags, top-k, alignment ---------------------------------------------------------------------

_CURVE = f"""WITH {_PAIR}, curve AS (SELECT l.lag, count(*) AS n_pairs, corr(p.value, r.value) AS correlation FROM generate_series(0, 30) l(lag) JOIN p ON true JOIN r ON r.day = p.day + CAST(l.lag AS INT) GROUP BY 1 HAVING count(*) >= 3)"""


@query(f"{_CURVE} SELECT CAST(lag AS INT) AS lag, n_pairs, round(correlation, 8) AS correlation FROM curve")
def st_lag_curve(spark, sf_dir):
    return lags.lag_curve(lags.lag_pairs(predictor(spark, sf_dir), response(spark, sf_dir), 30)).withColumn("correlation", F.round("correlation", 8))


@query(f"{_CURVE} SELECT CAST(lag AS INT) AS lag, round(correlation, 8) AS correlation, n_pairs FROM curve ORDER BY abs(correlation) DESC, lag LIMIT 1")
def tk_peak_lag(spark, sf_dir):
    return lags.peak_lag(lags.lag_curve(lags.lag_pairs(predictor(spark, sf_dir), response(spark, sf_dir), 30))).withColumn("correlation", F.round("correlation", 8))


@query(f"""WITH {_PAIR}, b AS (SELECT day, p.value x, r.value y FROM p FULL JOIN r USING (day)), m AS (SELECT avg(value) m FROM p), l AS (SELECT b.day, b.x, b.y, c.x x1, c.y y1, m.m FROM b JOIN b c ON b.day = c.day + 1, m),
 f AS (SELECT sum((x - m) * (x1 - m)) / sum((x1 - m) * (x1 - m)) phi FROM l WHERE x IS NOT NULL AND x1 IS NOT NULL) SELECT day, round(phi, 8) AS phi, round(x - phi * x1, 2) AS x, round(y - phi * y1, 2) AS y FROM l, f WHERE x - phi * x1 IS NOT NULL OR y - phi * y1 IS NOT NULL""")
def st_prewhiten(spark, sf_dir):
    return lags.prewhiten(predictor(spark, sf_dir), response(spark, sf_dir)).select("day", F.round("phi", 8).alias("phi"), F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query(f"""WITH RECURSIVE {_PAIR}, pick AS (SELECT 1 AS rank, day, value, [day] AS days FROM (SELECT * FROM p ORDER BY value DESC, day LIMIT 1) UNION ALL
 SELECT * FROM (SELECT k.rank + 1, p.day, p.value, list_append(k.days, p.day) FROM pick k JOIN p ON true WHERE k.rank < 3 AND len(list_filter(k.days, lambda z: abs(z - p.day) < 7)) = 0 ORDER BY p.value DESC, p.day LIMIT 1)) SELECT rank, day, value FROM pick""")
def tk_separated_events(spark, sf_dir):
    return align.separated_top(predictor(spark, sf_dir), 3, 7)


@query(f"""WITH {_OBS} SELECT a.row_no IS NOT NULL AS found, a.stamp AS left_stamp, b.stamp AS right_stamp, CAST(date_diff('microsecond', b.stamp, a.stamp) AS BIGINT) AS offset_us
 FROM (SELECT DISTINCT ON (stamp) * FROM obs WHERE sensor = 'click' ORDER BY stamp, row_no) a JOIN (SELECT DISTINCT ON (stamp) * FROM obs WHERE sensor = 'view' ORDER BY stamp, row_no) b ON abs(date_diff('microsecond', b.stamp, a.stamp)) <= 480000000""")
def jn_nearest_candidates(spark, sf_dir):
    side = lambda s: observations(spark, sf_dir).where(F.col("sensor") == s).groupBy("stamp").agg(F.min("row_no").cast("double").alias("value"))
    return align.nearest_candidates(side("click"), side("view"), 480).select(F.lit(True).alias("found"), "left_stamp", "right_stamp", "offset_us")


#: Rounds of mutual best pairs over c(k, l, r, o): the same pairs as the greedy order.
_GREEDY = """s AS (
  SELECT *, 0 AS turn, CAST(NULL AS BOOLEAN) AS won FROM c
  UNION ALL SELECT * EXCLUDE (turn, won, m, lw, rw), turn + 1, CASE WHEN m THEN true WHEN lw OR rw THEN false END FROM (
    SELECT *, bool_or(m) OVER (PARTITION BY k, l) AS lw, bool_or(m) OVER (PARTITION BY k, r) AS rw FROM (
      SELECT *, row_number() OVER (PARTITION BY k, l ORDER BY abs(o), l, r) = 1 AND row_number() OVER (PARTITION BY k, r ORDER BY abs(o), l, r) = 1 AS m FROM s WHERE won IS NULL)))"""


@query(f"""WITH RECURSIVE {_OBS}, side AS (SELECT sensor, stamp, min(row_no) AS v FROM obs GROUP BY ALL),
c AS (SELECT 1 AS k, a.stamp AS l, b.stamp AS r, CAST(date_diff('microsecond', b.stamp, a.stamp) AS BIGINT) AS o, a.v AS lv, b.v AS rv FROM side a JOIN side b ON a.sensor = 'click' AND b.sensor = 'view' AND abs(date_diff('microsecond', b.stamp, a.stamp)) <= 480000000),
{_GREEDY} SELECT l AS left_stamp, r AS right_stamp, o AS offset_us, CAST(lv AS DOUBLE) AS left_value, CAST(rv AS DOUBLE) AS right_value FROM s WHERE won""")
def jn_one_to_one(spark, sf_dir):
    side = lambda s: observations(spark, sf_dir).where(F.col("sensor") == s).groupBy("stamp").agg(F.min("row_no").cast("double").alias("value"))
    return align.one_to_one(align.nearest_candidates(side("click"), side("view"), 480), []).select("left_stamp", "right_stamp", "offset_us", "left_value", "right_value")


def _event_inputs(spark, sf_dir):
    """Values of purchases, changes of clicks and views, and the three days of largest purchases at least seven days apart."""
    o = quality.level_eligibility(quality.flagged(observations(spark, sf_dir))).where("eligible").withColumn("segment", F.lit("s"))
    rain = o.where("sensor = 'purchase'")
    days = align.separated_top(rain.groupBy(F.to_date("stamp").alias("day")).agg(F.sum("value").alias("value")), 3, 7)
    events = days.select(F.concat(F.lit("e"), F.col("rank").cast("string")).alias("event"), "day", F.col("value").alias("amount"))
    return rain.select("stamp", "value"), align.event_changes(o.where("sensor in ('click', 'view')")).select("sensor", "stamp", "value"), events


_EVENTS = f"""{_FLAGS.replace('WITH', 'WITH RECURSIVE', 1)},
ok AS (SELECT sensor, stamp, value FROM flagged WHERE value IS NOT NULL AND NOT dup AND NOT blank AND NOT bad AND NOT malformed AND NOT sentinel AND NOT coalesce(d < 0, false)),
chg AS (SELECT sensor, stamp, value - lag(value) OVER w AS value, date_diff('microsecond', lag(stamp) OVER w, stamp) AS gap FROM ok WHERE sensor IN ('click', 'view') WINDOW w AS (PARTITION BY sensor ORDER BY stamp)),
daysum AS (SELECT CAST(stamp AS DATE) AS day, sum(value) AS value FROM ok WHERE sensor = 'purchase' GROUP BY 1),
pick AS (SELECT 1 AS rank, day, value, [day] AS days FROM (SELECT * FROM daysum ORDER BY value DESC, day LIMIT 1) UNION ALL
  SELECT * FROM (SELECT k.rank + 1, p.day, p.value, list_append(k.days, p.day) FROM pick k JOIN daysum p ON true WHERE k.rank < 3 AND len(list_filter(k.days, lambda z: abs(z - p.day) < 7)) = 0 ORDER BY p.value DESC, p.day LIMIT 1)),
ev AS (SELECT 'e' || rank AS event, day, value AS amount FROM pick),
lagged AS (SELECT event, g.m AS lag_min, stamp + to_minutes(g.m) AS stamp, value FROM ok JOIN ev ON ok.sensor = 'purchase' AND stamp >= day - 1 AND stamp < day + 3, (SELECT unnest(range(0, 2881, 15)) AS m) g),
aim AS (SELECT event, sensor, stamp, value FROM chg JOIN ev ON gap > 0 AND gap <= 1200000000 AND stamp >= day - 1 AND stamp < day + 3),
c AS (SELECT a.event || '/' || b.sensor || '/' || t.tol || '/' || a.lag_min AS k, a.event, b.sensor, t.tol, a.lag_min, a.stamp AS l, b.stamp AS r, CAST(date_diff('microsecond', b.stamp, a.stamp) AS BIGINT) AS o, a.value AS lv, b.value AS rv
  FROM lagged a JOIN aim b ON a.event = b.event AND b.stamp BETWEEN a.stamp - INTERVAL 15 MINUTE AND a.stamp + INTERVAL 15 MINUTE JOIN (VALUES (8), (15)) t(tol) ON abs(date_diff('microsecond', b.stamp, a.stamp)) <= t.tol * 60000000),
{_GREEDY},
curve AS (SELECT event, sensor, tol, lag_min, count(*) AS n, CASE WHEN count(*) >= 20 AND var_pop(lv) > 0 AND var_pop(rv) > 0 THEN covar_pop(lv, rv) / (stddev_pop(lv) * stddev_pop(rv)) END AS corr FROM s WHERE won GROUP BY ALL),
peak AS (SELECT event, sensor, tol, arg_max(lag_min, CASE WHEN corr IS NOT NULL THEN [abs(corr), -lag_min] END) AS lag_min, coalesce(max(CASE WHEN lag_min = 0 THEN n END), 0) AS n0 FROM curve GROUP BY ALL),
peaks AS (SELECT p.event, p.sensor, p.tol, p.lag_min / 60 AS lag_hours, c.corr, c.n, p.n0 FROM peak p JOIN curve c USING (event, sensor, tol, lag_min) WHERE corr IS NOT NULL),
firm AS (SELECT event, sensor, count(*) = 2 AND min(sign(corr)) = max(sign(corr)) AND max(corr) - min(corr) <= 0.1 AND max(lag_hours) - min(lag_hours) <= 2 AS stable FROM peaks GROUP BY ALL)"""


@query(f"""{_EVENTS} SELECT event, day, round(amount, 4) AS amount, sensor, tol AS tolerance, lag_hours, round(corr, 8) AS correlation, n, n0 AS n_simultaneous, stable FROM peaks JOIN firm USING (event, sensor) JOIN ev USING (event)""")
def ev_alignment(spark, sf_dir):
    """All 193 lags, both tolerances, by event and responding sensor."""
    peaks, _ = exploratory.event_alignment(*_event_inputs(spark, sf_dir), ["sensor"])
    return peaks.select("event", "day", F.round("amount", 4).alias("amount"), "sensor", "tolerance", "lag_hours", F.round("correlation", 8).alias("correlation"), "n", "n_simultaneous", "stable")


@query(f"""{_EVENTS} SELECT event, sensor, max(CASE WHEN tol = 8 THEN lag_hours END) AS "8_lag_hours", round(max(CASE WHEN tol = 8 THEN corr END), 8) AS "8_correlation", max(CASE WHEN tol = 15 THEN lag_hours END) AS "15_lag_hours",
  round(max(CASE WHEN tol = 15 THEN corr END), 8) AS "15_correlation" FROM peaks GROUP BY ALL""")
def ev_tolerance_pivot(spark, sf_dir):
    peaks, _ = exploratory.event_alignment(*_event_inputs(spark, sf_dir), ["sensor"])
    return exploratory.tolerance_pivot(peaks, ["event", "sensor"]).withColumns({f"{t}_correlation": F.round(f"{t}_correlation", 8) for t in (8, 15)})


@query(f"""{_EVENTS} SELECT event, sensor, tol AS tolerance, l AS left_stamp, r AS right_stamp, o AS offset_us, lv AS left_value, round(rv, 6) AS right_value FROM s WHERE won AND lag_min = 0""")
def ev_matches(spark, sf_dir):
    _, m = exploratory.event_alignment(*_event_inputs(spark, sf_dir), ["sensor"])
    return m.select("event", "sensor", "tolerance", "left_stamp", "right_stamp", "offset_us", "left_value", F.round("right_value", 6).alias("right_value"))


@query(f"""WITH {_OBS} SELECT stamp FROM obs WHERE sensor = 'click' INTERSECT SELECT stamp FROM obs WHERE sensor = 'view'""")
def so_common_stamps(spark, sf_dir):
    o = observations(spark, sf_dir)
    return o.where("sensor = 'click'").select("stamp").intersect(o.where("sensor = 'view'").select("stamp"))


@query(f"""WITH {_DAILY}, c AS (SELECT sensor, day, CASE WHEN day - lag(day) OVER (PARTITION BY sensor ORDER BY day) <= 2 THEN 0 ELSE 1 END AS gap FROM daily), n AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY sensor ORDER BY day) AS BIGINT) AS cluster FROM c)
 SELECT sensor, cluster, min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM n GROUP BY ALL""")
def wn_date_clusters(spark, sf_dir):
    return series.date_clusters(daily_levels(spark, sf_dir), ["sensor"], within_days=2).groupBy("sensor", "cluster").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n"))


@query(f"""WITH {_DAILY} SELECT sensor, CAST(day - make_date(CAST({_WY.format('day')} - 1 AS BIGINT), 10, 1) + 1 AS INT) AS wy_day, count(value) AS n, round(quantile_cont(value, 0.1), 4) AS q10, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.9), 4) AS q90 FROM daily GROUP BY 1, 2 HAVING count(value) >= 3""")
def pd_climatology(spark, sf_dir):
    return series.climatology(daily_levels(spark, sf_dir)).select("sensor", "wy_day", "n", *[F.round(c, 4).alias(c) for c in ("q10", "median", "q90")])


@query(f"""WITH {_DAILY} SELECT sensor, CAST(date_trunc('month', day) AS DATE) AS month, round(avg(CAST(eligible AS INT)), 8) AS eligible_fraction FROM daily GROUP BY ALL""")
def pd_monthly_eligible(spark, sf_dir):
    return series.monthly_eligible(daily_levels(spark, sf_dir)).withColumn("eligible_fraction", F.round("eligible_fraction", 8))


# -- changepoints and contracts -----------------------------------------------------------------

def _cp_runs(spark, sf_dir):
    r = response(spark, sf_dir).withColumn("sensor", F.lit("all"))
    return series.contiguous_runs(r, ["sensor"], 60).withColumn("run", F.concat_ws("__r", "sensor", F.col("run_no").cast("string")))


@query()
def cp_detections(spark, sf_dir):
    return changepoints.detect(_cp_runs(spark, sf_dir), ["run"])


@query()
def cp_summary(spark, sf_dir):
    return changepoints.summarize(changepoints.detect(_cp_runs(spark, sf_dir), ["run"]), ["run"])


# -- further operators --------------------------------------------------------------------------

def _interval(spark, sf_dir):
    return series.interval_daily(quality.level_eligibility(quality.flagged(observations(spark, sf_dir))).withColumn("segment", F.lit("s")), min_count=20)


@query(f"""{_FLAGS}, {_DAILY}, c AS (SELECT *, lag(day) OVER q AS d1, lag(value) OVER q AS v1, lag(segment) OVER q AS s1, lag(eligible) OVER q AS e1 FROM daily WINDOW q AS (PARTITION BY sensor ORDER BY day)),
u AS (
  SELECT sensor, day, segment, CASE WHEN sensor = '5-LOW' THEN 'daily_cumulative_level' ELSE 'daily_level' END AS transformation, value, eligible, NULL AS coverage_count FROM daily
  UNION ALL SELECT sensor, day, segment, CASE WHEN sensor = '5-LOW' THEN 'daily_cumulative_difference' ELSE 'daily_first_difference' END, value - v1,
    coalesce(eligible AND e1 AND day - d1 = 1 AND segment = s1 AND (sensor NOT IN ('5-LOW', '2-HIGH') OR {_WY.format('day')} = {_WY.format('d1')}), false), NULL FROM c
  UNION ALL SELECT sensor, CAST(stamp AS DATE), CASE WHEN count(*) FILTER (ok) > 0 THEN 's' ELSE 'mixed_or_none' END, 'interval_daily_total', sum(CASE WHEN ok THEN value END), count(*) FILTER (ok) >= 20, count(*) FILTER (ok)
  FROM (SELECT *, value IS NOT NULL AND NOT dup AND NOT blank AND NOT bad AND NOT malformed AND NOT sentinel AND NOT coalesce(d < 0, false) AS ok FROM flagged) GROUP BY sensor, CAST(stamp AS DATE))
SELECT sensor, day, segment, transformation, round(value, 2) AS value, eligible, coverage_count, {_WY.format('day')} AS water_year FROM u""")
def wn_daily_analysis(spark, sf_dir):
    a = series.daily_analysis(daily_levels(spark, sf_dir), _interval(spark, sf_dir), cumulative=("5-LOW",), same_water_year=("2-HIGH",))
    return a.select("sensor", "day", "segment", "transformation", F.round("value", 2).alias("value"), "eligible", "coverage_count", "water_year")


@query(f"""{_FLAGS}, one AS (SELECT sensor, stamp, any_value(value) AS value FROM flagged WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) = 1) SELECT sensor, count(*) AS n, round(sum(value), 2) AS total FROM one GROUP BY 1""")
def ag_drop_all_copies(spark, sf_dir):
    f = quality.flagged(observations(spark, sf_dir)).where("value is not null")
    return series.drop_all_copies(f, ["sensor", "stamp"]).groupBy("sensor").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"""WITH {_OBS} SELECT sensor, CAST(stamp AS DATE) AS day, arg_min(row_no, (stamp, row_no)) AS row_no FROM obs GROUP BY ALL""")
def pj_first_per_day(spark, sf_dir):
    return series.first_per_day(observations(spark, sf_dir).withColumn("day", F.to_date("stamp")), ["sensor"], ["stamp", "row_no"]).select("sensor", "day", "row_no")


@query(f"""WITH {_DAILY}, m AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, sensor, avg(value) AS v FROM daily GROUP BY ALL), e AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM m)
 SELECT e.month, round(max(v) FILTER (sensor = '1-URGENT'), 6) AS urgent, round(max(v) FILTER (sensor = '5-LOW'), 6) AS low FROM e LEFT JOIN m USING (month) GROUP BY ALL""")
def pj_month_pivot(spark, sf_dir):
    return series.month_pivot(daily_levels(spark, sf_dir), ["1-URGENT", "5-LOW"]).select("month", F.round("1-URGENT", 6).alias("urgent"), F.round("5-LOW", 6).alias("low"))


@query(f"""{_FLAGS} SELECT sensor, CAST(stamp AS DATE) AS day, flag, CASE WHEN flag THEN reason ELSE 'none' END AS event_text, count(*) AS n
 FROM (SELECT f.*, b.reason IS NOT NULL AS flag, b.reason FROM flagged f LEFT JOIN (VALUES ('click', DATE '2024-01-01', 'first'), ('view', DATE '2024-01-03', 'moved')) AS b(sensor, day, reason) ON b.sensor = f.sensor AND b.day = CAST(f.stamp AS DATE)) GROUP BY ALL""")
def qc_change_boundaries(spark, sf_dir):
    starts = spark.sql("SELECT * FROM VALUES ('click', TIMESTAMP_NTZ '2024-01-01 06:00:00', 'first'), ('view', TIMESTAMP_NTZ '2024-01-03 00:00:00', 'moved') AS t(sensor, start, segment)")
    out = regimes.change_boundaries(quality.flagged(observations(spark, sf_dir)), starts)
    return out.groupBy("sensor", F.to_date("stamp").alias("day"), F.col("flag_documented_change_boundary").alias("flag"), "event_text").agg(F.count("*").alias("n"))


@query(f"""{_FLAGS}, p AS (SELECT sensor, stamp, value, lag(stamp) OVER q AS s1, lag(value) OVER q AS v1, count(*) OVER (PARTITION BY sensor, stamp) AS n FROM (SELECT sensor, stamp, avg(value) AS value FROM flagged WHERE value IS NOT NULL GROUP BY ALL) WINDOW q AS (PARTITION BY sensor ORDER BY stamp))
 SELECT sensor, count(*) AS n, round(sum(value - v1), 4) AS total FROM p WHERE stamp > s1 AND stamp <= s1 + INTERVAL 20 MINUTE GROUP BY 1""")
def wn_event_changes(spark, sf_dir):
    f = quality.flagged(observations(spark, sf_dir)).where("value is not null").groupBy("sensor", "stamp").agg(F.avg("value").alias("value")).withColumn("segment", F.lit("s"))
    return align.event_changes(f).groupBy("sensor").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""{_FLAGS}, again AS (SELECT sensor, CAST(stamp AS DATE) AS day, quantile_cont(value, 0.5) AS m, max(value) AS top FROM flagged WHERE value IS NOT NULL GROUP BY ALL)
 SELECT sensor, count(*) AS n_days, count(*) FILTER (m = top) AS n_match, count(*) FILTER (m <> top) AS n_differ, round(max(abs(top - m)), 6) AS max_diff FROM again GROUP BY 1""")
def ag_recomputed_daily(spark, sf_dir):
    f = quality.flagged(observations(spark, sf_dir))
    top = f.where("value is not null").groupBy("sensor", F.to_date("stamp").alias("day")).agg(F.max("value").alias("value"))
    return coverage.recomputed_daily(f, top, cumulative=False).withColumn("max_diff", F.round("max_diff", 6))


@query(f"""WITH {_PAIR}, c AS (SELECT * FROM (VALUES ('a', DATE '1995-03-10', 0), ('b', DATE '1995-03-16', 1), ('c', DATE '1997-08-01', 2)) AS t(context, day, position))
 SELECT p.day AS point, arg_min(context, (abs(p.day - c.day), position)) AS context, CAST(arg_min(p.day - c.day, (abs(p.day - c.day), position)) AS INT) AS offset_days FROM p LEFT JOIN c ON abs(p.day - c.day) <= 7 GROUP BY 1""")
def jn_nearest_context(spark, sf_dir):
    c = spark.sql("SELECT * FROM VALUES ('a', DATE '1995-03-10', 0), ('b', DATE '1995-03-16', 1), ('c', DATE '1997-08-01', 2) AS t(context, day, position)")
    return regimes.nearest_context(predictor(spark, sf_dir).select(F.col("day").alias("point")), c)


@query(f"""WITH {_PAIR}, r2 AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM r), k AS (SELECT min(day) AS first_day, max(day) AS last_day, count(*) AS n_days FROM (SELECT day, day - CAST(i AS INT) AS g FROM r2) GROUP BY g HAVING count(*) >= 60)
 SELECT first_day, last_day, n_days, CAST(3 + CAST(n_days >= 60 AS INT) + CAST(n_days >= 90 AS INT) + CAST(n_days >= 120 AS INT) AS INT) AS n_settings FROM k""")
def cp_run_settings(spark, sf_dir):
    return changepoints.run_settings(_cp_runs(spark, sf_dir), ["run"]).drop("run")


@query(f"""WITH {_OBS} SELECT stamp FROM obs WHERE sensor = 'click' EXCEPT SELECT stamp FROM obs WHERE sensor = 'view'""")
def so_difference(spark, sf_dir):
    o = observations(spark, sf_dir)
    return o.where("sensor = 'click'").select("stamp").subtract(o.where("sensor = 'view'").select("stamp"))


@query(f"""WITH {_OBS} SELECT stamp FROM obs WHERE sensor = 'click' UNION SELECT stamp FROM obs WHERE sensor = 'view'""")
def so_union_distinct(spark, sf_dir):
    o = observations(spark, sf_dir)
    return o.where("sensor in ('click', 'view')").select("stamp").distinct()


@query("""SELECT 'duplicate_key' AS rule, 'page_id' AS "column", CAST(coalesce(sum(k) FILTER (k > 1), 0) AS BIGINT) AS n FROM (SELECT page_id, count(*) k FROM pages GROUP BY 1)
 UNION ALL SELECT 'blank', 'url', count(*) FILTER (coalesce(lower(trim(url)) IN ('','na','n/a','nan','null','none','tbd'), true)) FROM pages UNION ALL SELECT 'https', 'url', count(*) FILTER (NOT coalesce(regexp_matches(url, '^https://[^/\\s]+'), false)) FROM pages
 UNION ALL SELECT 'min_rows', '*', CAST(greatest(0, 1 - count(*)) AS BIGINT) FROM pages""")
def ct_page_contract(spark, sf_dir):
    return contracts.row_rules(table(spark, sf_dir, "pages"), ["page_id"], ["url"], {("https", "url"): contracts.https(F.col("url"))})


@query(f"""WITH {_DAILY}, x AS (SELECT sensor, day, value FROM daily), y AS (SELECT sensor, day, value + CASE WHEN day = DATE '1996-05-05' THEN 1 ELSE 0 END AS value FROM daily WHERE day <> DATE '1997-03-03')
 SELECT sensor, day, CASE WHEN y.value IS NULL THEN 'left_only' ELSE 'differs' END AS side FROM x LEFT JOIN y USING (sensor, day) WHERE y.value IS NULL OR abs(x.value - y.value) > 1e-12""")
def ct_table_difference(spark, sf_dir):
    d = daily_levels(spark, sf_dir).select("sensor", "day", "value")
    other = d.where("day <> DATE '1997-03-03'").withColumn("value", F.col("value") + (F.col("day") == "1996-05-05").cast("int"))
    return contracts.table_difference(d, other, ["sensor", "day"], ["value"])


@query("""WITH r AS (SELECT CAST(l_shipdate AS DATE) AS day, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1), g AS (SELECT *, CASE WHEN day - lag(day) OVER (ORDER BY day) = 1 THEN 0 ELSE 1 END AS gap FROM r),
 n AS (SELECT *, sum(gap) OVER (ORDER BY day) AS run_no FROM g), c AS (SELECT 'all__r' || CAST(run_no AS BIGINT) AS run, day, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY run_no) AS n, sum(value) OVER (PARTITION BY run_no) AS s, sum(value) OVER w - value AS l FROM n WINDOW w AS (PARTITION BY run_no ORDER BY day)),
 q AS (SELECT run, day, i, l * l / i + (s - l) * (s - l) / (n - i) - s * s / n AS gain FROM c WHERE n >= 60 AND i >= 30 AND n - i >= 30) SELECT run, day, i, round(gain / 1e9, 2) AS gain FROM q QUALIFY row_number() OVER (PARTITION BY run ORDER BY gain DESC, i) = 1""")
def cp_first_split(spark, sf_dir):
    return changepoints.first_split(_cp_runs(spark, sf_dir), ["run"]).select("run", "day", F.col("i").cast("bigint").alias("i"), F.round(F.col("gain") / 1e9, 2).alias("gain"))


@query()
def st_stationarity(spark, sf_dir):
    return exploratory.stationarity(_cp_runs(spark, sf_dir), ["run"])


@query()
def st_dependence(spark, sf_dir):
    return exploratory.dependence(_cp_runs(spark, sf_dir), ["run"])


@query()
def st_decomposition(spark, sf_dir):
    return exploratory.decomposition(_cp_runs(spark, sf_dir), ["run"])


@query()
def st_bootstrap_intervals(spark, sf_dir):
    return lags.bootstrap_intervals(lags.lag_pairs(predictor(spark, sf_dir), response(spark, sf_dir), 30), ["lag"])


@query()
def st_residual_diagnostics(spark, sf_dir):
    return exploratory.residual_diagnostics(_attempts(spark, sf_dir), ["window", "model"])


@query(f"""WITH RECURSIVE {_PAIR}, e AS (SELECT row_number() OVER (ORDER BY day) AS i, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS e FROM r),
ar AS (SELECT i, e AS y FROM e WHERE i = 1 UNION ALL SELECT e.i, 0.7 * ar.y + e.e FROM ar JOIN e ON e.i = ar.i + 1),
y AS (SELECT 'ar1' AS process, i, y FROM ar UNION ALL SELECT 'ma1', i, e + 0.7 * coalesce(lag(e) OVER (ORDER BY i), 0) FROM e UNION ALL SELECT 'random_walk', i, sum(e) OVER (ORDER BY i) FROM e),
d AS (SELECT process, i, y - avg(y) OVER (PARTITION BY process) AS d, count(*) OVER (PARTITION BY process) AS n FROM y)
SELECT a.process, a.n, CAST(l.lag AS INT) AS lag, round(sum(a.d * b.d) / any_value(z.z), 6) AS acf FROM d a JOIN (SELECT unnest(range(0, 21)) AS lag) l ON true JOIN d b ON b.process = a.process AND b.i = a.i + l.lag JOIN (SELECT process, sum(d * d) AS z FROM d GROUP BY 1) z ON z.process = a.process GROUP BY ALL""")
def st_linear_processes(spark, sf_dir):
    """Processes driven by the standardised daily response; the fixed-seed table is a test."""
    return exploratory.processes_of(response(spark, sf_dir), "day", "value").withColumn("acf", F.round("acf", 6))


@query(f"""WITH {_PAIR}, x AS (SELECT (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS z, count(*) OVER () AS n, row_number() OVER (ORDER BY day) - 1 AS i, row_number() OVER (ORDER BY md5(CAST(day AS VARCHAR)), day) - 1 AS r FROM r),
s AS (SELECT 'chronological' AS split, n, i AS place, z + CASE WHEN i >= floor(n * 220 / 300) THEN 5 ELSE 0 END AS y FROM x UNION ALL SELECT 'random', n, r, z + CASE WHEN i >= floor(n * 220 / 300) THEN 5 ELSE 0 END FROM x),
f AS (SELECT split, avg(y) AS m FROM s WHERE place < floor(n * 0.7) GROUP BY 1)
SELECT split, count(*) AS n, round(avg(abs(y - m)), 6) AS mae, round(sqrt(avg((y - m) * (y - m))), 6) AS rmse, round(avg(y - m), 6) AS bias FROM s JOIN f USING (split) WHERE place >= floor(n * 0.7) GROUP BY 1""")
def st_leakage_demo(spark, sf_dir):
    """Splits of the daily response; the fixed-seed demonstration is a test."""
    return exploratory.split_errors(response(spark, sf_dir), "day", "value").withColumns({c: F.round(c, 6) for c in ("mae", "rmse", "bias")})


@query(f"""{_ATTEMPTS}, o AS (SELECT win, model, error, row_number() OVER (PARTITION BY win, model ORDER BY origin) AS i FROM att WHERE error IS NOT NULL),
g AS (SELECT win, model, count(*) AS n, avg(error) AS bias, CASE WHEN count(*) >= 3 AND var_pop(error) > 0 THEN skewness(error) END AS skew, CASE WHEN count(*) >= 4 AND var_pop(error) > 0 THEN kurtosis(error) END AS kurtosis,
  quantile_cont(abs(error), 0.5) AS median_ae, quantile_cont(abs(error), 0.95) AS q95_ae, min(error) < max(error) AND count(*) >= 3 AS varies, CAST(least(10, count(*) // 5) AS INT) AS m FROM o GROUP BY ALL),
z AS (SELECT win, model, sum((error - bias) * (error - bias)) AS z FROM o JOIN g USING (win, model) GROUP BY ALL),
a AS (SELECT o.win, o.model, l.lag, sum((o.error - g.bias) * (p.error - g.bias)) / any_value(z.z) AS acf FROM o JOIN g USING (win, model) JOIN z USING (win, model) JOIN (SELECT unnest(range(0, 11)) AS lag) l ON true JOIN o p ON p.win = o.win AND p.model = o.model AND p.i = o.i + l.lag WHERE varies GROUP BY ALL),
q AS (SELECT win, model, n * (n + 2) * sum(acf * acf / (n - lag)) AS q FROM a JOIN g USING (win, model) WHERE lag BETWEEN 1 AND m GROUP BY win, model, n)
SELECT g.win AS "window", g.model, n, CAST(l.lag AS INT) AS lag, CASE WHEN l.lag = 0 THEN 1.0 ELSE round(acf, 6) END AS acf, m AS ljung_box_lag, CASE WHEN m >= 1 THEN round(q, 4) END AS ljung_box, round(bias, 2) AS bias, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, round(median_ae, 2) AS median_ae, round(q95_ae, 2) AS q95_ae
FROM g JOIN (SELECT unnest(range(0, 11)) AS lag) l ON true LEFT JOIN a ON a.win = g.win AND a.model = g.model AND a.lag = l.lag LEFT JOIN q ON q.win = g.win AND q.model = g.model""")
def st_residual_acf(spark, sf_dir):
    """Residual diagnostics without the tail probability, which SQL has no function for."""
    d = exploratory.residual_autocorrelation(_attempts(spark, sf_dir), ["window", "model"])
    return d.withColumns({"acf": F.round("acf", 6), "ljung_box": F.round("ljung_box", 4), **{c: F.round(c, 6) for c in ("skew", "kurtosis")}, **{c: F.round(c, 2) for c in ("bias", "median_ae", "q95_ae")}})


@query(f"""WITH {_PAIR}, k AS (SELECT *, CASE WHEN day - lag(day) OVER (ORDER BY day) = 1 THEN 0 ELSE 1 END AS g FROM r), u AS (SELECT *, CAST(sum(g) OVER (ORDER BY day) AS BIGINT) AS run_no FROM k),
x AS (SELECT 'all__r' || run_no AS run, value, row_number() OVER (PARTITION BY run_no ORDER BY day) AS i, count(*) OVER (PARTITION BY run_no) AS n, value - avg(value) OVER (PARTITION BY run_no) AS d FROM u)
SELECT a.run, a.n, CAST(l.lag AS INT) AS lag, round(sum(a.d * b.d) / any_value(z.z), 6) AS acf, round(1.96 / sqrt(a.n), 8) AS band FROM x a JOIN (SELECT unnest(range(0, 61)) AS lag) l ON l.lag <= least(60, a.n // 4, a.n // 2 - 1) JOIN x b ON b.run = a.run AND b.i = a.i + l.lag
 JOIN (SELECT run, sum(d * d) AS z FROM x GROUP BY 1 HAVING min(value) < max(value)) z ON z.run = a.run WHERE a.n >= 120 GROUP BY a.run, a.n, l.lag""")
def st_autocorrelation(spark, sf_dir):
    return exploratory.dependence(_cp_runs(spark, sf_dir), ["run"]).drop("pacf").withColumns({"acf": F.round("acf", 6), "band": F.round("band", 8)})


@query()
def pd_stationarity_counts(spark, sf_dir):
    """Readings of the two tests, which have no SQL, by run."""
    found = exploratory.stationarity(_cp_runs(spark, sf_dir), ["run"])
    return found.groupBy("reading").agg(F.count("*").alias("n"))


@query()
def fc_comparison_uncertainty(spark, sf_dir):
    return exploratory.comparison_uncertainty(_attempts(spark, sf_dir), ["window"])


@query()
def fc_arima_attempts(spark, sf_dir):
    """All orders at every scheduled origin of all windows, in the one rolling run; a fit has no SQL, tests hold its likelihood and forecasts."""
    a, _ = _rolling(spark, sf_dir, forecast.ARIMA)
    return a.where("family = 'ARIMA'").select("window", "origin", "stage", "horizon", "model", "status", "converged", *[F.round(c, 2).alias(c) for c in ("prediction", "lower_80", "upper_80")])


@query()
def fc_selection_all(spark, sf_dir):
    """Decisions among all ten models; fc_selection has the SQL of the rule for those without a likelihood."""
    d = rolling.selection_decisions(_rolling(spark, sf_dir, forecast.ARIMA)[0])
    return d.withColumns({c: F.round(c, 2) for c in ("selection_mae", "evaluation_mae", "evaluation_best_mae", "external_mae")})


@query(f"""{_DECIDED}, m AS (SELECT win, horizon, model, avg(abs(error)) AS mae, count(*) FILTER (status = 'ok') AS n FROM att WHERE stage = 'evaluation' GROUP BY ALL)
 SELECT b.win AS "window", b.horizon, b.retained, round(own.mae, 2) AS retained_mae, own.n AS retained_n, round(ref.mae, 2) AS reference_mae, round(own.mae / nullif(ref.mae, 0), 8) AS ratio
 FROM base b LEFT JOIN m own ON own.win = b.win AND own.horizon = b.horizon AND own.model = b.retained LEFT JOIN m ref ON ref.win = b.win AND ref.horizon = b.horizon AND ref.model = 'zero_change'""")
def sy_key_results(spark, sf_dir):
    a, _ = _rolling(spark, sf_dir)
    later = a.where("stage = 'evaluation'")
    out = synthesis.key_results(rolling.selection_decisions(a).select("window", "horizon", "retained"), forecast.validation_metrics(later, ["window", "horizon", "model"]), ["window", "horizon"])
    return out.select("window", "horizon", "retained", F.round("retained_mae", 2).alias("retained_mae"), "retained_n", F.round("reference_mae", 2).alias("reference_mae"), F.round("ratio", 8).alias("ratio"))


@query("""SELECT 'C01' AS claim, 'daily' AS evidence, printf('%d sensors on %d days', count(DISTINCT o_orderpriority), count(DISTINCT CAST(o_orderdate AS DATE))) AS statement FROM orders""")
def sy_claims(spark, sf_dir):
    rules = [("C01", "daily", "%d sensors on %d days", [F.count_distinct("sensor"), F.count_distinct("day")], F.col("a0") > 0)]
    return synthesis.claims({"daily": daily_levels(spark, sf_dir)}, rules)


from . import suite_archives, suite_contracts, suite_series  # noqa: E402, F401  (register their queries)
