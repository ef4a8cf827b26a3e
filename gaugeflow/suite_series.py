"""Queries over daily series: lag tables, changepoints in context, daily semantics, panels of the rolling run."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import coverage, quality, series
from .plans import changepoints, daily_lags, forecast, panels, rolling
from .suite import _DAILY, _DECIDED, _FLAGS, _ROLL, _WY, _rolling, daily_levels, observations, query, table

# -- lag table ----------------------------------------------------------------------------------

_PAIRS = """(VALUES ('w1', DATE '1995-01-01', DATE '1998-06-01', '5-LOW', '1-URGENT'), ('w1', DATE '1995-01-01', DATE '1998-06-01', '1-URGENT', '2-HIGH'), ('w2', DATE '1998-01-01', DATE '2001-01-01', '5-LOW', '2-HIGH'),
 ('w3', DATE '2010-01-01', DATE '2011-01-01', '5-LOW', '2-HIGH')) AS t({0}, start, stop, predictor, response)"""


def _analysis(spark, sf_dir):
    """Daily levels, 5-LOW as rain; its interval sums are line items by day."""
    rain = (table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"), F.count("*").alias("coverage_count"))
            .select(F.lit("5-LOW").alias("sensor"), "day", "value", "coverage_count", (F.col("coverage_count") / 96.0).alias("coverage_fraction"), F.lit("s").alias("segment"), (F.col("coverage_count") >= 3).alias("eligible")))
    return series.daily_analysis(daily_levels(spark, sf_dir), rain, cumulative=("5-LOW",), same_water_year=("2-HIGH",))


def _lags(spark, sf_dir, draws=None):
    pairs = spark.sql("SELECT * FROM " + _PAIRS.format("`window`"))
    return daily_lags.daily_lags(_analysis(spark, sf_dir), pairs, ["5-LOW"], 30, draws)


_LAGS = f"""WITH {_DAILY}, c AS (SELECT *, lag(day) OVER q AS d1, lag(value) OVER q AS v1, lag(segment) OVER q AS s1, lag(eligible) OVER q AS e1 FROM daily WINDOW q AS (PARTITION BY sensor ORDER BY day)),
long AS (
  SELECT sensor, day, CASE WHEN sensor = '5-LOW' THEN 'daily_cumulative_level' ELSE 'daily_level' END AS tr, value FROM daily WHERE eligible
  UNION ALL SELECT sensor, day, CASE WHEN sensor = '5-LOW' THEN 'daily_cumulative_difference' ELSE 'daily_first_difference' END, value - v1 FROM c
    WHERE eligible AND e1 AND day - d1 = 1 AND segment = s1 AND (sensor NOT IN ('5-LOW', '2-HIGH') OR {_WY.format('day')} = {_WY.format('d1')})
  UNION ALL SELECT '5-LOW', CAST(l_shipdate AS DATE), 'interval_daily_total', round(sum(l_extendedprice), 2) FROM lineitem GROUP BY 2 HAVING count(*) >= 3),
prep(rain, method, pt, rt, def) AS (VALUES
  (true, 'naive_levels', 'daily_cumulative_level', 'daily_level', 'published_cumulative'), (true, 'transformed', 'daily_cumulative_difference', 'daily_first_difference', 'cumulative_daily_difference'),
  (true, 'transformed', 'interval_daily_total', 'daily_first_difference', '15_minute_interval_sum'), (true, 'prewhitened', 'daily_cumulative_difference', 'daily_first_difference', 'cumulative_daily_difference'),
  (true, 'prewhitened', 'interval_daily_total', 'daily_first_difference', '15_minute_interval_sum'), (false, 'naive_levels', 'daily_level', 'daily_level', 'not_applicable'),
  (false, 'transformed', 'daily_first_difference', 'daily_first_difference', 'not_applicable'), (false, 'prewhitened', 'daily_first_difference', 'daily_first_difference', 'not_applicable')),
cfg AS (SELECT row_number() OVER () AS id, w.*, prep.* FROM {_PAIRS.format('win').replace('AS t(', 'AS w(')} JOIN prep ON prep.rain = (predictor = '5-LOW')),
x AS (SELECT id, day, value AS x FROM cfg JOIN long ON sensor = predictor AND tr = pt AND day >= start AND day < stop),
y AS (SELECT id, day, value AS y FROM cfg JOIN long ON sensor = response AND tr = rt AND day >= start AND day < stop),
both_ AS (SELECT id, day, x, y, method FROM x FULL JOIN y USING (id, day) JOIN cfg USING (id)),
step AS (SELECT *, CASE WHEN day - lag(day) OVER q = 1 THEN lag(x) OVER q END AS x1, CASE WHEN day - lag(day) OVER q = 1 THEN lag(y) OVER q END AS y1, avg(x) OVER (PARTITION BY id) AS m FROM both_ WHERE method = 'prewhitened' WINDOW q AS (PARTITION BY id ORDER BY day)),
fit AS (SELECT id, CASE WHEN sum((x1 - m) * (x1 - m)) > 0 THEN sum((x - m) * (x1 - m)) / sum((x1 - m) * (x1 - m)) ELSE 0 END AS phi FROM step WHERE x IS NOT NULL AND x1 IS NOT NULL GROUP BY id HAVING count(*) >= 20),
ready AS (SELECT id, day, x, y FROM both_ WHERE method <> 'prewhitened' UNION ALL SELECT id, day, x - phi * x1, y - phi * y1 FROM step JOIN fit USING (id)),
curve AS (
  SELECT cfg.id, g.lag, count(b.y) AS n, CASE WHEN count(b.y) >= 3 AND var_pop(a.x) FILTER (b.y IS NOT NULL) > 0 AND var_pop(b.y) > 0
    THEN covar_pop(a.x, b.y) / (stddev_pop(a.x) FILTER (b.y IS NOT NULL) * stddev_pop(b.y)) END AS corr
  FROM cfg CROSS JOIN (SELECT unnest(range(0, 31)) AS lag) g LEFT JOIN ready a ON a.id = cfg.id AND a.x IS NOT NULL LEFT JOIN ready b ON b.id = cfg.id AND b.day = a.day + CAST(g.lag AS INT) AND b.y IS NOT NULL GROUP BY ALL)"""
_CFG = "win AS \"window\", predictor, response, method, def AS rain_definition"


@query(f"""{_LAGS} SELECT {_CFG}, pt AS predictor_transformation, rt AS response_transformation, CAST(lag AS INT) AS lag, n AS n_pairs, round(corr, 5) AS correlation, round(phi, 8) AS phi FROM curve JOIN cfg USING (id) LEFT JOIN fit USING (id)""")
def st_daily_lags(spark, sf_dir):
    curves, _ = _lags(spark, sf_dir)
    return curves.withColumns({"correlation": F.round("correlation", 5), "phi": F.round("phi", 8)})


@query(f"""{_LAGS}, top AS (SELECT DISTINCT ON (id) * FROM curve WHERE corr IS NOT NULL ORDER BY id, abs(corr) DESC, lag)
SELECT {_CFG}, start AS window_start, stop AS window_stop, CASE WHEN top.id IS NOT NULL THEN 'ok' WHEN NOT EXISTS (SELECT 1 FROM x WHERE x.id = cfg.id) OR NOT EXISTS (SELECT 1 FROM y WHERE y.id = cfg.id) THEN 'no_series'
  WHEN method = 'prewhitened' AND fit.id IS NULL THEN 'insufficient_prewhitening_pairs' ELSE 'no_correlation' END AS status, CAST(lag AS INT) AS peak_lag, round(corr, 5) AS peak_correlation, n AS peak_pairs, round(phi, 8) AS phi,
  CASE WHEN lag IS NOT NULL THEN CAST(least(30, greatest(2, n // 4)) AS INT) END AS block_length FROM cfg LEFT JOIN top USING (id) LEFT JOIN fit USING (id)""")
def st_daily_lag_peaks(spark, sf_dir):
    """Every configuration with its status; the bootstrap interval, which draws random numbers, is held by tests."""
    _, peaks = _lags(spark, sf_dir)
    return peaks.drop("predictor_transformation", "response_transformation").withColumns({"peak_correlation": F.round("peak_correlation", 5), "phi": F.round("phi", 8)})


@query(f"""{_LAGS} SELECT win AS "window", predictor, response, method || '; ' || replace(def, '_', ' ') AS line, CAST(lag AS INT) AS lag, round(corr, 5) AS correlation FROM curve JOIN cfg USING (id) WHERE rain AND method <> 'naive_levels'""")
def pd_lag_panels(spark, sf_dir):
    return panels.lag_panels(_lags(spark, sf_dir)[0], ["5-LOW"]).withColumn("correlation", F.round("correlation", 5))


# -- changepoints in context --------------------------------------------------------------------

_STARTS = "(VALUES ('A', DATE '1996-03-05', 'new cable'), ('N', DATE '1998-01-01', 'moved'), ('R', DATE '1997-05-20', 'new head'), ('R', DATE '1997-05-24', 'new base')) AS t(sensor, day, reason)"
_FIXED = "(VALUES (DATE '1997-03-16', 'topple', 1), (DATE '1999-02-02', 'gauge stopped', 2), (DATE '1999-02-10', 'gauge resumed', 3)) AS t(day, context, position)"
_STORMS = "(VALUES (DATE '1996-11-30'), (DATE '1999-04-24'), (DATE '2000-06-03')) AS t(day)"
_RUNS = f"""WITH lv AS (SELECT l_returnflag AS sensor, CAST(l_shipdate AS DATE) AS day, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY ALL),
seg AS (SELECT *, CASE WHEN day < DATE '1998-01-01' THEN 'a' ELSE 'b' END AS segment, {_WY.format('day')} AS water_year FROM lv),
gap AS (SELECT *, CASE WHEN day - lag(day) OVER q = 1 THEN 0 ELSE 1 END AS g FROM seg WINDOW q AS (PARTITION BY sensor, segment, water_year ORDER BY day)),
num AS (SELECT *, CAST(sum(g) OVER (PARTITION BY sensor, segment, water_year ORDER BY day) AS BIGINT) AS run_no FROM gap),
runs AS (SELECT *, sensor || '__' || segment || '__WY' || water_year || '__r' || run_no AS run FROM num QUALIFY count(*) OVER (PARTITION BY sensor, segment, water_year, run_no) >= 60),
det AS (
  SELECT run, day, 'pelt' AS method, 'multiplier_' || k AS setting FROM runs, (SELECT unnest([1, 2, 4]) AS k) WHERE dayofyear(day) % (17 * k) = 0
  UNION ALL SELECT run, day, 'binary', 'breaks_' || k FROM runs, (SELECT unnest([1, 2, 3]) AS k) WHERE (dayofyear(day) + 2) % (23 * k) = 0)"""


def _runs(spark, sf_dir):
    """Line items by return flag and day in runs within a segment and water year."""
    keys = ["sensor", "segment", "water_year"]
    lv = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("sensor"), F.to_date("l_shipdate").alias("day")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
    lv = lv.withColumns({"segment": F.when(F.col("day") < "1998-01-01", "a").otherwise("b"), "water_year": F.year("day") + (F.month("day") >= 10).cast("int"), "window": F.lit("all")})
    runs = series.contiguous_runs(lv, keys, 60)
    return runs.withColumn("run", F.concat(F.col("sensor"), F.lit("__"), F.col("segment"), F.lit("__WY"), F.col("water_year").cast("string"), F.lit("__r"), F.col("run_no").cast("string")))


def _fixed_detections(runs):
    """Detections that follow from the calendar of the runs' days, for what comes after detecting."""
    y = F.dayofyear("day")
    pelt = runs.withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 4))))).where(y % (17 * F.col("k")) == 0).select("run", F.lit("pelt").alias("method"), F.concat(F.lit("multiplier_"), "k").alias("setting"), F.col("day").alias("candidate_day"))
    binary = runs.withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3))))).where((y + 2) % (23 * F.col("k")) == 0).select("run", F.lit("binary").alias("method"), F.concat(F.lit("breaks_"), "k").alias("setting"), F.col("day").alias("candidate_day"))
    return pelt.unionByName(binary)


def _contexts(spark):
    return (spark.sql(f"SELECT * FROM {_STARTS}"), spark.sql(f"SELECT * FROM {_FIXED}"), spark.sql(f"SELECT * FROM {_STORMS}"))


_IN_CONTEXT = f"""{_RUNS},
q95 AS (SELECT run, any_value(sensor) AS sensor, any_value(segment) AS segment, any_value(water_year) AS water_year, quantile_cont(abs(value), 0.95) AS q95 FROM runs GROUP BY run),
u AS (SELECT DISTINCT run, day FROM det), cl AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY run ORDER BY day) <= 7 THEN 0 ELSE 1 END AS g FROM u), cn AS (SELECT *, CAST(sum(g) OVER (PARTITION BY run ORDER BY day) AS BIGINT) AS cluster FROM cl),
mid AS (SELECT run, cluster, DATE '1970-01-01' + CAST(floor(quantile_cont(CAST(day - DATE '1970-01-01' AS DOUBLE), 0.5)) AS INT) AS point, min(day) AS first_day, max(day) AS last_day FROM cn GROUP BY ALL),
sup AS (SELECT run, cluster, count(DISTINCT method || ':' || setting) AS n_settings, count(DISTINCT method) AS n_methods, string_agg(DISTINCT method, ';' ORDER BY method) AS methods FROM cn JOIN det USING (run, day) GROUP BY ALL),
meta AS (
  SELECT q95.run, s.day, 'target_' || replace(reason, ' ', '_') AS context, 0 AS class, row_number() OVER (ORDER BY s.day) AS position FROM q95 JOIN {_STARTS.replace('AS t', 'AS s')} USING (sensor)
  UNION ALL SELECT run, f.day, f.context, 1, f.position FROM q95, {_FIXED.replace('AS t', 'AS f')}
  UNION ALL SELECT DISTINCT run, make_date(CAST(year(point) AS BIGINT) + k, 10, 1), 'water_year_reset', 2, 0 FROM mid, (VALUES (-1), (0)) o(k)),
event AS (SELECT run, s.day, 'selected_rain_event' AS context, 0 AS class, 0 AS position FROM q95, {_STORMS.replace('AS t', 'AS s')} UNION ALL SELECT run, day, 'run_q95_displacement_episode', 1, 0 FROM runs JOIN q95 USING (run) WHERE abs(value) > q95.q95),
nm AS (SELECT DISTINCT ON (m.run, m.cluster) m.run, m.cluster, c.day, c.context FROM mid m JOIN meta c ON c.run = m.run AND abs(c.day - m.point) <= 7 ORDER BY m.run, m.cluster, abs(c.day - m.point), class, position),
ne AS (SELECT DISTINCT ON (m.run, m.cluster) m.run, m.cluster, c.day, c.context FROM mid m JOIN event c ON c.run = m.run AND abs(c.day - m.point) <= 7 ORDER BY m.run, m.cluster, abs(c.day - m.point), class, position, c.day),
cand AS (
  SELECT run || '__c' || lpad(CAST(cluster AS VARCHAR), 2, '0') AS candidate, run, 'all' AS "window", sensor, segment, water_year, point AS candidate_day, first_day, last_day, n_settings, methods,
    CASE WHEN n_settings >= 2 AND n_methods >= 2 THEN 'method_stable' WHEN n_settings >= 2 THEN 'within_method_only' ELSE 'unstable' END AS stability,
    CASE WHEN nm.run IS NOT NULL THEN 'metadata_aligned' WHEN ne.run IS NOT NULL THEN 'event_aligned' ELSE 'unexplained' END AS classification, coalesce(strftime(coalesce(nm.day, ne.day), '%Y-%m-%d'), 'none') AS context_day,
    coalesce(nm.context, ne.context, 'none') AS context, coalesce(CAST(point - coalesce(nm.day, ne.day) AS VARCHAR), 'not_applicable') AS offset_days, 'statistical_candidate_not_a_physical_slope_regime_claim' AS "limit"
  FROM mid JOIN sup USING (run, cluster) JOIN q95 USING (run) LEFT JOIN nm USING (run, cluster) LEFT JOIN ne USING (run, cluster))"""


@query(f"{_IN_CONTEXT} SELECT * FROM cand")
def cp_contexts(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return changepoints.candidates_in_context(_fixed_detections(runs), runs, *_contexts(spark))


@query(f"{_IN_CONTEXT} SELECT stability, classification, count(*) AS n FROM cand GROUP BY ALL")
def pd_candidate_counts(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return panels.reading_counts(changepoints.candidates_in_context(_fixed_detections(runs), runs, *_contexts(spark)), ["stability"], "classification")


@query(f"""{_RUNS}, n AS (SELECT run, count(*) AS n FROM det GROUP BY 1) SELECT run, min(day) AS first_day, max(day) AS last_day, count(*) AS n_days,
 CAST(CASE WHEN count(*) >= 60 THEN 3 + CAST(count(*) >= 60 AS INT) + CAST(count(*) >= 90 AS INT) + CAST(count(*) >= 120 AS INT) ELSE 0 END AS INT) AS n_settings, coalesce(any_value(n.n), 0) AS n_detections FROM runs LEFT JOIN n USING (run) GROUP BY run""")
def cp_run_summary(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return changepoints.run_summary(runs, _fixed_detections(runs), ["run"])


@query(f"""{_RUNS} SELECT run, day AS candidate_day, method || ': ' || setting AS method_setting FROM det""")
def pd_method_settings(spark, sf_dir):
    return panels.method_settings(_fixed_detections(_runs(spark, sf_dir))).select("run", "candidate_day", "method_setting")


@query()
def cp_detected_in_context(spark, sf_dir):
    """Both detectors on every run, and their candidates in context. The detectors have no SQL; tests hold them against optimal partitions."""
    runs = _runs(spark, sf_dir)
    return changepoints.candidates_in_context(changepoints.detect(runs.select("run", "day", "value"), ["run"]), runs, *_contexts(spark))


# -- daily semantics ----------------------------------------------------------------------------

def _fine(spark, sf_dir):
    """Observations with purchases as rain in two roles, and daily values of which some differ and some repeat."""
    o = quality.flagged(observations(spark, sf_dir)).select("sensor", "product", "stamp", "value", "row_no")
    rain = F.col("sensor") == "purchase"
    fine = o.withColumn("role", F.when(rain, "interval_precipitation").otherwise("15_minute_observation")).unionByName(o.where(rain).select(*o.columns, F.lit("cumulative_precipitation").alias("role")).withColumn("value", F.col("value") + 1))
    days = fine.where("value is not null").groupBy("sensor", F.to_date("stamp").alias("day")).agg(F.max("value").alias("top"), F.percentile("value", F.lit(0.5)).alias("middle"))
    off = (F.day("day") % 7 == 0).cast("double")
    daily = days.select("sensor", "day", (F.when(rain, F.col("top")).otherwise(F.col("middle")) + off).alias("value"), F.lit(1).alias("order"))
    return fine, daily.unionByName(daily.where((F.day("day") % 9 == 0) & (F.col("sensor") == "click")).withColumns({"value": F.lit(-5.0), "order": F.lit(2)}))


_FINE = f"""{_FLAGS}, fine AS (SELECT sensor, stamp, value, CASE WHEN sensor = 'purchase' THEN 'interval_precipitation' ELSE '15_minute_observation' END AS role FROM flagged UNION ALL SELECT sensor, stamp, value + 1, 'cumulative_precipitation' FROM flagged WHERE sensor = 'purchase'),
days AS (SELECT sensor, day, CASE WHEN sensor = 'purchase' THEN top ELSE middle END + CAST(day(day) % 7 = 0 AS INT) AS value FROM (SELECT sensor, CAST(stamp AS DATE) AS day, max(value) AS top, quantile_cont(value, 0.5) AS middle FROM fine WHERE value IS NOT NULL GROUP BY ALL)),
again AS (SELECT sensor, role, CAST(stamp AS DATE) AS day, CASE WHEN any_value(sensor) = 'purchase' THEN max(value) ELSE quantile_cont(value, 0.5) END AS again FROM fine WHERE value IS NOT NULL GROUP BY sensor, role, CAST(stamp AS DATE))"""


@query(f"""{_FINE}, dup AS (SELECT sensor, count(*) AS n_daily_days, CASE WHEN sensor = 'click' THEN 2 * count(*) FILTER (day(day) % 9 = 0) ELSE 0 END AS n_duplicate_rows FROM days GROUP BY sensor),
j AS (SELECT a.sensor, role, a.day, d.value, abs(d.value - again) AS diff FROM again a LEFT JOIN days d USING (sensor, day)),
y AS (SELECT sensor, role, string_agg(CAST(yr AS VARCHAR), ';' ORDER BY yr) AS years FROM (SELECT DISTINCT sensor, role, year(day) AS yr FROM j WHERE diff > 1e-12) GROUP BY ALL)
SELECT sensor, CASE WHEN sensor = 'purchase' THEN 'daily_rainfall_maximum' ELSE 'daily_median' END AS daily_role, role, CASE WHEN sensor = 'purchase' THEN 'maximum' ELSE 'median' END AS aggregation, any_value(n_daily_days) AS n_daily_days, count(*) AS n_fine_days,
  count(value) AS n_comparable, count(*) FILTER (diff <= 1e-12) AS n_match, count(*) FILTER (diff > 1e-12) AS n_mismatch, coalesce(any_value(years), 'none') AS mismatch_years, round(max(diff), 12) AS max_difference, any_value(n_duplicate_rows) AS n_duplicate_rows
FROM j JOIN dup USING (sensor) LEFT JOIN y USING (sensor, role) GROUP BY sensor, role""")
def ag_daily_relationship(spark, sf_dir):
    return coverage.daily_relationship(*_fine(spark, sf_dir), ["purchase"])


@query(f"""{_FINE} SELECT d.sensor, d.day, d.value, d.sensor <> 'purchase' OR coalesce(abs(d.value - a.again) <= 1e-12, false) AS daily_semantics_match FROM days d LEFT JOIN again a ON a.sensor = d.sensor AND a.day = d.day AND a.role = 'cumulative_precipitation'""")
def ag_semantics_match(spark, sf_dir):
    fine, daily = _fine(spark, sf_dir)
    return coverage.semantics_match(daily.where("order = 1").drop("order"), fine, ["purchase"])


@query(f"""{_FINE} SELECT sensor, role, count(*) AS n, round(sum(value), 4) AS total FROM fine WHERE sensor IN ('click', 'purchase') AND role = CASE WHEN sensor = 'purchase' THEN 'cumulative_precipitation' ELSE '15_minute_observation' END GROUP BY ALL""")
def pj_preferred_rows(spark, sf_dir):
    chosen = coverage.preferred_rows(_fine(spark, sf_dir)[0], "15_minute", ["click", "purchase"], ["purchase"], "cumulative_precipitation")
    return chosen.groupBy("sensor", "role").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# -- panels -------------------------------------------------------------------------------------

@query(f"""WITH {_DAILY}, q AS (SELECT sensor, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM daily GROUP BY 1), s AS (SELECT d.* FROM daily d JOIN q USING (sensor) WHERE value BETWEEN lo AND hi),
 e AS (SELECT sensor, min(value) AS lowest, max(value) AS highest, count(*) AS n_shown FROM s GROUP BY 1), c AS (SELECT sensor, least(45, CAST(floor((value - lowest) / ((highest - lowest) / 45)) AS INT) + 1) AS bin, count(*) AS n FROM s JOIN e USING (sensor) GROUP BY ALL)
 SELECT sensor, CAST(g.bin AS INT) AS bin, round(lowest + (g.bin - 1) * ((highest - lowest) / 45), 4) AS left_edge, coalesce(n, 0) AS n, n_shown FROM e CROSS JOIN (SELECT unnest(range(1, 46)) AS bin) g LEFT JOIN c USING (sensor, bin)""")
def pd_histogram(spark, sf_dir):
    return panels.trimmed_histogram(daily_levels(spark, sf_dir), ["sensor"]).withColumn("left_edge", F.round("left_edge", 4))


@query(f"""WITH {_DAILY} SELECT sensor, segment, day, value FROM daily WHERE sensor IN ('1-URGENT', '2-HIGH') AND eligible""")
def pd_level_regimes(spark, sf_dir):
    return panels.level_regimes(_analysis(spark, sf_dir), ["1-URGENT", "2-HIGH"])


@query(f"""{_RUNS}, n AS (SELECT sensor, run, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM runs GROUP BY ALL) SELECT DISTINCT ON (sensor) * FROM n ORDER BY sensor, n DESC, run""")
def pd_longest_examples(spark, sf_dir):
    n = _runs(spark, sf_dir).groupBy("sensor", "run").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return panels.longest_example(n, ["sensor"], ["run"])


@query(f"""{_ROLL}, m AS (SELECT win, horizon, stage, model, count(*) FILTER (status = 'ok') / nullif(count(*) FILTER (core_eligible), 0) AS coverage, avg(abs(error)) AS mae FROM att WHERE stage <> 'selection' GROUP BY ALL HAVING avg(abs(error)) IS NOT NULL)
 SELECT win AS "window", horizon, stage, model, round(coverage, 8) AS coverage, round(mae, 2) AS mae, CAST(row_number() OVER (PARTITION BY win, horizon, stage ORDER BY mae, model) AS INT) AS place, round(mae / nullif(max(CASE WHEN model = 'zero_change' THEN mae END) OVER (PARTITION BY win, horizon, stage), 0), 6) AS ratio_to_reference FROM m""")
def pd_mae_panels(spark, sf_dir):
    p = panels.mae_panels(_rolling(spark, sf_dir)[0], ["window", "horizon"])
    return p.withColumns({"coverage": F.round("coverage", 8), "mae": F.round("mae", 2), "ratio_to_reference": F.round("ratio_to_reference", 6)})


def _level_sql(level: int, z: str) -> str:
    a = 2 * 100 // (100 - level)
    return f"""SELECT win, sensor, stage, horizon, model, CAST({level / 100} AS DOUBLE) AS level, count(*) FILTER (lo IS NOT NULL AND observed IS NOT NULL) AS n_intervals, avg(CASE WHEN lo IS NOT NULL AND observed IS NOT NULL THEN CAST(observed BETWEEN lo AND hi AS INT) END) AS coverage,
  avg(CASE WHEN observed IS NOT NULL THEN hi - lo END) AS width, avg(CASE WHEN observed IS NOT NULL THEN hi - lo + {a} * greatest(lo - observed, 0) + {a} * greatest(observed - hi, 0) END) AS score FROM
  (SELECT att.*, CASE WHEN status = 'ok' AND model = 'arx' THEN prediction - {z} * sqrt(v) WHEN n_cal >= 30 THEN prediction + lo END AS lo, CASE WHEN status = 'ok' AND model = 'arx' THEN prediction + {z} * sqrt(v) WHEN n_cal >= 30 THEN prediction + hi END AS hi
   FROM att LEFT JOIN (SELECT h.win, h.model, h.horizon, h.origin, count(*) AS n_cal, quantile_cont(p.error, {(100 - level) / 200}) AS lo, quantile_cont(p.error, {(100 + level) / 200}) AS hi
     FROM att h JOIN att p ON p.win = h.win AND p.model = h.model AND p.horizon = h.horizon AND p.origin < h.origin AND p.target_date <= h.origin AND p.error IS NOT NULL WHERE h.prediction IS NOT NULL AND h.model <> 'arx' GROUP BY ALL) USING (win, model, horizon, origin)) GROUP BY ALL"""


_BOTH = f"{_DECIDED}, iv AS ({_level_sql(80, '1.2815515655446004')} UNION ALL {_level_sql(95, '1.959963984540054')})"
_IV = 'i.win AS "window", i.sensor, i.stage, i.horizon, i.model, level, n_intervals, round(coverage, 8) AS coverage, CASE WHEN i.model = \'arx\' THEN round(width, 0) ELSE round(width, 1) END AS width, CASE WHEN i.model = \'arx\' THEN round(score, 0) ELSE round(score, 1) END AS score'


def _shown(df):
    near = lambda c: F.when(F.col("model") == "arx", F.round(c, 0)).otherwise(F.round(c, 1))
    return df.withColumns({"coverage": F.round("coverage", 8), "width": near("width"), "score": near("score")})


@query(f"{_BOTH} SELECT {_IV} FROM iv i")
def fc_interval_levels(spark, sf_dir):
    """Both levels by window, stage, horizon and model."""
    return _shown(forecast.interval_levels(_rolling(spark, sf_dir)[0], ["window", "sensor", "stage", "horizon", "model"]))


@query(f"""{_BOTH} SELECT {_IV} FROM iv i WHERE i.stage = 'evaluation' AND EXISTS (SELECT 1 FROM base b WHERE b.win = i.win AND b.sensor = i.sensor AND b.horizon = i.horizon AND i.model IN (b.retained, 'zero_change'))""")
def pd_retained_intervals(spark, sf_dir):
    """Intervals of the retained models beside zero change; selection and panel read one table of attempts."""
    attempts, _ = _rolling(spark, sf_dir)
    return _shown(panels.retained_rows(forecast.interval_levels(attempts, ["window", "sensor", "stage", "horizon", "model"]), rolling.selection_decisions(attempts)))


_STRATA = f"""{_DECIDED}, ok AS (SELECT * FROM att WHERE status = 'ok'), str AS (
  SELECT win, sensor, stage, horizon, model, d.dimension, d.level, count(*) AS n_forecasts, avg(abs(error)) AS mae, sqrt(avg(error * error)) AS rmse, avg(error) AS bias, avg(abs(error) / mase_scale) AS mase
  FROM ok, LATERAL (VALUES ('water_year', CAST({_WY.format('target_date')} AS VARCHAR)), ('season', CASE WHEN month(target_date) IN (10,11,12,1,2,3,4) THEN 'wet' ELSE 'dry' END),
    ('movement_subset', CASE WHEN abs(observed) > high_movement THEN 'training_q95_high_movement' ELSE 'not_training_q95_high_movement' END), ('evaluation_half', half)) d(dimension, level) GROUP BY ALL)"""
_ST = 's.win AS "window", s.sensor, s.stage, s.horizon, s.model, dimension, level, n_forecasts, round(mae, 1) AS mae, round(rmse, 1) AS rmse, round(bias, 1) AS bias, round(mase, 5) AS mase'


def _errors(df):
    return df.withColumns({**{c: F.round(c, 1) for c in ("mae", "rmse", "bias")}, "mase": F.round("mase", 5)})


@query(f"{_STRATA} SELECT {_ST} FROM str s")
def fc_stratified_errors(spark, sf_dir):
    """All four dimensions."""
    return _errors(panels.stratified_errors(_rolling(spark, sf_dir)[0], ["window", "sensor", "stage", "horizon", "model"]))


@query(f"""{_STRATA} SELECT {_ST} FROM str s WHERE s.stage = 'evaluation' AND dimension = 'water_year' AND EXISTS (SELECT 1 FROM base b WHERE b.win = s.win AND b.sensor = s.sensor AND b.horizon = s.horizon AND s.model IN (b.retained, 'zero_change'))""")
def pd_retained_water_years(spark, sf_dir):
    attempts, _ = _rolling(spark, sf_dir)
    rows = panels.stratified_errors(attempts, ["window", "sensor", "stage", "horizon", "model"]).where("dimension = 'water_year'")
    return _errors(panels.retained_rows(rows, rolling.selection_decisions(attempts)))


@query(f"""{_ROLL} SELECT win AS "window", 'arx' AS model, parameter, origin, round(value, 4) AS value FROM (SELECT c.win, c.origin, d.parameter, d.value FROM coef c JOIN stats s USING (win, origin), LATERAL (VALUES ('ar.L1', phi), ('rain_lag2', beta)) d(parameter, value)
 WHERE training_days >= 365 AND training_targets >= 300) WHERE (win = 'w1' AND parameter = 'ar.L1') OR (win = 'w2' AND parameter = 'rain_lag2')""")
def pd_parameter_paths(spark, sf_dir):
    p = panels.parameter_paths(_rolling(spark, sf_dir)[1], [("w1", "arx", "ar.L1"), ("w2", "arx", "rain_lag2")])
    return p.withColumn("value", F.round("value", 4))
