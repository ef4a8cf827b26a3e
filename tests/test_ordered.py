"""Ordered state in parts, expanding quantiles, and one rolling run, against plain Python."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import parts, series
from gaugeflow.operators.quantiles import expanding_quantiles, kth
from gaugeflow.plans import rolling
from gaugeflow.plans.forecast import past_residual_intervals

D = lambda s: dt.date.fromisoformat(s)


def test_kth_of_two_sorted_arrays():
    rng = np.random.default_rng(1)
    for _ in range(400):
        a, b = (np.sort(rng.integers(0, 8, rng.integers(0, 7)).astype(float)) for _ in range(2))
        both = np.sort(np.concatenate([a, b]))
        assert [kth(a, b, k) for k in range(len(both))] == both.tolist()


def test_expanding_quantiles_are_those_of_all_earlier_values(spark):
    rng = np.random.default_rng(2)
    first = D("1950-01-01")
    rows = [(k, first + dt.timedelta(int(i)), None if rng.random() < 0.1 else float(rng.integers(0, 9))) for k in ("a", None, "b") for i in rng.choice(25_000, 300)]
    rows += [("c", first, None)]
    moments = [(k, first + dt.timedelta(int(i))) for k in ("a", None, "b", "c") for i in [*rng.choice(25_000, 40), 0, 24_999]] + [("gone", first), ("a", None)]
    df = spark.createDataFrame(rows, "k string, day date, v double")
    at = spark.createDataFrame(moments, "k string, t date")
    got = {(r.k, r.t): (r.v_n, r.v_q) for r in expanding_quantiles(df, at, ["k"], "day", "t", {"v": (0.1, 0.5, 0.95)}).collect()}
    assert set(got) == {m for m in moments if m[1] is not None}
    for (k, t), (n, q) in got.items():
        past = [v for kk, d, v in rows if kk == k and d <= t and v is not None]
        assert n == len(past) and (q is None if not n else q == pytest.approx(np.quantile(past, [0.1, 0.5, 0.95]).tolist(), abs=1e-12))


def test_islands_cross_parts(spark):
    rng = np.random.default_rng(3)
    days = {k: sorted(rng.choice(9000, 2500, replace=False).tolist()) for k in ("a", "b", None)} | {"solid": list(range(8000)), "one": [5]}
    rows = [(k, D("1970-01-01") + dt.timedelta(d)) for k, ds in days.items() for d in ds]
    df = spark.createDataFrame(rows, "k string, day date").orderBy(F.rand(1))
    out = parts.islands(df, ["k"], parts.by_years(F.col("day")), "day", F.col("day"), lambda b, o: F.datediff(o["v"], b["v"]) != 1, "run")
    got = {(r.k, (r.day - D("1970-01-01")).days): r.run for r in out.collect()}
    for k, ds in days.items():
        run, last = 0, None
        for d in ds:
            run += last is None or d != last + 1
            assert got[(k, d)] == run
            last = d
    long = series.contiguous_runs(df.where("k = 'solid'"), ["k"], 8000)
    assert {r.run_days for r in long.collect()} == {8000}


def test_runs_and_clusters_have_no_window_over_a_series(spark):
    df = spark.createDataFrame([("s", D("2020-01-01"))], "sensor string, day date")
    for out in (series.contiguous_runs(df, ["sensor"]), series.date_clusters(df, ["sensor"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert all("_part" in line for line in plan.splitlines() if " Window " in line and "row_number" in line)


def test_every_status(spark):
    said = {
        ("conditional_ARX", 7, True, True, True, True, 1.0): "feature_unavailable", ("conditional_ARX", 7, False, False, False, False, None): "feature_unavailable",
        ("conditional_ARX", 1, False, True, True, True, 1.0): "ineligible_core_origin", ("baseline", 1, False, False, False, False, 1.0): "ineligible_core_origin",
        ("ARIMA", 2, True, False, True, True, 1.0): "insufficient_training", ("conditional_ARX", 2, True, True, False, False, None): "insufficient_training",
        ("ARIMA", 7, True, True, False, False, None): "fit_failure", ("ARIMA", 7, True, True, False, True, 1.0): "fit_failure", ("ARIMA", 1, True, True, True, False, None): "forecast_failure",
        ("conditional_ARX", 1, True, True, True, False, None): "feature_unavailable", ("baseline", 2, True, True, False, False, None): "feature_unavailable",
        ("baseline", 7, True, True, False, False, 0.0): "ok", ("ARIMA", 7, True, True, True, True, 2.0): "ok", ("conditional_ARX", 2, True, True, True, False, 2.0): "ok"}
    df = spark.createDataFrame(list(said), "kind string, h int, core boolean, enough boolean, fits boolean, made boolean, point double")
    got = df.withColumn("s", rolling.attempt_status(F.col("kind"), F.col("h"), F.col("core"), F.col("enough"), F.col("fits"), F.col("made"), F.col("point"))).collect()
    assert {tuple(r)[:7]: r.s for r in got} == said


def test_missing_rain_makes_a_feature_unavailable(spark):
    """Of the origins with a fit, one lacks the day before's rain, one its own: 1 and 2 days ahead, and 2 days ahead only, can't be forecast."""
    rng = np.random.default_rng(4)
    start, n = D("2001-01-01"), 540
    day = [start + dt.timedelta(i) for i in range(n)]
    y = np.cumsum(rng.normal(0, 0.1, n)).tolist()
    anchor = D("2002-03-01")
    at = [(anchor - start).days + 14 * k for k in range(3)]
    rain = [float(v) for v in rng.random(n)]
    rain[at[1] - 1] = rain[at[2]] = None
    levels = spark.createDataFrame([("s", d, v, "a", True) for d, v in zip(day, y)], "sensor string, day date, value double, segment string, eligible boolean")
    wet = spark.createDataFrame(list(zip(day, rain)), "day date, rain double")
    windows = spark.createDataFrame([("w", "s", start, day[-1], anchor, D("2002-03-20"), None)], "window string, sensor string, start date, stop date, anchor date, selection_end date, blank_from date")
    a, p = rolling.rolling_forecasts(rolling.target_grid(levels, wet, windows), windows, arima={})
    got = {(at.index((r.origin - start).days), r.horizon): (r.status, r.converged) for r in a.where("model = 'arx'").collect() if (r.origin - start).days in at}
    no, yes = ("feature_unavailable", True), ("ok", True)
    assert got == {(0, 1): yes, (0, 2): yes, (1, 1): no, (1, 2): no, (2, 1): yes, (2, 2): no, **{(k, 7): ("feature_unavailable", False) for k in range(3)}}
    assert {r.converged for r in a.where("family = 'baseline'").collect()} == {True}
    # the fit at the first origin is least squares over all complete equations up to it
    k = at[0]
    eq = [(y[i], 1.0, y[i - 1], rain[i - 2]) for i in range(2, k + 1)]
    x = np.array([e[1:] for e in eq])
    want = np.linalg.lstsq(x, np.array([e[0] for e in eq]), rcond=None)[0]
    mine = {r.parameter: r.value for r in p.where("model = 'arx'").collect() if (r.origin - start).days == k}
    assert [mine["constant"], mine["ar.L1"], mine["rain_lag2"]] == pytest.approx(want.tolist(), abs=1e-8)
    point = a.where("model = 'arx' and horizon = 1").orderBy("origin").first().prediction
    assert point == pytest.approx(want[0] + want[1] * y[k] + want[2] * rain[k - 1], abs=1e-8)


def test_selection_reads_tables_not_plans(spark):
    from gaugeflow import suite

    def exchanges(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return sum("Exchange" in line for line in plan.splitlines())

    sf = "/root/testdata/sf0.001"
    assert max(exchanges(suite.QUERIES[q](spark, sf)) for q in ("fc_attempts", "fc_selection", "sy_key_results")) < 40


def test_residual_intervals_by_brute_force(spark):
    rng = np.random.default_rng(6)
    first = D("2000-01-03")
    rows = [(m, h, first + dt.timedelta(14 * i), first + dt.timedelta(14 * i + h), 1.0, None if rng.random() < 0.1 else float(rng.normal())) for m in "ab" for h in (1, 7, 20) for i in range(60)]
    df = spark.createDataFrame(rows, "model string, horizon int, origin date, target_date date, prediction double, error double")
    for r in past_residual_intervals(df, ["model", "horizon"]).collect():
        past = [e for m, h, o, t, _, e in rows if m == r.model and h == r.horizon and o < r.origin and t <= r.origin and e is not None]
        assert r.n_calibration == len(past)
        if len(past) >= 30:
            assert r.lower_95 == pytest.approx(1 + np.quantile(past, 0.025)) and r.upper_80 == pytest.approx(1 + np.quantile(past, 0.9))
        else:
            assert r.lower_80 is None and r.interval_status == "insufficient_past_calibration"


def test_dependence_is_that_of_the_kernels(spark):
    from gaugeflow.functions import kernels as K
    from gaugeflow.plans import exploratory

    rng = np.random.default_rng(11)
    runs = {"a": np.cumsum(rng.normal(size=400)), "b": rng.normal(size=121), "short": rng.normal(size=119), "flat": np.ones(200)}
    rows = [(k, D("2001-01-01") + dt.timedelta(i), float(v)) for k, x in runs.items() for i, v in enumerate(x)]
    got = {(r.run, r.lag): r for r in exploratory.dependence(spark.createDataFrame(rows, "run string, day date, value double"), ["run"]).collect()}
    assert {k for k, _ in got} == {"a", "b"} and len(got) == 61 + 31
    for k, top in (("a", 60), ("b", 30)):
        assert [got[k, i].acf for i in range(top + 1)] == pytest.approx(K.acf(runs[k], top).tolist(), abs=1e-10)
        assert [got[k, i].pacf for i in range(top + 1)] == pytest.approx(K.pacf(runs[k], top).tolist(), abs=1e-10)
        # order 3 by solving its Yule-Walker equations
        r = K.acf(runs[k], 3)
        want = np.linalg.solve([[r[abs(i - j)] for j in range(3)] for i in range(3)], r[1:4])[-1]
        assert got[k, 3].pacf == pytest.approx(want, abs=1e-10)


def test_residual_diagnostics_of_few_and_constant_errors(spark):
    from gaugeflow.functions import kernels as K
    from gaugeflow.plans import exploratory

    rng = np.random.default_rng(12)
    errors = {"many": rng.normal(size=70).tolist(), "two": [1.0, 2.0], "flat": [3.0] * 12, "gone": [None]}
    rows = [(k, D("2001-01-01") + dt.timedelta(14 * i), e) for k, x in errors.items() for i, e in enumerate(x)]
    got = {(r.model, r.lag): r for r in exploratory.residual_diagnostics(spark.createDataFrame(rows, "model string, origin date, error double"), ["model"]).collect()}
    assert len(got) == 33 and all(got[k, 0].acf == 1 for k in ("many", "two", "flat")) and all(got[k, 1].acf is None for k in ("two", "flat"))
    e = np.array(errors["many"])
    q, p = K.ljung_box(e, 10)
    m = got["many", 4]
    assert [got["many", i].acf for i in range(11)] == pytest.approx(K.acf(e, 10).tolist()) and (m.ljung_box, m.ljung_box_p, m.ljung_box_lag) == (pytest.approx(q), pytest.approx(p), 10)
    assert got["two", 1].ljung_box is None and got["flat", 1].ljung_box is None and got["flat", 1].skew is None


def test_losses_at_once_are_those_of_the_filter():
    from gaugeflow.functions import kernels as K

    rng = np.random.default_rng(13)
    for spec in ((0, 0, 0, 7), (1, 0, 0, 7), (2, 0, 0, 7), (1, 1, 0, 7), (1, 0, 1, 7)):
        y = rng.normal(size=160)
        y[rng.choice(160, 30, replace=False)] = np.nan
        xs = rng.normal(size=(5, 1 + spec[0] + spec[1] + spec[2])) * 0.5
        want = [-K._filter(y, x[0], *K._polynomials(spec, x[1:]))[0] / 130 for x in xs]
        assert K._losses(y, np.isfinite(y), spec, xs).tolist() == pytest.approx(want, abs=1e-10)
