"""Behaviour of single operators on small frames."""

import datetime as dt
import io
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import kernels as K
from gaugeflow.operators import align, lags, quality, regimes, series
from gaugeflow.plans import changepoints, contracts, forecast
from gaugeflow.sources import archives, sinks

D = lambda s: dt.date.fromisoformat(s)
T = lambda s: dt.datetime.fromisoformat(s)
LEVEL = "sensor string, day date, value double, segment string, eligible boolean"


def test_changes_do_not_bridge_gaps_years_or_segments(spark):
    rows = [("s", D("2020-09-29"), 1.0, "a", True), ("s", D("2020-09-30"), 3.0, "a", True), ("s", D("2020-10-01"), 4.0, "a", True), ("s", D("2020-10-03"), 9.0, "a", True), ("s", D("2020-10-04"), 10.0, "b", True), ("s", D("2020-10-05"), 12.0, "b", True)]
    out = {r.day.isoformat(): (r.value, r.eligible) for r in series.daily_changes(spark.createDataFrame(rows, LEVEL), same_water_year=True).collect()}
    assert out["2020-09-30"] == (2.0, True)
    assert out["2020-10-01"] == (1.0, False)
    assert out["2020-10-03"] == (5.0, False)
    assert out["2020-10-04"] == (1.0, False)
    assert out["2020-10-05"] == (2.0, True)


def test_range_concern_is_kept_eligible(spark):
    df = spark.createDataFrame([(T("2020-01-01 00:00"), 99.0, True), (T("2020-01-01 00:15"), None, False)], "stamp timestamp_ntz, value double, flag_metadata_range_concern boolean")
    df = df.withColumns({f: F.lit(False) for f in quality.FATAL})
    got = quality.level_eligibility(df).orderBy("stamp").collect()
    assert [(r.eligible, r.retains_range_concern) for r in got] == [(True, True), (False, False)]


def test_positive_lag_means_predictor_leads(spark):
    x = [3.0, -1.0, 4.0, 1.0, -5.0, 9.0, 2.0, 6.0]
    p = spark.createDataFrame([(D("2020-01-01") + dt.timedelta(i), v) for i, v in enumerate(x)], "day date, value double")
    r = p.select(F.date_add("day", 2).alias("day"), "value")
    assert lags.peak_lag(lags.lag_curve(lags.lag_pairs(p, r, 4))).first()["lag"] == 2


def test_alignment_never_reuses_and_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    base = T("2020-01-01 00:00")
    left, right = (sorted({base + dt.timedelta(minutes=int(m)) for m in rng.integers(0, 600, 60)}) for _ in range(2))
    frame = lambda s: spark.createDataFrame([("k", x, float(i)) for i, x in enumerate(s)], "k string, stamp timestamp_ntz, value double")
    got = {(r.left_stamp, r.right_stamp) for r in align.one_to_one(align.nearest_candidates(frame(left), frame(right), 480, ["k"]), ["k"]).collect()}
    pairs = sorted((abs((a - b).total_seconds()), a, b) for a in left for b in right if abs((a - b).total_seconds()) <= 480)
    used_a, used_b, want = set(), set(), set()
    for _, a, b in pairs:
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            want.add((a, b))
    assert got == want


def test_no_candidates_is_an_empty_frame(spark):
    e = spark.createDataFrame([], "k string, stamp timestamp_ntz, value double")
    assert align.one_to_one(align.nearest_candidates(e, e, 60, ["k"]), ["k"]).count() == 0


def test_separated_events(spark):
    rows = [(D("2020-01-01"), 5.0), (D("2020-01-05"), 9.0), (D("2020-01-12"), 9.0), (D("2020-01-13"), 8.0), (D("2020-02-01"), 1.0)]
    got = align.separated_top(spark.createDataFrame(rows, "day date, value double"), 3, 7).orderBy("rank").collect()
    assert [r.day.isoformat() for r in got] == ["2020-01-05", "2020-01-12", "2020-02-01"]


def test_segments_are_half_open_and_operating_days_inclusive(spark):
    obs = spark.createDataFrame([("a", T("2020-01-01 00:00")), ("a", T("2020-01-02 00:00")), ("a", T("2020-01-03 23:59")), ("a", T("2020-01-04 00:00"))], "sensor string, stamp timestamp_ntz")
    starts = spark.createDataFrame([("a", "s1", T("2020-01-01 12:00")), ("a", "s2", T("2020-01-02 00:00"))], "sensor string, segment string, start timestamp_ntz")
    ops = spark.createDataFrame([("a", None, D("2020-01-03"))], "sensor string, first_day date, last_day date")
    assert [r.segment for r in regimes.assign_segments(obs, starts, ops).orderBy("stamp").collect()] == [quality.OUTSIDE, "s2", "s2", quality.OUTSIDE]


def test_origins_never_move_and_core_rejects_gaps(spark):
    w = spark.createDataFrame([("w", D("2020-01-01"), D("2020-02-01"))], "window string, anchor date, stop date")
    assert [r.origin.isoformat() for r in series.scheduled_origins(w).orderBy("origin").collect()] == ["2020-01-01", "2020-01-15", "2020-01-29"]
    g = spark.createDataFrame([("w", "s", D("2020-09-28") + dt.timedelta(i), None if i == 1 else 1.0, "a") for i in range(8)], "window string, sensor string, day date, value double, segment string")
    ok = {r.day.isoformat(): r.core_eligible for r in series.core_origins(g, 1).collect()}
    assert not ok["2020-09-28"] and not ok["2020-09-29"] and not ok["2020-09-30"] and ok["2020-10-01"] and not ok["2020-10-05"]


def test_intervals_need_thirty_known_residuals(spark):
    rows = [("m", D("2020-01-01") + dt.timedelta(14 * i), D("2020-01-01") + dt.timedelta(14 * i + 7), 0.0, float(i)) for i in range(35)]
    out = forecast.past_residual_intervals(spark.createDataFrame(rows, "model string, origin date, target_date date, prediction double, error double"), ["model"]).orderBy("origin").collect()
    assert out[29].interval_status == "insufficient_past_calibration" and out[30].interval_status == "calibrated"


def test_runs_and_changepoints(spark):
    rng = np.random.default_rng(170)
    y = rng.normal(0, 0.2, 300)
    y[150:] += 3
    df = spark.createDataFrame([("s", D("2020-01-01") + dt.timedelta(i), float(v)) for i, v in enumerate(y)], "sensor string, day date, value double")
    runs = series.contiguous_runs(df, ["sensor"], 180)
    found = changepoints.detect(runs, ["sensor"])
    penalty = {k: f"{k * math.log(300) * np.var(y, ddof=1):.12g}" for k in (1, 2, 4)}
    assert {(r.method, r.setting) for r in found.select("method", "setting").distinct().collect()} == {("pelt", f"multiplier_{k}_penalty_{penalty[k]}") for k in (1, 2, 4)} | {("binary", f"breaks_{k}") for k in (1, 2, 3)}
    assert abs(changepoints.first_split(runs, ["sensor"]).first()["i"] - 150) <= 1
    best = changepoints.summarize(found, ["sensor"]).where("stability = 'method_stable'").collect()
    assert any(abs((r.day - D("2020-05-30")).days) <= 7 for r in best)


def test_kernels():
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    assert K.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert K.acf(x, 3)[0] == 1 and K.pacf(x, 3)[1] == pytest.approx(K.acf(x, 3)[1])
    assert K.stationarity_label(K.adf(x)[1], K.kpss(x)[1]) == "stationary"
    assert K.adf(np.cumsum(x))[1] > 0.05
    s, t, r = K.stl(np.sin(np.arange(120) / 6 * math.pi) + 0.01 * np.arange(120), 12)
    assert np.allclose(s + t + r, np.sin(np.arange(120) / 6 * math.pi) + 0.01 * np.arange(120)) and K.strengths(s, t, r)[0] > 0.9
    assert K.block_bootstrap_mean(x, seed=170) == K.block_bootstrap_mean(x, seed=170)


def test_pelt_is_the_optimal_partition():
    rng = np.random.default_rng(5)
    for _ in range(15):
        x = np.concatenate([rng.normal(rng.normal(0, 1.5), 1, rng.integers(8, 25)) for _ in range(4)])
        cost, least, pen, n = K._Cost(x), 6, rng.uniform(1, 8), len(x)
        best, last = [-pen] + [math.inf] * n, [0] * (n + 1)
        for t in range(least, n + 1):
            for a in range(t - least + 1):
                if best[a] < math.inf and (v := best[a] + cost(a, t) + pen) < best[t]:
                    best[t], last[t] = v, a
        want, t = [], n
        while last[t] > 0:
            want.append(t := last[t])
        assert K.pelt(x, pen, least) == sorted(want)


def test_arima_recovers_an_autoregression_with_missing_values():
    rng = np.random.default_rng(2)
    x, e = np.zeros(800), rng.normal(size=800)
    for i in range(1, 800):
        x[i] = 0.7 * x[i - 1] + e[i]
    x[200:230] = np.nan
    f = K.arima_forecast(x + 5, (1, 0, 0, 7))
    assert f["converged"] and f["ar"][0] == pytest.approx(0.7, abs=0.08) and f["variance"] == pytest.approx(1, abs=0.15)
    assert f["mean"][1] - f["level"] == pytest.approx(f["ar"][0] * (f["mean"][0] - f["level"]))
    assert K.arima_forecast(np.ones(50), (1, 0, 0, 7)) is None


def _archive(path, lines):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("Station_Middle_WY2017.csv", "﻿a\nb\nc\n" + "\n".join(lines) + "\n")


def test_archive_source(spark, tmp_path):
    _archive(tmp_path / "X_15_Minute.zip", ["date_time_PST,rain_R1,rain_R1", "9/30/2016 23:45,1,2", "bad,,x", "10/1/2016 0:00,3,4"])
    rows = archives.read_members(spark, str(tmp_path / "X_15_Minute.zip")).orderBy("row_no", "position").collect()
    assert [(r.row_no, r.position, r.value_text) for r in rows] == [(5, 1, "1"), (5, 2, "2"), (6, 1, ""), (6, 2, "x"), (7, 1, "3"), (7, 2, "4")]
    assert (rows[0].station, rows[0].water_year_label, rows[0].product) == ("middle", "2017", "15_minute")
    from gaugeflow.functions.scalar import parse_stamp, to_utc, water_year

    got = archives.read_members(spark, str(tmp_path / "X_15_Minute.zip")).where("position = 1").orderBy("row_no").select(to_utc(parse_stamp(F.col("stamp_text"))).alias("u"), water_year(parse_stamp(F.col("stamp_text"))).alias("w")).collect()
    assert [(r.u, r.w) for r in got] == [(T("2016-10-01 07:45"), 2016), (None, None), (T("2016-10-01 08:00"), 2017)]


def test_manifest_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"abc")
    m = spark.createDataFrame([("a.bin", 3, "MD5", "900150983cd24fb0d6963f7d28e17f72"), ("b.bin", 1, "md5", "x")], "name string, size bigint, algorithm string, checksum string")
    v = {r.name: r.verdict for r in archives.verify_manifest(archives.file_digests(spark, str(tmp_path / "in")), m).collect()}
    assert v == {"a.bin": "verified", "b.bin": "missing"}
    assert sinks.write_checked(m, f"file://{tmp_path}/out") == 2 and sinks.row_count(spark, f"file://{tmp_path}/out") == 2
    (tmp_path / "again.partial").mkdir()
    with pytest.raises(FileExistsError):
        sinks.write_checked(m, f"file://{tmp_path}/again")


def test_contracts(spark):
    df = spark.createDataFrame([("1", "https://a.b/c", "ok"), ("1", "http://a", "/home/me"), ("2", None, "")], "record_id string, url string, note string")
    assert contracts.column_rules(df, ["record_id", "gone"], ["note"]) == [("required_column", "gone"), ("forbidden_column", "note")]
    n = {(r.rule, r.column): r.n for r in contracts.row_rules(df, ["record_id"], ["note"], {("https", "url"): contracts.https(F.col("url"))} | contracts.text_rules(["note"])).collect()}
    assert n[("duplicate_key", "record_id")] == 2 and n[("blank", "note")] == 1 and n[("https", "url")] == 2 and n[("local_path", "note")] == 1 and n[("credential", "note")] == 0
    assert contracts.exactly_one(df, F.col("record_id") == "2").first()["record_id"] == "2"


def test_streamed_steps(spark, tmp_path):
    from gaugeflow.streaming import quality as stream

    rows = [("m", i, T("2020-01-01 00:00") + dt.timedelta(minutes=m)) for i, m in enumerate((0, 15, 60, 50))]
    spark.createDataFrame(rows, "member string, row_no bigint, ts timestamp").write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("member string, row_no bigint, ts timestamp").parquet(f"{tmp_path}/in")
    q = stream.stream_step_flags(src).writeStream.format("memory").queryName("steps").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.flag_gap_before, r.flag_out_of_order_timestamp) for r in spark.table("steps").orderBy("row_no").collect()] == [(False, False), (False, False), (True, False), (False, True)]


def test_fixed_seed_fixtures_reproduce_published_values(spark):
    from gaugeflow.plans import exploratory

    mae = {r.split: r.mae for r in exploratory.leakage_demo(spark).collect()}
    assert mae["chronological"] == pytest.approx(4.695688886092125, abs=1e-12) and mae["random"] == pytest.approx(2.0226285060748843, abs=1e-12)
    r = exploratory.linear_processes(spark).where("process = 'ar1' and lag = 2").first()
    assert r.acf == pytest.approx(0.4837397600894996, abs=1e-12) and r.pacf == pytest.approx(0.0035106076729137033, abs=1e-12)


def test_parts_carry_over_like_one_window(spark):
    from pyspark.sql import Window

    from gaugeflow.operators.parts import lag_in_parts

    rng = np.random.default_rng(8)
    rows = [(f"k{int(k)}", int(i), None if i % 7 == 0 else float(i)) for k in range(3) for i in rng.choice(100, 40, replace=False)]
    df = spark.createDataFrame(rows, "k string, i bigint, v double")
    want = {(r.k, r.i): r.p for r in df.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("i"))).collect()}
    got = {(r.k, r.i): r.p for r in lag_in_parts(df, ["k"], F.floor(F.col("i") / 10), "i", F.col("v"), "p").collect()}
    assert got == want
