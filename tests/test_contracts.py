"""Compiled contracts and claims, acquisition, and lag and changepoint tables on small frames."""

import datetime as dt
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import kernels as K
from gaugeflow.operators import align
from gaugeflow.plans import changepoints, compiled, daily_lags, exploratory, panels
from gaugeflow.sources import acquire

D = lambda s: dt.date.fromisoformat(s)


def test_every_kind_of_rule_finds_its_rows(spark):
    rows = [("a", 1, 0.5, "f" * 64, "x/y.csv", "https://a.b/c", "fine"), ("a", -1, 1.5, "F" * 64, "../y", "http://a", "/home/me"), ("", 2, None, "f" * 63, "/y", None, "password: x1"), (None, None, 0.0, None, "c:\\y", "https:///", "na")]
    df = spark.createDataFrame(rows, "id string, n_rows int, share double, sha string, place string, url string, note string")
    other = spark.createDataFrame([("a",), ("b",)], "name string")
    c = compiled.Contract("t", ("id",), required=("id", "gone"), forbidden=("NOTE",), not_blank=("note",), counts=("n_rows",), fractions=("share",), digests=("sha",), ids=("place",), urls=("url",), safe=("note",), min_rows=6,
                          references={"id": ("o", "name")}, checks={("even", "n_rows"): F.col("n_rows") % 2 == 0})
    got = {(r.name, r.column): (r.n, r.holds) for r in compiled.evaluate({"t": df, "o": other}, [c]).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        ("required_column", "gone"): 1, ("forbidden_column", "NOTE"): 1, ("blank_key", "id"): 2, ("blank", "note"): 1, ("nonnegative_integer", "n_rows"): 2, ("fraction", "share"): 1, ("sha256", "sha"): 3, ("safe_id", "place"): 3,
        ("https", "url"): 3, ("local_path", "note"): 1, ("credential", "note"): 1, ("even", "n_rows"): 3, ("min_rows", "*"): 2, ("duplicate_key", "id"): 1, ("reference", "id in o.name"): 1}
    assert all(v[1] == (v[0] == 0) for v in got.values())
    with pytest.raises(Exception, match="broken rule t"):
        compiled.raise_broken(compiled.evaluate({"t": df, "o": other}, [c])).collect()


def test_a_table_is_read_once_and_broken_claims_raise(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("x")).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    claim = lambda ok: compiled.Claim("C1", "t", "%d rows up to %d.", (F.count("*"), F.max("x")), lambda a, b: (a > b) & F.lit(ok))
    found = compiled.evaluate({"t": t}, [compiled.Contract("t", ("x",), counts=("x",))], [claim(True)])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert {(r.kind, r.name): (r.n, r.statement, r.holds) for r in compiled.raise_broken(found).collect()}[("claim", "C1")] == (None, "10 rows up to 9.", True)
    with pytest.raises(Exception, match="broken claim t C1"):
        compiled.raise_broken(compiled.evaluate({"t": t}, [], [claim(False)])).collect()


def test_sentences_stand_in_pages_whatever_their_white_space(spark):
    df = spark.createDataFrame([("<p>One\n two<b> three</b></p>",), ("<p>One twothree</p>",)], "html string")
    assert [r.h for r in df.select(compiled.holds_sentence(F.col("html"), "One  two three").alias("h")).collect()] == [True, False]


def resources(spark, tmp_path, **changed):
    raw = b"abc" * 1000
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in/a.zip").write_bytes(raw)
    item = {"id": "I1", "identifiers": [{"key": "doi:10.1/x"}], "provenance": {"lastUpdated": "2020"}, "rights": "free", "files": [
        {"name": "a.zip", "title": "A", "url": f"{tmp_path}/in/a.zip", "size": len(raw), "dateUploaded": None, "checksum": {"type": "MD5", "value": hashlib.md5(raw).hexdigest().upper()}} | changed,
        {"name": "b.zip", "title": None, "url": "u", "size": 1, "dateUploaded": "d", "checksum": {"type": "crc9", "value": "1"}}]}
    (tmp_path / "item.json").write_text(json.dumps(item))
    return acquire.read_catalogue(spark, str(tmp_path / "item.json"), "I1", "10.1/x")


def test_acquisition_copies_verifies_and_keeps(spark, tmp_path):
    cat = resources(spark, tmp_path)
    chosen = acquire.select_resources(cat, ["a.zip"])
    [r] = acquire.acquire(chosen, str(tmp_path / "raw")).collect()
    raw = (tmp_path / "in/a.zip").read_bytes()
    assert (r.outcome, r.filename, r.byte_size, r.sha256, r.source_checksum_algorithm, r.title, r.license) == ("copied", "a.zip", len(raw), hashlib.sha256(raw).hexdigest(), "md5", "A", "free")
    assert (tmp_path / "raw/a.zip").read_bytes() == raw and [p.name for p in (tmp_path / "raw").iterdir() if not p.name.endswith(".crc")] == ["a.zip"]
    (tmp_path / "in/a.zip").unlink()  # what stands is verified, not copied again
    assert [x.outcome for x in acquire.acquire(chosen, str(tmp_path / "raw")).collect()] == ["verified"]
    acquire.write_receipt(acquire.acquire(chosen, str(tmp_path / "raw")), str(tmp_path / "receipt"))
    back = acquire.read_receipt(spark, str(tmp_path / "receipt"))
    assert len(acquire.RECEIPT) == 17 and back.columns == list(acquire.RECEIPT) and back.first().filename == "a.zip" and back.first().response_etag == "not_stated"


@pytest.mark.parametrize("changed, said", [({"size": 5}, "size"), ({"checksum": {"type": "sha256", "value": "00"}}, "sha256")])
def test_what_does_not_verify_leaves_nothing(spark, tmp_path, changed, said):
    chosen = acquire.select_resources(resources(spark, tmp_path, **changed), ["a.zip"])
    with pytest.raises(Exception, match=f"a.zip: {said}"):
        acquire.acquire(chosen, str(tmp_path / "raw")).collect()
    assert not any((tmp_path / "raw").glob("a*"))
    (tmp_path / "raw").mkdir(exist_ok=True)
    (tmp_path / "raw/a.zip").write_bytes(b"another one")
    with pytest.raises(Exception, match=f"a.zip: {'size' if said == 'size' else 'size|sha256'}"):
        acquire.acquire(chosen, str(tmp_path / "raw")).collect()


def test_a_partial_file_is_an_error(spark, tmp_path):
    chosen = acquire.select_resources(resources(spark, tmp_path), ["a.zip"])
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.zip.partial").write_bytes(b"x")
    with pytest.raises(Exception, match="partial"):
        acquire.acquire(chosen, str(tmp_path / "raw")).collect()


def test_catalogue_errors(spark, tmp_path):
    cat = resources(spark, tmp_path)
    for names, said in (([], "non-empty"), (["a.zip", "a.zip"], "unique"), (["../a.zip"], "plain"), (["c.zip"], "not in the catalogue"), (["b.zip"], "checksum")):
        with pytest.raises(ValueError, match=said):
            acquire.select_resources(cat, names)
    for item, doi in (("I2", "10.1/x"), ("I1", "10.1/y")):
        with pytest.raises(ValueError, match="catalogue"):
            acquire.read_catalogue(spark, str(tmp_path / "item.json"), item, doi)


def test_lag_table_statuses_and_interval(spark):
    rng = np.random.default_rng(3)
    first, n = D("2001-01-01"), 200
    x = rng.normal(size=n)
    y = np.concatenate([[0, 0, 0], x[:-3]]) + 0.1 * rng.normal(size=n)
    day = [first + dt.timedelta(i) for i in range(n)]
    rows = [(s, t, d, float(v), True) for s, v_ in (("p", x), ("q", y)) for t in ("daily_level", "daily_first_difference") for d, v in zip(day, v_)]
    rows += [("flat", t, d, 1.0, True) for t in ("daily_level", "daily_first_difference") for d in day] + [("few", t, d, float(k % 3), True) for t in ("daily_level", "daily_first_difference") for k, d in enumerate(day[:15])]
    series = spark.createDataFrame(rows, "sensor string, transformation string, day date, value double, eligible boolean")
    pairs = spark.createDataFrame([("w", first, D("2002-01-01"), a, b) for a, b in (("p", "q"), ("flat", "q"), ("few", "q"), ("gone", "q"))], "window string, start date, stop date, predictor string, response string")
    curves, peaks = daily_lags.daily_lags(series, pairs, [], 10, draws=40)
    got = {(r.predictor, r.method): r for r in peaks.collect()}
    assert {k: r.status for k, r in got.items() if k[0] != "few"} == {("p", m): "ok" for m in ("naive_levels", "transformed", "prewhitened")} | {("gone", m): "no_series" for m in ("naive_levels", "transformed", "prewhitened")} | {
        ("flat", m): "no_correlation" for m in ("naive_levels", "transformed", "prewhitened")}
    assert got[("few", "prewhitened")].status == "insufficient_prewhitening_pairs" and got[("few", "naive_levels")].status == "ok"
    r = got[("p", "transformed")]
    assert r.peak_lag == 3 and r.peak_pairs == n - 3 and r.block_length == 30
    want = K.block_bootstrap_corr(x[: n - 3], y[3:], 30, 40)
    assert (r.ci_low, r.ci_high) == pytest.approx(want) and curves.count() == 12 * 11
    c = x - x.mean()
    phi = (c[1:] * c[:-1]).sum() / (c[:-1] ** 2).sum()
    assert got[("p", "prewhitened")].phi == pytest.approx(phi)


def test_contexts_in_order(spark):
    base = D("2000-01-01")
    runs = spark.createDataFrame([("r", "w", "s", "a", 2000, base + dt.timedelta(i), 100.0 if i in (50, 120) else 1.0) for i in range(300)], "run string, window string, sensor string, segment string, water_year int, day date, value double")
    at = lambda i: base + dt.timedelta(i)
    det = spark.createDataFrame([("r", "pelt", f"m{k}", at(i)) for i in (20, 52, 118, 160, 200, 276) for k in (1, 2)] + [("r", "binary", "b1", at(20)), ("r", "pelt", "m1", at(25))], "run string, method string, setting string, candidate_day date")
    starts = spark.createDataFrame([("s", at(17), "new cable"), ("t", at(52), "no")], "sensor string, day date, reason string")
    fixed = spark.createDataFrame([(at(123), "topple", 1), (at(22), "later", 2)], "day date, context string, position int")
    storms = spark.createDataFrame([(at(164),)], "day date")
    got = [(r.candidate, r.candidate_day, r.stability, r.classification, r.context, r.offset_days) for r in changepoints.candidates_in_context(det, runs, starts, fixed, storms).orderBy("candidate").collect()]
    assert got == [
        ("r__c01", at(22), "method_stable", "metadata_aligned", "later", "0"), ("r__c02", at(52), "within_method_only", "event_aligned", "run_q95_displacement_episode", "2"),
        ("r__c03", at(118), "within_method_only", "metadata_aligned", "topple", "-5"), ("r__c04", at(160), "within_method_only", "event_aligned", "selected_rain_event", "-4"),
        ("r__c05", at(200), "within_method_only", "unexplained", "none", "not_applicable"), ("r__c06", at(276), "within_method_only", "metadata_aligned", "water_year_reset", "2")]


def test_rounds_are_the_greedy_order(spark):
    rng = np.random.default_rng(8)
    base = dt.datetime(2020, 1, 1)
    for spread in (300, 90):
        left, right = (sorted({base + dt.timedelta(minutes=int(m)) for m in rng.integers(0, spread, 70)}) for _ in range(2))
        rows = lambda s: spark.createDataFrame([(x, 1.0) for x in s], "stamp timestamp_ntz, value double")
        got = {(r.left_stamp, r.right_stamp) for r in align.one_to_one(align.nearest_candidates(rows(left), rows(right), 900), [], rounds=1).collect()}
        pairs = sorted((abs((a - b).total_seconds()), a, b) for a in left for b in right if abs((a - b).total_seconds()) <= 900)
        a_used, b_used, want = set(), set(), set()
        for _, a, b in pairs:
            if a not in a_used and b not in b_used:
                a_used.add(a), b_used.add(b), want.add((a, b))
        assert got == want


def test_event_alignment_by_brute_force(spark):
    rng = np.random.default_rng(9)
    base = dt.datetime(2020, 5, 4)
    left = [(base + dt.timedelta(minutes=int(m)), float(rng.normal())) for m in sorted(rng.choice(4000, 150, replace=False))]
    right = [("s", base + dt.timedelta(minutes=int(m)), float(rng.normal())) for m in sorted(rng.choice(4000, 150, replace=False))]
    events = spark.createDataFrame([("e", dt.date(2020, 5, 5))], "event string, day date")
    peaks, zero = exploratory.event_alignment(spark.createDataFrame(left, "stamp timestamp_ntz, value double"), spark.createDataFrame(right, "sensor string, stamp timestamp_ntz, value double"), events, ["sensor"], max_lag_hours=3)

    def greedy(shift, tol):
        moved = [(t + dt.timedelta(minutes=shift), v) for t, v in left]
        pairs = sorted((abs((a - b).total_seconds()), a, b, v, w) for a, v in moved for _, b, w in right if abs((a - b).total_seconds()) <= tol * 60)
        ua, ub, out = set(), set(), []
        for _, a, b, v, w in pairs:
            if a not in ua and b not in ub:
                ua.add(a), ub.add(b), out.append((v, w))
        return out

    for tol in (8, 15):
        curve = {lag: (np.corrcoef(*zip(*m))[0, 1], len(m)) for lag in range(0, 181, 15) if len(m := greedy(lag, tol)) >= 20}
        best = max(curve, key=lambda k: (abs(curve[k][0]), -k))
        r = peaks.where(F.col("tolerance") == tol).first()
        assert (r.lag_hours * 60, r.n, r.n_simultaneous) == (best, curve[best][1], len(greedy(0, tol))) and r.correlation == pytest.approx(curve[best][0])
        assert zero.where(F.col("tolerance") == tol).count() == len(greedy(0, tol))


def test_histogram_keeps_empty_bins_and_ends(spark):
    rows = [("a", float(v)) for v in [0] * 3 + [45] * 2 + [10]] + [("b", 7.0)] * 4 + [("c", None)]
    got = panels.trimmed_histogram(spark.createDataFrame(rows, "k string, value double"), ["k"], low=0.0, high=1.0).orderBy("k", "bin").collect()
    a = [r for r in got if r.k == "a"]
    assert len(a) == 45 and {r.bin: r.n for r in a if r.n} == {1: 3, 11: 1, 45: 2} and [(r.bin, r.n) for r in got if r.k == "b"] == [(1, 4)] and not [r for r in got if r.k == "c"]


def test_command_line_keeps_what_stands(spark, tmp_path):
    from gaugeflow import __main__ as cli

    given = ["--data", "/root/testdata/sf0.001", "--out", str(tmp_path), "--only", "ag_distribution", "qc_value_flags"]
    a = cli.arguments([*given, "--summaries-only", "--record"])
    assert list(cli.run(spark, a)) == ["ag_distribution"] and not (tmp_path / "qc_value_flags").exists()
    stood = (tmp_path / "ag_distribution/_SUCCESS").stat().st_mtime_ns
    b = cli.arguments(given)
    assert cli.run(spark, b) == {"ag_distribution": 10, "qc_value_flags": 1000} and (tmp_path / "ag_distribution/_SUCCESS").stat().st_mtime_ns == stood
    cli.run(spark, cli.arguments([*given[:4], "--only", "ag_distribution", "--again"]))
    assert (tmp_path / "ag_distribution/_SUCCESS").stat().st_mtime_ns > stood
    assert {r.table: r.n_rows for r in spark.read.json(str(tmp_path / "_receipt")).collect()} == {"ag_distribution": 10}
    with pytest.raises(SystemExit, match="nope"):
        cli.run(spark, cli.arguments([*given[:4], "--only", "nope"]))


def test_counts_come_from_footers_and_settings_are_a_table(spark, tmp_path):
    from gaugeflow.plans import synthesis
    from gaugeflow.sources import sinks

    spark.range(1234).repartition(3).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    assert sinks.row_count(spark, str(tmp_path / "t")) == 1234 and spark.conf.get("spark.sql.sources.useV1SourceList") == before
    got = {r.setting: r.value for r in synthesis.settings(synthesis.forecast_settings(), spark).collect()}
    assert got["horizons_days"] == "1;2;7" and got["minimum_equations"] == "240" and len(got) == 10
