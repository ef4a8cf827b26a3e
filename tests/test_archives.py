"""The archive source: ranges, errors, roles, profiles."""

import hashlib
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import parts, quality
from gaugeflow.plans import ingest
from gaugeflow.sources import monitoring

HEAD = "﻿x\ny\nthe product\n"


def archive(path, members, how=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", how) as z:
        for name, text in members.items():
            z.writestr(name, text)


def fine(n, header="date_time_PST,rain_R1,rain_R1,disp_E2"):
    rows = [f"10/{1 + i // 96}/2016 {i % 96 // 4}:{i % 4 * 15:02d},{i},{i * 2},\"é{i}\"" for i in range(n)]
    return HEAD + header + "\r\n" + "\r\n".join(rows[: n // 2]) + "\r\n\r\n" + "\r\n".join(rows[n // 2 :]) + "\r\n"


def operating(spark):
    return spark.createDataFrame([("R1", None, None), ("E2", None, None)], "sensor string, first_day date, last_day date")


@pytest.mark.parametrize("how", [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED])
def test_a_member_of_many_ranges_is_read_once(spark, tmp_path, how):
    archive(tmp_path / "A_15_Minute.zip", {"d/": "", "Station_Middle_WY2017.csv": fine(700), "readme.txt": "no"}, how)
    for size in (900, 1 << 20):
        got = monitoring.read_rows(spark, str(tmp_path), ["R1", "E2"], ["R1"], size)
        assert (got.rdd.getNumPartitions() > 20) == (size == 900)
        rows = got.orderBy("row_no").collect()
        assert [r.row_no for r in rows] == list(range(5, 705))
        assert [[(f.position, f.sensor, f.ordinal, f.value_text) for f in r.fields] for r in rows] == [
            [(2, "R1", 1, str(i)), (3, "R1", 2, str(2 * i)), (4, "E2", 1, f"é{i}")] for i in range(700)]
    assert (rows[0].product, rows[0].station, rows[0].water_year_label, rows[0].archive) == ("15_minute", "middle", "2017", "A_15_Minute.zip")


def test_roles_and_fixed_offset(spark, tmp_path):
    archive(tmp_path / "B_15_Minute.zip", {"toe_WY2016.csv": HEAD + "date_time_PST,rain_R1,rain_R1,disp_E2\n7/1/2016 0:00,1,5,2\nbad,1,1,1\n7/1/2016 0:30,1,4,1\n"})
    archive(tmp_path / "C_daily.zip", {"toe.csv": HEAD + "date,rain_R1,disp_E2\n7/1/2016,1,2\n7/2/2016,,3\n"})
    got = ingest.monitoring_observations(spark, str(tmp_path), ["R1", "E2"], operating(spark), ["R1"], ["E2"]).collect()
    assert sum(r.flag_timestamp_parse_failure for r in got) == 3 and len(got) == 13
    assert {(r.product, r.sensor, r.ordinal, r.role) for r in got} == {
        ("15_minute", "R1", 1, "interval_precipitation"), ("15_minute", "R1", 2, "cumulative_precipitation"), ("15_minute", "E2", 1, "15_minute_observation"),
        ("daily", "R1", 1, "daily_rainfall_maximum"), ("daily", "E2", 1, "daily_median")}
    assert {str(r.stamp_utc) for r in got if r.product == "daily"} == {"2016-07-01 08:00:00", "2016-07-02 08:00:00"}
    change = {(r.row_no, r.ordinal): (r.value_change, r.flag_negative_increment, r.flag_unexplained_negative_increment) for r in got if r.product == "15_minute" and r.sensor == "R1" and r.ordinal == 2}
    assert change[(7, 2)] == (-1.0, True, True)  # an unparsed row breaks the step, so that no gap explains it
    assert {r.is_cumulative for r in got if r.sensor == "E2"} == {True}


@pytest.mark.parametrize("name, member, text, said", [
    ("A_15_Minute.zip", "toe.csv", HEAD + "date,rain_R1\n", "first column"), ("A_15_Minute.zip", "other.csv", fine(3), "no station"), ("A_monthly.zip", "toe.csv", fine(3), "no product"),
    ("A_15_Minute.zip", "toe.csv", HEAD + "date_time_PST,d_E2,d_E2\n1,2,3\n", "repeated header"), ("A_15_Minute.zip", "toe.csv", fine(3) + "a,b\n", "has 2 fields"),
    ("A_15_Minute.zip", "toe.csv", fine(3) + '1,2,3,"x\n', "line 8"), ("A_15_Minute.zip", "toe.csv", HEAD + "date_time_PST,d_X9\n1,2\n", "no column of"), ("A_15_Minute.zip", "toe.csv", HEAD + "date_time_PST,a_b_R1\n1,2\n", "ids of")])
def test_errors_are_named(spark, tmp_path, name, member, text, said):
    archive(tmp_path / name, {member: text})
    with pytest.raises(Exception, match=said):
        monitoring.read_rows(spark, str(tmp_path), ["R1", "E2"] + (["b_R1"] if said == "ids of" else []), ["R1"]).collect()


def test_a_wrong_crc_is_found(spark, tmp_path):
    path = tmp_path / "A_15_Minute.zip"
    archive(path, {"toe.csv": fine(300)}, zipfile.ZIP_STORED)
    raw = path.read_bytes()
    path.write_bytes(raw.replace(b",7,14,", b",7,15,", 1))
    with pytest.raises(Exception, match="CRC"):
        monitoring.read_rows(spark, str(tmp_path), ["E2"], ["R1"], 1000).collect()


def test_unknown_sensor_and_ambiguous_regimes(spark, tmp_path):
    archive(tmp_path / "A_15_Minute.zip", {"toe.csv": fine(3)})
    with pytest.raises(ValueError, match="Z7"):
        ingest.monitoring_observations(spark, str(tmp_path), ["Z7", "R1"], operating(spark))


def test_profile_of_members(spark, tmp_path):
    text = fine(300)
    archive(tmp_path / "A_15_Minute.zip", {"toe_WY2017.csv": text, "upper.csv": HEAD + "date_time_PST,d_X9\n"})
    whole = [ingest.member_profiles(spark, str(tmp_path), size).orderBy("member").collect() for size in (500, 1 << 20)]
    assert whole[0] == whole[1]
    a, b = whole[0]
    raw = text.encode()
    assert (a.crc32, a.uncompressed_bytes, a.n_rows, a.n_parse_failures, a.n_gaps, a.n_columns) == (f"{zlib.crc32(raw):08x}", len(raw), 300, 0, 0, 4)
    assert a.archive_sha256 == hashlib.sha256((tmp_path / "A_15_Minute.zip").read_bytes()).hexdigest() and a.compressed_bytes < a.uncompressed_bytes
    assert (a.first_text, a.last_text, a.minute_phases, a.preamble) == ("10/1/2016 0:00", "10/4/2016 2:45", "00;15;30;45", "the product")
    assert (b.n_rows, b.first_text, b.last_text, b.minute_phases, b.water_year_label) == (0, "not_available", "not_available", "", "not_applicable")


def test_written_archives_hold_the_lines(spark, tmp_path):
    rows = [(f"{p}_15_Minute.zip", f"{m}.csv", i, f"{p}{m}{i}é") for p in "ab" for m in ("toe", "upper") for i in range(50)]
    df = spark.createDataFrame(rows, "archive string, member string, line_no int, line string").orderBy(F.rand(3))
    assert monitoring.write_archives(df, f"file://{tmp_path}/z") == 2
    for p in "ab":
        with zipfile.ZipFile(tmp_path / "z" / f"{p}_15_Minute.zip") as z:
            assert z.testzip() is None and z.namelist() == ["toe.csv", "upper.csv"]
            assert z.read("upper.csv").decode().splitlines() == [f"{p}upper{i}é" for i in range(50)]
    assert monitoring.listed(f"file://{tmp_path}/z") == [f"file://{tmp_path}/z/{p}_15_Minute.zip" for p in "ab"]


def test_an_archive_is_deflated_by_many_tasks(spark, tmp_path):
    assert all(monitoring.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b) for a in (b"", b"ab", b"x" * 999) for b in (b"", b"c", bytes(70_000)))
    df = spark.range(40_000).selectExpr("'a_daily.zip' archive", "if(id < 35000, 'toe.csv', 'upper.csv') member", "id line_no", "concat(id, ',é') line").repartition(7)
    whole = ["".join(f"{i},é\n" for i in r).encode() for r in (range(35_000), range(35_000, 40_000))]
    for name, compressed in (("packed", True), ("plain", False)):
        assert monitoring.write_archives(df, str(tmp_path / name), compressed) == 1
        assert [p.name for p in (tmp_path / name).iterdir() if not p.name.endswith(".crc")] == ["a_daily.zip"]
        with zipfile.ZipFile(tmp_path / name / "a_daily.zip") as z:
            assert z.testzip() is None and [z.read(m) for m in z.namelist()] == whole
            assert [i.file_size for i in z.infolist()] == [len(w) for w in whole]
    assert (tmp_path / "packed" / "a_daily.zip").read_bytes().count(b"\x00\x00\xff\xff") >= 4  # pieces end in a flush


def test_ranges_of_a_member_are_bounded(spark, tmp_path):
    text = fine(3000).replace("\r\n10/5/", "\n\n\r\n10/5/")
    archive(tmp_path / "A_15_Minute.zip", {"toe.csv": text})
    assert len(monitoring.planned(str(tmp_path), 100)) == monitoring.RANGES
    rows = monitoring.read_rows(spark, str(tmp_path), ["R1", "E2"], ["R1"], 100).orderBy("row_no").collect()
    assert [(r.row_no, r.fields[2].value_text) for r in rows] == [(i + 5, f"é{i}") for i in range(3000)]


def test_series_are_ordered_in_small_parts(spark):
    many = spark.range(2880).selectExpr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 15 * cast(id as int)) stamp")
    assert many.groupBy(parts.by_hours(F.col("stamp"))).count().count() == 120
    rows = spark.range(10).selectExpr("'m' member", "'15_minute' product", "'E2' sensor", "'15_minute_observation' role", "cast(null as timestamp_ntz) stamp", "id row_no", "cast(id as string) value_text",
                                      "15.0D expected_min", "id % 2 = 0 is_cumulative")
    found = quality.flagged(rows)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN isnull(stamp") >= 2  # rows without a stamp are no group
    got = {r.row_no: (r.value_change, r.flag_duplicate_timestamp, r.flag_duplicate_timestamp_in_member) for r in found.collect()}
    assert got == {i: (2.0 if i % 2 == 0 and i else None, False, False) for i in range(10)}


def test_source_rows_are_read_once(spark, tmp_path):
    archive(tmp_path / "A_15_Minute.zip", {"toe.csv": fine(200), "upper.csv": fine(100)})
    got = ingest.monitoring_observations(spark, str(tmp_path), ["R1", "E2"], operating(spark), ["R1"], ["E2"])
    assert "monitoring_archive" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.member[16:], r.flag_duplicate_timestamp, r.n) for r in got.groupBy("member", "flag_duplicate_timestamp").agg(F.count("*").alias("n")).collect()} == {
        ("toe.csv", True, 300), ("toe.csv", False, 300), ("upper.csv", True, 300)}
