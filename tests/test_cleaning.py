"""Hand-computed answers for cleaning, flags and text rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidepanel.functions import dates, stats, text
from tidepanel.operators import clean, quality


def test_clamp_and_log(spark):
    df = spark.createDataFrame([(-1.0,), (7.0,), (15.0,), (None,)], "w_ph double")
    assert [r[0] for r in quality.clamp_ranges(df).collect()] == [None, 7.0, None, None]
    log = quality.clamp_log(df).first()
    assert (log["column"], log["low_ok"], log["high_ok"], log["n_set_to_missing"]) == ("w_ph", 0.0, 14.0, 2)


def test_longitude_east_wins(spark):
    rows = [(76.1, "W"), (76.1, "E"), (76.1, "W E"), (76.1, ""), (-76.1, "e"), (76.1, None)]
    df = spark.createDataFrame(rows, "v double, t string")
    got = [r[0] for r in df.select(text.longitude(F.col("v"), F.col("t"))).collect()]
    assert got == [-76.1, 76.1, 76.1, -76.1, 76.1, -76.1]


def test_number_turns_bad_text_and_nan_to_null(spark):
    df = spark.createDataFrame([("<4>",), (" 4 ",), ("NaN",), (None,), ("-1.5e1",)], "t string")
    assert [r[0] for r in df.select(text.number(F.col("t"))).collect()] == [None, 4.0, None, None, -15.0]


def test_four_timestamp_layouts(spark):
    texts = ["3/4/2005 9:05", "03/04/2005 09:00:00", "2005-03-04 09:00", "2005-03-04 09:05:01", "nope", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    ts = dates.parse_timestamp(F.col("t"))
    got = [tuple(r) for r in df.select(ts, dates.is_full_hour(ts)).collect()]
    day = dt.datetime(2005, 3, 4)
    assert got[0] == (day.replace(hour=9, minute=5), False)
    assert got[1] == (day.replace(hour=9), True)
    assert got[2] == (day.replace(hour=9), True)
    assert got[3] == (day.replace(hour=9, minute=5, second=1), False)
    assert got[4] == (None, None) and got[5] == (None, None)


def test_full_hour_spares_other_classes(spark):
    df = spark.createDataFrame([("3/4/2005 9:05", "wq"), ("3/4/2005 9:05", "nut"), ("3/4/2005 9:00", "wq"), ("x", "wq")], "t string, c string")
    kept = clean.full_hour_rows(df, "t", F.col("c")).select("t", "c").collect()
    assert sorted(map(tuple, kept)) == [("3/4/2005 9:00", "wq"), ("3/4/2005 9:05", "nut")]


def test_parsing_does_not_depend_on_the_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([("3/13/2005 2:30",), ("4/3/2005 2:30",)], "t string")
        got = [r[0] for r in df.select(dates.parse_timestamp(F.col("t")).cast("string")).collect()]
        assert got == ["2005-03-13 02:30:00", "2005-04-03 02:30:00"]  # the second time does not exist there
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_nearest_hour(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1, 9, 29),), (dt.datetime(2020, 1, 1, 9, 30),)], "ts timestamp_ntz")
    assert [r[0].hour for r in df.select(dates.nearest_hour(F.col("ts"))).collect()] == [9, 10]


def test_flags(spark):
    df = spark.createDataFrame([(1.0, 3, 2.0, 0), (1.0, -2, 2.0, 1), (1.0, None, 2.0, 2), (1.0, 0, 2.0, -3)], "a double, a_flag int, b double, b_flag int")
    rows = quality.row_corruption(df, ["a_flag", "b_flag"]).collect()
    assert [r["is_highly_corrupted_record"] for r in rows] == [True, True, False, False]
    assert [r["has_rejected_flag"] for r in rows] == [True, False, False, False]
    assert [r["n_reserved_flags_row"] for r in rows] == [0, 0, 1, 0]
    nulled = quality.null_bad_values(df, {"a": "a_flag", "b": "b_flag"}).collect()
    assert [(r["a"], r["b"]) for r in nulled] == [(None, 2.0), (1.0, None), (1.0, 2.0), (1.0, 2.0)]


def test_sensor_choice(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (None, None)], "m double, e double")
    out = clean.first_of(df, [("m", "local"), ("e", "model")], "v", "src").select("v", "src").collect()
    assert list(map(tuple, out)) == [(1.0, "local"), (2.0, "model"), (None, None)]


def test_bins_drop_the_top_edge(spark):
    df = spark.createDataFrame([(9.0,), (9.5,), (10.0,)], "v double")
    assert [r["bin"] for r in clean.unit_bins(df, "v").orderBy("v").collect()] == [9.0, 9.0]


def test_shares_with_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "v double")
    row = df.agg(stats.fraction_below(F.col("v"), 2.0).alias("risk"), stats.share_below(F.col("v"), 2.0).alias("share")).first()
    assert row["risk"] == pytest.approx(1 / 3) and row["share"] == 0.5


def test_headers_labels_and_suffix(spark):
    df = spark.createDataFrame([("apaCPwq", "CP", " ")], ["Station Code", " Site-ID ", "Name"])
    out = clean.normalise_headers(df)
    assert out.columns == ["station_code", "site_id", "name"]
    row = out.select(
        text.suffix_code(F.col("station_code")).alias("s"),
        text.station_label(F.col("name"), F.lit("apa"), F.lit("cp"), F.lit("Bay")).alias("blank"),
        text.station_label(F.lit("Cat Point"), F.lit("apa"), F.lit("cp"), F.lit("Bay")).alias("named"),
    ).first()
    assert tuple(row) == ("wq", "(apacp) Bay", "(apacp) Cat Point, Bay")


def test_dead_weight(spark):
    rows = [(i, 5, 1.0 if i == 0 else None, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, fixed int, rare double, good double")
    flagged = {r["column"]: r["why_flagged"] for r in quality.column_profile(df, ["k"]).collect()}
    assert flagged == {"fixed": "constant_or_single_value", "rare": "constant_or_single_value", "good": None}
    assert quality.drop_dead_weight(df, ["k"]).columns == ["k", "good"]


def test_units(spark):
    df = spark.createDataFrame([("273.15", "3600000", "0.001")], "m_era5_air_temp_k string, m_era5_ssrd_j_m2 string, m_era5_precip_m string")
    row = clean.convert_units(df).first()
    assert row["m_era5_air_temp_c"] == 0.0 and row["m_era5_ssrd_kwh_m2"] == 1.0 and row["m_precip_mmh"] == 1.0
