"""Hand-computed answers for roll-ups, windows, joins and coverage."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import baseline, coverage, joins, ordered, rolling, rollup

D = dt.date


def ntz(*args):
    return dt.datetime(*args)


def test_downsample_bins_carry_and_null_keys(spark):
    rows = [("a", ntz(2020, 1, 1, 0), 1.0, None), ("a", ntz(2020, 1, 1, 3, 59), None, 0), ("a", ntz(2020, 1, 1, 4), 5.0, 7), (None, ntz(2020, 1, 1, 1), 2.0, None)]
    df = spark.createDataFrame(rows, "station string, ts timestamp_ntz, v double, flag int")
    out = rollup.downsample(df, ["station"], "ts", "4 hours", ["v"], ["flag", "absent"]).orderBy(F.asc_nulls_last("station"), "ts").collect()
    assert [(r["station"], r["ts"].hour, r["v"], r["flag"]) for r in out] == [("a", 0, 1.0, 0), ("a", 4, 5.0, 7), (None, 0, 2.0, None)]


def test_partial_and_final_downsample_agree(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), ntz(2020, 1, 1) + dt.timedelta(minutes=rng.randrange(3000)), rng.random()) for _ in range(400)]
    df = spark.createDataFrame(rows, "station string, ts timestamp_ntz, v double")
    whole = rollup.downsample(df, ["station"], "ts", "4 hours", ["v"])
    many = rollup.downsample(df.repartition(7), ["station"], "ts", "4 hours", ["v"])
    key = lambda d: sorted((r["station"], r["ts"], round(r["v"], 9)) for r in d.collect())
    assert key(whole) == key(many)


def test_null_sum_is_zero(spark):
    df = spark.createDataFrame([("r", "s", D(2020, 1, 1), None)], "region string, station string, ts date, precip double")
    assert rollup.daily(df, sums=["precip"]).first()["precip"] == 0.0


def panel(spark, values, start=D(2020, 1, 1)):
    rows = [("r", "s", start + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "region string, station string, date date, v double")


def test_trailing_means(spark):
    df = panel(spark, [1.0, 2.0, 4.0])
    shifted = rolling.trailing_mean(df, ["v"], (1, 7)).orderBy("date").collect()
    assert [r["v_r1d"] for r in shifted] == [None, 1.0, 2.0]
    assert [r["v_r7d"] for r in shifted] == [None, 1.0, 1.5]
    now = rolling.trailing_mean(df, ["v"], (1,), shift=0).orderBy("date").collect()
    assert [r["v_r1d"] for r in now] == [1.0, 2.0, 4.0]


@pytest.mark.parametrize("n,expected", [(36, 1.0), (35, None)])
def test_minimum_count(spark, n, expected):
    df = panel(spark, [1.0] * n + [None] * (60 - n))
    last = rolling.rolling_mean(df, {"v": "m"}, 60, 36).orderBy(F.desc("date")).first()
    assert last["m"] == expected


def test_run_length_nulls_stand_alone(spark):
    df = panel(spark, [1.0, 1.0, None, None, 2.0, 2.0, 2.0])
    out = rolling.run_length(df, "v").orderBy("date").collect()
    assert [r["run_length"] for r in out] == [2, 2, 1, 1, 3, 3, 3]
    assert sum(1 / r["run_length"] for r in out) == pytest.approx(len({r["run_id"] for r in out}))


def test_interpolation_fills_both_ends(spark):
    df = panel(spark, [None, 2.0, None, None, 8.0, None])
    got = [r["filled"] for r in rolling.interpolate_time(df, "v", "date").orderBy("date").collect()]
    assert got == pytest.approx([2.0, 2.0, 4.0, 6.0, 8.0, 8.0])


def test_asof_takes_the_whole_row_and_the_inclusive_tolerance(spark):
    obs = spark.createDataFrame(
        [("a", ntz(2020, 1, 1, 0), 1.0, 2.0), ("a", ntz(2020, 1, 1, 5), None, 3.0)], "station string, ot timestamp_ntz, x double, y double"
    )
    left = spark.createDataFrame([("a", ntz(2020, 1, 1, 6)), ("a", ntz(2020, 1, 1, 5)), ("a", ntz(2019, 12, 31)), ("b", ntz(2020, 1, 1, 6)), (None, ntz(2020, 1, 1, 6))], "station string, ts timestamp_ntz")
    out = {(r["station"], r["ts"]): r for r in joins.asof_join(left, obs, ["station"], "ts", "ot").collect()}
    r = out[("a", ntz(2020, 1, 1, 6))]
    assert (r["x"], r["y"], r["age_hours"]) == (None, 3.0, 1.0)
    assert out[("a", ntz(2020, 1, 1, 5))]["age_hours"] == 0.0
    assert out[("a", ntz(2019, 12, 31))]["ot"] is None and out[("b", ntz(2020, 1, 1, 6))]["y"] is None
    assert len(out) == 5
    one = obs.limit(1)
    late = spark.createDataFrame([("a", ntz(2020, 1, 8, 0)), ("a", ntz(2020, 1, 8, 1))], "station string, ts timestamp_ntz")
    ages = [r["age_hours"] for r in joins.asof_join(late, one, ["station"], "ts", "ot").orderBy("ts").collect()]
    assert ages == [168.0, None]


def test_asof_equals_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    base = ntz(2020, 1, 1)
    obs = [(rng.choice(["hot", "b"]), base + dt.timedelta(minutes=rng.randrange(20000)), rng.random()) for _ in range(150)]
    obs = list({(k, t): (k, t, v) for k, t, v in obs}.values())
    left = [(i, "hot" if i % 3 else rng.choice("bc"), base + dt.timedelta(minutes=rng.randrange(20000))) for i in range(600)]
    left += [(600 + i, "hot", left[0][2]) for i in range(50)]  # copies of one moment
    ldf = spark.createDataFrame(left, "i long, station string, ts timestamp_ntz")
    odf = spark.createDataFrame(obs, "station string, ot timestamp_ntz, v double")
    got = {r["i"]: r["v"] for r in joins.asof_join(ldf, odf, ["station"], "ts", "ot", "3 days").collect()}
    for i, k, t in left:
        ok = [(ot, v) for s, ot, v in obs if s == k and ot <= t and t - ot <= dt.timedelta(days=3)]
        assert got[i] == (max(ok)[1] if ok else None)


def test_attach_dimension_replaces_columns_and_keeps_rows(spark):
    fact = spark.createDataFrame([(1, "old"), (1, "old"), (2, "old")], "k int, name string")
    dim = spark.createDataFrame([(1, "n"), (1, "n")], "k int, name string")
    out = joins.attach_dimension(fact, dim, ["k"]).collect()
    assert sorted((r["k"], r["name"] or "") for r in out) == [(1, "n"), (1, "n"), (2, "")]


def test_missing_runs_first_longest_wins(spark):
    def year(missing):
        return [("r", "s", D(2020, m, 5)) for m in range(1, 13) if m not in missing]

    for missing, run, start in [({2, 3, 7, 8}, 2, 2), ({5}, 1, None), (set(), 0, None), ({10, 11, 12}, 3, 10)]:
        df = spark.createDataFrame(year(missing), "region string, station string, date date")
        span = spark.createDataFrame([("r", "s", 2020, 2020, 1)], "region string, station string, first_full_year int, last_full_year int, n_full_years int")
        row = coverage.missing_runs(df, span).first()
        assert (row["max_consecutive_missing_months"], row["long_gap_start_month"]) == (run, start)
        assert row["n_missing_whole_months"] == len(missing) and row["has_long_gap"] == (run >= 2)


def test_full_years(spark):
    df = spark.createDataFrame([("r", "s", D(1995, 1, 1)), ("r", "s", D(2000, 12, 30))], "region string, station string, date date")
    row = coverage.station_span(df).first()
    assert (row["first_full_year"], row["last_full_year"], row["n_full_years"]) == (1995, 1999, 5)


def test_cohort_split_of_small_regions(spark):
    keys = spark.createDataFrame([("one", "x")] + [("five", c) for c in "abcde"], "region string, station string")
    got = {(r["region"], r["station"]): r["cohort"] for r in coverage.cohort_split(keys).collect()}
    assert got[("one", "x")] == "holdout"
    assert [got[("five", c)] for c in "abcde"] == ["train"] * 4 + ["holdout"]
    nth = {r["station"]: r["cohort"] for r in coverage.every_nth_holdout(keys).collect()}
    assert [nth[c] for c in "abcde"] + [nth["x"]] == ["holdout", "train", "train", "train", "train", "holdout"]


def test_season_signature(spark):
    temps = [10, 10, 10, 15, 20, 25, 30, 25, 20, 15, 10, 10]
    oxygen = [9, 9, 9, 8, 7, 4, 5, 6, 7, 8, 9, 9]
    rows = [("r", "s", m + 1, float(temps[m]), float(oxygen[m])) for m in range(12)]
    df = spark.createDataFrame(rows, "region string, station string, month int, water_temp_mmean double, oxygen_mmean double")
    r = baseline.season_signature(df).first()
    assert (r["warm_peak_month"], r["oxygen_nadir_month"], r["temp_oxygen_phase_lag"]) == (7, 6, 11.0)
    assert (r["warm_len_months"], r["cold_len_months"]) == (5, 7)
    flat = df.withColumn("water_temp_mmean", F.lit(5.0))
    f = baseline.season_signature(flat).first()
    assert (f["warm_len_months"], f["cold_len_months"], f["warm_peak_month"]) == (12, 12, 1)


def test_ranks_quantiles_and_sums_match_a_plain_sort(spark):
    rng = random.Random(5)
    vals = [rng.choice([0.0, 1.5, rng.random() * 10]) for _ in range(500)]
    df = spark.createDataFrame([(i, "hot" if i % 3 else "cold", v) for i, v in enumerate(vals)], "i long, g string, v double").repartition(5)
    ranks = {r["i"]: r["rank"] for r in ordered.global_rank(df, ["v", "i"]).collect()}
    assert [ranks[i] for i, _ in sorted(enumerate(vals), key=lambda x: (x[1], x[0]))] == list(range(1, 501))
    got = {(r["g"], r["prob"]): r["quantile"] for r in ordered.exact_quantiles(df, ["g"], ["v"], [0.0, 0.1, 0.5, 1.0]).collect()}
    for g in ("hot", "cold"):
        xs = sorted(v for i, v in enumerate(vals) if ("hot" if i % 3 else "cold") == g)
        for p in (0.0, 0.1, 0.5, 1.0):
            pos = p * (len(xs) - 1)
            lo, hi = xs[int(pos)], xs[min(int(pos) + 1, len(xs) - 1)]
            assert got[(g, p)] == pytest.approx(lo + (hi - lo) * (pos - int(pos)))
    sums = {r["i"]: r["v_before"] for r in ordered.cumulative_sum(df.select("i", "v"), ["i"], ["v"]).collect()}
    assert sums[499] == pytest.approx(sum(vals[:-1]))


def test_previous_reading_crosses_days(spark):
    ts = [ntz(2020, 1, 1, 23), ntz(2020, 1, 1, 23), ntz(2020, 1, 3, 1), ntz(2020, 1, 3, 2)]
    df = spark.createDataFrame([("s", t) for t in ts], "station string, ts timestamp_ntz")
    got = [(r["n_copies"], r["gap_hours"]) for r in rolling.reading_gaps(df, ["station"], "ts").orderBy("ts").collect()]
    assert got == [(2, None), (1, 26.0), (1, 1.0)]


def test_month_partials_give_what_the_readings_give(spark):
    """Uneven months, a measure without values, a null value, two stations; coverage, yearly means and climatology alike."""
    rng = random.Random(5)
    rows = []
    for station, step in (("a", 3), ("b", 11)):
        for i in range(0, 900, step):
            rows.append(("r", station, dt.date(2001, 3, 1) + dt.timedelta(days=i), None if i % 4 == 1 else rng.uniform(0, 30), None if station == "b" else rng.random()))
    df = spark.createDataFrame(rows, "region string, station string, date date, water_temp double, oxygen double").repartition(4)
    measures, keys = ["water_temp", "oxygen"], ["region", "station"]
    partials = baseline.station_month_partials(df, measures)
    assert partials.count() == len({(r[1], r[2].year, r[2].month) for r in rows})

    def same(a, b):
        got, want = ({tuple(r[c] for c in by): r for r in x.collect()} for x in (a, b))
        assert set(got) == set(want) and want
        for k in want:
            for c in set(want[k].asDict()) - set(by):
                assert got[k][c] is None if want[k][c] is None else got[k][c] == pytest.approx(want[k][c], rel=1e-12)

    by = [*keys, "year"]
    same(baseline.annual_coverage_of(partials, 0.2), baseline.annual_coverage(df, per_day=0.2))
    by = [*keys, "month"]
    same(baseline.merged_means(partials, measures, by, "_mmean"), baseline.climatology(df, measures))
    by = keys
    window = spark.createDataFrame([("r", "a", True)], "region string, station string, is_eligible boolean")
    whole = baseline.station_baseline(df.withColumn("depth", F.lit(1.0)), measures, window)
    names = [*keys, "mean_annual_water_temp", "mean_annual_oxygen", "n_years_oxygen"]
    same(whole.select(*names), baseline.year_balanced_means(df, measures).select(*names))
    same(whole.select(*keys, "n_obs_total", "n_years_present"), baseline.coverage_counts(df))
