"""Roll-up, baseline, coverage and screening queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators import baseline, clean, coverage, ordered, rollup
from tidepanel.plans.cleaning import EVENT_TYPES
from tidepanel.plans.registry import query, tidy
from tidepanel.session import staged
from tidepanel.sources.panels import (
    EV_SQL,
    LI_SQL,
    LOOKUP_SQL,
    OC_SQL,
    WATER_MEASURES,
    events_panel,
    sparse_panel,
    station_lookup,
    water_panel,
)

AIR = ["air_temp", "wind_speed", "solar"]


def daily_water(spark: SparkSession, d: str) -> DataFrame:
    """Daily water and driver panel of the long history."""
    return rollup.daily(water_panel(spark, d, by_station=True), ts="date", means=[*WATER_MEASURES, *AIR], sums=["precip"])


DW_SQL = (
    LI_SQL
    + ", dw AS (SELECT region, station, date, "
    + ", ".join(f"avg({c}) AS {c}" for c in [*WATER_MEASURES, *AIR])
    + ", coalesce(sum(precip), 0) AS precip FROM li GROUP BY region, station, date)"
)


@query(
    "daily_rollup",
    f"""WITH {EV_SQL} SELECT region, station, variable, CAST(ts AS DATE) AS date, round(avg(value), 6) AS value,
        round(coalesce(sum(CASE WHEN variable <> 'error' THEN value END), 0), 6) AS amount FROM ev GROUP BY ALL""",
)
def daily_rollup(spark, d):
    ev = events_panel(spark, d).withColumn("amount", F.when(F.col("variable") != "error", F.col("value")))
    return tidy(rollup.daily(ev, ["region", "station", "variable"], means=["value"], sums=["amount"]))


@query("daily_panel", f"WITH {DW_SQL} SELECT region, station, date, " + ", ".join(f"round({c}, 6) AS {c}" for c in [*WATER_MEASURES, *AIR, "precip"]) + " FROM dw")
def daily_panel(spark, d):
    return tidy(daily_water(spark, d))


@query(
    "downsample_4h",
    f"""WITH {EV_SQL}, e2 AS (SELECT *, CASE WHEN flag <> 0 THEN flag END AS mark FROM ev)
        SELECT region, station, time_bucket(INTERVAL '4 hours', ts) AS ts, round(avg(value), 6) AS value,
          arg_min(variable, ts) AS variable, CAST(arg_min(mark, ts) FILTER (WHERE mark IS NOT NULL) AS BIGINT) AS mark FROM e2 GROUP BY 1, 2, 3""",
)
def downsample_4h(spark, d):
    ev = events_panel(spark, d).withColumn("mark", F.when(F.col("flag") != 0, F.col("flag")))
    return tidy(rollup.downsample(ev, ["region", "station"], "ts", "4 hours", ["value"], ["variable", "mark"]))


@query(
    "snap_hour",
    f"""WITH {EV_SQL} SELECT station, date_trunc('hour', ts + INTERVAL 30 MINUTE) AS hour_ts, round(avg(value), 6) AS nut_value
        FROM ev WHERE variable = 'purchase' GROUP BY 1, 2""",
)
def snap_hour(spark, d):
    ev = events_panel(spark, d).filter(F.col("variable") == "purchase")
    return tidy(rollup.snap_hour(ev, ["station"], "ts", ["value", "absent"]))


# 100 readings stand for a full year of the given tables, so coverage is n / 100 (per day 100/365 or 100/366)
COVER_SQL = (
    LI_SQL
    + """, cov AS (SELECT region, station, year(date) AS year, count(*) AS n_obs, (CASE WHEN year(date) % 4 = 0 THEN 366 ELSE 365 END) * CAST(0.25 AS DOUBLE) AS expected_obs
      FROM li GROUP BY 1, 2, 3), cov2 AS (SELECT *, n_obs / expected_obs AS coverage_frac, n_obs / expected_obs >= 0.7 AS year_is_valid FROM cov),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY region, station ORDER BY year) AS valid_year_rank FROM cov2 WHERE year_is_valid),
    byr AS (SELECT * FROM ranked WHERE valid_year_rank <= 5),
    win AS (SELECT region, station, min(year) AS baseline_start_year, max(year) AS baseline_end_year, count(*) AS n_valid_years,
      avg(coverage_frac) AS mean_year_coverage, count(*) < 5 AS is_partial_baseline, count(*) >= 3 AS is_eligible FROM byr GROUP BY 1, 2),
    base AS (SELECT li.*, year(li.date) AS year FROM li JOIN byr ON li.region = byr.region AND li.station = byr.station AND year(li.date) = byr.year
      JOIN win ON li.region = win.region AND li.station = win.station WHERE is_eligible)"""
)


def covered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Panel, baseline years and baseline window of every station."""
    panel = water_panel(spark, d)
    years = baseline.baseline_years(baseline.annual_coverage(panel, per_day=0.25))
    return panel, years, baseline.baseline_window(years)


def baseline_panel(spark: SparkSession, d: str) -> DataFrame:
    panel, years, window = covered(spark, d)
    return baseline.baseline_rows(panel, years, window)


@query("annual_coverage", f"WITH {COVER_SQL} SELECT region, station, year, n_obs, expected_obs, round(coverage_frac, 6) AS coverage_frac, year_is_valid FROM cov2")
def annual_coverage(spark, d):
    return tidy(baseline.annual_coverage(water_panel(spark, d), per_day=0.25))


@query(
    "baseline_years",
    f"WITH {COVER_SQL} SELECT region, station, baseline_start_year, baseline_end_year, n_valid_years, round(mean_year_coverage, 6) AS mean_year_coverage, is_partial_baseline, is_eligible FROM win",
)
def baseline_years(spark, d):
    return tidy(covered(spark, d)[2])


@query("valid_year_rank", f"WITH {COVER_SQL} SELECT region, station, year, valid_year_rank FROM ranked")
def valid_year_rank(spark, d):
    ranked = baseline.rank_valid_years(baseline.annual_coverage(water_panel(spark, d), per_day=0.25))
    return tidy(ranked.select("region", "station", "year", "valid_year_rank"))


BALANCED_SQL = (
    "ym AS (SELECT region, station, year, " + ", ".join(f"avg({c}) AS {c}" for c in WATER_MEASURES) + " FROM base GROUP BY 1, 2, 3), "
    "yb AS (SELECT region, station, "
    + ", ".join(f"avg({c}) AS mean_annual_{c}, count({c}) AS n_years_{c}" for c in WATER_MEASURES)
    + " FROM ym GROUP BY 1, 2)"
)
MONTHLY_SQL = "mm AS (SELECT region, station, month(date) AS month, " + ", ".join(f"avg({c}) AS {c}_mmean" for c in WATER_MEASURES) + " FROM base GROUP BY 1, 2, 3)"


@query(
    "year_balanced_means",
    f"WITH {COVER_SQL}, {BALANCED_SQL} SELECT region, station, "
    + ", ".join(f"round(mean_annual_{c}, 6) AS mean_annual_{c}, n_years_{c}" for c in WATER_MEASURES)
    + " FROM yb",
)
def year_balanced_means(spark, d):
    return tidy(baseline.year_balanced_means(baseline_panel(spark, d), WATER_MEASURES))


@query("climatology", f"WITH {COVER_SQL}, {MONTHLY_SQL} SELECT region, station, month, " + ", ".join(f"round({c}_mmean, 6) AS {c}_mmean" for c in WATER_MEASURES) + " FROM mm")
def climatology(spark, d):
    return tidy(baseline.climatology(baseline_panel(spark, d), WATER_MEASURES))


@query(
    "seasonal_amplitude",
    f"WITH {COVER_SQL}, {MONTHLY_SQL} SELECT region, station, "
    + ", ".join(f"round(max({c}_mmean) - min({c}_mmean), 6) AS seasonal_amp_{c}" for c in WATER_MEASURES)
    + " FROM mm GROUP BY 1, 2",
)
def seasonal_amplitude(spark, d):
    monthly = baseline.climatology(baseline_panel(spark, d), WATER_MEASURES)
    return tidy(baseline.seasonal_amplitude(monthly, WATER_MEASURES))


SIGNATURE_SQL = """m1 AS (SELECT *, water_temp_mmean AS t, oxygen_mmean AS o, avg(water_temp_mmean) OVER w AS tm, max(water_temp_mmean) OVER w AS tx, min(water_temp_mmean) OVER w AS tn
     FROM mm WINDOW w AS (PARTITION BY region, station)),
  m2 AS (SELECT *, bool_or(t > tm) OVER (PARTITION BY region, station) AS aw, bool_or(t < tm) OVER (PARTITION BY region, station) AS ac FROM m1),
  m3 AS (SELECT *, coalesce(CASE WHEN aw THEN t > tm ELSE t = tx END, false) AS warm, coalesce(CASE WHEN ac THEN t < tm ELSE t = tn END, false) AS cold FROM m2),
  sig AS (SELECT region, station, arg_max(month, (round(t, 9), -month)) FILTER (WHERE t IS NOT NULL) AS warm_peak_month,
    arg_min(month, (round(o, 9), month)) FILTER (WHERE o IS NOT NULL) AS oxygen_nadir_month,
    count(*) FILTER (WHERE warm) AS warm_len_months, count(*) FILTER (WHERE cold) AS cold_len_months,
    sum(t - tm) FILTER (WHERE warm) AS warm_intensity_temp, coalesce(sum(tm - t) FILTER (WHERE cold), 0) AS cold_intensity_temp,
    avg(o) FILTER (WHERE warm) AS warm_oxygen_mean, min(o) FILTER (WHERE warm) AS warm_oxygen_min, avg(o) FILTER (WHERE cold) AS cold_oxygen_mean
    FROM m3 GROUP BY region, station)"""


@query(
    "season_signature",
    f"""WITH {COVER_SQL}, {MONTHLY_SQL}, {SIGNATURE_SQL} SELECT region, station, warm_peak_month, oxygen_nadir_month,
        CAST((oxygen_nadir_month - warm_peak_month + 12) % 12 AS DOUBLE) AS temp_oxygen_phase_lag, warm_len_months, cold_len_months,
        round(warm_intensity_temp, 6) AS warm_intensity_temp, round(cold_intensity_temp, 6) AS cold_intensity_temp,
        round(warm_oxygen_mean, 6) AS warm_oxygen_mean, round(warm_oxygen_min, 6) AS warm_oxygen_min, round(cold_oxygen_mean, 6) AS cold_oxygen_mean FROM sig""",
)
def season_signature(spark, d):
    return tidy(baseline.season_signature(baseline.climatology(baseline_panel(spark, d), WATER_MEASURES)))


DEPTH_SQL = "dp AS (SELECT region, station, quantile_cont(depth, 0.1) AS p10_depth, median(depth) AS median_depth, quantile_cont(depth, 0.9) AS p90_depth FROM base GROUP BY 1, 2)"


@query(
    "depth_percentiles",
    f"""WITH {COVER_SQL}, {DEPTH_SQL} SELECT region, station, round(p10_depth, 6) AS p10_depth, round(median_depth, 6) AS median_depth,
        round(p90_depth, 6) AS p90_depth, round(p90_depth - p10_depth, 6) AS iqr_depth FROM dp""",
)
def depth_percentiles(spark, d):
    return tidy(baseline.depth_percentiles(baseline_panel(spark, d)))


@query("coverage_counts", f"WITH {COVER_SQL} SELECT region, station, count(*) AS n_obs_total, count(DISTINCT year) AS n_years_present FROM base GROUP BY 1, 2")
def coverage_counts(spark, d):
    return tidy(baseline.coverage_counts(baseline_panel(spark, d)))


@query(
    "station_baseline",
    f"""WITH {COVER_SQL}, {BALANCED_SQL}, {MONTHLY_SQL}, {SIGNATURE_SQL}, {DEPTH_SQL},
        cc AS (SELECT region, station, count(*) AS n_obs_total, count(DISTINCT year) AS n_years_present FROM base GROUP BY 1, 2)
        SELECT yb.region, yb.station, round(mean_annual_water_temp, 6) AS mean_annual_water_temp, round(mean_annual_oxygen, 6) AS mean_annual_oxygen,
          warm_peak_month, warm_len_months, round(median_depth, 6) AS median_depth, n_obs_total, n_years_present, baseline_start_year, is_partial_baseline
        FROM yb LEFT JOIN sig ON yb.region = sig.region AND yb.station = sig.station LEFT JOIN dp ON yb.region = dp.region AND yb.station = dp.station
        LEFT JOIN cc ON yb.region = cc.region AND yb.station = cc.station LEFT JOIN win ON yb.region = win.region AND yb.station = win.station""",
)
def station_baseline(spark, d):
    panel = water_panel(spark, d)
    partials = staged(baseline.station_month_partials(panel, WATER_MEASURES))
    years = staged(baseline.baseline_years(baseline.annual_coverage_of(partials, per_day=0.25)))
    window = baseline.baseline_window(years)
    rows = baseline.baseline_rows(panel, years, window)
    out = baseline.station_baseline(rows, WATER_MEASURES, window, partials=baseline.in_baseline(partials, years, window))
    return tidy(
        out.select(
            "region", "station", "mean_annual_water_temp", "mean_annual_oxygen", "warm_peak_month", "warm_len_months",
            "median_depth", "n_obs_total", "n_years_present", "baseline_start_year", "is_partial_baseline",
        )
    )


@query(
    "impute_group_median",
    f"""WITH {LI_SQL}, s AS (SELECT region, station, avg(CASE WHEN station % 3 <> 0 THEN water_temp END) AS t,
          avg(CASE WHEN region NOT LIKE '%1' THEN oxygen END) AS o FROM li GROUP BY 1, 2),
        g AS (SELECT *, coalesce(t, median(t) OVER (PARTITION BY region)) AS t2, coalesce(o, median(o) OVER (PARTITION BY region)) AS o2 FROM s)
        SELECT region, station, round(coalesce(t2, (SELECT median(t2) FROM g)), 6) AS t, round(coalesce(o2, (SELECT median(o2) FROM g)), 6) AS o FROM g""",
)
def impute_group_median(spark, d):
    s = water_panel(spark, d).groupBy("region", "station").agg(
        F.avg(F.when(F.col("station") % 3 != 0, F.col("water_temp"))).alias("t"),
        F.avg(F.when(~F.col("region").like("%1"), F.col("oxygen"))).alias("o"),
    )
    return tidy(baseline.impute_group_median(s, ["region"], ["t", "o"]))


@query(
    "column_medians",
    f"WITH {LI_SQL} SELECT round(median(water_temp), 6) AS water_temp, round(median(salinity), 6) AS salinity, round(median(oxygen), 6) AS oxygen FROM li",
)
def column_medians(spark, d):
    return tidy(baseline.column_medians(water_panel(spark, d), ["water_temp", "salinity", "oxygen"]))


BASE_SQL = (
    "fb AS (SELECT region, station, "
    + ", ".join(f"avg({c}) AS {c}_baseline" for c in WATER_MEASURES)
    + " FROM dw WHERE date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' GROUP BY 1, 2)"
)


def water_with_deltas(spark: SparkSession, d: str) -> DataFrame:
    days = daily_water(spark, d)
    base = baseline.fixed_baseline(days, WATER_MEASURES, "1995-01-01", "1996-12-31")
    return baseline.deltas(days, base, WATER_MEASURES)


@query(
    "baseline_deltas",
    f"WITH {DW_SQL}, {BASE_SQL} SELECT dw.region, dw.station, date, "
    + ", ".join(f"round({c} - {c}_baseline, 6) AS delta_{c}" for c in WATER_MEASURES)
    + " FROM dw LEFT JOIN fb ON dw.region = fb.region AND dw.station = fb.station",
)
def baseline_deltas(spark, d):
    return tidy(water_with_deltas(spark, d).select("region", "station", "date", *[f"delta_{c}" for c in WATER_MEASURES]))


SYM_SQL = "sym AS (SELECT region, station, year(date) AS year, month(date) AS month_num, count(*) AS n_rows, avg(water_temp) AS water_temp, avg(oxygen) AS oxygen FROM li GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3)"


@query("station_year_months", f"WITH {LI_SQL}, {SYM_SQL} SELECT region, station, year, month_num, n_rows, round(water_temp, 6) AS water_temp, round(oxygen, 6) AS oxygen FROM sym")
def station_year_months(spark, d):
    return tidy(rollup.station_year_months(water_panel(spark, d), ["water_temp", "oxygen"], 3))


@query(
    "month_baseline",
    f"""WITH {LI_SQL}, {SYM_SQL} SELECT region, station, month_num, count(*) AS n_baseline_months, round(avg(water_temp), 6) AS water_temp_baseline,
        round(avg(oxygen), 6) AS oxygen_baseline FROM sym WHERE year BETWEEN 1995 AND 1999 GROUP BY 1, 2, 3 HAVING count(*) >= 3""",
)
def month_baseline(spark, d):
    months = rollup.station_year_months(water_panel(spark, d), ["water_temp", "oxygen"], 3)
    return tidy(baseline.month_baseline(months, ["water_temp", "oxygen"], 1995, 1999))


SPAN_SQL = (
    OC_SQL
    + """, sp0 AS (SELECT region, station, min(date) AS first_obs_date, max(date) AS last_obs_date, count(DISTINCT year(date)) AS n_years_obs FROM oc GROUP BY 1, 2),
    sp1 AS (SELECT *, CASE WHEN month(first_obs_date) = 1 AND day(first_obs_date) = 1 THEN year(first_obs_date) ELSE year(first_obs_date) + 1 END AS first_full_year,
      CASE WHEN month(last_obs_date) = 12 AND day(last_obs_date) = 31 THEN year(last_obs_date) ELSE year(last_obs_date) - 1 END AS last_full_year FROM sp0),
    sp AS (SELECT *, greatest(0, last_full_year - first_full_year + 1) AS n_full_years FROM sp1)"""
)
GAP_SQL = """grid AS (SELECT region, station, y AS year, m AS month FROM sp, unnest(generate_series(first_full_year, last_full_year)) AS a(y), unnest(generate_series(1, 12)) AS b(m) WHERE n_full_years > 0),
    seen AS (SELECT DISTINCT region, station, year(date) AS year, month(date) AS month FROM oc),
    g AS (SELECT grid.*, seen.month IS NULL AS missing FROM grid LEFT JOIN seen USING (region, station, year, month)),
    isl AS (SELECT *, month - row_number() OVER (PARTITION BY region, station, year, missing ORDER BY month) AS island FROM g),
    runs AS (SELECT region, station, year, min(month) AS start, count(*) AS len FROM isl WHERE missing GROUP BY region, station, year, island),
    best AS (SELECT region, station, year, max(len) AS len, arg_min(start, (-len, start)) AS start FROM runs GROUP BY 1, 2, 3),
    cnt AS (SELECT region, station, year, count(*) FILTER (WHERE missing) AS n_missing, count(*) FILTER (WHERE NOT missing) AS n_obs FROM g GROUP BY 1, 2, 3),
    gaps AS (SELECT cnt.region, cnt.station, cnt.year, n_missing AS n_missing_whole_months, n_obs AS n_obs_months, coalesce(len, 0) AS max_consecutive_missing_months,
      CASE WHEN len >= 2 THEN start END AS long_gap_start_month, coalesce(len, 0) >= 2 AS has_long_gap FROM cnt LEFT JOIN best USING (region, station, year))"""


@query("station_span", f"WITH {SPAN_SQL} SELECT region, station, first_obs_date, last_obs_date, n_years_obs, first_full_year, last_full_year, n_full_years FROM sp")
def station_span(spark, d):
    return tidy(coverage.station_span(sparse_panel(spark, d)))


@query("month_days", f"WITH {OC_SQL} SELECT region, station, year(date) AS year, month(date) AS month, count(DISTINCT date) AS n_obs_days FROM oc GROUP BY 1, 2, 3, 4")
def month_days(spark, d):
    return tidy(coverage.month_days(sparse_panel(spark, d)))


@query("missing_runs", f"WITH {SPAN_SQL}, {GAP_SQL} SELECT * FROM gaps")
def missing_runs(spark, d):
    panel = sparse_panel(spark, d)
    return tidy(coverage.missing_runs(panel, coverage.station_span(panel)))


MODAL_SQL = """modal AS (SELECT region, station, long_gap_start_month AS modal_long_gap_start_month, n AS n_years_same_start FROM (
    SELECT region, station, long_gap_start_month, count(*) AS n FROM gaps WHERE has_long_gap GROUP BY 1, 2, 3)
    QUALIFY row_number() OVER (PARTITION BY region, station ORDER BY n DESC, long_gap_start_month) = 1)"""


@query("modal_gap", f"WITH {SPAN_SQL}, {GAP_SQL}, {MODAL_SQL} SELECT * FROM modal")
def modal_gap(spark, d):
    panel = sparse_panel(spark, d)
    return tidy(coverage.modal_gap(coverage.missing_runs(panel, coverage.station_span(panel))))


@query(
    "seasonal_breaks",
    f"""WITH {SPAN_SQL}, {GAP_SQL}, {MODAL_SQL}, su AS (SELECT region, station, median(n_missing_whole_months) AS mm, median(max_consecutive_missing_months) AS mc,
          count(*) FILTER (WHERE has_long_gap) AS nl, avg(CAST(has_long_gap AS INT)) AS pl FROM gaps GROUP BY 1, 2),
        j AS (SELECT sp.region, sp.station, n_full_years, coalesce(mm, 0) AS median_missing_whole_months, coalesce(mc, 0) AS median_max_consecutive_missing_months,
          coalesce(nl, 0) AS n_full_years_long_gap, coalesce(pl, 0) AS pct_full_years_with_long_gap, coalesce(modal_long_gap_start_month, 0) AS modal_long_gap_start_month,
          coalesce(n_years_same_start, 0) AS n_years_same_start FROM sp LEFT JOIN su USING (region, station) LEFT JOIN modal USING (region, station)),
        k AS (SELECT *, CASE WHEN n_full_years_long_gap > 0 THEN n_years_same_start / n_full_years_long_gap ELSE 0 END AS share FROM j)
        SELECT region, station, n_full_years, round(median_missing_whole_months, 6) AS median_missing_whole_months,
          round(median_max_consecutive_missing_months, 6) AS median_max_consecutive_missing_months, n_full_years_long_gap,
          round(pct_full_years_with_long_gap, 6) AS pct_full_years_with_long_gap, modal_long_gap_start_month, n_years_same_start,
          round(share, 6) AS modal_long_gap_start_share, n_full_years >= 3 AND pct_full_years_with_long_gap >= 0.5 AND share >= 0.6 AS seasonal_break_station FROM k""",
)
def seasonal_breaks(spark, d):
    panel = sparse_panel(spark, d)
    span = coverage.station_span(panel)
    out = coverage.seasonal_breaks(span, coverage.missing_runs(panel, span))
    return tidy(out.drop("first_obs_date", "last_obs_date", "n_years_obs", "first_full_year", "last_full_year"))


@query(
    "short_records",
    f"""WITH {LI_SQL}, {LOOKUP_SQL}, f AS (SELECT *, water_temp IS NOT NULL OR oxygen IS NOT NULL AS core FROM li),
        h AS (SELECT region, station, count(*) AS n_raw_rows, count(DISTINCT date) AS n_raw_dates, count(DISTINCT year(date)) AS n_raw_years,
          count(*) FILTER (WHERE core) AS n_core_rows, count(DISTINCT CASE WHEN core THEN date END) AS n_core_dates,
          count(DISTINCT CASE WHEN core THEN year(date) END) AS n_core_years, max(date) - min(date) AS record_span_days FROM f GROUP BY 1, 2),
        j AS (SELECT lk.region, lk.station, in_history, coalesce(n_raw_rows, 0) AS n_raw_rows, coalesce(n_raw_dates, 0) AS n_raw_dates, coalesce(n_raw_years, 0) AS n_raw_years,
          coalesce(n_core_rows, 0) AS n_core_rows, coalesce(n_core_dates, 0) AS n_core_dates, coalesce(n_core_years, 0) AS n_core_years,
          coalesce(record_span_days, 0) AS record_span_days FROM lk LEFT JOIN h USING (region, station))
        SELECT *, round(record_span_days / 365.25, 4) AS record_span_years, NOT in_history AS lookup_preexcluded,
          round(record_span_days / 365.25, 4) < 6.65 AS short_record_span_station, NOT in_history OR round(record_span_days / 365.25, 4) < 6.65 AS pointless_station FROM j""",
)
def short_records(spark, d):
    out = coverage.short_records(water_panel(spark, d), station_lookup(spark, d), ["water_temp", "oxygen"], min_years=6.65)
    return tidy(out)


@query(
    "raw_quality",
    f"""WITH {DW_SQL} SELECT region, station, count(*) AS n_daily_rows,
        count(water_temp) + count(salinity) + count(oxygen) + count(ph) + count(depth) AS n_non_null_core_water,
        count(water_temp) + count(salinity) + count(oxygen) + count(ph) + count(depth) > 0 AS has_raw_signal FROM dw GROUP BY 1, 2""",
)
def raw_quality(spark, d):
    return tidy(coverage.raw_quality(daily_water(spark, d), WATER_MEASURES))


_SYQ = """q AS (SELECT region, station, year(date) AS year, count(*) AS n_days,
    count(*) FILTER (WHERE water_temp IS NOT NULL OR salinity IS NOT NULL OR oxygen IS NOT NULL) AS n_any_core_days,
    count(water_temp) AS n_temp_days, count(oxygen) AS n_oxygen_days,
    count(DISTINCT month(date)) FILTER (WHERE water_temp IS NOT NULL OR salinity IS NOT NULL OR oxygen IS NOT NULL) AS n_any_core_months,
    count(DISTINCT month(date)) FILTER (WHERE water_temp IS NOT NULL) AS n_temp_months,
    count(DISTINCT month(date)) FILTER (WHERE oxygen IS NOT NULL) AS n_oxygen_months,
    count(*) FILTER (WHERE month(date) BETWEEN 6 AND 9) AS n_warm_days,
    count(water_temp) FILTER (WHERE month(date) BETWEEN 6 AND 9) AS n_warm_temp_days,
    count(oxygen) FILTER (WHERE month(date) BETWEEN 6 AND 9) AS n_warm_oxygen_days,
    count(DISTINCT month(date)) FILTER (WHERE month(date) BETWEEN 6 AND 9 AND water_temp IS NOT NULL) AS n_warm_temp_months,
    count(DISTINCT month(date)) FILTER (WHERE month(date) BETWEEN 6 AND 9 AND oxygen IS NOT NULL) AS n_warm_oxygen_months
    FROM dw GROUP BY 1, 2, 3)"""
SYQ_SQL = f"{_SYQ}, syq AS (SELECT *, n_any_core_days >= 60 AND n_temp_days >= 60 AND n_temp_months >= 6 AS has_model_year, " \
    "n_any_core_days >= 60 AND n_temp_days >= 60 AND n_temp_months >= 6 AND n_warm_oxygen_days >= 20 AND n_warm_oxygen_months >= 3 AS has_warm_oxygen_year FROM q)"
SYQ_LIMITS = {"min_days": 60, "min_months": 6, "min_warm_days": 20, "min_warm_months": 3}


@query("station_year_quality", f"WITH {DW_SQL}, {SYQ_SQL} SELECT * FROM syq")
def station_year_quality(spark, d):
    return tidy(coverage.station_year_quality(daily_water(spark, d), ["water_temp", "salinity", "oxygen"], **SYQ_LIMITS))


@query(
    "station_summary",
    f"""WITH {DW_SQL} SELECT region, station, min(date) AS first_date, max(date) AS last_date, count(*) AS n_daily_rows, count(DISTINCT year(date)) AS n_years,
        count(water_temp) AS n_temp_days, count(oxygen) AS n_oxygen_days, count(DISTINCT year(date)) >= 5 AND count(water_temp) >= 480 AS keep_station,
        CASE WHEN count(DISTINCT year(date)) >= 5 AND count(water_temp) >= 480 THEN 'keep' ELSE 'drop_small_station' END AS screen_note FROM dw GROUP BY 1, 2""",
)
def station_summary(spark, d):
    return tidy(coverage.station_summary(daily_water(spark, d), min_temp_days=480))


@query(
    "station_year_screen",
    f"""WITH {DW_SQL}, s AS (SELECT region, station, year(date) AS year, count(*) AS n_days, count(water_temp) AS n_temp_days, count(oxygen) AS n_oxygen_days,
          count(DISTINCT month(date)) AS n_any_months, count(oxygen) FILTER (WHERE month(date) BETWEEN 6 AND 9) AS n_warm_oxygen_days,
          count(DISTINCT month(date)) FILTER (WHERE month(date) BETWEEN 6 AND 9) AS n_warm_months FROM dw GROUP BY 1, 2, 3)
        SELECT *, n_temp_days >= 60 AND n_any_months >= 6 AS keep_year,
          n_temp_days >= 60 AND n_any_months >= 6 AND n_warm_oxygen_days >= 20 AND n_warm_months >= 3 AS keep_warm_oxygen_year,
          CASE WHEN n_temp_days >= 60 AND n_any_months >= 6 THEN 'keep' ELSE 'drop_sparse_year' END AS screen_note FROM s""",
)
def station_year_screen(spark, d):
    return tidy(coverage.station_year_screen(daily_water(spark, d), **SYQ_LIMITS))


@query(
    "cohort_split",
    f"""WITH {LI_SQL}, k AS (SELECT DISTINCT region, station FROM li),
        r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY station) AS region_rank, count(*) OVER (PARTITION BY region) AS region_n FROM k)
        SELECT *, round(region_rank / region_n, 6) AS region_frac, CASE WHEN region_rank / region_n <= 0.8 THEN 'train' ELSE 'holdout' END AS cohort FROM r""",
)
def cohort_split(spark, d):
    return tidy(coverage.cohort_split(water_panel(spark, d).select("region", "station").distinct()))


@query(
    "every_fifth",
    f"""WITH {LI_SQL}, k AS (SELECT DISTINCT region, station FROM li)
        SELECT region, station, CASE WHEN (row_number() OVER (ORDER BY region, station) - 1) % 5 = 0 THEN 'holdout' ELSE 'train' END AS cohort FROM k""",
)
def every_fifth(spark, d):
    return coverage.every_nth_holdout(water_panel(spark, d).select("region", "station").distinct())


@query("context_stats", f"WITH {DW_SQL} SELECT region, station, round(avg(water_temp), 6) AS water_temp_context_mean, round(avg(ph), 6) AS ph_context_mean, round(stddev_samp(water_temp), 6) AS water_temp_context_std, round(stddev_samp(ph), 6) AS ph_context_std FROM dw GROUP BY 1, 2")
def context_stats(spark, d):
    return tidy(rollup.context_stats(daily_water(spark, d), ["water_temp", "ph"]))


@query(
    "doy_median",
    f"""WITH {DW_SQL}, m AS (SELECT dayofyear(date) AS doy, median(water_temp) AS v FROM dw WHERE region <> 'NATION_3' GROUP BY 1)
        SELECT dw.region, dw.station, dw.date, round(coalesce(m.v, (SELECT median(water_temp) FROM dw WHERE region <> 'NATION_3')), 6) AS pred
        FROM dw LEFT JOIN m ON dayofyear(dw.date) = m.doy""",
)
def doy_median(spark, d):
    from tidepanel.operators.joins import lookup_fill

    days = daily_water(spark, d).withColumn("doy", F.dayofyear("date"))
    train = days.filter(F.col("region") != "NATION_3")
    table = ordered.quantile_columns(train, ["doy"], {"v": ("water_temp", 0.5)})
    overall = ordered.quantile_columns(train, [], {"v": ("water_temp", 0.5)}).scalar()
    return tidy(lookup_fill(days, table, ["doy"], "v", overall, "pred").select("region", "station", "date", "pred"))


SYF_SQL = """syf AS (SELECT region, station, year(date) AS year, count(*) AS n_days_annual, count(*) FILTER (WHERE month(date) BETWEEN 6 AND 9) AS n_days_warm,
    avg(air_temp) AS air_temp_mean, stddev_samp(air_temp) AS air_temp_std, avg(air_temp) FILTER (WHERE month(date) BETWEEN 6 AND 9) AS air_temp_warm_mean,
    stddev_samp(air_temp) FILTER (WHERE month(date) BETWEEN 6 AND 9) AS air_temp_warm_std,
    avg(precip) AS precip_mean, stddev_samp(precip) AS precip_std, avg(precip) FILTER (WHERE month(date) BETWEEN 6 AND 9) AS precip_warm_mean,
    stddev_samp(precip) FILTER (WHERE month(date) BETWEEN 6 AND 9) AS precip_warm_std,
    avg(ph) AS ph_annual_mean, avg(oxygen) AS oxygen_annual_mean, avg(oxygen) FILTER (WHERE month(date) BETWEEN 6 AND 9) AS oxygen_warm_mean FROM dw GROUP BY 1, 2, 3)"""
_SYF_COLS = ["air_temp_mean", "air_temp_std", "air_temp_warm_mean", "air_temp_warm_std", "precip_mean", "precip_std", "precip_warm_mean", "precip_warm_std", "ph_annual_mean", "oxygen_annual_mean", "oxygen_warm_mean"]


@query("station_year_features", f"WITH {DW_SQL}, {SYF_SQL} SELECT region, station, year, n_days_annual, n_days_warm, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SYF_COLS) + " FROM syf")
def station_year_features(spark, d):
    return tidy(rollup.station_year_features(daily_water(spark, d), ["air_temp", "precip"], ["ph"], ["oxygen"]).drop("oxygen_std"))


STRESS_SQL = """os AS (SELECT region, station, year(date) AS year, min(oxygen) AS oxygen_warm_min, quantile_cont(oxygen, 0.1) AS oxygen_warm_p10,
    avg(CAST(round(oxygen, 9) < 2 AS INT)) AS oxygen_warm_hypoxic_day_share, avg(CAST(round(oxygen, 9) < 5 AS INT)) AS oxygen_warm_below_optimal_day_share
    FROM dw WHERE month(date) BETWEEN 6 AND 9 GROUP BY 1, 2, 3)"""


@query("oxygen_stress", f"WITH {DW_SQL}, {STRESS_SQL} SELECT region, station, year, " + ", ".join(f"round({c}, 6) AS {c}" for c in ["oxygen_warm_min", "oxygen_warm_p10", "oxygen_warm_hypoxic_day_share", "oxygen_warm_below_optimal_day_share"]) + " FROM os")
def oxygen_stress(spark, d):
    return tidy(rollup.oxygen_stress(daily_water(spark, d)))


@query("driver_climatology", f"WITH {DW_SQL} SELECT region, station, least(dayofyear(date), 365) AS doy, round(avg(air_temp), 6) AS air_temp, round(avg(precip), 6) AS precip FROM dw GROUP BY 1, 2, 3")
def driver_climatology(spark, d):
    return tidy(rollup.driver_climatology(daily_water(spark, d), ["air_temp", "precip"]))


@query(
    "monthly_history",
    f"""WITH {DW_SQL} SELECT region, station, CAST(date_trunc('month', date) AS DATE) AS month_date, round(avg(air_temp), 6) AS air_temp, round(avg(precip), 6) AS precip,
        round(avg(water_temp), 6) AS water_temp, round(avg(oxygen), 6) AS oxygen, min(year(date)) AS year, min(month(date)) AS month_num FROM dw WHERE year(date) >= 1997 GROUP BY 1, 2, 3""",
)
def monthly_history(spark, d):
    days = daily_water(spark, d)
    air, water = days.select("region", "station", "date", "air_temp", "precip"), days.select("region", "station", "date", "water_temp", "oxygen")
    return tidy(rollup.monthly_history(air, water, ["air_temp", "precip"], ["water_temp", "oxygen"], 1997))


@query(
    "crosstab_shares",
    f"WITH {EV_SQL} SELECT region, count(*) AS n_rows, " + ", ".join(f"round(count(*) FILTER (WHERE variable = '{v}') / count(*), 6) AS {v}" for v in EVENT_TYPES) + " FROM ev GROUP BY region",
)
def crosstab_shares(spark, d):
    return tidy(rollup.crosstab_shares(events_panel(spark, d), ["region"], "variable", EVENT_TYPES))


@query(
    "top_shares_text",
    f"""WITH {EV_SQL}, c AS (SELECT region, station, count(*) AS n, sum(count(*)) OVER (PARTITION BY region) AS t, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, station) AS rk
          FROM ev GROUP BY 1, 2) SELECT region, string_agg(station || ' (' || format('{{:.3f}}', n / t) || ')', ', ' ORDER BY rk) AS top_members FROM c WHERE rk <= 5 GROUP BY region""",
)
def top_shares_text(spark, d):
    return rollup.top_shares_text(events_panel(spark, d), "region", "station")


@query(
    "exceedance",
    f"""WITH {LI_SQL}, b AS (SELECT floor(water_temp) AS bin, * FROM li WHERE water_temp IS NOT NULL AND salinity IS NOT NULL AND water_temp < (SELECT ceil(max(water_temp)) FROM li WHERE salinity IS NOT NULL)),
        t AS (SELECT unnest([5.0, 20.0, 30.0]) AS threshold)
        SELECT bin, round(avg(water_temp), 6) AS bin_mean, count(*) AS n_rows, CAST(threshold AS DOUBLE) AS threshold, round(avg(CAST(salinity >= threshold AS INT)), 6) AS rate,
          round(100 * avg(CAST(salinity >= threshold AS INT)), 6) AS pct_rows_above_threshold FROM b, t GROUP BY bin, threshold""",
)
def exceedance(spark, d):
    out = rollup.exceedance(water_panel(spark, d), "water_temp", "salinity", [5, 20, 30])
    return tidy(out.withColumn("bin", F.col("bin").cast("double")))


BAND_SQL = """cut AS (SELECT quantile_cont(water_temp, 1.0 / 3) AS a, quantile_cont(water_temp, 2.0 / 3) AS b FROM li),
    banded AS (SELECT li.*, CASE WHEN water_temp <= a THEN 'cold' WHEN water_temp > b THEN 'warm' WHEN water_temp IS NOT NULL THEN 'mid' END AS band FROM li, cut)"""


@query("tercile_bands", f"WITH {LI_SQL}, {BAND_SQL} SELECT band, count(*) AS n, round(avg(water_temp), 6) AS mean_temp FROM banded GROUP BY band")
def tercile_bands(spark, d):
    banded = rollup.tercile_bands(water_panel(spark, d), "water_temp", ["cold", "mid", "warm"])
    return tidy(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg("water_temp").alias("mean_temp")))


@query(
    "state_mix",
    f"""WITH {LI_SQL}, {BAND_SQL}, s AS (SELECT *, CASE WHEN salinity < 5 THEN 'low' WHEN salinity < 20 THEN 'moderate' WHEN salinity >= 20 THEN 'bloom' END AS state FROM banded)
        SELECT year(date) AS year, band, count(*) AS n_rows, round(count(*) FILTER (WHERE state = 'low') / count(*), 6) AS low,
          round(count(*) FILTER (WHERE state = 'moderate') / count(*), 6) AS moderate, round(count(*) FILTER (WHERE state = 'bloom') / count(*), 6) AS bloom
        FROM s WHERE state IS NOT NULL AND band IS NOT NULL GROUP BY 1, 2""",
)
def state_mix(spark, d):
    banded = rollup.tercile_bands(water_panel(spark, d), "water_temp", ["cold", "mid", "warm"]).filter("band is not null")
    states = banded.withColumns({"state": clean.state_label(F.col("salinity")), "year": F.year("date")})
    return tidy(rollup.crosstab_shares(states, ["year", "band"], "state", ["low", "moderate", "bloom"]))


@query(
    "balanced_daily",
    f"""WITH {LI_SQL}, s AS (SELECT date, station, avg(water_temp) AS v FROM li GROUP BY 1, 2)
        SELECT date, round(avg(v), 6) AS water_temp_balanced, count(station) AS station_count FROM s GROUP BY date HAVING count(station) >= 8 AND avg(v) IS NOT NULL""",
)
def balanced_daily(spark, d):
    return tidy(rollup.balanced_daily(water_panel(spark, d), "station", "date", "water_temp", 8))


@query(
    "station_count_quantiles",
    f"""WITH {LI_SQL}, s AS (SELECT date, count(DISTINCT station) AS n FROM li GROUP BY 1)
        SELECT CAST(p AS DOUBLE) AS prob, round(quantile_cont(n, p), 6) AS quantile FROM s, (VALUES (0.1), (0.25), (0.5), (0.75), (0.9)) t(p) GROUP BY p""".replace(
        "quantile_cont(n, p)", "CASE p WHEN 0.1 THEN quantile_cont(n, 0.1) WHEN 0.25 THEN quantile_cont(n, 0.25) WHEN 0.5 THEN quantile_cont(n, 0.5) WHEN 0.75 THEN quantile_cont(n, 0.75) ELSE quantile_cont(n, 0.9) END"
    ),
)
def station_count_quantiles(spark, d):
    days = water_panel(spark, d).select("date", "station").distinct().groupBy("date").agg(F.count("station").alias("n"))
    return tidy(ordered.exact_quantiles(days, [], ["n"], [0.1, 0.25, 0.5, 0.75, 0.9]).select("prob", "quantile"))


TERT_SQL = """rm AS (SELECT region, avg(water_temp) AS m FROM li GROUP BY 1), rc AS (SELECT quantile_cont(m, 1.0 / 3) AS a, quantile_cont(m, 2.0 / 3) AS b FROM rm),
    rg AS (SELECT region, m, CASE WHEN m <= a THEN 'cold' WHEN m > b THEN 'warm' ELSE 'mid' END AS tertile FROM rm, rc)"""


@query("tertile_groups", f"WITH {LI_SQL}, {TERT_SQL} SELECT region, round(m, 6) AS group_mean, tertile FROM rg")
def tertile_groups(spark, d):
    return tidy(rollup.tertile_groups(water_panel(spark, d), "region", "water_temp", ["cold", "mid", "warm"]))


@query(
    "group_daily_anomaly",
    f"WITH {LI_SQL}, {TERT_SQL}, dd AS (SELECT date, region, avg(water_temp) AS v FROM li GROUP BY 1, 2) SELECT date, "
    + ", ".join(f"round(avg(v) FILTER (WHERE tertile = '{t}'), 6) AS {t}, round(avg(v - m) FILTER (WHERE tertile = '{t}'), 6) AS {t}_anomaly" for t in ["cold", "mid", "warm"])
    + " FROM dd JOIN rg USING (region) GROUP BY date",
)
def group_daily_anomaly(spark, d):
    return tidy(rollup.group_daily_anomaly(water_panel(spark, d), "region", "date", "water_temp"))


@query(
    "resample_week",
    f"""WITH {OC_SQL}, o AS (SELECT * FROM oc WHERE station % 37 = 0), w AS (SELECT CAST(date_trunc('week', date) AS DATE) + 6 AS period, avg(value) AS value FROM o GROUP BY 1),
        sp AS (SELECT CAST(unnest(generate_series((SELECT min(period) FROM w), (SELECT max(period) FROM w), INTERVAL 7 DAY)) AS DATE) AS period)
        SELECT sp.period, round(value, 6) AS value FROM sp LEFT JOIN w USING (period)""".replace("SELECT * FROM oc WHERE station % 37 = 0", "SELECT * FROM oc"),
)
def resample_week(spark, d):
    return tidy(rollup.resample_calendar(sparse_panel(spark, d), "date", ["value"], "week"))


@query(
    "resample_day",
    f"""WITH {OC_SQL}, w AS (SELECT date AS period, avg(value) AS value FROM oc GROUP BY 1),
        sp AS (SELECT CAST(unnest(generate_series((SELECT min(period) FROM w), (SELECT max(period) FROM w), INTERVAL 1 DAY)) AS DATE) AS period)
        SELECT sp.period, round(value, 6) AS value FROM sp LEFT JOIN w USING (period)""",
)
def resample_day(spark, d):
    return tidy(rollup.resample_calendar(sparse_panel(spark, d), "date", ["value"], "day"))


@query(
    "residual_spread",
    f"""WITH {LI_SQL} SELECT region, round(stddev_samp(air_temp - water_temp) FILTER (WHERE date < DATE '1998-01-01'), 6) AS std_before,
        round(stddev_samp(air_temp - water_temp) FILTER (WHERE date >= DATE '1998-01-01'), 6) AS std_after,
        round(stddev_samp(air_temp - water_temp) FILTER (WHERE date >= DATE '1998-01-01') / stddev_samp(air_temp - water_temp) FILTER (WHERE date < DATE '1998-01-01'), 6) AS ratio FROM li GROUP BY region""",
)
def residual_spread(spark, d):
    li = water_panel(spark, d).withColumn("r", F.col("air_temp") - F.col("water_temp"))
    return tidy(rollup.residual_spread(li, "r", "date", "1998-01-01", ["region"]))


@query(
    "cohort_counts",
    f"""WITH {DW_SQL} SELECT year(date) AS year, region, count(*) AS n_rows, count(DISTINCT station) AS n_stations FROM dw GROUP BY 1, 2""",
)
def cohort_counts(spark, d):
    per_station = daily_water(spark, d).groupBy(F.year("date").alias("year"), "region", "station").agg(F.count(F.lit(1)).alias("n"))
    return tidy(per_station.groupBy("year", "region").agg(F.sum("n").alias("n_rows"), F.count("station").alias("n_stations")))


@query("distinct_keys", f"WITH {LI_SQL} SELECT DISTINCT region, station FROM li")
def distinct_keys(spark, d):
    return water_panel(spark, d).select("region", "station").distinct()


@query(
    "daily_coverage",
    f"""WITH {DW_SQL} SELECT region, station, year(date) AS year, count(*) AS n_days, count(water_temp) AS n_temp_days, count(oxygen) AS n_oxygen_days FROM dw GROUP BY 1, 2, 3""",
)
def daily_coverage(spark, d):
    days = daily_water(spark, d)
    return tidy(
        days.groupBy("region", "station", F.year("date").alias("year")).agg(
            F.count(F.lit(1)).alias("n_days"), F.count("water_temp").alias("n_temp_days"), F.count("oxygen").alias("n_oxygen_days")
        )
    )


@query(
    "station_year_history",
    f"""WITH {DW_SQL}, {BASE_SQL}, a AS (SELECT region, station, year(date) AS year, avg(air_temp) AS air_temp_mean, avg(water_temp) AS water_temp_abs_annual_mean, avg(oxygen) AS oxygen_abs_annual_mean,
          min(oxygen) FILTER (WHERE month(date) BETWEEN 6 AND 9) AS oxygen_warm_min_abs, avg(CAST(round(oxygen, 9) < 2 AS INT)) FILTER (WHERE month(date) BETWEEN 6 AND 9) AS share FROM dw GROUP BY 1, 2, 3)
        SELECT a.region, a.station, year, round(air_temp_mean, 6) AS air_temp_mean, round(water_temp_abs_annual_mean, 6) AS water_temp_abs_annual_mean,
          round(oxygen_abs_annual_mean, 6) AS oxygen_abs_annual_mean, round(oxygen_warm_min_abs, 6) AS oxygen_warm_min_abs, round(share, 6) AS oxygen_warm_hypoxic_day_share_abs,
          round(coalesce(oxygen_warm_min_abs, oxygen_abs_annual_mean), 6) AS oxygen_plot_abs, round(depth_baseline, 6) AS depth_baseline
        FROM a LEFT JOIN fb ON a.region = fb.region AND a.station = fb.station""",
)
def station_year_history(spark, d):
    days = daily_water(spark, d)
    base = baseline.fixed_baseline(days, ["depth"], "1995-01-01", "1996-12-31")
    names = {"air_temp": "air_temp_mean", "water_temp": "water_temp_abs_annual_mean", "oxygen": "oxygen_abs_annual_mean"}
    return tidy(rollup.station_year_history(days, names, base))
