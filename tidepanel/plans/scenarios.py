"""Scenario, case, manifest, risk and crossing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators import baseline, coverage, regime, risk, rolling, rollup, scenario
from tidepanel.plans.registry import query, tidy
from tidepanel.plans.regimes import DAYS_SQL, FEATURES, first_events, labelled_stations
from tidepanel.plans.rollups import DW_SQL, SPAN_SQL, WATER_MEASURES, daily_water
from tidepanel.session import staged
from tidepanel.sources.panels import EV_SQL, LI_SQL, LOOKUP_SQL, events_panel, sparse_panel, station_lookup, table, water_panel

DRIVERS = scenario.DRIVERS
RAMP_CTE = """ramp AS (SELECT scenario, y AS year, a * (y - 2026) / 74 AS air_temp_add_c, 1 + (p - 1) * (y - 2026) / 74 AS precip_mult, 1 + (w - 1) * (y - 2026) / 74 AS wind_speed_mult,
    1 + (s - 1) * (y - 2026) / 74 AS solar_mult FROM (VALUES ('ssp245_demo', 1.8::DOUBLE, 1.00::DOUBLE, 1.00::DOUBLE, 1.00::DOUBLE), ('ssp585_demo', 3.7, 0.97, 1.02, 1.00)) v(scenario, a, p, w, s), unnest(generate_series(2026, 2100)) AS g(y))"""


@query(
    "scenario_ramp",
    f"""WITH {DW_SQL}, {RAMP_CTE}, st AS (SELECT region, station, avg(air_temp) AS t, avg(precip) AS p FROM dw GROUP BY 1, 2)
        SELECT region, station, scenario, year, round(t + air_temp_add_c, 6) AS air_temp, round(p * precip_mult, 6) AS precip, round(wind_speed_mult, 6) AS wind_speed_mult,
          round(solar_mult, 6) AS solar_mult FROM st, ramp""",
)
def scenario_ramp(spark, d):
    stations = daily_water(spark, d).groupBy("region", "station").agg(F.avg("air_temp").alias("t"), F.avg("precip").alias("p"))
    stations = stations.withColumn("year", F.explode(F.sequence(F.lit(2026), F.lit(2100))))
    out = stations.join(F.broadcast(scenario.scenario_ramp(spark)), "year")
    return tidy(
        out.select(
            "region", "station", "scenario", "year", (F.col("t") + F.col("air_temp_add_c")).alias("air_temp"),
            (F.col("p") * F.col("precip_mult")).alias("precip"), "wind_speed_mult", "solar_mult",
        )
    )


def projected_days(spark: SparkSession, d: str, rolled: bool = False) -> DataFrame:
    days = daily_water(spark, d)
    stations = days.select("region", "station").distinct()
    project = scenario.rolled_driver_days if rolled else scenario.driver_days
    return project(days, stations, scenario.scenario_ramp(spark), *scenario.RAMP_YEARS, n_stations=table(spark, d, "supplier").count())


FUT_CTE = (
    RAMP_CTE
    + ", cal AS (SELECT CAST(u AS DATE) AS date, year(u) AS year, least(dayofyear(u), 365) AS doy FROM unnest(generate_series(DATE '2026-01-01', DATE '2100-12-31', INTERVAL 1 DAY)) AS t(u)), "
    "cli AS (SELECT region, station, least(dayofyear(date), 365) AS doy, " + ", ".join(f"avg({c}) AS {c}" for c in DRIVERS) + " FROM dw GROUP BY 1, 2, 3), "
    "mea AS (SELECT region, station, " + ", ".join(f"avg({c}) AS {c}_m" for c in DRIVERS) + " FROM dw GROUP BY 1, 2), "
    "fut AS (SELECT mea.region, mea.station, scenario, cal.date, cal.year, coalesce(cli.air_temp, air_temp_m) + air_temp_add_c AS air_temp, coalesce(cli.precip, precip_m) * precip_mult AS precip, "
    "coalesce(cli.wind_speed, wind_speed_m) * wind_speed_mult AS wind_speed, coalesce(cli.solar, solar_m) * solar_mult AS solar "
    "FROM mea JOIN cal ON true JOIN ramp ON ramp.year = cal.year LEFT JOIN cli ON cli.region = mea.region AND cli.station = mea.station AND cli.doy = cal.doy)"
)


@query(
    "future_calendar",
    f"""WITH {DW_SQL}, {RAMP_CTE}, k AS (SELECT DISTINCT region, station FROM dw), cal AS (SELECT CAST(u AS DATE) AS date FROM unnest(generate_series(DATE '2026-01-01', DATE '2100-12-31', INTERVAL 1 DAY)) AS t(u))
        SELECT region, station, scenario, year, count(*) AS n_days, max(least(dayofyear(date), 365)) AS last_doy FROM k, cal JOIN ramp ON ramp.year = year(date) GROUP BY 1, 2, 3, 4""",
)
def future_calendar(spark, d):
    stations = daily_water(spark, d).select("region", "station").distinct()
    days = scenario.future_days(stations, scenario.scenario_ramp(spark), *scenario.RAMP_YEARS)
    return tidy(days.groupBy("region", "station", "scenario", "year").agg(F.count(F.lit(1)).alias("n_days"), F.max("doy").alias("last_doy")))


def by_day(c: str) -> str:
    """Mean weighted by the day of year in SQL: a day out of its place changes it."""
    return f"round(avg({c} * dayofyear(date)), 6) AS {c}_by_day"


@query(
    "perturb_drivers",
    f"WITH {DW_SQL}, {FUT_CTE} SELECT region, station, scenario, year, count(*) AS n_days, " + ", ".join(f"round(avg({c}), 6) AS {c}, {by_day(c)}" for c in DRIVERS) + " FROM fut GROUP BY 1, 2, 3, 4",
)
def perturb_drivers(spark, d):
    """Daily drivers of the whole horizon, each station's years summed up: means, and means weighted by the day of year."""
    days = projected_days(spark, d).groupBy("region", "station", "scenario", "year")
    weighted = [F.avg(F.col(c) * F.dayofyear("date")).alias(f"{c}_by_day") for c in DRIVERS]
    return tidy(days.agg(F.count(F.lit(1)).alias("n_days"), *[F.avg(c).alias(c) for c in DRIVERS], *weighted))


@query(
    "projected_drivers_daily",
    f"WITH {DW_SQL}, {FUT_CTE} SELECT scenario, date, count(*) AS n_stations, " + ", ".join(f"round(avg({c}), 6) AS {c}, round(min({c}), 6) AS {c}_min, round(max({c}), 6) AS {c}_max" for c in DRIVERS) + " FROM fut GROUP BY 1, 2",
)
def projected_drivers_daily(spark, d):
    """Every day of the horizon: mean and extremes of each driver over all stations."""
    cells = [f(c).alias(n) for c in DRIVERS for f, n in ((F.avg, c), (F.min, f"{c}_min"), (F.max, f"{c}_max"))]
    return tidy(projected_days(spark, d).groupBy("scenario", "date").agg(F.count(F.lit(1)).alias("n_stations"), *cells))


ROLL_CTE = f"""r AS (SELECT region, station, scenario, year, date, avg(air_temp) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS air_temp_r7d,
        avg(solar) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS solar_r28d, sin(2 * pi() * dayofyear(date) / 365.25) AS doy_sin
        FROM fut WINDOW w AS (PARTITION BY region, station, scenario ORDER BY date))"""


@query(
    "future_driver_rolls",
    f"""WITH {DW_SQL}, {FUT_CTE}, {ROLL_CTE}
        SELECT region, station, scenario, year, round(avg(air_temp_r7d), 6) AS air_temp_r7d, {by_day("air_temp_r7d")}, round(avg(solar_r28d), 6) AS solar_r28d, {by_day("solar_r28d")},
          round(max(doy_sin), 6) AS doy_sin FROM r GROUP BY 1, 2, 3, 4""",
)
def future_driver_rolls(spark, d):
    """Trailing means over the whole horizon, each station's years summed up as in ``perturb_drivers``."""
    rolled = projected_days(spark, d, rolled=True).groupBy("region", "station", "scenario", "year")
    rolls = ["air_temp_r7d", "solar_r28d"]
    weighted = [F.avg(F.col(c) * F.dayofyear("date")).alias(f"{c}_by_day") for c in rolls]
    return tidy(rolled.agg(*[F.avg(c).alias(c) for c in rolls], *weighted, F.max("doy_sin").alias("doy_sin")))


@query(
    "projected_rolls_daily",
    f"""WITH {DW_SQL}, {FUT_CTE}, {ROLL_CTE}
        SELECT scenario, date, round(avg(air_temp_r7d), 6) AS air_temp_r7d, round(max(air_temp_r7d), 6) AS air_temp_r7d_max, round(avg(solar_r28d), 6) AS solar_r28d,
          round(min(solar_r28d), 6) AS solar_r28d_min, round(max(doy_sin), 6) AS doy_sin FROM r GROUP BY 1, 2""",
)
def projected_rolls_daily(spark, d):
    """Every day of the horizon: the trailing means over all stations."""
    rolled = projected_days(spark, d, rolled=True).groupBy("scenario", "date")
    cells = [F.avg("air_temp_r7d").alias("air_temp_r7d"), F.max("air_temp_r7d").alias("air_temp_r7d_max"), F.avg("solar_r28d").alias("solar_r28d")]
    return tidy(rolled.agg(*cells, F.min("solar_r28d").alias("solar_r28d_min"), F.max("doy_sin").alias("doy_sin")))


BENCH_CTE = "bm AS (SELECT * FROM (VALUES ('baseline_ref', 0.0::DOUBLE, 1.0::DOUBLE), ('plus1p0C_precip_same', 1.0, 1.0), ('plus1p5C_precip_same', 1.5, 1.0), ('plus2p0C_precip_same', 2.0, 1.0)) v(scenario, t, p))"


@query(
    "benchmark_scenarios",
    f"""WITH {DW_SQL}, {BENCH_CTE}, y AS (SELECT region, station, year(date) AS year, avg(air_temp) AS air_temp_mean, avg(precip) AS precip_mean FROM dw GROUP BY 1, 2, 3)
        SELECT region, station, year, scenario, round(air_temp_mean + t, 6) AS air_temp_mean, round(precip_mean * p, 6) AS precip_mean FROM y, bm""",
)
def benchmark_scenarios(spark, d):
    y = daily_water(spark, d).groupBy("region", "station", F.year("date").alias("year")).agg(
        F.avg("air_temp").alias("air_temp_mean"), F.avg("precip").alias("precip_mean")
    )
    return tidy(scenario.benchmark_rows(y, add=["air_temp_mean"], scale=["precip_mean"]))


@query(
    "benchmark_forcing",
    f"""WITH {DW_SQL}, bm AS (SELECT * FROM (VALUES ('baseline_ref', 0.0::DOUBLE, 1.0::DOUBLE), ('plus1p5C_precip_minus10pct', 1.5, 0.9), ('plus1p5C_precip_same', 1.5, 1.0), ('plus1p5C_precip_plus10pct', 1.5, 1.1)) v(scenario, t, p)),
        b AS (SELECT region, station, month(date) AS month_num, avg(precip) AS precipitation_baseline FROM dw GROUP BY 1, 2, 3)
        SELECT region, station, month_num, round(precipitation_baseline, 6) AS precipitation_baseline, scenario, t AS delta_air_temp, round(precipitation_baseline * (p - 1), 6) AS delta_precipitation,
          0.0::DOUBLE AS delta_wind_speed, 0.0::DOUBLE AS delta_solar_radiation FROM b, bm""",
)
def benchmark_forcing(spark, d):
    base = daily_water(spark, d).groupBy("region", "station", F.month("date").alias("month_num")).agg(F.avg("precip").alias("precipitation_baseline"))
    return tidy(scenario.benchmark_forcing(base))


SCEN_CTE = f"{DW_SQL}, {BENCH_CTE}, sp AS (SELECT region, station, year(date) AS year, scenario, avg(oxygen) - 0.3 * t AS oxygen, avg(salinity) + 0.1 * t AS salinity FROM dw, bm GROUP BY region, station, year(date), scenario, t)"


def scenario_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Station-years moved by a fixed linear response, in place of a fitted model."""
    y = daily_water(spark, d).groupBy("region", "station", F.year("date").alias("year")).agg(F.avg("oxygen").alias("oxygen"), F.avg("salinity").alias("salinity"))
    moved = scenario.benchmark_rows(y.withColumn("dt", F.lit(0.0)), add=["dt"])
    return moved.withColumns({"oxygen": F.col("oxygen") - 0.3 * F.col("dt"), "salinity": F.col("salinity") + 0.1 * F.col("dt")}).drop("dt")


@query(
    "scenario_summary",
    f"""WITH {SCEN_CTE}, l AS (SELECT scenario, 'oxygen' AS target, oxygen AS v FROM sp UNION ALL SELECT scenario, 'salinity', salinity FROM sp),
        a AS (SELECT scenario, target, avg(v) AS m, median(v) AS md, count(v) AS n FROM l GROUP BY 1, 2)
        SELECT a.scenario, a.target, round(a.m, 6) AS mean_pred, n AS n_rows, round(md, 6) AS median_pred, round(b.m, 6) AS baseline_mean_pred, round(a.m - b.m, 6) AS delta_vs_baseline
        FROM a JOIN (SELECT target, m FROM a WHERE scenario = 'baseline_ref') b ON a.target = b.target""",
)
def scenario_summary(spark, d):
    predicted = staged(scenario_predictions(spark, d))  # means, medians and their passes all read it
    return tidy(risk.scenario_summary(predicted, ["oxygen", "salinity"]))


@query(
    "scenario_by_region",
    f"""WITH {SCEN_CTE}, a AS (SELECT region, scenario, 'oxygen' AS target, avg(oxygen) AS m, count(oxygen) AS n FROM sp GROUP BY 1, 2)
        SELECT a.region, a.scenario, a.target, round(a.m, 6) AS mean_pred, n AS n_rows, round(b.m, 6) AS baseline_mean_pred, round(a.m - b.m, 6) AS delta_vs_baseline
        FROM a JOIN (SELECT region, m FROM a WHERE scenario = 'baseline_ref') b ON a.region = b.region""",
)
def scenario_by_region(spark, d):
    return tidy(risk.scenario_summary(scenario_predictions(spark, d), ["oxygen"], ["region"], with_median=False))


@query(
    "oxygen_risk",
    f"""WITH {SCEN_CTE}, t AS (SELECT unnest([5.0, 4.0, 2.0]) AS threshold) SELECT scenario, region, count(*) AS n_rows, round(avg(oxygen), 6) AS mean_oxygen, CAST(threshold AS DOUBLE) AS threshold,
        round(avg(CAST(coalesce(round(oxygen, 9) < threshold, false) AS INT)), 6) AS frac_below FROM sp, t GROUP BY scenario, region, threshold""",
)
def oxygen_risk(spark, d):
    return tidy(risk.risk_table(scenario_predictions(spark, d), "oxygen", ["scenario", "region"]))


YEARS_CTE = (
    "yr AS (SELECT region, station, year(date) AS year, min(oxygen) FILTER (WHERE month(date) BETWEEN 6 AND 9) AS fl, avg(CAST(round(oxygen, 9) < 2 AS INT)) FILTER (WHERE month(date) BETWEEN 6 AND 9) AS sh FROM dw GROUP BY 1, 2, 3), "
    "his AS (SELECT * FROM yr WHERE year < 1999), ftr AS (SELECT yr.region, yr.station, year, scenario, fl - 0.4 * t AS fl, sh + 0.03 * t AS sh FROM yr, bm WHERE year >= 1999)"
)


def yearly_oxygen(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Past station-years, and later ones moved by a fixed response to each benchmark scenario."""
    days = daily_water(spark, d)
    base = baseline.fixed_baseline(days, ["depth"], "1995-01-01", "1996-12-31")
    years = rollup.station_year_history(days, {"oxygen": "oxygen_abs_annual_mean"}, base)
    future = scenario.benchmark_rows(years.filter("year >= 1999").withColumn("dt", F.lit(0.0)), add=["dt"])
    future = future.withColumns(
        {
            "oxygen_warm_min_abs": F.col("oxygen_warm_min_abs") - 0.4 * F.col("dt"),
            "oxygen_warm_hypoxic_day_share_abs": F.col("oxygen_warm_hypoxic_day_share_abs") + 0.03 * F.col("dt"),
        }
    )
    return years.filter("year < 1999"), future


HYP_CTE = (
    f"{DW_SQL}, {BENCH_CTE}, {YEARS_CTE}, "
    "hp AS (SELECT region, station, max(sh) AS hist_hypoxic_share_peak, avg(sh) AS hist_hypoxic_share_mean, min(fl) AS hist_warm_min_floor, avg(fl) AS hist_warm_min_mean FROM his GROUP BY 1, 2), "
    "fp AS (SELECT region, station, scenario, max(sh) AS future_hypoxic_share_peak, avg(sh) AS future_hypoxic_share_mean, min(fl) AS future_warm_min_floor, avg(fl) AS future_warm_min_mean, "
    "avg(sh) FILTER (WHERE year >= 2001) AS future_hypoxic_share_late, avg(fl) FILTER (WHERE year >= 2001) AS future_warm_min_mean_late FROM ftr GROUP BY 1, 2, 3), "
    "hj AS (SELECT fp.*, hp.* EXCLUDE (region, station), round(coalesce(hist_hypoxic_share_peak, 0), 9) > 0 OR round(coalesce(hist_warm_min_floor, 1e9), 9) < 2 AS hist_hypoxia_any FROM fp LEFT JOIN hp ON fp.region = hp.region AND fp.station = hp.station), "
    "hc AS (SELECT *, NOT hist_hypoxia_any AND (round(coalesce(future_hypoxic_share_peak, 0), 9) >= 0.05 OR round(coalesce(future_warm_min_floor, 1e9), 9) < 2) AS new_hypoxia_flag, "
    "coalesce(future_hypoxic_share_peak, 0) - coalesce(hist_hypoxic_share_peak, 0) AS hypoxia_share_increase_peak, coalesce(future_hypoxic_share_late, 0) - coalesce(hist_hypoxic_share_mean, 0) AS hypoxia_share_increase_late, "
    "hist_warm_min_mean - future_warm_min_mean_late AS warm_min_drop_mean_late FROM hj)"
)
_HYP_COLS = ["hist_hypoxic_share_peak", "hist_warm_min_floor", "future_hypoxic_share_peak", "future_hypoxic_share_late", "hypoxia_share_increase_peak", "hypoxia_share_increase_late", "warm_min_drop_mean_late"]


@query(
    "hypoxia_change",
    f"WITH {HYP_CTE} SELECT region, station, scenario, hist_hypoxia_any, new_hypoxia_flag, round(hypoxia_share_increase_peak, 9) >= 0.05 OR round(coalesce(warm_min_drop_mean_late, 0), 9) >= 0.5 AS hypoxia_intensifies_flag, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in _HYP_COLS) + " FROM hc",
)
def hypoxia_change(spark, d):
    history, future = yearly_oxygen(spark, d)
    out = risk.hypoxia_change(history, future, late_year=2001)
    return tidy(out.select("region", "station", "scenario", "hist_hypoxia_any", "new_hypoxia_flag", "hypoxia_intensifies_flag", *_HYP_COLS))


@query(
    "hypoxia_ranking",
    f"""WITH {HYP_CTE} SELECT scenario, region, station, new_hypoxia_flag, round(hypoxia_share_increase_peak, 6) AS hypoxia_share_increase_peak FROM hc
        ORDER BY scenario, new_hypoxia_flag DESC, round(hypoxia_share_increase_peak, 9) DESC, round(future_hypoxic_share_peak, 9) DESC NULLS LAST, round(future_warm_min_floor, 9) NULLS LAST, region, station LIMIT 15""",
)
def hypoxia_ranking(spark, d):
    history, future = yearly_oxygen(spark, d)
    changes = risk.hypoxia_change(history, future, late_year=2001)
    nine = {c: F.round(c, 9) for c in ["hypoxia_share_increase_peak", "future_hypoxic_share_peak", "future_warm_min_floor"]}
    top = risk.rank_hypoxia(changes.withColumns(nine), 15)
    return tidy(top.select("scenario", "region", "station", "new_hypoxia_flag", "hypoxia_share_increase_peak"))


def regime_path(spark: SparkSession, d: str) -> DataFrame:
    """History and benchmark future of every station as one path per scenario, rolled and classified."""
    years = daily_water(spark, d).groupBy("region", "station", F.year("date").alias("year")).agg(*[F.avg(c).alias(c) for c in WATER_MEASURES])
    moved = scenario.benchmark_rows(years.withColumn("dt", F.lit(0.0)), add=["dt"])
    later = F.col("year") >= 1999
    path = moved.withColumn("water_temp", F.when(later, F.col("water_temp") + F.col("dt")).otherwise(F.col("water_temp")))
    names = dict(zip(["water_temp", "salinity", "oxygen", "depth"], FEATURES))
    rolled = rolling.rolling_mean(path, names, 5, 3, ["region", "station", "scenario"], "year")
    stations = labelled_stations(spark, d)
    centers, scale = regime.centroids(stations, FEATURES)
    out = regime.nearest_centroid(rolled, FEATURES, centers, scale, out="regime_roll5y")
    return out.join(stations.select("region", "station", "cluster"), ["region", "station"], "left")


PATH_CTE = (
    DAYS_SQL.split(", dw2 AS")[0]
    + ", dw2 AS (SELECT region, station, date, " + ", ".join(f"avg({c}) AS {c}" for c in WATER_MEASURES) + " FROM li GROUP BY 1, 2, 3), " + BENCH_CTE
    + ", ye AS (SELECT region, station, year(date) AS year, " + ", ".join(f"avg({c}) AS {c}" for c in WATER_MEASURES) + " FROM dw2 GROUP BY 1, 2, 3), "
    "mv AS (SELECT ye.* REPLACE (CASE WHEN year >= 1999 THEN water_temp + t ELSE water_temp END AS water_temp), scenario FROM ye, bm), "
    "ro AS (SELECT region, station, scenario, year, "
    + ", ".join(f"CASE WHEN count({c}) OVER w >= 3 THEN avg({c}) OVER w END AS {n}" for c, n in zip(["water_temp", "salinity", "oxygen", "depth"], FEATURES))
    + " FROM mv WINDOW w AS (PARTITION BY region, station, scenario ORDER BY year ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), "
    "pd AS (SELECT ro.*, ce.cluster AS k, " + " + ".join(f"CAST(ro.{c} IS NOT NULL AS INT)" for c in FEATURES) + " AS nf, sqrt("
    + " + ".join(f"coalesce(pow(ce.{c} - (ro.{c} - sc.{c}_mu) / sc.{c}_sd, 2), 0)" for c in FEATURES) + ") AS dist FROM ro, sc, ce), "
    "pb AS (SELECT region, station, scenario, year, nf, k AS best FROM pd QUALIFY row_number() OVER (PARTITION BY region, station, scenario, year ORDER BY dist, k) = 1), "
    "pp AS (SELECT pb.region, pb.station, scenario, year, CASE WHEN nf >= 3 THEN best END AS regime_roll5y, st.cluster FROM pb LEFT JOIN st ON pb.region = st.region AND pb.station = st.station), "
    "cr AS (SELECT region, station, scenario, min(year) AS first_regime_cross_year FROM pp WHERE year >= 1999 AND regime_roll5y IS NOT NULL AND cluster IS NOT NULL AND regime_roll5y <> cluster GROUP BY 1, 2, 3)"
)


@query("projected_regimes", f"WITH {PATH_CTE} SELECT region, station, scenario, year, CAST(regime_roll5y AS BIGINT) AS regime_roll5y FROM pp")
def projected_regimes(spark, d):
    return tidy(regime_path(spark, d).select("region", "station", "scenario", "year", "regime_roll5y"))


@query("regime_crossings", f"WITH {PATH_CTE} SELECT region, station, scenario, first_regime_cross_year, CAST(first_regime_cross_year // 10 * 10 AS BIGINT) AS first_regime_cross_decade FROM cr")
def regime_crossings(spark, d):
    return tidy(risk.crossings(regime_path(spark, d), 1999))


@query(
    "final_year",
    f"""WITH {SCEN_CTE}, {LOOKUP_SQL} SELECT lk.region, lk.station, region_name, scenario, round(oxygen, 6) AS oxygen FROM lk
        LEFT JOIN (SELECT * FROM sp WHERE year = (SELECT max(year) FROM sp)) f ON lk.region = f.region AND lk.station = f.station""",
)
def final_year(spark, d):
    meta = station_lookup(spark, d).select("region", "station", "region_name")
    return tidy(risk.final_year(scenario_predictions(spark, d), meta, ["oxygen"]))


# --- cases, priority and manifest -------------------------------------------------------------

SPAN_EVENTS = """evt AS (SELECT region, station, first_obs_date AS event_date, station % 4 AS cluster FROM sp WHERE n_full_years >= 4 AND station % 3 = 0)"""


def span_events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """First dates of a third of the sparse stations as events, and every station's span."""
    span = coverage.station_span(sparse_panel(spark, d))
    events = span.filter((F.col("n_full_years") >= 4) & (F.col("station") % 3 == 0)).select(
        "region", "station", F.col("first_obs_date").alias("event_date")
    )
    return events, span


def _pool(spark: SparkSession, d: str, mode: str) -> DataFrame:
    events, span = span_events(spark, d)
    meta = span.select("region", "station", (F.col("station") % 4).alias("cluster"))
    holdout = span.filter(F.col("station") % 6 == 0)
    available = span.filter("n_full_years >= 5")
    wanted = span.filter(F.col("station") % 50 == 0).select("region", "station") if mode == "station_list" else None
    return scenario.case_pool(mode, events, meta, holdout, available, wanted)


def _pool_sql(where: str) -> str:
    return f"""WITH {SPAN_SQL}, {SPAN_EVENTS} SELECT evt.region, evt.station, evt.event_date, CAST(evt.cluster AS BIGINT) AS cluster, evt.station % 6 = 0 AS is_holdout, evt.station % 6 <> 0 AS is_train
        FROM evt JOIN sp ON evt.region = sp.region AND evt.station = sp.station WHERE sp.n_full_years >= 5 {where}"""


@query("station_key_list", f"WITH {EV_SQL} SELECT CAST(region AS VARCHAR) AS region, CAST(station AS VARCHAR) AS station, min(event_id) AS case_order FROM ev WHERE event_id % 7 > 0 GROUP BY 1, 2")
def station_key_list(spark, d):
    """Keys as a list of cases gives them: padded with blanks, repeated, some absent."""
    pad = F.when(F.col("event_id") % 2 == 0, F.lit("  ")).otherwise(F.lit(""))
    given = events_panel(spark, d).select(
        F.concat(pad, F.col("region").cast("string")).alias("region"), F.when(F.col("event_id") % 7 > 0, F.concat(F.col("station").cast("string"), pad)).alias("station"), F.col("event_id").alias("case_order"),
    )
    return tidy(scenario.normalise_station_keys(given))


@query("case_pool_holdout", _pool_sql("AND evt.station % 6 = 0"))
def case_pool_holdout(spark, d):
    return tidy(_pool(spark, d, "holdout_transition"))


@query("case_pool_train", _pool_sql("AND evt.station % 6 <> 0"))
def case_pool_train(spark, d):
    return tidy(_pool(spark, d, "train_transition"))


@query(
    "case_pool_list",
    f"""WITH {SPAN_SQL}, {SPAN_EVENTS} SELECT sp.region, sp.station, CAST(sp.station % 4 AS BIGINT) AS cluster, event_date, sp.station % 6 = 0 AS is_holdout, sp.station % 6 <> 0 AS is_train
        FROM sp LEFT JOIN evt ON evt.region = sp.region AND evt.station = sp.station WHERE sp.n_full_years >= 5 AND sp.station % 50 = 0""",
)
def case_pool_list(spark, d):
    return tidy(_pool(spark, d, "station_list"))


@query(
    "pick_cases",
    f"""WITH {SPAN_SQL}, {SPAN_EVENTS}, po AS (SELECT evt.*, row_number() OVER (PARTITION BY cluster ORDER BY event_date, evt.region, evt.station) AS rn FROM evt JOIN sp ON evt.region = sp.region AND evt.station = sp.station WHERE n_full_years >= 5),
        t AS (SELECT *, CASE WHEN rn = 1 THEN 0 ELSE 1 END AS tier, CASE WHEN rn = 1 THEN cluster END AS c FROM po ORDER BY tier, c NULLS LAST, event_date, region, station LIMIT 6)
        SELECT region, station, event_date, 'case_' || row_number() OVER (ORDER BY tier, c NULLS LAST, event_date, region, station) AS case_id FROM t""",
)
def pick_cases(spark, d):
    return scenario.pick_cases(_pool(spark, d, "all_transition"), 6).select("region", "station", "event_date", "case_id")


PRIO_CTE = f"{SPAN_SQL}, {SPAN_EVENTS}, sb AS (SELECT sp.region, sp.station, n_years_obs AS n_years_present, n AS n_obs_total, n_full_years < 6 AS is_partial_baseline FROM sp JOIN (SELECT region, station, count(*) AS n FROM oc GROUP BY 1, 2) c ON sp.region = c.region AND sp.station = c.station), pr AS (SELECT evt.region, evt.station, event_date, n_years_present, n_obs_total, is_partial_baseline FROM evt JOIN sb ON evt.region = sb.region AND evt.station = sb.station WHERE evt.region NOT IN ('NATION_4', 'NATION_9'))"


def span_stations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events, span = span_events(spark, d)
    rows = sparse_panel(spark, d).groupBy("region", "station").agg(F.count(F.lit(1)).alias("n_obs_total"))
    stations = span.join(rows, ["region", "station"]).select(
        "region", "station", F.col("n_years_obs").alias("n_years_present"), "n_obs_total", (F.col("n_full_years") < 6).alias("is_partial_baseline")
    )
    return events, stations


@query("priority_ranking", f"WITH {PRIO_CTE} SELECT region, station, event_date, n_years_present, n_obs_total FROM pr ORDER BY is_partial_baseline, n_years_present DESC, n_obs_total DESC, event_date, region, station LIMIT 12")
def priority_ranking(spark, d):
    events, stations = span_stations(spark, d)
    pool, order = scenario.rank_priority(events, stations, ["nation_4", "nation_9"])
    return tidy(pool.orderBy(*order).limit(12).select("region", "station", "event_date", "n_years_present", "n_obs_total"))


@query(
    "priority_stations",
    f"""WITH {PRIO_CTE} SELECT region, station, n_obs_total, 'region_member' AS selection_reason FROM sb WHERE region IN ('NATION_4', 'NATION_9')
        UNION ALL (SELECT region, station, n_obs_total, 'extra_complete' FROM pr ORDER BY is_partial_baseline, n_years_present DESC, n_obs_total DESC, event_date, region, station LIMIT 1)""",
)
def priority_stations(spark, d):
    events, stations = span_stations(spark, d)
    return tidy(scenario.priority_stations(stations, events, ["nation_4", "nation_9"]).select("region", "station", "n_obs_total", "selection_reason"))


@query("bounding_box", f"WITH {LOOKUP_SQL} SELECT round(min(longitude) - 0.25, 6) AS lon_min, round(max(longitude) + 0.25, 6) AS lon_max, round(min(latitude) - 0.25, 6) AS lat_min, round(max(latitude) + 0.25, 6) AS lat_max FROM lk")
def bounding_box(spark, d):
    return tidy(scenario.bounding_box(station_lookup(spark, d)))


BASE_URL = "https://data.example.org/climate"
MAN_CTE = (
    f"{LOOKUP_SQL}, mo AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{v}')" for m, v in scenario.MODEL_MEMBERS.items()) + ") v(model, member)), "
    "sy AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {a}, {b})" for s, (a, b) in scenario.SCENARIO_YEARS.items()) + ") v(scenario, a, b)), "
    "va AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in (k, *v)) + ")" for k, v in scenario.VARIABLE_SPECS.items()) + ") v(variable, target_driver, native_units, target_units, conversion_note)), "
    "man AS (SELECT region, station, model, member, scenario, y AS year, variable, target_driver, model || '/' || scenario || '/' || member || '/' || variable || '/' || variable || '_day_' || model || '_' || scenario || '_' || member || '_gn_' || y || '.nc' AS relative_path "
    "FROM lk, mo, sy, va, unnest(generate_series(a, b)) AS g(y))"
)


@query("asset_manifest", f"WITH {MAN_CTE} SELECT region, station, model, member, scenario, year, variable, target_driver, relative_path, '{BASE_URL}/' || relative_path AS file_url FROM man")
def asset_manifest(spark, d):
    man = scenario.asset_manifest(station_lookup(spark, d).select("region", "station"), BASE_URL)
    return tidy(man.select("region", "station", "model", "member", "scenario", "year", "variable", "target_driver", "relative_path", "file_url"))


@query("manifest_summary", f"WITH {MAN_CTE} SELECT model, scenario, variable, count(DISTINCT relative_path) AS n_files, min(year) AS year_start, max(year) AS year_end FROM man GROUP BY 1, 2, 3")
def manifest_summary(spark, d):
    return tidy(scenario.manifest_summary(scenario.needed_assets(station_lookup(spark, d).select("region", "station"), BASE_URL)))
