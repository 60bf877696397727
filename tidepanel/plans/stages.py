"""The work flow in stages, each a function from tables to tables.

foundation -> screen -> response models -> projection. A stage can be written as a table
and read back (``sources.io.write_table``) or passed on as it is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel import KEYS
from tidepanel.functions import stats
from tidepanel.operators import baseline, clean, coverage, joins, models, regime, risk, rolling, rollup, scenario
from tidepanel.plans.registry import query, tidy
from tidepanel.plans.regimes import FEATURES, labelled_stations
from tidepanel.plans.rollups import DW_SQL, SYQ_LIMITS
from tidepanel.session import scratch_path, staged
from tidepanel.sources import io
from tidepanel.sources.panels import LOOKUP_SQL, WATER_MEASURES, station_lookup, table, water_panel

DRIVERS = scenario.DRIVERS
ROLLS = [f"{c}_r{n}d" for c in DRIVERS for n in (1, 7, 28)]
CENTER_NAMES = dict(zip(["water_temp", "salinity", "oxygen", "depth"], FEATURES))
PATH_COLUMNS = ["water_temp", "salinity", "oxygen", "oxygen_warm_min_abs", "oxygen_warm_hypoxic_day_share_abs"]


def foundation(readings: DataFrame, lookup: DataFrame, baseline_years: tuple[str, str]) -> DataFrame:
    """Daily panel with driver rolls, calendar, station context and deltas from the baseline."""
    days = rollup.daily(readings, ts="date", means=[*WATER_MEASURES, "air_temp", "wind_speed", "solar"], sums=["precip"])
    base = baseline.fixed_baseline(days, WATER_MEASURES, *baseline_years)
    days = baseline.deltas(rolling.trailing_mean(days, DRIVERS), base, WATER_MEASURES)
    return joins.attach_dimension(clean.calendar_features(days), lookup, KEYS)


def screen(days: DataFrame, core: Sequence[str], limits: Mapping[str, int], min_temp_days: int) -> DataFrame:
    """Rows of stations and years worth modelling, with cohort and warm-oxygen flag."""
    stations = coverage.station_summary(days, min_temp_days=min_temp_days).filter("keep_station")
    years = coverage.station_year_quality(days, core, **limits).filter("has_model_year")
    cohorts = coverage.cohort_split(stations.select(*KEYS)).select(*KEYS, "cohort")
    years = years.select(*KEYS, "year", "has_model_year", "has_warm_oxygen_year")
    return days.join(cohorts, KEYS).join(years, [*KEYS, "year"])


def station_years(days: DataFrame) -> DataFrame:
    """Station-year features and responses of screened days."""
    feats = rollup.station_year_features(
        days, ["delta_water_temp_pred", *DRIVERS], [f"{m}_baseline" for m in WATER_MEASURES], ["delta_salinity", "delta_oxygen"]
    )
    flags = days.groupBy(*KEYS, F.year("date").alias("year")).agg(
        F.max("cohort").alias("cohort"), F.max("has_model_year").alias("has_model_year"), F.max("has_warm_oxygen_year").alias("has_warm_oxygen_year")
    )
    return feats.join(rollup.oxygen_stress(days), [*KEYS, "year"], "left").join(flags, [*KEYS, "year"])


YEAR_FEATURES = [f"{c}_{s}" for c in ["delta_water_temp_pred", *DRIVERS] for s in ("mean", "warm_mean")]
RESPONSES = [
    models.Target("delta_salinity", "delta_salinity_annual_mean", tuple(YEAR_FEATURES)),
    models.Target("delta_oxygen", "delta_oxygen_warm_mean", tuple(YEAR_FEATURES), "has_warm_oxygen_year"),
    models.Target("oxygen_warm_min", "oxygen_warm_min", tuple(YEAR_FEATURES), "has_warm_oxygen_year"),
    models.Target("oxygen_warm_hypoxic_day_share", "oxygen_warm_hypoxic_day_share", tuple(YEAR_FEATURES), "has_warm_oxygen_year"),
]


def fit_temperature(days: DataFrame, fit: models.Fit = models.ridge) -> tuple[models.FittedResponse, DataFrame, DataFrame]:
    """The water-temperature model, the days scored with it and their station-years."""
    features = [*DRIVERS, *ROLLS, "doy_sin", "doy_cos", "water_temp_baseline"]
    train = days.filter(F.col("cohort") == "train")
    temp = models.fit_response(train, features, "delta_water_temp", fit, name="water_temp")
    scored = temp.predict(days, "delta_water_temp_pred")
    # a linear model is one more expression on days that are staged; storing them again would double the disk
    scored = scored if isinstance(temp.model, models.LinearRegressionModel) else staged(scored)
    return temp, scored, staged(station_years(scored))


def fit_chemistry(years: DataFrame, targets: Sequence[models.Target] = RESPONSES, fit: models.Fit = models.ridge) -> dict[str, models.FittedResponse]:
    """The models of those targets that have rows to train on."""
    usable = {r["target"] for r in models.target_counts(years, targets).filter("n_train > 0").collect()}
    return {
        t.name: models.fit_response(models.target_rows(years, t).filter("cohort = 'train'"), t.features, t.column, fit, t.name, t.name)
        for t in targets
        if t.name in usable
    }


def fit_models(days: DataFrame, fit: models.Fit = models.ridge) -> tuple[models.FittedResponse, dict[str, models.FittedResponse], DataFrame]:
    """The water-temperature model, the chemistry models on its predictions, and the scored days."""
    temp, scored, years = fit_temperature(days, fit)
    return temp, fit_chemistry(years, fit=fit), scored


def project(
    spark: SparkSession, scored: DataFrame, temp: models.FittedResponse, chemistry: Mapping[str, models.FittedResponse], paths: DataFrame, first: int, last: int
) -> DataFrame:
    """Projected station-years of every station and scenario at once: drivers, temperature, chemistry."""
    base_cols = [f"{m}_baseline" for m in WATER_MEASURES]
    bases = scored.groupBy(*KEYS).agg(*[F.avg(c).alias(c) for c in base_cols])
    days = scenario.rolled_driver_days(scored, bases, paths, first, last, n_stations=bases.count())
    days = temp.predict(days, "delta_water_temp_pred")
    years = rollup.station_year_features(days, ["delta_water_temp_pred", *DRIVERS], base_cols, keys=[*KEYS, "scenario"])
    for name, response in chemistry.items():
        years = response.predict(years, f"{name}_pred")

    def pred(name: str):
        return F.col(f"{name}_pred") if f"{name}_pred" in years.columns else F.lit(None).cast("double")

    return years.select(
        *KEYS, "scenario", "year", "depth_baseline_annual_mean",
        (F.col("water_temp_baseline_annual_mean") + F.col("delta_water_temp_pred_mean")).alias("water_temp"),
        (F.col("salinity_baseline_annual_mean") + F.coalesce(pred("delta_salinity"), F.lit(0.0))).alias("salinity"),
        (F.col("oxygen_baseline_annual_mean") + pred("delta_oxygen")).alias("oxygen"),
        pred("oxygen_warm_min").alias("oxygen_warm_min_abs"),
        pred("oxygen_warm_hypoxic_day_share").alias("oxygen_warm_hypoxic_day_share_abs"),
    ).withColumnRenamed("depth_baseline_annual_mean", "depth")


def observed_years(scored: DataFrame) -> DataFrame:
    base = scored.groupBy(*KEYS).agg(F.avg("depth_baseline").alias("depth"))
    names = {"water_temp": "water_temp", "salinity": "salinity", "oxygen": "oxygen_abs_annual_mean"}
    years = rollup.station_year_history(scored, names, base)
    return years.withColumnRenamed("oxygen_abs_annual_mean", "oxygen").drop("oxygen_plot_abs")


def station_scan(spark: SparkSession, scored: DataFrame, temp, chemistry, stations: DataFrame, paths: DataFrame, first: int, last: int) -> dict[str, DataFrame]:
    """History, projection, regimes, crossings and hypoxia of all stations, without a loop over them."""
    history = staged(observed_years(scored))
    future = staged(project(spark, scored, temp, chemistry, paths, first, last))
    names = [r["scenario"] for r in paths.select("scenario").distinct().orderBy("scenario").collect()]
    each = history.withColumn("scenario", F.explode(F.array(*[F.lit(n) for n in names])))
    path = each.select(*KEYS, "scenario", "year", "depth", *PATH_COLUMNS).unionByName(future.select(*KEYS, "scenario", "year", "depth", *PATH_COLUMNS))
    keys = [*KEYS, "scenario"]
    rolled = rolling.rolling_years(path, {c: n for c, n in CENTER_NAMES.items() if c != "depth"}, keys=keys)
    rolled = rolled.withColumn(CENTER_NAMES["depth"], F.col("depth"))
    centers, scale = regime.centroids(stations, FEATURES)
    classified = regime.nearest_centroid(rolled, FEATURES, centers, scale, out="regime_roll5y")
    classified = classified.join(stations.select(*KEYS, "cluster"), KEYS, "left")
    return {
        "history": history,
        "future": future,
        "path": classified,
        "crossings": risk.crossings(classified, first),
        "hypoxia": risk.hypoxia_change(history, future),
    }


# --- queries -----------------------------------------------------------------------------------

SPAN = ("1995-01-01", "1996-12-31")


#: What fits and projections read of a screened day.
DAY_COLUMNS = [
    *KEYS, "date", "cohort", "has_model_year", "has_warm_oxygen_year", "water_temp", "salinity", "oxygen", *DRIVERS, *ROLLS, "doy_sin", "doy_cos",
    *[f"{m}_baseline" for m in WATER_MEASURES], "delta_water_temp", "delta_salinity", "delta_oxygen",
]


def screened(spark: SparkSession, d: str) -> DataFrame:
    days = foundation(water_panel(spark, d, by_station=True), station_lookup(spark, d), SPAN)
    return screen(days, ["water_temp", "salinity", "oxygen"], SYQ_LIMITS, 480)


def screened_days(spark: SparkSession, d: str) -> DataFrame:
    return staged(screened(spark, d).select(DAY_COLUMNS))


@query(
    "foundation_days",
    f"""WITH {DW_SQL}, {LOOKUP_SQL} SELECT dw.region, dw.station, date, region_name, round(water_temp - (SELECT avg(b.water_temp) FROM dw b WHERE b.station = dw.station AND b.region = dw.region AND b.date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'), 6) AS delta_water_temp,
        round(avg(air_temp) OVER (PARTITION BY dw.region, dw.station ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS air_temp_r7d FROM dw LEFT JOIN lk ON dw.region = lk.region AND dw.station = lk.station""",
)
def foundation_days(spark, d):
    days = foundation(water_panel(spark, d, by_station=True), station_lookup(spark, d), SPAN)
    return tidy(days.select("region", "station", "date", "region_name", "delta_water_temp", "air_temp_r7d"))


@query(
    "screened_days",
    f"""WITH {DW_SQL}, ks AS (SELECT region, station FROM dw GROUP BY 1, 2 HAVING count(DISTINCT year(date)) >= 5 AND count(water_temp) >= 480),
        co AS (SELECT region, station, CASE WHEN row_number() OVER (PARTITION BY region ORDER BY station) / count(*) OVER (PARTITION BY region) <= 0.8 THEN 'train' ELSE 'holdout' END AS cohort FROM ks),
        ky AS (SELECT region, station, year(date) AS year FROM dw GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE water_temp IS NOT NULL OR salinity IS NOT NULL OR oxygen IS NOT NULL) >= 60 AND count(water_temp) >= 60
          AND count(DISTINCT month(date)) FILTER (WHERE water_temp IS NOT NULL) >= 6)
        SELECT dw.region, dw.station, year, cohort, count(*) AS n_days, round(avg(water_temp), 6) AS water_temp FROM dw JOIN co ON dw.region = co.region AND dw.station = co.station
        JOIN ky ON dw.region = ky.region AND dw.station = ky.station AND year(date) = year GROUP BY ALL""",
)
def screened_days_query(spark, d):
    days = screened(spark, d)  # read once, so nothing is stored
    return tidy(days.groupBy("region", "station", "year", "cohort").agg(F.count(F.lit(1)).alias("n_days"), F.avg("water_temp").alias("water_temp")))


def scenario_paths(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The scenario table at ``path`` if there is one, else the ramps."""
    ramp = scenario.scenario_ramp(spark)
    return ramp if path is None else io.read_or(spark, path, ramp, scenario.PATH_DEFAULTS)


def scan(spark: SparkSession, d: str, paths: str | None = None) -> dict[str, DataFrame]:
    temp, chemistry, scored = fit_models(screened_days(spark, d))
    return station_scan(spark, scored, temp, chemistry, labelled_stations(spark, d), scenario_paths(spark, paths), *scenario.RAMP_YEARS)


@query("station_scan")
def station_scan_query(spark, d):
    return tidy(scan(spark, d)["path"].select("region", "station", "scenario", "year", *FEATURES, "regime_roll5y", "margin", "cluster"))


USER_SQL = """us AS (SELECT r_name AS scenario, 2026 + y AS year, CASE WHEN y % 2 = 0 THEN r_regionkey * 0.5 * y END AS air_temp_add_c, 1 - 0.01 * r_regionkey * y AS precip_mult FROM region, range(0, 5) t(y))"""


def user_scenarios(spark: SparkSession, d: str) -> str:
    """A scenario table as a user brings it: one scenario per region over five years, some cells empty, two columns absent."""
    path = scratch_path(spark, "scenarios")
    y, key = F.col("y"), F.col("r_regionkey")
    rows = table(spark, d, "region").withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(4))))
    rows.select(
        F.col("r_name").alias("scenario"), (y + 2026).alias("year"), F.when(y % 2 == 0, key * 0.5 * y).cast("double").alias("air_temp_add_c"), (1 - 0.01 * key * y).cast("double").alias("precip_mult"),
    ).write.parquet(path)
    return path


@query(
    "scenario_table",
    f"WITH {USER_SQL} SELECT scenario, CAST(year AS BIGINT) AS year, round(coalesce(air_temp_add_c, 0.0), 6) AS air_temp_add_c, round(precip_mult, 6) AS precip_mult, 1.0::DOUBLE AS wind_speed_mult, 1.0::DOUBLE AS solar_mult FROM us",
)
def scenario_table(spark, d):
    paths = scenario_paths(spark, user_scenarios(spark, d))
    return tidy(paths.select("scenario", "year", *scenario.PATH_DEFAULTS))


@query(
    "scan_user_scenarios",
    f"""WITH {DW_SQL}, ks AS (SELECT region, station FROM dw GROUP BY 1, 2 HAVING count(DISTINCT year(date)) >= 5 AND count(water_temp) >= 480),
        ky AS (SELECT DISTINCT region, station FROM (SELECT region, station, year(date) FROM dw GROUP BY ALL HAVING count(*) FILTER (WHERE water_temp IS NOT NULL OR salinity IS NOT NULL OR oxygen IS NOT NULL) >= 60
          AND count(water_temp) >= 60 AND count(DISTINCT month(date)) FILTER (WHERE water_temp IS NOT NULL) >= 6))
        SELECT region, station, r_name AS scenario, 2026::BIGINT AS first_year, 2030::BIGINT AS last_year, 5::BIGINT AS n_years, 5::BIGINT AS n_temps FROM ks JOIN ky USING (region, station), (SELECT r_name FROM region) AS r""",
)
def scan_user_scenarios(spark, d):
    """A scan over a user's scenario table: every screened station has every scenario's years, with a temperature in each."""
    future = scan(spark, d, user_scenarios(spark, d))["future"]
    out = future.groupBy(*KEYS, "scenario").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("n_years"), F.count("water_temp").alias("n_temps")
    )
    return tidy(out)


@query("scan_crossings_and_hypoxia")
def scan_crossings_and_hypoxia(spark, d):
    out = scan(spark, d)
    cols = ["region", "station", "scenario", "new_hypoxia_flag", "hypoxia_intensifies_flag", "future_hypoxic_share_peak", "future_warm_min_floor"]
    return tidy(out["hypoxia"].select(*cols).join(out["crossings"], ["region", "station", "scenario"], "left"))


@query("benchmark_projection")
def benchmark_projection(spark, d):
    """Benchmark scenarios on the observed station-years with the fitted oxygen model."""
    _, _, years = fit_temperature(screened_days(spark, d))
    chemistry = fit_chemistry(years, [t for t in RESPONSES if t.name == "delta_oxygen"])
    add = ["air_temp_mean", "air_temp_warm_mean", "delta_water_temp_pred_mean", "delta_water_temp_pred_warm_mean"]
    rows = scenario.benchmark_rows(years, add=add, scale=["precip_mean", "precip_warm_mean"])
    pred = chemistry["delta_oxygen"].predict(rows, "delta_oxygen").filter(stats.all_present(["delta_oxygen"]))
    return tidy(risk.scenario_summary(pred, ["delta_oxygen"], ["region"], with_median=False))
