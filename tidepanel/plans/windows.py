"""Window, gap, lag and run queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions import dates, stats
from tidepanel.operators import joins, ordered, rolling
from tidepanel.plans.registry import query, r6, tidy
from tidepanel.plans.rollups import DW_SQL, daily_water
from tidepanel.sources.panels import EV_SQL, LI_SQL, OC_SQL, WATER_MEASURES, events_panel, sparse_panel, table, water_panel


def _trailing_sql(shift: int) -> str:
    cells = ", ".join(
        f"round(avg({c}) OVER (PARTITION BY region, station ORDER BY date ROWS BETWEEN {n - 1 + shift} PRECEDING AND "
        f"{'CURRENT ROW' if shift == 0 else f'{shift} PRECEDING'}), 6) AS {c}_r{n}d"
        for c in ["air_temp", "precip"]
        for n in (1, 7, 28)
    )
    return f"WITH {DW_SQL} SELECT region, station, date, {cells} FROM dw"


def _trailing(spark: SparkSession, d: str, shift: int) -> DataFrame:
    rolled = rolling.trailing_mean(daily_water(spark, d), ["air_temp", "precip"], shift=shift)
    return tidy(rolled.select("region", "station", "date", *[f"{c}_r{n}d" for c in ["air_temp", "precip"] for n in (1, 7, 28)]))


@query("trailing_mean_shifted", _trailing_sql(1))
def trailing_mean_shifted(spark, d):
    return _trailing(spark, d, 1)


@query("trailing_mean_current", _trailing_sql(0))
def trailing_mean_current(spark, d):
    return _trailing(spark, d, 0)


def monthly_water(spark: SparkSession, d: str) -> DataFrame:
    """Monthly means with the five-year rolling means and coverage."""
    monthly = daily_water(spark, d).groupBy("region", "station", dates.month_start(F.col("date")).alias("month")).agg(
        *[F.avg(c).alias(c) for c in WATER_MEASURES]
    )
    rolled = rolling.rolling_mean(monthly, {c: f"{c}_roll5y" for c in WATER_MEASURES}, 60, 36, order="month")
    return rolling.rolling_coverage(rolled, stats.any_present(WATER_MEASURES), order="month")


MW_SQL = (
    DW_SQL
    + ", mo AS (SELECT region, station, CAST(date_trunc('month', date) AS DATE) AS month, "
    + ", ".join(f"avg({c}) AS {c}" for c in WATER_MEASURES)
    + " FROM dw GROUP BY 1, 2, 3), mw AS (SELECT *, "
    + ", ".join(f"CASE WHEN count({c}) OVER w >= 36 THEN avg({c}) OVER w END AS {c}_roll5y" for c in WATER_MEASURES)
    + ", CAST(sum(1) OVER w AS BIGINT) AS months_with_any_data_5y, sum(1) OVER w / 60 AS coverage_ratio_5y FROM mo"
    " WINDOW w AS (PARTITION BY region, station ORDER BY month ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"
)


@query(
    "rolling_5y_months",
    f"WITH {MW_SQL} SELECT region, station, month, " + ", ".join(f"round({c}_roll5y, 6) AS {c}_roll5y" for c in WATER_MEASURES)
    + ", months_with_any_data_5y, round(coverage_ratio_5y, 6) AS coverage_ratio_5y FROM mw",
)
def rolling_5y_months(spark, d):
    cols = [f"{c}_roll5y" for c in WATER_MEASURES]
    return tidy(monthly_water(spark, d).select("region", "station", "month", *cols, "months_with_any_data_5y", "coverage_ratio_5y"))


@query(
    "rolling_5_years",
    f"""WITH {DW_SQL}, y AS (SELECT region, station, year(date) AS year, avg(oxygen) AS oxygen FROM dw GROUP BY 1, 2, 3)
        SELECT region, station, year, round(CASE WHEN count(oxygen) OVER w >= 3 THEN avg(oxygen) OVER w END, 6) AS oxygen_roll5y FROM y
        WINDOW w AS (PARTITION BY region, station ORDER BY year ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def rolling_5_years(spark, d):
    years = daily_water(spark, d).groupBy("region", "station", F.year("date").alias("year")).agg(F.avg("oxygen").alias("oxygen"))
    return tidy(rolling.rolling_mean(years, {"oxygen": "oxygen_roll5y"}, 5, 3, order="year").drop("oxygen"))


@query(
    "run_length",
    f"""WITH {DW_SQL}, s AS (SELECT region, station, date, CASE WHEN o < 4 THEN 1 WHEN o < 8 THEN 2 WHEN o >= 8 THEN 3 END AS state FROM (SELECT *, round(oxygen, 6) AS o FROM dw)),
        c AS (SELECT *, CASE WHEN lag(state) OVER w = state THEN 0 ELSE 1 END AS starts FROM s WINDOW w AS (PARTITION BY region, station ORDER BY date)),
        r AS (SELECT *, sum(starts) OVER (PARTITION BY region, station ORDER BY date) AS run_id FROM c)
        SELECT region, station, date, CAST(state AS BIGINT) AS state, CAST(run_id AS BIGINT) AS run_id, count(*) OVER (PARTITION BY region, station, run_id) AS run_length FROM r""",
)
def run_length(spark, d):
    oxygen = r6("oxygen")
    state = F.when(oxygen < 4, 1).when(oxygen < 8, 2).when(oxygen >= 8, 3)
    days = daily_water(spark, d).select("region", "station", "date", state.alias("state"))
    return tidy(rolling.run_length(days, "state"))


@query(
    "persistence",
    f"""WITH {DW_SQL}, p AS (SELECT region, date, water_temp, coalesce(lag(water_temp) OVER (PARTITION BY region, station ORDER BY date), 15.0) AS pred FROM dw)
        SELECT region, count(*) AS n, round(avg(abs(water_temp - pred)), 6) AS mae FROM p WHERE date >= DATE '1999-01-01' AND water_temp IS NOT NULL GROUP BY region""",
)
def persistence(spark, d):
    days = rolling.persistence(daily_water(spark, d), "water_temp", fallbacks=[F.lit(15.0)])
    test = days.filter((F.col("date") >= F.lit("1999-01-01").cast("date")) & F.col("water_temp").isNotNull())
    return tidy(test.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("water_temp") - F.col("pred"))).alias("mae")))


def event_days(spark: SparkSession, d: str) -> DataFrame:
    """Dense daily series per station with the mean click and purchase value."""
    ev = events_panel(spark, d)
    days = ev.groupBy("station", F.to_date("ts").alias("date")).agg(
        F.avg(F.when(F.col("variable") == "click", F.col("value"))).alias("driver"), F.avg("value").alias("response")
    )
    return rolling.spine(days, ["station"], "date", "1 DAY", ["driver", "response"])


ED_SQL = (
    EV_SQL
    + """, ed0 AS (SELECT station, CAST(ts AS DATE) AS date, avg(value) FILTER (WHERE variable = 'click') AS driver, avg(value) AS response FROM ev GROUP BY 1, 2),
    span AS (SELECT station, min(date) AS a, max(date) AS b FROM ed0 GROUP BY 1),
    grid AS (SELECT station, CAST(u AS DATE) AS date FROM span, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS t(u)),
    ed AS (SELECT grid.station, grid.date, driver, response FROM grid LEFT JOIN ed0 USING (station, date))"""
)


@query("spine_days", f"WITH {ED_SQL} SELECT station, date, round(driver, 6) AS driver, round(response, 6) AS response FROM ed")
def spine_days(spark, d):
    return tidy(event_days(spark, d))


def event_hours(spark: SparkSession, d: str) -> DataFrame:
    """Dense hourly series per station with the mean click value and the mean value."""
    ev = events_panel(spark, d)
    hours = ev.groupBy("station", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.avg(F.when(F.col("variable") == "click", F.col("value"))).alias("driver"), F.avg("value").alias("response")
    )
    return rolling.spine(hours, ["station"], "ts", "1 HOUR", ["driver", "response"])


EH_SQL = (
    EV_SQL
    + """, eh0 AS (SELECT station, date_trunc('hour', ts) AS ts, avg(value) FILTER (WHERE variable = 'click') AS driver, avg(value) AS response FROM ev GROUP BY 1, 2),
    hspan AS (SELECT station, min(ts) AS a, max(ts) AS b FROM eh0 GROUP BY 1),
    hgrid AS (SELECT station, u AS ts FROM hspan, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS t(u)),
    eh AS (SELECT hgrid.station, hgrid.ts, coalesce(driver, response) AS driver, response FROM hgrid LEFT JOIN eh0 USING (station, ts))"""
)
SCAN_HOURS = 168  # fixed value: lags of the scan run from 0 to this many hours
_LAGS_SQL = (
    f"WITH {EH_SQL}, df AS (SELECT station, ts, driver - lag(driver) OVER w AS dx, response - lag(response) OVER w AS dy FROM eh WINDOW w AS (PARTITION BY station ORDER BY ts)), "
    "lg AS (SELECT station, ts, dy, " + ", ".join(f"lag(dx, {n}) OVER w AS x{n}" for n in range(SCAN_HOURS + 1)) + " FROM df WINDOW w AS (PARTITION BY station ORDER BY ts))"
)


def hourly_lags(spark: SparkSession, d: str) -> DataFrame:
    hours = event_hours(spark, d).withColumn("driver", F.coalesce("driver", "response"))
    return rolling.lag_scan(hours, "driver", "response", range(SCAN_HOURS + 1), ["station"], "ts")


@query(
    "lag_scan_hours",
    _LAGS_SQL + " " + " UNION ALL ".join(f"SELECT CAST({n} AS BIGINT) AS lag, CASE WHEN NOT isnan(corr(x{n}, dy)) THEN round(corr(x{n}, dy), 6) END AS corr, count(*) FILTER (WHERE x{n} IS NOT NULL AND dy IS NOT NULL) AS n_pairs FROM lg" for n in range(SCAN_HOURS + 1)),
)
def lag_scan_hours(spark, d):
    return tidy(hourly_lags(spark, d))


_LAG_NAMES = [f"response_lag_{n}h" for n in rolling.LAG_HOURS]


@query(
    "lag_matrix_hours",
    f"WITH {EH_SQL}, m AS (SELECT station, ts, response, " + ", ".join(f"lag(response, {n}) OVER w AS response_lag_{n}h" for n in rolling.LAG_HOURS)
    + " FROM eh WINDOW w AS (PARTITION BY station ORDER BY ts)) SELECT station, ts, round(response, 6) AS response, " + ", ".join(f"round({n}, 6) AS {n}" for n in _LAG_NAMES)
    + " FROM m WHERE response IS NOT NULL AND " + " + ".join(f"({n} IS NOT NULL)::INT" for n in _LAG_NAMES) + " > 0",
)
def lag_matrix_hours(spark, d):
    """Lagged hourly columns of the rows that have the response and any lag of it."""
    m = rolling.lag_matrix(event_hours(spark, d).drop("driver"), "response", keys=["station"])
    return tidy(m.dropna(subset=["response"]).dropna(thresh=1, subset=_LAG_NAMES).select("station", "ts", "response", *_LAG_NAMES))


@query(
    "lag_scan",
    f"WITH {ED_SQL}, df AS (SELECT station, date, driver - lag(driver) OVER w AS dx, response - lag(response) OVER w AS dy FROM ed WINDOW w AS (PARTITION BY station ORDER BY date)), "
    "lg AS (SELECT station, date, dy, " + ", ".join(f"lag(dx, {n}) OVER w AS x{n}" for n in range(8)) + " FROM df WINDOW w AS (PARTITION BY station ORDER BY date)) "
    + " UNION ALL ".join(f"SELECT CAST({n} AS BIGINT) AS lag, round(corr(x{n}, dy), 6) AS corr, count(*) FILTER (WHERE x{n} IS NOT NULL AND dy IS NOT NULL) AS n_pairs FROM lg" for n in range(8)),
)
def lag_scan(spark, d):
    return tidy(rolling.lag_scan(event_days(spark, d), "driver", "response", range(8), ["station"], "date"))


@query(
    "lag_scan_best",
    f"WITH {ED_SQL}, df AS (SELECT station, date, driver - lag(driver) OVER w AS dx, response - lag(response) OVER w AS dy FROM ed WINDOW w AS (PARTITION BY station ORDER BY date)), "
    "lg AS (SELECT station, date, dy, " + ", ".join(f"lag(dx, {n}) OVER w AS x{n}" for n in range(8)) + " FROM df WINDOW w AS (PARTITION BY station ORDER BY date)), s AS ("
    + " UNION ALL ".join(f"SELECT CAST({n} AS BIGINT) AS lag, corr(x{n}, dy) AS c FROM lg" for n in range(8))
    + ") SELECT lag, round(c, 6) AS corr FROM s ORDER BY abs(c) DESC, lag LIMIT 3",
)
def lag_scan_best(spark, d):
    scan = rolling.lag_scan(event_days(spark, d), "driver", "response", range(8), ["station"], "date")
    return tidy(scan.orderBy(F.desc(F.abs("corr")), "lag").limit(3).select("lag", "corr"))


@query(
    "lag_matrix",
    f"WITH {ED_SQL}, m AS (SELECT station, date, response, " + ", ".join(f"lag(response, {n}) OVER w AS response_lag_{n}d" for n in (1, 2, 3, 7))
    + ", dayofyear(date) AS day_of_year FROM ed WINDOW w AS (PARTITION BY station ORDER BY date)) SELECT station, date, round(response, 6) AS response, "
    + ", ".join(f"round(response_lag_{n}d, 6) AS response_lag_{n}d" for n in (1, 2, 3, 7))
    + ", day_of_year FROM m WHERE response IS NOT NULL AND " + " AND ".join(f"response_lag_{n}d IS NOT NULL" for n in (1, 2, 3, 7)),
)
def lag_matrix(spark, d):
    m = rolling.lag_matrix(event_days(spark, d).drop("driver"), "response", (1, 2, 3, 7), ["station"], "date", "d")
    return tidy(m.withColumn("day_of_year", F.dayofyear("date")).dropna())


@query(
    "timestamp_integrity",
    f"""WITH {EV_SQL}, e AS (SELECT station, date_trunc('hour', ts) AS ts FROM ev), u AS (SELECT DISTINCT station, ts FROM e),
        g AS (SELECT station, epoch(ts - lag(ts) OVER (PARTITION BY station ORDER BY ts)) / 3600 AS gap FROM u),
        n AS (SELECT station, count(*) AS n_rows, count(DISTINCT ts) AS n_unique FROM e GROUP BY 1)
        SELECT n.station, n_rows, n_unique, n_rows - n_unique AS n_duplicates, round(max(gap), 6) AS max_gap_hours, round(avg(gap), 6) AS mean_gap_hours
        FROM n JOIN g ON n.station = g.station GROUP BY 1, 2, 3""",
)
def timestamp_integrity(spark, d):
    ev = events_panel(spark, d).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return tidy(rolling.timestamp_integrity(ev, ["station"], "ts"))


@query(
    "gap_histogram",
    f"""WITH {EV_SQL}, e AS (SELECT station, date_trunc('hour', ts) AS ts FROM ev),
        g AS (SELECT CAST(round(epoch(ts - lag(ts) OVER (PARTITION BY station ORDER BY ts)) / 3600) AS BIGINT) AS gap FROM e)
        SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY gap ORDER BY n DESC, gap LIMIT 10""",
)
def gap_histogram(spark, d):
    ev = events_panel(spark, d).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return rolling.gap_histogram(ev, ["station"], "ts")


@query(
    "previous_reading",
    f"""WITH {EV_SQL}, u AS (SELECT DISTINCT station, ts FROM ev) SELECT station, ts,
        round(epoch(ts - lag(ts) OVER (PARTITION BY station ORDER BY ts)) / 3600, 6) AS gap_hours FROM u""",
)
def previous_reading(spark, d):
    return tidy(rolling.reading_gaps(events_panel(spark, d), ["station"], "ts").select("station", "ts", "gap_hours"))


@query(
    "order_violations",
    """SELECT o_custkey, count(*) FILTER (WHERE o_orderdate < m) AS n_order_violations FROM (
         SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM orders) GROUP BY 1""",
)
def order_violations(spark, d):
    return rolling.order_violations(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey")


@query(
    "interpolate_months",
    f"""WITH {OC_SQL}, m AS (SELECT region, station, CAST(date_trunc('month', date) AS DATE) AS month, avg(value) AS value FROM oc GROUP BY 1, 2, 3),
        sp AS (SELECT region, station, min(month) AS a, max(month) AS b FROM m GROUP BY 1, 2),
        grid AS (SELECT region, station, CAST(u AS DATE) AS month FROM sp, unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS t(u)),
        g AS (SELECT grid.*, value FROM grid LEFT JOIN m USING (region, station, month)),
        w AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN month END IGNORE NULLS) OVER p AS ta, last_value(value IGNORE NULLS) OVER p AS va,
          first_value(CASE WHEN value IS NOT NULL THEN month END IGNORE NULLS) OVER n AS tb, first_value(value IGNORE NULLS) OVER n AS vb FROM g
          WINDOW p AS (PARTITION BY region, station ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 n AS (PARTITION BY region, station ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT region, station, month, round(coalesce(value, va + (vb - va) * (month - ta) / (tb - ta), va, vb), 6) AS filled FROM w""",
)
def interpolate_months(spark, d):
    months = sparse_panel(spark, d).groupBy("region", "station", dates.month_start(F.col("date")).alias("month")).agg(F.avg("value").alias("value"))
    grid = rolling.spine(months, ["region", "station"], "month", "1 MONTH", ["value"])
    return tidy(rolling.interpolate_time(grid, "value", "month").drop("value"))


@query(
    "group_transform",
    f"""WITH {LI_SQL}, s AS (SELECT region, station, avg(water_temp) AS t FROM li GROUP BY 1, 2)
        SELECT region, station, count(*) OVER w AS group_size, round(median(t) OVER w, 6) AS group_median FROM s WINDOW w AS (PARTITION BY region)""",
)
def group_transform(spark, d):
    s = water_panel(spark, d).groupBy("region", "station").agg(F.avg("water_temp").alias("t"))
    return tidy(rolling.group_size_and_median(s, ["region"], "t").drop("t"))


ASOF_SQL = f"""WITH {EV_SQL}, obs AS (SELECT station, date_trunc('hour', ts + INTERVAL 30 MINUTE) AS obs_ts, avg(value) AS nut_value,
      avg(CASE WHEN flag > 0 THEN value END) AS nut_good FROM ev WHERE variable = 'purchase' GROUP BY 1, 2)
    SELECT ev.event_id, ev.station, ev.ts, CASE WHEN ok THEN round(nut_value, 6) END AS nut_value, CASE WHEN ok THEN round(nut_good, 6) END AS nut_good,
      CASE WHEN ok THEN obs_ts END AS obs_ts, CASE WHEN ok THEN round(epoch(ts - obs_ts) / 3600, 6) END AS age_hours
    FROM (SELECT ev.*, obs.* EXCLUDE (station), obs_ts >= ts - INTERVAL 7 DAY AS ok FROM ev ASOF LEFT JOIN obs ON ev.station = obs.station AND ev.ts >= obs.obs_ts) ev"""


def purchase_obs(spark: SparkSession, d: str) -> DataFrame:
    from tidepanel.operators import rollup

    buys = events_panel(spark, d).filter(F.col("variable") == "purchase")
    buys = buys.withColumn("good", F.when(F.col("flag") > 0, F.col("value")))
    return rollup.snap_hour(buys, ["station"], "ts", ["value", "good"]).withColumnRenamed("hour_ts", "obs_ts")


@query("asof_7d", ASOF_SQL)
def asof_7d(spark, d):
    ev = events_panel(spark, d).select("event_id", "station", "ts")
    return tidy(joins.asof_join(ev, purchase_obs(spark, d), ["station"], "ts", "obs_ts"))


@query(
    "asof_12h",
    ASOF_SQL.replace("INTERVAL 7 DAY", "INTERVAL 12 HOUR"),
)
def asof_12h(spark, d):
    ev = events_panel(spark, d).select("event_id", "station", "ts")
    return tidy(joins.asof_join(ev, purchase_obs(spark, d), ["station"], "ts", "obs_ts", "12 hours"))


@query(
    "global_rank",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS price_rank FROM orders",
)
def global_rank(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return ordered.global_rank(o, [F.desc("o_totalprice"), "o_orderkey"], "price_rank").select("o_orderkey", "price_rank")
