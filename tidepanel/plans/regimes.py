"""Regime, transition, clustering and neighbour queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions import dates
from tidepanel.operators import baseline, coverage, density, neighbours, regime
from tidepanel.plans.registry import query, tidy
from tidepanel.plans.rollups import BALANCED_SQL, COVER_SQL, MONTHLY_SQL, baseline_panel, covered, daily_water
from tidepanel.plans.windows import MW_SQL, monthly_water
from tidepanel.session import staged
from tidepanel.sources.panels import WATER_MEASURES, events_panel, table, water_panel

FEATURES = ["mean_annual_water_temp", "mean_annual_salinity", "mean_annual_oxygen", "mean_annual_depth"]
PROFILE = [*FEATURES, "seasonal_amp_water_temp"]


def labelled_stations(spark: SparkSession, d: str) -> DataFrame:
    """Station baselines with a cluster from a fixed rule on mean depth and oxygen."""
    rows = baseline_panel(spark, d)
    means = baseline.year_balanced_means(rows, WATER_MEASURES)
    amps = baseline.seasonal_amplitude(baseline.climatology(rows, WATER_MEASURES), WATER_MEASURES)
    deep, rich = F.col("mean_annual_depth") >= 5, F.col("mean_annual_oxygen") >= 6
    labels = means.join(amps, ["region", "station"], "left").select(
        "region", "station", *PROFILE, F.when(deep & rich, 2).when(deep, 1).when(rich, 3).otherwise(0).alias("cluster")
    )
    return staged(labels)


ST_SQL = (
    f"{COVER_SQL}, {BALANCED_SQL}, {MONTHLY_SQL}, amp AS (SELECT region, station, max(water_temp_mmean) - min(water_temp_mmean) AS seasonal_amp_water_temp FROM mm GROUP BY 1, 2), "
    "st AS (SELECT yb.region, yb.station, " + ", ".join(FEATURES) + ", seasonal_amp_water_temp, "
    "CASE WHEN mean_annual_depth >= 5 AND mean_annual_oxygen >= 6 THEN 2 WHEN mean_annual_depth >= 5 THEN 1 WHEN mean_annual_oxygen >= 6 THEN 3 ELSE 0 END AS cluster "
    "FROM yb LEFT JOIN amp USING (region, station))"
)
SCALE_SQL = "sc AS (SELECT " + ", ".join(f"avg({c}) AS {c}_mu, stddev_pop({c}) AS {c}_sd" for c in FEATURES) + " FROM st)"
CENTER_SQL = "ce AS (SELECT cluster, " + ", ".join(f"avg(({c} - {c}_mu) / {c}_sd) AS {c}" for c in FEATURES) + " FROM st, sc GROUP BY 1)"


@query(
    "standardise",
    f"WITH {ST_SQL}, {SCALE_SQL} SELECT region, station, " + ", ".join(f"round(({c} - {c}_mu) / {c}_sd, 6) AS {c}_z" for c in FEATURES) + " FROM st, sc",
)
def standardise(spark, d):
    z = regime.standardise(labelled_stations(spark, d), FEATURES)
    return tidy(z.select("region", "station", *[f"{c}_z" for c in FEATURES]))


@query("centroids", f"WITH {ST_SQL}, {SCALE_SQL}, {CENTER_SQL} SELECT CAST(cluster AS BIGINT) AS cluster, " + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES) + " FROM ce")
def centroids(spark, d):
    return tidy(regime.centroids(labelled_stations(spark, d), FEATURES)[0])


def classified_months(spark: SparkSession, d: str) -> DataFrame:
    """Months with their five-year condition classified against the baseline clusters."""
    stations = labelled_stations(spark, d)
    centers, scale = regime.centroids(stations, FEATURES)
    renames = {"water_temp": FEATURES[0], "salinity": FEATURES[1], "oxygen": FEATURES[2], "depth": FEATURES[3]}
    months = monthly_water(spark, d).select(
        "region", "station", "month", "coverage_ratio_5y",
        *[(F.when(F.col("station") % 7 != 0, F.col(f"{c}_roll5y")) if c == "salinity" else F.col(f"{c}_roll5y")).alias(n) for c, n in renames.items()],
    )
    months = months.join(stations.select("region", "station", "cluster"), ["region", "station"], "left")
    return regime.nearest_centroid(months, FEATURES, centers, scale, coverage="coverage_ratio_5y")


_Z = {c: f"(mc.{c} - sc.{c}_mu) / sc.{c}_sd" for c in FEATURES}
CLASS_SQL = (
    f"{ST_SQL}, {SCALE_SQL}, {CENTER_SQL}, "
    + MW_SQL.split("precip FROM li GROUP BY region, station, date), ")[1].replace("mo AS", "mo AS", 1)
    + ", mc AS (SELECT mw.region, mw.station, month, coverage_ratio_5y, water_temp_roll5y AS mean_annual_water_temp, CASE WHEN mw.station % 7 <> 0 THEN salinity_roll5y END AS mean_annual_salinity, "
    "oxygen_roll5y AS mean_annual_oxygen, depth_roll5y AS mean_annual_depth, st.cluster FROM mw LEFT JOIN st USING (region, station)), "
    "ds AS (SELECT mc.*, " + " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in [f"mc.{f}" for f in FEATURES]) + " AS nf, ce.cluster AS k, sqrt("
    + " + ".join(f"coalesce(pow(ce.{c} - {_Z[c]}, 2), 0)" for c in FEATURES)
    + ") AS dist FROM mc, sc, ce), rk AS (SELECT *, row_number() OVER (PARTITION BY region, station, month ORDER BY dist, k) AS rn FROM ds), "
    "two AS (SELECT region, station, month, any_value(cluster) AS cluster, any_value(coverage_ratio_5y) AS cov, any_value(nf) AS nf, max(CASE WHEN rn = 1 THEN k END) AS k, "
    "max(CASE WHEN rn = 1 THEN dist END) AS d1, max(CASE WHEN rn = 2 THEN dist END) AS d2 FROM rk GROUP BY 1, 2, 3), "
    "cl AS (SELECT *, CASE WHEN cov < 0.7 THEN 'insufficient_coverage' WHEN nf < 3 THEN 'insufficient_features' WHEN nf = 4 THEN 'classified_full' ELSE 'classified_partial' END AS assignment_state, "
    "CASE WHEN cov >= 0.7 AND nf >= 3 THEN k END AS implied_cluster, CASE WHEN cov >= 0.7 AND nf >= 3 THEN d1 END AS dist_best, CASE WHEN cov >= 0.7 AND nf >= 3 THEN d2 END AS dist_second, "
    "CASE WHEN cov < 0.7 THEN 0 ELSE nf END AS n_features_used FROM two)"
)
CLASS_SQL = CLASS_SQL.replace("FROM dw GROUP BY 1, 2, 3), mw", "FROM dw2 GROUP BY 1, 2, 3), mw").replace(
    ", mo AS", ", dw2 AS (SELECT region, station, date, " + ", ".join(f"avg({c}) AS {c}" for c in WATER_MEASURES) + " FROM li GROUP BY 1, 2, 3), mo AS", 1
)


@query(
    "nearest_centroid",
    f"""WITH {CLASS_SQL} SELECT region, station, month, CAST(implied_cluster AS BIGINT) AS implied_cluster, round(dist_best, 6) AS dist_best, round(dist_second, 6) AS dist_second,
        round(dist_second - dist_best, 6) AS margin, CAST(n_features_used AS BIGINT) AS n_features_used, assignment_state FROM cl""",
)
def nearest_centroid(spark, d):
    cols = ["implied_cluster", "dist_best", "dist_second", "margin", "n_features_used", "assignment_state"]
    return tidy(classified_months(spark, d).select("region", "station", "month", *cols))


FLIP_SQL = (
    CLASS_SQL
    + """, ru AS (SELECT *, CASE WHEN lag(implied_cluster) OVER w = implied_cluster THEN 0 ELSE 1 END AS starts FROM cl WINDOW w AS (PARTITION BY region, station ORDER BY month)),
    ri AS (SELECT *, sum(starts) OVER (PARTITION BY region, station ORDER BY month) AS run FROM ru),
    rl AS (SELECT *, count(*) OVER (PARTITION BY region, station, run) AS run_len_months, row_number() OVER (PARTITION BY region, station, run ORDER BY month) AS upto, coalesce(implied_cluster <> cluster, false) AS candidate_flip FROM ri),
    fl AS (SELECT *, coalesce(candidate_flip AND run_len_months >= 6 AND dist_second - dist_best > 0.10, false) AS flip_confirmed_monthly FROM rl)"""
)


@query("regime_flips", f"WITH {FLIP_SQL} SELECT region, station, month, candidate_flip, run_len_months, flip_confirmed_monthly FROM fl")
def regime_flips(spark, d):
    flips = regime.confirm_flips(classified_months(spark, d))
    return flips.select("region", "station", "month", "candidate_flip", "run_len_months", "flip_confirmed_monthly")


@query("regime_flips_causal", f"WITH {FLIP_SQL} SELECT region, station, month, upto AS run_so_far_months, coalesce(candidate_flip AND upto >= 6 AND dist_second - dist_best > 0.10, false) AS flip_confirmed_monthly FROM fl")
def regime_flips_causal(spark, d):
    flips = regime.confirm_flips_causal(classified_months(spark, d))
    return tidy(flips.select("region", "station", "month", "run_so_far_months", "flip_confirmed_monthly"))


def flip_days(spark: SparkSession, d: str) -> DataFrame:
    flips = regime.confirm_flips(classified_months(spark, d))
    days = daily_water(spark, d).select("region", "station", "date", dates.month_start(F.col("date")).alias("month"))
    return regime.project_to_days(days, flips, ["implied_cluster", "run_len_months", "flip_confirmed_monthly"])


DAYS_SQL = FLIP_SQL + ", fd AS (SELECT dw2.region, dw2.station, date, implied_cluster, run_len_months * 30.4375 AS run_len_days, coalesce(flip_confirmed_monthly, false) AS flip_confirmed FROM dw2 LEFT JOIN fl ON dw2.region = fl.region AND dw2.station = fl.station AND CAST(date_trunc('month', date) AS DATE) = month)"


@query("regime_flip_days", f"WITH {DAYS_SQL} SELECT region, station, date, CAST(implied_cluster AS BIGINT) AS implied_cluster, round(CAST(run_len_days AS DOUBLE), 6) AS run_len_days, flip_confirmed FROM fd")
def regime_flip_days(spark, d):
    return tidy(flip_days(spark, d).select("region", "station", "date", "implied_cluster", "run_len_days", "flip_confirmed"))


@query("first_events", f"WITH {DAYS_SQL} SELECT region, station, min(date) AS event_date FROM fd WHERE flip_confirmed GROUP BY 1, 2")
def first_events(spark, d):
    return regime.first_events(flip_days(spark, d))


@query("classification_quality", f"WITH {DAYS_SQL} SELECT region, station, count(*) AS n_rows, count(implied_cluster) AS n_classified_days, count(*) FILTER (WHERE flip_confirmed) AS n_flip_days FROM fd GROUP BY 1, 2")
def classification_quality(spark, d):
    return coverage.classification_quality(flip_days(spark, d), "implied_cluster", "flip_confirmed")


PROF_SQL = (
    "pm AS (SELECT cluster, count(*) AS n_members, " + ", ".join(f"avg({c}) AS {c}" for c in PROFILE) + " FROM st GROUP BY 1), "
    "pz AS (SELECT *, " + ", ".join(f"({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0) AS {c}_z" for c in PROFILE) + " FROM pm)"
)


@query("cluster_profile", f"WITH {ST_SQL}, {PROF_SQL} SELECT CAST(cluster AS BIGINT) AS cluster, n_members, " + ", ".join(f"round({c}, 6) AS {c}, round({c}_z, 6) AS {c}_z" for c in PROFILE) + " FROM pz")
def cluster_profile(spark, d):
    return tidy(regime.cluster_profile(labelled_stations(spark, d), PROFILE))


def _tag_sql(c: str, low: str, mid: str, high: str) -> str:
    return f"CASE WHEN {c}_z >= 0.35 THEN '{high}' WHEN {c}_z <= -0.35 THEN '{low}' ELSE '{mid}' END"


_T, _S, _O = _tag_sql("mean_annual_water_temp", "Cool", "Temp", "Warm"), _tag_sql("mean_annual_salinity", "Fresh", "Brackish", "Saline"), _tag_sql("mean_annual_oxygen", "Low O2", "Mid O2", "High O2")
_A, _D = _tag_sql("seasonal_amp_water_temp", "Stable", "Mixed", "Seasonal"), _tag_sql("mean_annual_depth", "Shallow", "Mid", "Deep")


@query("cluster_names", f"WITH {ST_SQL}, {PROF_SQL} SELECT CAST(cluster AS BIGINT) AS cluster, {_T} || ' / ' || {_S} || ' / ' || {_O} AS cluster_name, {_T} || '-' || {_S} AS cluster_label, {_A} || ', ' || {_D} AS cluster_note FROM pz")
def cluster_names(spark, d):
    named = regime.cluster_names(regime.cluster_profile(labelled_stations(spark, d), PROFILE))
    return tidy(named.select("cluster", "cluster_name", "cluster_label", "cluster_note"))


NUTRIENTS = {"n_nh4f_mg_l": "click", "n_no3f_mg_l": "error", "n_no23f_mg_l": "purchase", "n_chla_ug_l": "signup", "w_sal_psu": "view"}
_NUT_CTE = (
    "g AS (SELECT user_id % 12 AS cluster, " + ", ".join(f"avg(value) FILTER (WHERE event_type = '{v}') AS {n}" for n, v in NUTRIENTS.items())
    + ", avg(hour(ts)) AS w_temp_c, avg(minute(ts)) AS w_do_mg_l FROM events GROUP BY 1), z AS (SELECT cluster, "
    + ", ".join(f"({n} - avg({n}) OVER ()) / stddev_pop({n}) OVER () AS {n}" for n in [*NUTRIENTS, "w_temp_c", "w_do_mg_l"]) + " FROM g)"
)
_NUT_COLS = [*NUTRIENTS, "w_temp_c", "w_do_mg_l"]


def _signal_sql(order: str) -> str:
    cells = ", ".join(f"{{'k': {n}, 'n': '{n}'}}" for n in _NUT_COLS)
    return f"(SELECT string_agg(n || ' (' || format('{{:.2f}}', k) || ')', ', ' ORDER BY k {order}, n) FROM (SELECT u.k AS k, u.n AS n FROM unnest([{cells}]) AS t(u) ORDER BY k {order}, n LIMIT 3))"


def _label_sql(i: int) -> str:
    t = {k: v[i].replace("'", "''") for k, v in regime.NUTRIENT_LABELS.items()}
    return (
        f"CASE WHEN n_nh4f_mg_l > 1.5 OR n_no3f_mg_l > 1.5 OR n_no23f_mg_l > 1.5 THEN '{t['pulse']}' "
        f"WHEN w_sal_psu < -1.0 AND n_no23f_mg_l > 0.3 AND n_chla_ug_l > 0.3 THEN '{t['fresh']}' "
        f"WHEN w_temp_c > 0.8 AND w_do_mg_l < -0.5 AND w_sal_psu > 0 THEN '{t['warm']}' "
        f"WHEN w_sal_psu > 0.5 AND w_do_mg_l > 0.5 AND w_temp_c < -0.5 THEN '{t['cool']}' ELSE '{t['mixed']}' END"
    )


@query("nutrient_labels", f"WITH {_NUT_CTE} SELECT cluster, {_label_sql(0)} AS label, {_label_sql(1)} AS rationale, {_signal_sql('DESC')} AS top_high_signals, {_signal_sql('ASC')} AS top_low_signals FROM z")
def nutrient_labels(spark, d):
    ev = events_panel(spark, d)
    g = ev.groupBy((F.col("station") % 12).alias("cluster")).agg(
        *[F.avg(F.when(F.col("variable") == v, F.col("value"))).alias(n) for n, v in NUTRIENTS.items()],
        F.avg(F.hour("ts")).alias("w_temp_c"),
        F.avg(F.minute("ts")).alias("w_do_mg_l"),
    )
    z = regime.standardise(g, _NUT_COLS).select("cluster", *[F.col(f"{n}_z").alias(n) for n in _NUT_COLS])
    return regime.label_nutrient_regimes(z, _NUT_COLS).select("cluster", "label", "rationale", "top_high_signals", "top_low_signals")


# --- neighbours ------------------------------------------------------------------------

VEC_SQL = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), pairs AS (SELECT a.vec_id AS id, b.vec_id AS other, list_distance(a.e, b.e) AS d FROM v a, v b)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.as_vectors(table(spark, d, "embeddings"), "vec_id", "embedding")


@query("knn_distance", f"WITH {VEC_SQL} SELECT id, round(d, 6) AS kth_distance FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY d) = 10")
def knn_distance(spark, d):
    return tidy(neighbours.knn_distance(vectors(spark, d), 10))


@query(
    "eps_candidates",
    f"WITH {VEC_SQL}, k AS (SELECT id, d FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY d) = 10) "
    + " UNION ALL ".join(f"SELECT CAST({p} AS DOUBLE) AS prob, round(quantile_cont(d, {p}), 3) AS eps FROM k" for p in (0.6, 0.7, 0.8, 0.85, 0.9, 0.95)),
)
def eps_candidates(spark, d):
    return neighbours.eps_candidates(vectors(spark, d), 10)


@query("range_counts", f"WITH {VEC_SQL} SELECT id, count(*) FILTER (WHERE d <= 0.95) AS n_neighbours FROM pairs GROUP BY id")
def range_counts(spark, d):
    return neighbours.range_counts(vectors(spark, d), 0.95)


def _dbscan_sql(eps: str, name: str = "") -> str:
    """Core points, clusters by reach over core links, and border points, as tables named with a suffix."""
    n = name
    return (
        f"core{n} AS (SELECT id FROM pairs WHERE d <= {eps} GROUP BY id HAVING count(*) >= 6), "
        f"link{n} AS (SELECT p.id, p.other FROM pairs p JOIN core{n} a ON p.id = a.id JOIN core{n} b ON p.other = b.id WHERE d <= {eps}), "
        f"reach{n}(id, node) AS (SELECT id, id FROM core{n} UNION SELECT r.id, l.other FROM reach{n} r JOIN link{n} l ON r.node = l.id), "
        f"root{n} AS (SELECT id, min(node) AS root FROM reach{n} GROUP BY id), "
        f"num{n} AS (SELECT id, CAST(dense_rank() OVER (ORDER BY root) - 1 AS BIGINT) AS cluster FROM root{n}), "
        f"bord{n} AS (SELECT p.id, min(m.cluster) AS cluster FROM pairs p JOIN num{n} m ON p.other = m.id WHERE d <= {eps} AND p.id NOT IN (SELECT id FROM core{n}) GROUP BY p.id), "
        f"lab{n} AS (SELECT v.vec_id AS id, m.id IS NOT NULL AS is_core, coalesce(m.cluster, b.cluster, -1) AS cluster FROM v LEFT JOIN num{n} m ON v.vec_id = m.id LEFT JOIN bord{n} b ON v.vec_id = b.id)"
    )


EPS = (0.85, 0.95, 1.0, 1.05)


def _eps_sql() -> str:
    """The scan by pairs: mean squared distance to the own cluster's others and to the nearest other cluster."""
    parts = []
    for k, eps in enumerate(EPS):
        parts.append(
            f"SELECT {eps}::DOUBLE AS eps, (SELECT count(DISTINCT cluster) FROM lab{k} WHERE cluster >= 0) AS n_clusters, "
            f"(SELECT round(100 * avg((cluster < 0)::INT), 2) FROM lab{k}) AS noise_pct, "
            f"(SELECT CASE WHEN count(DISTINCT c) > 1 THEN round(avg(s), 6) END FROM (SELECT c, CASE WHEN any_value(sizes) = 1 THEN 0 ELSE (min(d2) FILTER (WHERE o <> c) - max(own)) / greatest(min(d2) FILTER (WHERE o <> c), max(own)) END AS s FROM "
            f"(SELECT p.id, a.cluster AS c, b.cluster AS o, avg(d * d) AS d2, CASE WHEN a.cluster = b.cluster THEN sum(d * d) / greatest(count(*) - 1, 1) END AS own, CASE WHEN a.cluster = b.cluster THEN count(*) END AS sizes "
            f"FROM pairs p JOIN lab{k} a ON p.id = a.id JOIN lab{k} b ON p.other = b.id WHERE a.cluster >= 0 AND b.cluster >= 0 GROUP BY 1, 2, 3) GROUP BY id, c)) AS silhouette"
        )
    return "WITH RECURSIVE " + VEC_SQL + ", " + ", ".join(_dbscan_sql(str(e), str(k)) for k, e in enumerate(EPS)) + ", s AS (" + " UNION ALL ".join(parts) + ") SELECT *, silhouette IS NOT NULL AND row_number() OVER (ORDER BY silhouette DESC NULLS LAST, eps) = 1 AS best FROM s"


@query("density_clusters", f"WITH RECURSIVE {VEC_SQL}, {_dbscan_sql('0.95')} SELECT * FROM lab")
def density_clusters(spark, d):
    return density.dbscan(vectors(spark, d), 0.95, 6)


@query("eps_scan", _eps_sql())
def eps_scan(spark, d):
    return tidy(density.eps_scan(vectors(spark, d), EPS, 6))


@query("eps_best")
def eps_best(spark, d):
    """The scan over the radii that the quantiles of the k-distance propose."""
    points = vectors(spark, d)
    radii = [r["eps"] for r in neighbours.eps_candidates(points, 10).collect()]
    return tidy(density.eps_scan(points, radii, 6))


ANALOG = ["water_temp", "salinity", "oxygen", "air_temp"]


@query(
    "nearest_analog",
    """WITH """ + COVER_SQL.split(", cov AS")[0] + """, mo AS (SELECT region, station, year(date) AS year, month(date) AS month, avg(water_temp) AS water_temp, avg(salinity) AS salinity, avg(oxygen) AS oxygen, avg(air_temp) AS air_temp FROM li GROUP BY ALL),
        m AS (SELECT *, station * 10000 + year * 12 + month AS id FROM mo WHERE water_temp IS NOT NULL AND salinity IS NOT NULL AND oxygen IS NOT NULL AND air_temp IS NOT NULL),
        p AS (SELECT q.id, h.id AS analog_id, sqrt(pow(q.water_temp - h.water_temp, 2) + pow(q.salinity - h.salinity, 2) + pow(q.oxygen - h.oxygen, 2) + pow(q.air_temp - h.air_temp, 2)) AS d
          FROM m q JOIN m h ON q.month = h.month WHERE q.year >= 2000 AND h.year < 2000)
        SELECT id, analog_id, round(d, 6) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, analog_id) = 1""",
)
def nearest_analog(spark, d):
    months = water_panel(spark, d).groupBy("region", "station", F.year("date").alias("year"), F.month("date").alias("month")).agg(
        *[F.avg(c).alias(c) for c in ANALOG]
    )
    months = staged(months.withColumn("id", F.col("station") * 10000 + F.col("year") * 12 + F.col("month")))
    queries = neighbours.as_vectors(months.filter("year >= 2000"), "id", ANALOG, "month")
    history = neighbours.as_vectors(months.filter("year < 2000"), "id", ANALOG, "month")
    near = neighbours.nearest(queries, history, 1)
    return tidy(near.filter("rank = 1").select("id", F.col("neighbour").alias("analog_id"), "distance"))
