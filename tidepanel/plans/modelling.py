"""Model, calibration, clustering and decomposition queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel import KEYS
from tidepanel.functions import dates
from tidepanel.operators import baseline, causality, clean, clusters, coverage, decompose, evaluate, models, rolling, rollup, sets
from tidepanel.plans.cleaning import EVENT_TYPES
from tidepanel.plans.registry import query, tidy
from tidepanel.plans.regimes import PROFILE, ST_SQL, labelled_stations
from tidepanel.plans.rollups import DW_SQL, STRESS_SQL, SYQ_LIMITS, SYQ_SQL, daily_water, water_with_deltas
from tidepanel.plans.windows import event_days
from tidepanel.session import scratch_path, staged
from tidepanel.sources.panels import EV_SQL, LI_SQL, events_panel, table, water_panel

FEATURES = ["air_temp_mean", "air_temp_std", "air_temp_warm_mean", "precip_mean", "precip_warm_mean", "salinity_annual_mean"]


def station_years(spark: SparkSession, d: str) -> DataFrame:
    """Station-years with features, oxygen stress, quality flags and cohort."""
    days = daily_water(spark, d)
    feats = rollup.station_year_features(days, ["air_temp", "precip"], ["salinity", "water_temp", "ph"], ["oxygen"]).drop("oxygen_std")
    stress = rollup.oxygen_stress(days)
    quality = coverage.station_year_quality(days, ["water_temp", "salinity", "oxygen"], **SYQ_LIMITS)
    flags = quality.select("region", "station", "year", "has_model_year", "has_warm_oxygen_year")
    cohort = F.when(F.col("station") % 5 == 0, "holdout").otherwise("train")
    out = feats.join(stress, [*KEYS, "year"], "left").join(flags, [*KEYS, "year"], "left")
    return out.withColumn("cohort", cohort)


SY_SQL = (
    f"{DW_SQL}, {STRESS_SQL}, {SYQ_SQL}, f AS (SELECT region, station, year(date) AS year, avg(air_temp) AS air_temp_mean, avg(water_temp) AS water_temp_annual_mean, "
    "avg(oxygen) AS oxygen_annual_mean FROM dw GROUP BY 1, 2, 3), sy AS (SELECT f.*, oxygen_warm_min, oxygen_warm_p10, oxygen_warm_hypoxic_day_share, has_model_year, has_warm_oxygen_year, "
    "CASE WHEN f.station % 5 = 0 THEN 'holdout' ELSE 'train' END AS cohort FROM f LEFT JOIN os USING (region, station, year) LEFT JOIN syq USING (region, station, year))"
)

TARGETS = [
    models.Target("oxygen_warm_min", "oxygen_warm_min", tuple(FEATURES), "has_warm_oxygen_year", models.TARGET_WINDOWS["oxygen_warm_min"]),
    models.Target("oxygen_warm_p10", "oxygen_warm_p10", tuple(FEATURES), "has_warm_oxygen_year", models.TARGET_WINDOWS["oxygen_warm_p10"]),
    models.Target("water_temp", "water_temp_annual_mean", tuple(FEATURES)),
]


REGISTRY = [
    models.Target(name, column, tuple(FEATURES), "has_warm_oxygen_year" if "oxygen" in name else "has_model_year", models.TARGET_WINDOWS[name])
    for name, column in {
        "delta_salinity": "delta_salinity_annual_mean", "delta_oxygen": "delta_oxygen_warm_mean", "oxygen_warm_min": "oxygen_warm_min", "oxygen_warm_p10": "oxygen_warm_p10",
        "oxygen_warm_hypoxic_day_share": "oxygen_warm_hypoxic_day_share", "oxygen_warm_below_optimal_day_share": "oxygen_warm_below_optimal_day_share",
        "delta_ph": "delta_ph_annual_mean",
    }.items()
]


def response_years(spark: SparkSession, d: str) -> DataFrame:
    """Station-years with features and all seven responses, as deltas from the baseline where they are such."""
    days = water_with_deltas(spark, d)
    feats = rollup.station_year_features(days, ["air_temp", "precip"], ["salinity", "delta_salinity", "delta_ph"], ["delta_oxygen"])
    quality = coverage.station_year_quality(days, ["water_temp", "salinity", "oxygen"], **SYQ_LIMITS)
    flags = quality.select(*KEYS, "year", "has_model_year", "has_warm_oxygen_year")
    out = feats.join(rollup.oxygen_stress(days), [*KEYS, "year"], "left").join(flags, [*KEYS, "year"], "left")
    return out.withColumn("cohort", F.when(F.col("station") % 5 == 0, "holdout").otherwise("train"))


@query(
    "target_usable_rows",
    f"WITH {SY_SQL}, c AS (" + " UNION ALL ".join(
        f"SELECT '{t.name}' AS target, '{t.window}' AS target_window, '{t.flag}' AS coverage_flag, count(*) FILTER (WHERE {t.flag}) AS n_flagged FROM sy" for t in REGISTRY
    ) + ") SELECT * FROM c",
)
def target_usable_rows(spark, d):
    """The registry of all seven targets, with the station-years that each one's flag admits."""
    years = station_years(spark, d)
    flagged = years.agg(*[F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in ("has_model_year", "has_warm_oxygen_year")])
    counts = flagged.select(F.explode(F.create_map(*[x for f in flagged.columns for x in (F.lit(f), F.col(f))])).alias("coverage_flag", "n_flagged"))
    return models.target_registry(spark, REGISTRY).select("target", "target_window", "coverage_flag").join(counts, "coverage_flag").select("target", "target_window", "coverage_flag", "n_flagged")


@query(
    "target_counts",
    f"WITH {SY_SQL}, c AS (" + " UNION ALL ".join(
        f"SELECT '{t.name}' AS target, count(*) FILTER (WHERE {t.flag} AND {t.column} IS NOT NULL AND cohort = 'train') AS n_train, count(*) FILTER (WHERE {t.flag} AND {t.column} IS NOT NULL AND cohort = 'holdout') AS n_holdout FROM sy"
        for t in TARGETS
    ) + ") SELECT *, n_train > 0 AND n_holdout > 0 AS usable FROM c",
)
def target_counts(spark, d):
    return models.target_counts(station_years(spark, d), TARGETS)


def _weights_sql(col: str, rule: str) -> str:
    return f"WITH {SY_SQL} SELECT region, station, year, {rule} AS weight FROM sy, (SELECT quantile_cont({col}, 0.1) AS q10, quantile_cont({col}, 0.2) AS q20, quantile_cont({col}, 0.25) AS q25, quantile_cont({col}, 0.75) AS q75, quantile_cont({col}, 0.8) AS q80, quantile_cont({col}, 0.9) AS q90 FROM sy)"


def _weights(spark, d, col, target):
    out = models.tail_weights(station_years(spark, d), col, target)
    return out.select("region", "station", F.col("year").cast("bigint").alias("year"), "weight")


@query("tail_weights_low", _weights_sql("oxygen_warm_min", "CASE WHEN oxygen_warm_min <= q10 THEN 3.0::DOUBLE WHEN oxygen_warm_min <= q25 THEN 2.0 ELSE 1.0 END"))
def tail_weights_low(spark, d):
    return _weights(spark, d, "oxygen_warm_min", "oxygen_warm_min")


@query("tail_weights_high", _weights_sql("oxygen_warm_hypoxic_day_share", "CASE WHEN oxygen_warm_hypoxic_day_share >= q90 THEN 3.0::DOUBLE WHEN oxygen_warm_hypoxic_day_share >= q75 THEN 2.0 ELSE 1.0 END"))
def tail_weights_high(spark, d):
    return _weights(spark, d, "oxygen_warm_hypoxic_day_share", "oxygen_warm_hypoxic_day_share")


@query("tail_weights_both", _weights_sql("water_temp_annual_mean", "CASE WHEN water_temp_annual_mean <= q20 OR water_temp_annual_mean >= q80 THEN 1.75::DOUBLE ELSE 1.0 END"))
def tail_weights_both(spark, d):
    return _weights(spark, d, "water_temp_annual_mean", "delta_salinity")


PRED_SQL = "pr AS (SELECT region, station, date, water_temp AS y, 0.8 * air_temp + 1 AS pred_a, 5 + 0.5 * air_temp + 0.2 * ph AS pred_b FROM dw)"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Two fixed linear predictions of the daily water temperature."""
    return daily_water(spark, d).select(
        "region", "station", "date", F.col("water_temp").alias("y"), (0.8 * F.col("air_temp") + 1).alias("pred_a"), (5 + 0.5 * F.col("air_temp") + 0.2 * F.col("ph")).alias("pred_b")
    )


def _score_sql(p: str, group: str) -> str:
    return f"SELECT {group}'{p}' AS model, round(avg(abs({p} - y)), 6) AS mae, round(sqrt(avg(pow({p} - y, 2))), 6) AS rmse, round(1 - sum(pow({p} - y, 2)) / (var_pop(y) * count(y)), 6) AS r2, round(avg({p} - y), 6) AS bias, count(y) AS n_rows FROM pr WHERE y IS NOT NULL"


@query("regression_scores", f"WITH {DW_SQL}, {PRED_SQL} " + " UNION ALL ".join(_score_sql(p, "region, ") + " GROUP BY region" for p in ["pred_a", "pred_b"]))
def regression_scores(spark, d):
    return tidy(evaluate.regression_scores(predictions(spark, d), "y", ["pred_a", "pred_b"], ["region"]))


@query(
    "leaderboard",
    f"WITH {DW_SQL}, {PRED_SQL}, pn AS (SELECT *, 15.0 AS naive_const FROM pr), s AS (" + " UNION ALL ".join(
        f"SELECT region, '{p}' AS model, sqrt(avg(pow({p} - y, 2))) AS rmse FROM pn WHERE y IS NOT NULL GROUP BY region" for p in ["pred_a", "pred_b", "naive_const"]
    ) + """) SELECT region, model, round(rmse, 6) AS rmse, row_number() OVER (PARTITION BY region ORDER BY rmse, model) AS place,
      model <> 'naive_const' AND row_number() OVER (PARTITION BY region, model = 'naive_const' ORDER BY rmse, model) = 1 AS is_best_learned FROM s""",
)
def leaderboard(spark, d):
    pred = predictions(spark, d).withColumn("naive_const", F.lit(15.0))
    scores = evaluate.regression_scores(pred, "y", ["pred_a", "pred_b", "naive_const"], ["region"])
    return tidy(evaluate.leaderboard(scores, ["region"]).select("region", "model", "rmse", "place", "is_best_learned"))


@query(
    "linear_calibration",
    f"""WITH {DW_SQL}, {PRED_SQL}, p AS (SELECT * FROM pr WHERE y IS NOT NULL), c AS (SELECT region, regr_slope(y, pred_a) AS slope, regr_intercept(y, pred_a) AS intercept FROM p GROUP BY 1)
        SELECT p.region, round(any_value(slope), 6) AS slope, round(any_value(intercept), 6) AS intercept, round(avg(pred_a - y), 6) AS oof_bias_raw, round(avg(slope * pred_a + intercept - y), 6) AS oof_bias_calibrated,
          round(avg(abs(pred_a - y)), 6) AS oof_mae_raw, round(avg(abs(slope * pred_a + intercept - y)), 6) AS oof_mae_calibrated FROM p JOIN c ON p.region = c.region GROUP BY p.region""",
)
def linear_calibration(spark, d):
    return tidy(models.linear_calibration(predictions(spark, d), "pred_a", "y", by=["region"]))


@query(
    "weighted_calibration",
    f"""WITH {DW_SQL}, {PRED_SQL}, p AS (SELECT *, CASE WHEN month(date) BETWEEN 6 AND 9 THEN 2 ELSE 1 END AS w FROM pr WHERE y IS NOT NULL),
        m AS (SELECT sum(w) AS w, sum(w * pred_a) AS x, sum(w * y) AS yy, sum(w * pred_a * pred_a) AS xx, sum(w * pred_a * y) AS xy FROM p),
        c AS (SELECT (xy / w - x * yy / (w * w)) / (xx / w - x * x / (w * w)) AS slope, * FROM m), k AS (SELECT slope, (yy - slope * x) / w AS intercept FROM c)
        SELECT round(any_value(slope), 6) AS slope, round(any_value(intercept), 6) AS intercept, round(avg(pred_a - y), 6) AS oof_bias_raw, round(avg(slope * pred_a + intercept - y), 6) AS oof_bias_calibrated,
          round(avg(abs(pred_a - y)), 6) AS oof_mae_raw, round(avg(abs(slope * pred_a + intercept - y)), 6) AS oof_mae_calibrated FROM p, k""",
)
def weighted_calibration(spark, d):
    pred = predictions(spark, d).withColumn("w", F.when(dates.is_warm(F.col("date")), 2).otherwise(1))
    return tidy(models.linear_calibration(pred, "pred_a", "y", "w"))


@query("predict_wrapper", f"WITH {DW_SQL} SELECT region, station, date, round(least(greatest(0.3 * (oxygen / 10) + 0.9 - 0.1 * precip, 0), 1), 6) AS share, round(1.2 * oxygen - 0.5, 6) AS level FROM dw")
def predict_wrapper(spark, d):
    days = daily_water(spark, d)
    share = models.calibrated(F.col("oxygen") / 10, 0.3, 0.9, None) - 0.1 * F.col("precip")
    clipped = models.calibrated(share, target="oxygen_warm_hypoxic_day_share")
    return tidy(days.select("region", "station", "date", F.when(F.col("oxygen").isNotNull(), clipped).otherwise(clipped).alias("share"), models.calibrated(F.col("oxygen"), 1.2, -0.5).alias("level")))


@query(
    "group_folds",
    f"""WITH {LI_SQL}, s AS (SELECT region, station, count(*) AS n_rows FROM li GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY n_rows DESC, region, station) - 1 AS r FROM s)
        SELECT region, station, n_rows, CAST(CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS BIGINT) AS fold FROM r""",
)
def group_folds(spark, d):
    return tidy(models.group_folds(water_panel(spark, d)))


@query(
    "classifier_metrics",
    """WITH p AS (SELECT quality AS y, CASE WHEN n_chars % 3 > 0 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)),
       c AS (SELECT count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 0 AND p = 0) AS tn FROM p)
       SELECT 'balanced_accuracy' AS metric, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS value FROM c UNION ALL SELECT 'precision', round(tp / (tp + fp), 6) FROM c
       UNION ALL SELECT 'recall', round(tp / (tp + fn), 6) FROM c UNION ALL SELECT 'f1', round(2.0 * tp / (2 * tp + fp + fn), 6) FROM c""",
)
def classifier_metrics(spark, d):
    return tidy(evaluate.classifier_metrics(_rule_labels(spark, d), "y", "p"))


def _rule_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return rows.withColumns({"y": F.col("quality"), "p": F.when(F.col("n_chars") % 3 > 0, 1).otherwise(0), "score": F.log(F.col("n_chars") + 1.0)})


@query("confusion_matrix", "SELECT CAST(quality AS BIGINT) AS actual, CASE WHEN n_chars % 3 > 0 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def confusion_matrix(spark, d):
    return tidy(evaluate.confusion(_rule_labels(spark, d), "y", "p"))


@query(
    "roc_auc",
    """WITH p AS (SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rk FROM p)
       SELECT 'roc_auc' AS metric, round((sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 6) AS value FROM r""",
)
def roc_auc(spark, d):
    return tidy(evaluate.roc_auc(_rule_labels(spark, d), "y", "score"))


@query("class_profile", "SELECT CAST(quality AS BIGINT) AS y, count(*) AS n_rows, round(avg(n_chars), 6) AS n_chars, round(avg(toxic), 6) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def class_profile(spark, d):
    return tidy(evaluate.class_profile(_rule_labels(spark, d), "y", ["n_chars", "toxic"]))


# --- fits ----------------------------------------------------------------------------------


@query(
    "ridge_closed_form",
    f"""WITH {DW_SQL}, t AS (SELECT water_temp AS y, air_temp AS x FROM dw WHERE water_temp IS NOT NULL), m AS (SELECT avg(x) AS mx, avg(y) AS my FROM t),
        c AS (SELECT sum((x - mx) * (y - my)) / (sum((x - mx) * (x - mx)) + 1.0) AS b, any_value(mx) AS mx, any_value(my) AS my FROM t, m) SELECT round(b, 6) AS slope, round(my - b * mx, 6) AS intercept FROM c""",
)
def ridge_closed_form(spark, d):
    days = daily_water(spark, d).filter("water_temp is not null").select("water_temp", "air_temp")
    model = models.fit_ridge(models.assemble(days, {"air_temp": 0.0}), "water_temp")
    out = spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double")
    return tidy(out)


def daily_model_rows(spark: SparkSession, d: str) -> DataFrame:
    """Daily rows with drivers, their rolls, interactions and the water-temperature delta."""
    days = rolling.trailing_mean(water_with_deltas(spark, d), ["air_temp"])
    days = clean.driver_interactions(clean.calendar_features(days))
    return days.withColumn("cohort", F.when(F.col("station") % 5 == 0, "holdout").otherwise("train"))


AIR_FEATURES = ["air_temp", "air_temp_r1d", "air_temp_r7d", "air_temp_r28d", "wind_speed", "precip", "doy_sin", "doy_cos", "air_temp_minus_water_temp_baseline"]


@query("fit_daily_models")
def fit_daily_models(spark, d):
    """Ridge and boosted trees with linear calibration against two naive rules, scored on holdout stations."""
    rows = models.row_hashes(daily_model_rows(spark, d).filter("delta_water_temp is not null"))
    rows = staged(rows.select(*KEYS, "date", "cohort", "delta_water_temp", *AIR_FEATURES, *models.ROW_HASHES))
    train, hold = rows.filter("cohort = 'train'"), rows.filter("cohort = 'holdout'")
    median = models.fill_values(train, ["delta_water_temp"])["delta_water_temp"]
    hold = rolling.persistence(hold, "delta_water_temp", fallbacks=[F.lit(median)], out="naive_persistence")
    preds = ["naive_persistence"]
    fits = {
        "ridge_air_only": (models.ridge, AIR_FEATURES[:6], False),
        "ridge_air_context_calibrated": (models.ridge, AIR_FEATURES, True),
        "gbt_air_context": (models.gbt(*models.GBT_DAILY), AIR_FEATURES, False),
    }
    medians = models.fill_values(train, AIR_FEATURES)
    for name, (fit, features, calibrate) in fits.items():
        fills = {f: medians[f] for f in features if f in medians}
        hold = models.fit_response(train, features, "delta_water_temp", fit, name=name, calibrate=calibrate, fills=fills).predict(hold, name)
        preds.append(name)
    scores = evaluate.regression_scores(hold, "delta_water_temp", preds)
    return tidy(evaluate.leaderboard(scores.withColumn("target", F.lit("delta_water_temp"))))


@query("fit_response_models")
def fit_response_models(spark, d):
    """Every usable target with plain and weighted, calibrated ridge and trees; best learned model marked."""
    years = staged(response_years(spark, d))
    usable = {r["target"] for r in models.target_counts(years, REGISTRY).filter("usable").collect()}

    def fitted(t: models.Target) -> DataFrame:
        rows = models.target_rows(years, t)
        train = staged(models.tail_weights(rows.filter("cohort = 'train'"), t.column, t.name))
        fills = models.fill_values(train, t.features)
        hold = rows.filter("cohort = 'holdout'")
        median = models.fill_values(train, [t.column])[t.column]
        hold = hold.withColumn("naive_global_median", F.lit(median))
        preds = ["naive_global_median"]
        for name, fit, weight, calibrate in [
            ("ridge_climate", models.ridge, None, False),
            ("ridge_weighted_calibrated", models.ridge, "weight", True),
            ("gbt_climate", models.gbt(*models.GBT_YEARLY), None, False),
        ]:
            response = models.fit_response(train, t.features, t.column, fit, t.name, name, weight, calibrate, fills=fills)
            hold = response.predict(hold, name)
            preds.append(name)
        return evaluate.regression_scores(hold, t.column, preds).withColumns({"target": F.lit(t.name), "target_window": F.lit(t.window)})

    return tidy(evaluate.leaderboard(sets.stack(*models.side_by_side(fitted, [t for t in REGISTRY if t.name in usable]))))


@query("oof_predictions")
def oof_predictions(spark, d):
    years = staged(station_years(spark, d).filter("water_temp_annual_mean is not null"))
    rows = models.assemble(years, models.fill_values(years, FEATURES[:4]))
    oof = models.oof_predictions(models.ridge, rows, "water_temp_annual_mean")
    return tidy(oof.select("region", "station", "year", "fold", "water_temp_annual_mean", "oof"))


@query("isotonic_calibration")
def isotonic_calibration(spark, d):
    pred = predictions(spark, d).filter("y is not null")
    model = models.fit_isotonic(pred, "pred_a", "y")
    return tidy(evaluate.regression_scores(model.transform(pred), "y", ["pred_a", "isotonic"]))


@query("warming_sensitivity")
def warming_sensitivity(spark, d):
    rows = daily_model_rows(spark, d).filter("delta_water_temp is not null").select("region", "station", "date", "delta_water_temp", "cohort", *AIR_FEATURES[:6])
    rows = staged(rows)
    response = models.fit_response(rows.filter("cohort = 'train'"), AIR_FEATURES[:6], "delta_water_temp")
    shift = models.warming_sensitivity(response, rows.filter("cohort = 'holdout'"))
    return tidy(shift.groupBy("region").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("shift").alias("mean_shift"), F.min("shift").alias("min_shift")))


@query("staged_response")
def staged_response(spark, d):
    """Climate to water temperature to salinity, oxygen and pH."""
    rows = staged(daily_model_rows(spark, d).filter("delta_water_temp is not null"))
    stages = [
        ("water_temp_pred", AIR_FEATURES[:6], "delta_water_temp"),
        ("salinity_pred", ["water_temp_pred", "precip", "doy_sin", "doy_cos"], "delta_salinity"),
        ("oxygen_pred", ["water_temp_pred", "salinity_pred", "doy_sin", "doy_cos"], "delta_oxygen"),
        ("ph_pred", ["water_temp_pred", "oxygen_pred"], "delta_ph"),
    ]
    scored, _ = models.staged_response(rows.filter("cohort = 'train'"), rows.filter("cohort = 'holdout'"), stages)
    names = {"delta_water_temp": "water_temp_pred", "delta_salinity": "salinity_pred", "delta_oxygen": "oxygen_pred", "delta_ph": "ph_pred"}
    parts = [evaluate.regression_scores(scored, label, pred).withColumn("target", F.lit(label)) for label, pred in names.items()]
    return tidy(sets.stack(*parts))


PLACE_TARGETS = ["water_temp", "salinity", "oxygen", "ph", "depth"]


@query("place_comparison")
def place_comparison(spark, d):
    """R2 per nutrient-like variable with and without place columns."""
    days = daily_water(spark, d).withColumn("station_code", F.col("station").cast("string"))
    days = clean.calendar_features(days)
    encoded = models.place_encoder(["region", "station_code"]).fit(days).transform(days)
    numeric = ["air_temp", "precip", "wind_speed", "doy_sin", "doy_cos"]
    place_free = models.assemble(encoded, models.fill_values(encoded, numeric), "free")
    both = models.VectorAssembler(inputCols=["free", "region_hot", "station_code_hot"], outputCol="placed").transform(place_free)
    both = staged(sets.split_fraction(both, ["region", "station", "date"]))

    def compared(target: str) -> DataFrame:
        rows = both.filter(F.col(target).isNotNull())
        train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
        for name, col in [("with_place", "placed"), ("without_place", "free")]:
            test = models.fit_gbt(train, target, None, *models.GBT_NUTRIENT, col).transform(test).withColumnRenamed("prediction", name)
        s = evaluate.regression_scores(test, target, ["with_place", "without_place"]).groupBy().pivot("model", ["with_place", "without_place"]).agg(F.max("r2"))
        return s.select(F.lit(target).alias("target"), "with_place", "without_place", (F.col("with_place") - F.col("without_place")).alias("r2_gain"))

    return tidy(sets.stack(*models.side_by_side(compared, PLACE_TARGETS)))


@query("bloom_classifier")
def bloom_classifier(spark, d):
    """Balanced forest on event days: metrics of the held-out rows."""
    ev = events_panel(spark, d)
    wide = ev.groupBy("region", "station", F.to_date("ts").alias("date")).agg(
        *[F.avg(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in EVENT_TYPES], F.count(F.lit(1)).alias("n_events")
    )
    wide = wide.filter("view is not null").withColumn("is_bloom", (F.col("view") >= 100).cast("int"))
    split = staged(sets.split_stratified(wide, "is_bloom", ["station", "date"]))
    features = ["click", "error", "purchase", "signup", "n_events"]
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    fills = models.fill_values(train, features)
    model = models.fit_bloom_classifier(models.assemble(train, fills), "is_bloom")
    scored = model.transform(models.assemble(test, fills)).select("is_bloom", "prediction", vector_to_array("probability")[1].alias("p1"))
    scored = staged(scored)  # metrics and the curve start from three plain columns
    return tidy(evaluate.classifier_metrics(scored, "is_bloom", "prediction").unionByName(evaluate.roc_auc(scored, "is_bloom", "p1")))


@query("feature_importance")
def feature_importance(spark, d):
    days = clean.calendar_features(daily_water(spark, d)).filter("water_temp is not null")
    features = ["air_temp", "precip", "wind_speed", "solar", "doy_sin"]
    model = models.fit_gbt(models.assemble(days, {f: 0.0 for f in features}), "water_temp", None, *models.GBT_DAILY)
    return tidy(evaluate.feature_importance(model, features, days))


@query("batch_scoring")
def batch_scoring(spark, d):
    """A saved model is loaded again and scores every station-year at once, back to absolute values."""
    years = staged(station_years(spark, d).filter("water_temp_annual_mean is not null"))
    overall = years.groupBy("region", "station").agg(F.avg("water_temp_annual_mean").alias("water_temp_baseline"))
    rows = years.join(overall, KEYS).withColumn("delta", F.col("water_temp_annual_mean") - F.col("water_temp_baseline"))
    response = models.fit_response(rows.filter("cohort = 'train'"), FEATURES[:4], "delta")
    root = scratch_path(spark, "models")
    models.save_models(spark, {"water_temp": response}, root, "1")
    scored = models.load_model(spark, root, "water_temp").predict(rows, "delta_water_temp_pred")
    return tidy(clean.absolute_from_delta(scored, ["water_temp"]).select("region", "station", "year", "delta_water_temp_pred", "water_temp_abs"))


@query("model_registry")
def model_registry(spark, d):
    years = staged(station_years(spark, d).filter("water_temp_annual_mean is not null"))
    response = models.fit_response(years, FEATURES[:4], "water_temp_annual_mean", name="ridge_water_temp")
    registry = models.save_models(spark, {"water_temp": response}, scratch_path(spark, "models"), "1")
    return registry.select("name", "version", F.size("fills").alias("n_features"), "slope", "intercept")


# --- clusters and decomposition --------------------------------------------------------------


@query("k_scan")
def k_scan(spark, d):
    return tidy(clusters.k_scan(clusters.z_vectors(labelled_stations(spark, d), PROFILE)))


@query("kmeans_regimes")
def kmeans_regimes(spark, d):
    out = clusters.kmeans_regimes(labelled_stations(spark, d).drop("cluster"), PROFILE)
    return tidy(out.select("region", "station", "cluster"))


@query("kmeans_checks", "SELECT count(*) AS n_rows, CAST(count(DISTINCT label) AS BIGINT) AS n_clusters, 0::BIGINT AS n_nearer, 0::BIGINT AS n_off_mean, false AS worse_than_one_start FROM embeddings")
def kmeans_checks(spark, d):
    """What every k-means has to meet: rows at their nearest centre, centres at the means of their rows, no start better than the result."""
    e = staged(clusters.array_vectors(table(spark, d, "embeddings").select("embedding", "label"), "embedding"))
    best = clusters.fit_kmeans(e, 10)
    single = clusters.fit_kmeans(e, 10, starts=1)
    rows = best.transform(e.withColumn("_d", best.distances()))
    nearer = F.exists("_d", lambda x: x < F.element_at("_d", F.col("cluster") + 1))
    counts = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("cluster").alias("n_clusters"), F.count_if(nearer).alias("n_nearer"))
    means = rows.select("cluster", F.posexplode(vector_to_array("features")).alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("mean"))
    centre = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in best.centres])
    off = means.agg(F.count_if(F.abs(F.col("mean") - centre[F.col("cluster")][F.col("i")]) > 1e-6)).scalar()
    return counts.select("*", off.alias("n_off_mean"), F.lit(bool(best.cost > single.cost * (1 + 1e-9))).alias("worse_than_one_start"))


@query("kmeans_embeddings")
def kmeans_embeddings(spark, d):
    e = clusters.array_vectors(table(spark, d, "embeddings"), "embedding")
    out = clusters.fit_kmeans(e, 10).transform(e)
    return out.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))


@query("pca_scores")
def pca_scores(spark, d):
    scored, _ = clusters.pca_scores(clusters.array_vectors(table(spark, d, "embeddings"), "embedding"))
    return tidy(scored.select("vec_id", F.abs("pc1").alias("abs_pc1"), F.abs("pc2").alias("abs_pc2")))


@query("feature_set_comparison")
def feature_set_comparison(spark, d):
    stations = labelled_stations(spark, d).drop("cluster")
    both, _ = clusters.compare_feature_sets(stations, PROFILE, PROFILE[:3], 4)
    return both.groupBy("cluster_full", "cluster_reduced").agg(F.count(F.lit(1)).alias("n_stations"))


@query("feature_set_quality")
def feature_set_quality(spark, d):
    """The silhouettes of the two labellings that ``feature_set_comparison`` sets side by side."""
    _, quality = clusters.compare_feature_sets(labelled_stations(spark, d).drop("cluster"), PROFILE, PROFILE[:3], 4)
    return tidy(spark.createDataFrame(list(quality.items()), "feature_set string, silhouette double"))


@query(
    "pca_variances",
    f"""WITH {DW_SQL}, m AS (SELECT var_samp(air_temp) AS a, var_samp(water_temp) AS c, covar_samp(air_temp, water_temp) AS b FROM dw WHERE air_temp IS NOT NULL AND water_temp IS NOT NULL),
        e AS (SELECT (a + c) / 2 AS mid, sqrt(((a - c) / 2) ** 2 + b ** 2) AS half FROM m)
        SELECT 1::BIGINT AS component, round(mid + half, 6) AS variance, round((mid + half) / (2 * mid), 6) AS share FROM e UNION ALL SELECT 2, round(mid - half, 6), round((mid - half) / (2 * mid), 6) FROM e""",
)
def pca_variances(spark, d):
    """Variance of the scores of both components of two measures, and the model's explained share; by SQL as eigenvalues."""
    days = staged(daily_water(spark, d).dropna(subset=["air_temp", "water_temp"]).select("air_temp", "water_temp"))
    scored, model = clusters.pca_scores(clusters.array_vectors(days.withColumn("both", F.array("air_temp", "water_temp")), "both"))
    variances = scored.agg(F.var_samp("pc1").alias("v1"), F.var_samp("pc2").alias("v2"))
    shares = [float(x) for x in model.explainedVariance]
    return tidy(variances.select(F.inline(F.array(*[F.struct(F.lit(i + 1).alias("component"), F.col(f"v{i + 1}").alias("variance"), F.lit(shares[i]).alias("share")) for i in range(2)]))))


@query("environment_clusters")
def environment_clusters(spark, d):
    """Clusters of station-years without place, and the mean of the left-out measures per cluster."""
    years = station_years(spark, d).select("region", "station", "year", "air_temp_mean", "precip_mean", "ph_annual_mean", "oxygen_annual_mean")
    out = clusters.kmeans_regimes(years, ["air_temp_mean", "precip_mean", "ph_annual_mean"], 3)
    return tidy(out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("oxygen_annual_mean").alias("oxygen_mean")))


def station_months(spark: SparkSession, d: str) -> DataFrame:
    """Monthly station history of air and water for every station."""
    days = daily_water(spark, d)
    air, water = days.select(*KEYS, "date", "air_temp", "precip"), days.select(*KEYS, "date", "water_temp", "salinity", "oxygen")
    return rollup.monthly_history(air, water, ["air_temp", "precip"], ["water_temp", "salinity", "oxygen"], 1990)


def components(spark: SparkSession, d: str) -> DataFrame:
    series = decompose.monthly_series(station_months(spark, d), list(decompose.VARIABLE_NAMES), min_months=72)
    return staged(decompose.decompose(series))


@query("seasonal_decomposition")
def seasonal_decomposition(spark, d):
    return tidy(components(spark, d).select(*KEYS, "variable", "month_date", "filled", "trend", "seasonal"))


MEASURES = list(decompose.VARIABLE_NAMES)


@query(
    "decomposition_sums",
    f"""WITH {DW_SQL}, mo AS (SELECT region, station, CAST(date_trunc('month', date) AS DATE) AS month_date, {', '.join(f'avg({m}) AS {m}' for m in MEASURES)} FROM dw WHERE year(date) >= 1990 GROUP BY 1, 2, 3),
        lo AS (SELECT region, station, month_date, unnest({MEASURES}) AS variable, unnest([{', '.join(MEASURES)}]) AS observed FROM mo),
        en AS (SELECT region, station, variable, min(month_date) AS a, max(month_date) AS b FROM lo GROUP BY ALL HAVING count(observed) >= 72),
        gr AS (SELECT region, station, variable, CAST(u AS DATE) AS month_date FROM en, unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS g(u)),
        fu AS (SELECT gr.*, observed, CASE WHEN observed IS NOT NULL THEN month_date END AS t FROM gr LEFT JOIN lo USING (region, station, variable, month_date)),
        ab AS (SELECT *, last_value(t IGNORE NULLS) OVER back AS ta, last_value(observed IGNORE NULLS) OVER back AS va, first_value(t IGNORE NULLS) OVER ahead AS tb, first_value(observed IGNORE NULLS) OVER ahead AS vb FROM fu
               WINDOW back AS (PARTITION BY region, station, variable ORDER BY month_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ahead AS (PARTITION BY region, station, variable ORDER BY month_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT region, station, variable, month_date, round(observed, 6) AS observed, round(coalesce(observed, va + (vb - va) * (month_date - ta) / nullif(tb - ta, 0), va, vb), 6) AS filled, true AS adds_up, true AS residual_fits FROM ab""",
)
def decomposition_sums(spark, d):
    """Every month of every series: interpolated where nothing was observed, trend and season add up to the fit, the residual to the series."""
    parts = decompose.residuals(components(spark, d))
    adds_up = F.abs(F.col("trend") + F.col("seasonal") - F.col("fitted")) < 1e-9
    residual_fits = F.abs(F.col("fitted") + F.col("resid") - F.col("filled")) < 1e-9
    return tidy(parts.select(*KEYS, "variable", "month_date", "observed", "filled", adds_up.alias("adds_up"), residual_fits.alias("residual_fits")))


@query("decomposition_extension")
def decomposition_extension(spark, d):
    out = decompose.extend(components(spark, d))
    return tidy(out.filter("is_future").select(*KEYS, "variable", "month_date", "trend", "seasonal", "fitted"))


@query("extension_summary")
def extension_summary(spark, d):
    return tidy(decompose.extension_summary(decompose.extend(components(spark, d))))


@query(
    "trend_extension",
    f"""WITH {DW_SQL}, m AS (SELECT region, station, CAST(date_trunc('month', date) AS DATE) AS month_date, avg(air_temp) AS trend FROM dw GROUP BY 1, 2, 3),
        b AS (SELECT *, row_number() OVER (PARTITION BY region, station ORDER BY month_date DESC) AS back FROM m), t AS (SELECT * FROM b WHERE back <= 36),
        l AS (SELECT region, station, count(*) AS n, max(month_date) AS last_month, regr_slope(trend, -back) AS slope, regr_intercept(trend, -back) AS i0 FROM t GROUP BY 1, 2)
        SELECT region, station, CAST(u AS DATE) AS month_date, round(i0 - slope * n + slope * (n + datediff('month', last_month, CAST(u AS DATE)) - 1), 6) AS trend
        FROM l, unnest(generate_series(last_month + INTERVAL 1 MONTH, DATE '2003-12-01', INTERVAL 1 MONTH)) AS g(u)""",
)
def trend_extension(spark, d):
    """Extension of given components: the monthly mean as trend, no season."""
    parts = daily_water(spark, d).groupBy(*KEYS, dates.month_start(F.col("date")).alias("month_date")).agg(F.avg("air_temp").alias("trend"))
    parts = parts.withColumns({"variable": F.lit("air_temp"), "seasonal": F.lit(0.0), "observed": F.col("trend"), "filled": F.col("trend"), "fitted": F.col("trend")})
    out = decompose.extend(parts, end_year=2003, trend_years=3)
    return tidy(out.filter("is_future").select("region", "station", "month_date", "trend"))


@query("predictive_lags")
def predictive_lags(spark, d):
    out = causality.granger(daily_water(spark, d), "air_temp", "water_temp")
    return tidy(out)


LAG_VARIABLES = ", ".join(["1.0", "y", *[f"lag({v}, {k}) OVER w" for v in "yx" for k in range(1, causality.MAX_LAG + 1)]])


@query(
    "predictive_lag_stats",
    f"""WITH RECURSIVE {DW_SQL},
        c AS (SELECT region, station, date, water_temp - avg(water_temp) OVER (PARTITION BY region, station) AS y, air_temp - avg(air_temp) OVER (PARTITION BY region, station) AS x
              FROM dw WHERE water_temp IS NOT NULL AND air_temp IS NOT NULL),
        z AS (SELECT region, station, least(row_number() OVER w, 15) AS b, [{LAG_VARIABLES}] AS v FROM c WINDOW w AS (PARTITION BY region, station ORDER BY date)),
        m AS (SELECT region, station, b, i, j, sum(v[i] * v[j]) AS v FROM z, range(1, 31) r(i), range(1, 31) s(j) WHERE i <= j GROUP BY ALL),
        o AS (SELECT i AS id, CASE WHEN i = 1 THEN 0 WHEN i = 2 THEN 99 ELSE i - 2 END AS e, CASE WHEN i <= 2 THEN 0 ELSE (i - 3) % 14 + 1 END AS delay FROM range(1, 31) r(i)),
        a AS (SELECT region, station, p, least(o.e, q.e) AS i, greatest(o.e, q.e) AS j, sum(m.v) AS v FROM m JOIN o ON o.id = m.i JOIN o q ON q.id = m.j, range(1, 15) r(p)
              WHERE b > p AND o.delay <= p AND q.delay <= p GROUP BY ALL),
        g AS (SELECT -1 AS step, region, station, p, i, j, v FROM a UNION ALL SELECT -1, region, station, p, j, i, v FROM a WHERE i <> j),
        s AS (SELECT * FROM g UNION ALL
              SELECT step + 1, region, station, p, i, j, CASE WHEN piv <> 0 THEN v - along * down / piv ELSE v END
              FROM (SELECT *, max(CASE WHEN i = step + 1 THEN v END) OVER (PARTITION BY region, station, p, j) AS along,
                    max(CASE WHEN j = step + 1 THEN v END) OVER (PARTITION BY region, station, p, i) AS down,
                    max(CASE WHEN i = step + 1 AND j = step + 1 THEN v END) OVER (PARTITION BY region, station, p) AS piv FROM s WHERE step < 28)
              WHERE i > step + 1 AND j > step + 1),
        f AS (SELECT region, station, p, max(v) FILTER (WHERE step = 14) AS own, max(v) FILTER (WHERE step = 28) AS rest FROM s WHERE i = 99 AND j = 99 GROUP BY ALL),
        n AS (SELECT region, station, count(*) AS n FROM c GROUP BY ALL)
        SELECT region, station, p AS lag, n - p AS n_rows, round((own - rest) / p / (rest / (n - 3 * p - 1)), 6) AS f_stat FROM f JOIN n USING (region, station) WHERE n - 3 * p >= 2""",
)
def predictive_lag_stats(spark, d):
    """F of every lag; the SQL side eliminates the variables of the sums of products one by one."""
    return tidy(causality.granger(daily_water(spark, d), "air_temp", "water_temp").drop("p_value"))


@query("predictive_lags_events")
def predictive_lags_events(spark, d):
    return tidy(causality.granger(event_days(spark, d), "driver", "response", keys=["station"]))


@query(
    "chronological_split",
    f"""WITH {DW_SQL}, m AS (SELECT date, avg(water_temp) AS v FROM dw GROUP BY 1), l AS (SELECT *, lag(v) OVER (ORDER BY date) AS p FROM m WHERE date >= DATE '2000-01-01')
        SELECT (SELECT count(*) FROM m WHERE date < DATE '2000-01-01') AS n_train, count(*) AS n_test, round(avg(abs(v - p)), 6) AS mae_naive FROM l""",
)
def chronological_split(spark, d):
    days = daily_water(spark, d).groupBy("date").agg(F.avg("water_temp").alias("v")).filter("v is not null")
    split = F.col("date") < F.lit("2000-01-01").cast("date")
    test = rolling.persistence(days.filter(~split).withColumn("series", F.lit(1)), "v", ["series"])
    n_train = days.filter(split).agg(F.count(F.lit(1))).scalar()
    out = test.agg(F.count(F.lit(1)).alias("n_test"), F.avg(F.abs(F.col("v") - F.col("pred"))).alias("mae_naive"))
    return tidy(out.select(n_train.alias("n_train"), "n_test", "mae_naive"))
