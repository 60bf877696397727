"""Response models: fills, fits, folds, calibration and staged prediction with MLlib."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel import KEYS
from tidepanel.functions.stats import one_row
from tidepanel.operators import boosting
from tidepanel.operators.ordered import global_rank, quantile_columns
from tidepanel.session import ROWS_A_TASK, scratch_path, staged

# Ridge penalty, learning rate, and rounds x depth of the boosted trees.
RIDGE_ALPHA, LEARNING_RATE = 1.0, 0.05
GBT_DAILY, GBT_YEARLY, GBT_NUTRIENT = (250, 6, 1), (300, 4, 20), (300, 8, 1)
# Trees, depth and leaf size of the bloom classifier.
FOREST = (400, 12, 10)
# Rows beyond which boosting may end early, and the part of rows that decides it.
STOP_EARLY_ROWS, VALIDATION_PART = 10_000, 10
TASKS_A_CORE = 3
BINS, FOLDS = 64, 5
# Targets that are shares of days, and targets whose low tail weighs more.
SHARE_TARGETS = ("oxygen_warm_hypoxic_day_share", "oxygen_warm_below_optimal_day_share")
LOW_TAIL_TARGETS = ("delta_oxygen", "oxygen_warm_min", "oxygen_warm_p10")

Fit = Callable[[DataFrame, str, str | None], Model]


# --- features ----------------------------------------------------------------------------


def fill_values(df: DataFrame, features: Sequence[str], empty: float | None = None) -> dict[str, float]:
    """Exact median of every feature; a feature with no value at all is left out (or gets ``empty``)."""
    row = quantile_columns(df, [], {f: (f, 0.5) for f in features}).first()
    found = {f: row[f] for f in features if row is not None and row[f] is not None}
    if empty is not None:
        found.update({f: empty for f in features if f not in found})
    return found


def assemble(df: DataFrame, fills: Mapping[str, float], out: str = "features") -> DataFrame:
    """Feature vector with nulls filled; an absent feature is its fill value."""
    cols = {
        f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(float(v))) if c in df.columns else F.lit(float(v))
        for c, v in fills.items()
    }
    ready = VectorAssembler(inputCols=list(cols), outputCol=out).transform(df.withColumns(cols))
    return ready.drop(*cols)


def place_encoder(columns: Sequence[str] = KEYS) -> Pipeline:
    """One-hot place columns with the first level in alphabetical order dropped; its rows are all zeros.

    Levels are indexed backwards, so the first one is the last index, which ``dropLast`` leaves out.
    """
    indexed = [f"{c}_idx" for c in columns]
    return Pipeline(
        stages=[
            StringIndexer(inputCols=list(columns), outputCols=indexed, stringOrderType="alphabetDesc", handleInvalid="error"),
            OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_hot" for c in columns], dropLast=True),
        ]
    )


# --- fits ----------------------------------------------------------------------------------


def fit_ridge(df: DataFrame, label: str, weight: str | None = None, alpha: float = RIDGE_ALPHA, features: str = "features") -> Model:
    """Least squares with penalty alpha on the coefficients and a free intercept.

    MLlib divides the loss by the weight sum and scales the label by its spread, so its
    penalty is alpha x population spread / weight sum.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    y = F.col(label)
    m = df.agg(F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.sum(w * y * y).alias("wyy")).first()
    mean = m["wy"] / m["w"]
    spread = max(m["wyy"] / m["w"] - mean * mean, 0.0) ** 0.5
    lr = LinearRegression(
        featuresCol=features, labelCol=label, solver="normal", standardization=False, elasticNetParam=0.0,
        regParam=alpha * spread / m["w"],
    )
    return (lr.setWeightCol(weight) if weight else lr).fit(df)


def fit_gbt(
    df: DataFrame, label: str, weight: str | None = None, rounds: int = GBT_DAILY[0], depth: int = GBT_DAILY[1], leaf: int = GBT_DAILY[2], features: str = "features",
    stop_early: bool | None = None,
) -> Model:
    """Boosted trees. With ``stop_early`` (by default beyond ``STOP_EARLY_ROWS`` rows, as the source's estimator does) a
    tenth of the rows, chosen by a hash, isn't fitted on, and boosting ends once ten rounds in a row haven't lowered its error.
    """
    value, spark = F.col("v"), df.sparkSession
    # only what trees read is kept
    rows = row_hashes(df).select(
        F.unwrap_udt(features).alias("v"), F.col(label).cast("double").alias("y"), (F.col(weight) if weight else F.lit(None)).cast("double").alias("w"), *ROW_HASHES
    ).persist()
    try:
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("n_labels"), F.max(F.coalesce(value["size"], F.size(value["values"]))).alias("width")).first()
        if not seen["n"] or seen["n_labels"] < seen["n"]:
            raise ValueError("no rows to fit trees on" if not seen["n"] else f"{label} is missing in some rows")
        early = seen["n"] > STOP_EARLY_ROWS if stop_early is None else stop_early
        held = F.pmod(F.col("_validation_hash"), F.lit(VALIDATION_PART)) == 0 if early else F.lit(False)
        params = {
            "featuresCol": features, "labelCol": label, "maxIter": rounds, "maxDepth": depth, "minInstancesPerNode": leaf, "stepSize": LEARNING_RATE, "maxBins": BINS, "seed": 42,
            **({"weightCol": weight} if weight else {}),
        }
        path, uid = scratch_path(spark, "boosted"), f"GBTRegressor_{uuid.uuid4().hex[:12]}"
        cells = rows.agg(F.sum(1 + F.size(value["values"]))).first()[0]
        if cells <= boosting.HELD:
            return boosting.fit(rows.withColumn("held", held), seen["n"], seen["width"], path, uid, params, early)
        estimator = GBTRegressor(maxMemoryInMB=512, **params)
        marked = dealt(row_hashes(df).select(features, label, *([weight] if weight else []), *ROW_HASHES), seen["n"]).withColumn("_held", held)
        model = estimator.fit(marked.filter("not _held"))
        return boosting.cut(model, marked.filter("_held"), path, uid, params, seen["width"]) if early else model
    finally:
        rows.unpersist()


ROW_HASHES = ["_deal_hash", "_validation_hash"]


def row_hashes(df: DataFrame) -> DataFrame:
    """Hashes of a row's values that deal it and choose validation rows; made first, they let a row travel with few columns."""
    if set(ROW_HASHES) <= set(df.columns):
        return df
    plain = plain_columns(df)
    return df.withColumns({"_deal_hash": F.xxhash64(*plain), "_validation_hash": F.xxhash64(F.lit("validation"), *plain)})


def plain_columns(df: DataFrame) -> list[str]:
    """Columns that a hash can read; vectors aren't among them."""
    return [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "long", "integer", "short", "double", "float", "boolean", "date", "timestamp", "timestamp_ntz")]


def dealt(df: DataFrame, n: int, rows: int = 10_000) -> DataFrame:
    """The rows dealt by a hash of their values into as few partitions as ``rows`` each allow, or of many rows into some per core.

    Every level of every tree is a job over all partitions, whose results reach the driver task by task, and a tree's sample
    of rows follows them; by their hash, rows fall into the same ones wherever they come from.
    """
    some = max(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_A_TASK))
    parts = max(1, min(-(-n // rows), some))
    deal = F.pmod(F.col("_deal_hash") if "_deal_hash" in df.columns else F.xxhash64(*plain_columns(df)), F.lit(1 << 30))
    return df.repartitionByRange(parts, deal).sortWithinPartitions(deal) if parts > 1 else df.coalesce(1).sortWithinPartitions(deal)


def gbt(rounds: int, depth: int, leaf: int = 1) -> Fit:
    return lambda df, label, weight=None: fit_gbt(df, label, weight, rounds, depth, leaf)


def ridge(df: DataFrame, label: str, weight: str | None = None) -> Model:
    return fit_ridge(df, label, weight)


def fit_bloom_classifier(df: DataFrame, label: str, trees: int = FOREST[0], depth: int = FOREST[1], leaf: int = FOREST[2], features: str = "features") -> Model:
    """Random forest whose classes weigh the same in total.

    The fitted forest is written to the shared folder and read back: a fresh fit carries a summary with its session, which
    tasks that score with it would have to be sent.
    """
    n = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("p")).first()
    heavy, light = n["n"] / (2.0 * max(n["p"], 1.0)), n["n"] / (2.0 * max(n["n"] - n["p"], 1.0))
    weighted = df.withColumn("_w", F.when(F.col(label) == 1, heavy).otherwise(light))
    forest = RandomForestClassifier(
        featuresCol=features, labelCol=label, weightCol="_w", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=42, cacheNodeIds=True
    )
    path = scratch_path(df.sparkSession, "forest")
    forest.fit(dealt(weighted, n["n"])).write().save(path)
    return RandomForestClassificationModel.load(path)


def side_by_side(fit: Callable[..., DataFrame], items: Sequence, at_once: int = 8) -> list[DataFrame]:
    """``fit`` of every item, some at a time: the many short jobs of boosting leave a cluster idle one by one.

    Whoever leaves early (an error in one fit, an interrupt) cancels the jobs of the others.
    """
    spark = SparkSession.active()
    tag = f"side-by-side-{uuid.uuid4().hex}"

    def tagged(item: object) -> DataFrame:
        spark.addTag(tag)
        try:
            return fit(item)
        finally:
            spark.removeTag(tag)

    pool = ThreadPoolExecutor(at_once)
    try:
        found = list(pool.map(inheritable_thread_target(spark)(tagged), items))
    except BaseException:
        pool.shutdown(wait=False, cancel_futures=True)
        spark.interruptTag(tag)
        raise
    pool.shutdown()
    return found


# --- folds and calibration --------------------------------------------------------------------


def group_folds(df: DataFrame, group: Sequence[str] = KEYS, n: int = FOLDS) -> DataFrame:
    """Fold of every group: groups by size, dealt out forwards and backwards in turn."""
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"))
    ranked = global_rank(sizes, [F.desc("n_rows"), *group], "_r")
    lap, seat = F.floor((F.col("_r") - 1) / n), (F.col("_r") - 1) % n
    return ranked.withColumn("fold", F.when(lap % 2 == 0, seat).otherwise(n - 1 - seat).cast("int")).drop("_r")


def oof_predictions(fit: Fit, df: DataFrame, label: str, group: Sequence[str] = KEYS, weight: str | None = None, n: int = FOLDS, out: str = "oof") -> DataFrame:
    """Prediction of every row by a model that has not seen its group; one group predicts in-sample."""
    folds = group_folds(df, group, n)
    used = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    if len(used) < 2:
        return _predict(fit(df, label, weight), df, out)
    marked = staged(df.join(folds.select(*group, "fold"), list(group)))
    parts = [
        _predict(fit(marked.filter(F.col("fold") != f), label, weight), marked.filter(F.col("fold") == f), out) for f in used
    ]
    return reduce(DataFrame.unionByName, parts)


def _predict(model: Model, df: DataFrame, out: str) -> DataFrame:
    return model.transform(df).withColumnRenamed("prediction", out)


def linear_calibration(df: DataFrame, pred: str, label: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Slope and intercept of the label on the prediction, with bias and error before and after."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    x, y = F.col(pred), F.col(label)
    rows = df.filter(x.isNotNull() & y.isNotNull())
    sums = [
        F.sum(w).alias("_w"), F.sum(w * x).alias("_x"), F.sum(w * y).alias("_y"), F.sum(w * x * x).alias("_xx"), F.sum(w * x * y).alias("_xy"),
    ]
    c = F.col
    slope = (c("_xy") / c("_w") - c("_x") * c("_y") / (c("_w") * c("_w"))) / F.nullif(
        c("_xx") / c("_w") - c("_x") * c("_x") / (c("_w") * c("_w")), F.lit(0.0)
    )
    fit = (rows.groupBy(*by).agg(*sums) if by else rows.agg(*sums)).withColumn("slope", F.coalesce(slope, F.lit(0.0)))
    fit = fit.withColumn("intercept", (c("_y") - c("slope") * c("_x")) / c("_w")).select(*by, "slope", "intercept")
    if by:
        joined = rows.join(fit, list(by))
    else:
        row = one_row(fit)
        joined = rows.withColumns({"slope": row["slope"], "intercept": row["intercept"]})
    joined = joined.withColumn("_after", c("slope") * x + c("intercept"))
    checks = [
        F.max("slope").alias("slope"), F.max("intercept").alias("intercept"),
        F.avg(x - y).alias("oof_bias_raw"), F.avg(c("_after") - y).alias("oof_bias_calibrated"),
        F.avg(F.abs(x - y)).alias("oof_mae_raw"), F.avg(F.abs(c("_after") - y)).alias("oof_mae_calibrated"),
    ]
    return joined.groupBy(*by).agg(*checks) if by else joined.agg(*checks)


def fit_isotonic(df: DataFrame, pred: str, label: str) -> Model:
    """Monotone map from prediction to label; it clips outside the range it has seen."""
    return IsotonicRegression(featuresCol=pred, labelCol=label, predictionCol="isotonic").fit(df)


def calibrated(pred: Column, slope: float = 1.0, intercept: float = 0.0, target: str | None = None) -> Column:
    """Calibrated prediction; a share stays inside [0, 1]."""
    out = pred * slope + intercept
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0)) if target in SHARE_TARGETS else out


def tail_weights(df: DataFrame, label: str, target: str, out: str = "weight") -> DataFrame:
    """Heavier rows in the tail that matters for the target; under eight rows all weigh 1."""
    low, high = target in LOW_TAIL_TARGETS, target in SHARE_TARGETS
    probs = {"a": 0.25, "b": 0.10} if low else {"a": 0.75, "b": 0.90} if high else {"a": 0.20, "b": 0.80}
    cuts = quantile_columns(df, [], {k: (label, p) for k, p in probs.items()})
    cuts = cuts.select(F.struct("a", "b")).scalar()
    enough = df.agg(F.count(label)).scalar() >= 8
    y = F.col(label)
    if low:
        w = F.when(y <= cuts["b"], 3.0).when(y <= cuts["a"], 2.0)
    elif high:
        w = F.when(y >= cuts["b"], 3.0).when(y >= cuts["a"], 2.0)
    else:
        w = F.when((y <= cuts["a"]) | (y >= cuts["b"]), 1.75)
    return df.withColumn(out, F.when(enough, F.coalesce(w, F.lit(1.0))).otherwise(1.0))


# --- targets and staged models ------------------------------------------------------------------


@dataclass(frozen=True)
class Target:
    """A response: its column, features, the flag its rows need and the label of its window."""

    name: str
    column: str
    features: tuple[str, ...]
    flag: str = "has_model_year"
    window: str = "annual mean"


# Label of the window each target is measured over.
TARGET_WINDOWS = {
    "delta_salinity": "annual mean",
    "delta_oxygen": "warm-season mean",
    "oxygen_warm_min": "warm-season minimum",
    "oxygen_warm_p10": "warm-season 10th percentile",
    "oxygen_warm_hypoxic_day_share": "warm-season share < 2 mg/L",
    "oxygen_warm_below_optimal_day_share": "warm-season share < 5 mg/L",
    "delta_ph": "annual mean",
}


def target_registry(spark: SparkSession, targets: Sequence[Target]) -> DataFrame:
    return spark.createDataFrame(
        [(t.name, t.column, list(t.features), t.flag, t.window) for t in targets],
        "target string, target_col string, features array<string>, coverage_flag string, target_window string",
    )


def target_rows(df: DataFrame, target: Target) -> DataFrame:
    """Rows a target can use: its flag is set and its label present."""
    return df.filter(F.coalesce(F.col(target.flag), F.lit(False)) & F.col(target.column).isNotNull())


def target_counts(df: DataFrame, targets: Sequence[Target], cohort: str = "cohort") -> DataFrame:
    """Train and holdout rows of every target in one pass; a target without either is not usable."""
    cells = []
    for t in targets:
        ok = F.coalesce(F.col(t.flag), F.lit(False)) & F.col(t.column).isNotNull()
        cells.append(
            F.struct(
                F.lit(t.name).alias("target"),
                F.count_if(ok & (F.col(cohort) == "train")).alias("n_train"),
                F.count_if(ok & (F.col(cohort) == "holdout")).alias("n_holdout"),
            )
        )
    out = df.agg(F.array(*cells).alias("_t")).select(F.explode("_t").alias("_t")).select("_t.*")
    return out.withColumn("usable", (F.col("n_train") > 0) & (F.col("n_holdout") > 0))


def linear_value(model: LinearRegressionModel, df: DataFrame, fills: Mapping[str, float]) -> Column:
    """A linear model as a column expression, so that no vector is built per row; a NaN is an error, as it is to ``assemble``."""
    cells = [F.coalesce(F.col(c).cast("double"), F.lit(float(v))) if c in df.columns else F.lit(float(v)) for c, v in fills.items()]
    value = reduce(Column.__add__, [x * float(b) for x, b in zip(cells, model.coefficients, strict=True)], F.lit(0.0)) + float(model.intercept)
    odd = reduce(Column.__or__, [F.isnan(x) for x in cells], F.lit(False))
    return F.when(F.isnan(value) & odd, F.raise_error(F.lit("a feature is NaN")).cast("double")).otherwise(value)


@dataclass
class FittedResponse:
    """A fitted model with what is needed to score new rows."""

    model: Model
    fills: dict[str, float]
    target: str | None = None
    slope: float = 1.0
    intercept: float = 0.0
    name: str = "model"
    extra: dict = field(default_factory=dict)

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        if isinstance(self.model, LinearRegressionModel):
            value = calibrated(linear_value(self.model, df, self.fills), self.slope, self.intercept, self.target)
            return df.drop("features", "prediction").withColumn(out, value)
        scored = self.model.transform(assemble(df, self.fills, "features"))
        value = calibrated(F.col("prediction"), self.slope, self.intercept, self.target)
        return scored.withColumn(out, value).drop("features", "prediction")


def fit_response(df: DataFrame, features: Sequence[str], label: str, fit: Fit = ridge, target: str | None = None, name: str = "ridge", weight: str | None = None, calibrate: bool = False, group: Sequence[str] = KEYS, fills: Mapping[str, float] | None = None) -> FittedResponse:
    """Fill, fit and, if asked, calibrate on out-of-fold predictions.

    ``df`` is read several times, so it should be a table or staged. ``fills`` saves the
    medians when they are known from an earlier fit on the same rows.
    """
    fills = dict(fills) if fills is not None else fill_values(df, features)
    # least squares reads its vectors once and no hash, so only other fits and calibration keep them
    once = fit is ridge and not calibrate
    ready = assemble(df.filter(F.col(label).isNotNull()), fills)
    ready = ready if once else row_hashes(ready)
    narrow = [label, *([weight] if weight else []), *[k for k in group if k in df.columns], "features", *([] if once else ROW_HASHES)]
    ready = ready.select(*dict.fromkeys(narrow))
    ready = ready if once else ready.persist()
    out = FittedResponse(fit(ready, label, weight), fills, target, name=name)
    if calibrate:
        oof = oof_predictions(fit, ready, label, group, weight)
        row = linear_calibration(oof, "oof", label, weight).first()
        out.slope, out.intercept = float(row["slope"]), float(row["intercept"])
    if not once:
        ready.unpersist()
    return out


def staged_response(train: DataFrame, rows: DataFrame, stages: Sequence[tuple[str, Sequence[str], str]], fit: Fit = ridge) -> tuple[DataFrame, list[FittedResponse]]:
    """Chain of models: the prediction of each stage is a feature of the later ones.

    A stage is (output column, features, label). Both tables carry the predictions along.
    """
    fitted = []
    for out, features, label in stages:
        response = fit_response(train, features, label, fit, name=out)
        train, rows = response.predict(train, out), response.predict(rows, out)
        fitted.append(response)
    return rows, fitted


def warming_sensitivity(response: FittedResponse, df: DataFrame, added: float = 2.0, prefix: str = "air_temp") -> DataFrame:
    """Change of the prediction of every row when its air-temperature features are warmer.

    Both predictions are made on the same row, so nothing is joined.
    """
    used = [c for c in response.fills if c in df.columns]
    keys = [c for c in df.columns if c not in used]
    base = response.predict(df, "base_pred")
    warmer = base.withColumns({c: F.col(c) + added for c in used if c.startswith(prefix)})
    out = response.predict(warmer, "warm_pred")
    return out.select(*keys, "base_pred", "warm_pred", (F.col("warm_pred") - F.col("base_pred")).alias("shift"))


# --- persistence ----------------------------------------------------------------------------------


def save_models(spark: SparkSession, responses: Mapping[str, FittedResponse], root: str, version: str) -> DataFrame:
    """Write every fitted model and a registry table with its features, fills and stamp."""
    stamp = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows = []
    for name, r in responses.items():
        path = f"{root}/models/{name}"
        PipelineModel(stages=[r.model]).write().overwrite().save(path)
        rows.append((name, version, stamp, path, r.target, r.slope, r.intercept, {k: float(v) for k, v in r.fills.items()}))
    schema = "name string, version string, saved_at timestamp_ntz, path string, target string, slope double, intercept double, fills map<string,double>"
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{root}/registry")
    return spark.read.parquet(f"{root}/registry")


def load_model(spark: SparkSession, root: str, name: str) -> FittedResponse:
    row = spark.read.parquet(f"{root}/registry").filter(F.col("name") == name).first()
    if row is None:
        raise ValueError(f"no model named {name} below {root}")
    model = PipelineModel.load(row["path"]).stages[0]
    return FittedResponse(model, dict(row["fills"]), row["target"], row["slope"], row["intercept"], name)
