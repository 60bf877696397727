"""Regime clusters of stations and the transitions away from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel import KEYS
from tidepanel.functions import stats
from tidepanel.operators.rolling import run_length

# A month is classified from 70 % coverage and 3 features; a flip holds for
# 6 months with a margin above 0.10; a month counts 30.4375 days.
COVERAGE, MIN_FEATURES, MIN_RUN, MIN_MARGIN, DAYS_PER_MONTH = 0.70, 3, 6, 0.10, 30.4375
# Fixed values: |z| from which a cluster gets a low or high tag, and the tags per measure.
TAG_LIMIT = 0.35
TAGS = {
    "mean_annual_water_temp": ("Cool", "Temp", "Warm"),
    "mean_annual_salinity": ("Fresh", "Brackish", "Saline"),
    "mean_annual_oxygen": ("Low O2", "Mid O2", "High O2"),
    "seasonal_amp_water_temp": ("Stable", "Mixed", "Seasonal"),
    "mean_annual_depth": ("Shallow", "Mid", "Deep"),
}


def scaling(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: mean and population spread of every feature."""
    return df.agg(
        *[F.avg(c).alias(f"{c}_mu") for c in features], *[F.stddev_pop(c).alias(f"{c}_sd") for c in features]
    )


def standardise(df: DataFrame, features: Sequence[str], scale: DataFrame | None = None, suffix: str = "_z") -> DataFrame:
    """z-scores with the population spread; a spread of zero gives null."""
    row = stats.literal_row(scaling(df, features) if scale is None else scale)
    return df.withColumns(
        {f"{c}{suffix}": (F.col(c) - row[f"{c}_mu"]) / F.nullif(row[f"{c}_sd"], F.lit(0.0)) for c in features}
    )


def centroids(df: DataFrame, features: Sequence[str], cluster: str = "cluster") -> tuple[DataFrame, DataFrame]:
    """Mean z-score of every labelled cluster, and the scaling it is in (complete rows only)."""
    ref = df.select(cluster, *features).dropna()
    scale = scaling(ref, features)
    z = standardise(ref, features, scale)
    return z.groupBy(cluster).agg(*[F.avg(f"{c}_z").alias(c) for c in features]), scale


def nearest_centroid(
    df: DataFrame,
    features: Sequence[str],
    centers: DataFrame,
    scale: DataFrame,
    coverage: str | None = None,
    cluster: str = "cluster",
    out: str = "implied_cluster",
    min_coverage: float = COVERAGE,
    min_features: int = MIN_FEATURES,
) -> DataFrame:
    """Nearest cluster centre over the features a row has, with distances, margin and state.

    The centres (one per cluster) enter as one array value, so rows are classified where
    they are: no join and no shuffle. Ties go to the smallest cluster.
    """
    table = centers.filter(F.col(cluster).isNotNull()).agg(
        F.sort_array(F.collect_list(F.struct(F.col(cluster), *[F.col(c) for c in features])))
    ).scalar()
    row = stats.literal_row(scale)
    rows = df.withColumns(
        {f"_z_{c}": (F.col(c) - row[f"{c}_mu"]) / F.nullif(row[f"{c}_sd"], F.lit(0.0)) for c in features}
    ).withColumn("_centers", table)
    n_used = stats.total([F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in features])
    bad_scale = F.lit(False)
    for c in features:
        bad_scale = bad_scale | (F.col(c).isNotNull() & F.col(f"_z_{c}").isNull())

    def distance(center: Column) -> Column:
        parts = [F.coalesce(F.pow(center[c] - F.col(f"_z_{c}"), 2), F.lit(0.0)) for c in features]
        return F.struct(F.sqrt(stats.total(parts)).alias("d"), center[cluster].alias("c"))

    thin = F.lit(False) if coverage is None else F.coalesce(F.col(coverage) < min_coverage, F.lit(True))
    state = (
        F.when(thin, "insufficient_coverage")
        .when(F.col("_n") < min_features, "insufficient_features")
        .when(bad_scale, "scaling_issue")
        .when(F.col("_n") == len(features), "classified_full")
        .otherwise("classified_partial")
    )
    rows = rows.withColumn("_n", n_used).withColumn("assignment_state", state)
    ok = F.col("assignment_state").startswith("classified")
    rows = rows.withColumn("_near", F.when(ok, F.slice(F.array_sort(F.transform("_centers", distance)), 1, 2)))
    best, second = F.get("_near", F.lit(0)), F.get("_near", F.lit(1))
    return rows.withColumns(
        {
            out: best["c"],
            "dist_best": best["d"],
            "dist_second": second["d"],
            "margin": second["d"] - best["d"],
            "n_features_used": F.when(F.col("assignment_state") == "insufficient_coverage", 0).otherwise(F.col("_n")),
        }
    ).drop("_near", "_n", "_centers", *[f"_z_{c}" for c in features])


def confirm_flips(monthly: DataFrame, order: str = "month", base: str = "cluster", now: str = "implied_cluster", keys: Sequence[str] = KEYS) -> DataFrame:
    """Months whose cluster differs from the baseline, in a run long and clear enough.

    The run length is that of the whole run, so its first month already counts as confirmed.
    """
    runs = run_length(monthly, now, keys, order, "_run", "run_len_months").drop("_run")
    differs = F.coalesce(F.col(now) != F.col(base), F.lit(False))
    return runs.withColumn("candidate_flip", differs).withColumn(
        "flip_confirmed_monthly",
        F.coalesce(F.col("candidate_flip") & (F.col("run_len_months") >= MIN_RUN) & (F.col("margin") > MIN_MARGIN), F.lit(False)),
    )


def confirm_flips_causal(monthly: DataFrame, order: str = "month", base: str = "cluster", now: str = "implied_cluster", keys: Sequence[str] = KEYS) -> DataFrame:
    """As ``confirm_flips``, but a month knows only the part of its run up to itself."""
    from pyspark.sql.window import Window

    runs = run_length(monthly, now, keys, order, "_run", "_len")
    upto = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(order))
    differs = F.coalesce(F.col(now) != F.col(base), F.lit(False))
    confirmed = differs & (upto >= MIN_RUN) & F.coalesce(F.col("margin") > MIN_MARGIN, F.lit(False))
    return runs.withColumns({"run_so_far_months": upto, "flip_confirmed_monthly": confirmed}).drop("_run", "_len")


def project_to_days(days: DataFrame, monthly: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS, month: str = "month") -> DataFrame:
    """Bring monthly decisions down to the daily rows."""
    out = days.join(monthly.select(*keys, month, *columns), [*keys, month], "left")
    return out.withColumns(
        {
            "flip_confirmed": F.coalesce(F.col("flip_confirmed_monthly"), F.lit(False)),
            "run_len_days": F.col("run_len_months") * DAYS_PER_MONTH,
        }
    )


def first_events(days: DataFrame, date: str = "date", flag: str = "flip_confirmed", keys: Sequence[str] = KEYS) -> DataFrame:
    return days.filter(F.col(flag)).groupBy(*keys).agg(F.min(date).alias("event_date"))


def cluster_profile(df: DataFrame, features: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Size and mean of each cluster, with z-scores across the clusters (population spread)."""
    means = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_members"), *[F.avg(c).alias(c) for c in features])
    return standardise(means, features)


def _tag(measure: str) -> Column:
    low, mid, high = TAGS[measure]
    z = F.col(f"{measure}_z")
    return F.when(z >= TAG_LIMIT, high).when(z <= -TAG_LIMIT, low).otherwise(mid)


def cluster_names(profile: DataFrame) -> DataFrame:
    """Readable name, short label and note from the z-scores of a cluster profile."""
    t, s, o = _tag("mean_annual_water_temp"), _tag("mean_annual_salinity"), _tag("mean_annual_oxygen")
    return profile.withColumns(
        {
            "cluster_name": F.concat_ws(" / ", t, s, o),
            "cluster_label": F.concat_ws("-", t, s),
            "cluster_note": F.concat_ws(", ", _tag("seasonal_amp_water_temp"), _tag("mean_annual_depth")),
        }
    )


# Labels and reasons of the nutrient regimes, in order of precedence.
NUTRIENT_LABELS = {
    "pulse": ("extreme inorganic nutrient pulse regime", "the strongest standardized nutrient signals sit in ammonium and nitrate-family variables"),
    "fresh": ("fresh nitrate-rich bloom-prone regime", "fresher water with elevated nitrate-family nutrients and chlorophyll"),
    "warm": ("warm productive lower-oxygen regime", "warmer moderate-salinity water with lower dissolved oxygen and productive conditions"),
    "cool": ("cool saline oxygen-rich low-nutrient regime", "cooler saline water with stronger oxygen conditions and lower nutrient stress"),
    "mixed": ("mixed estuary regime", "no single pattern dominated the simple rule set"),
}


def label_nutrient_regimes(centers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rule label with reason and the three strongest high and low signals of each centre."""
    c = F.col
    rules = [
        ("pulse", (c("n_nh4f_mg_l") > 1.5) | (c("n_no3f_mg_l") > 1.5) | (c("n_no23f_mg_l") > 1.5)),
        ("fresh", (c("w_sal_psu") < -1.0) & (c("n_no23f_mg_l") > 0.3) & (c("n_chla_ug_l") > 0.3)),
        ("warm", (c("w_temp_c") > 0.8) & (c("w_do_mg_l") < -0.5) & (c("w_sal_psu") > 0)),
        ("cool", (c("w_sal_psu") > 0.5) & (c("w_do_mg_l") > 0.5) & (c("w_temp_c") < -0.5)),
    ]

    def pick(i: int) -> Column:
        out = F.lit(NUTRIENT_LABELS["mixed"][i])
        for name, rule in reversed(rules):
            out = F.when(rule, NUTRIENT_LABELS[name][i]).otherwise(out)
        return out

    def signals(sign: int) -> Column:
        cells = F.array(*[F.struct((sign * F.col(n)).alias("k"), F.lit(n).alias("n"), F.col(n).alias("v")) for n in columns])
        top = F.slice(F.array_sort(cells), 1, 3)
        return F.array_join(
            F.transform(top, lambda s: F.concat(s["n"], F.lit(" ("), F.format_number(s["v"], 2), F.lit(")"))), ", "
        )

    return centers.withColumns(
        {"label": pick(0), "rationale": pick(1), "top_high_signals": signals(-1), "top_low_signals": signals(1)}
    )
