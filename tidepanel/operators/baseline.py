"""Coverage-based baselines and the seasonal signature of a station."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel import KEYS
from tidepanel.functions import dates, stats
from tidepanel.session import staged

# A year counts from 70 % coverage; a baseline is the first five such years, three at least.
MIN_COVERAGE, BASELINE_YEARS, MIN_YEARS = 0.70, 5, 3


def station_month_partials(df: DataFrame, measures: Sequence[str], date: str = "date", keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per station, year and month: ``n_rows`` and, of every measure, the sum and count of its values.

    Yearly coverage, year-balanced means, climatology and what stands on them merge from these rows, so the readings are
    read once for all of them. A hot station's readings combine on the map side; the calendar bounds what is left.
    """
    return df.groupBy(*keys, F.year(date).alias("year"), F.month(date).alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum(F.col(c).cast("double")).alias(f"{c}_sum") for c in measures], *[F.count(c).alias(f"{c}_n") for c in measures]
    )


def merged_means(partials: DataFrame, measures: Sequence[str], by: Sequence[str], suffix: str = "") -> DataFrame:
    """Means of all readings behind the partial rows of each group; null where no reading has the measure."""
    return partials.groupBy(*by).agg(*[(F.sum(f"{c}_sum") / F.nullif(F.sum(f"{c}_n"), F.lit(0))).alias(f"{c}{suffix}") for c in measures])


def _coverage(rows_per_year: DataFrame, per_day: float, min_coverage: float) -> DataFrame:
    expected = dates.days_in_year(F.col("year")) * F.lit(float(per_day))
    return (
        rows_per_year.withColumn("expected_obs", expected)
        .withColumn("coverage_frac", F.col("n_obs") / F.col("expected_obs"))
        .withColumn("year_is_valid", F.col("coverage_frac") >= min_coverage)
    )


def annual_coverage(df: DataFrame, date: str = "date", per_day: float = 24.0, keys: Sequence[str] = KEYS, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Rows per station-year against the rows a full year would have."""
    return _coverage(df.groupBy(*keys, F.year(date).alias("year")).agg(F.count(F.lit(1)).alias("n_obs")), per_day, min_coverage)


def annual_coverage_of(partials: DataFrame, per_day: float = 24.0, keys: Sequence[str] = KEYS, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``annual_coverage`` from partial rows."""
    return _coverage(partials.groupBy(*keys, "year").agg(F.sum("n_rows").alias("n_obs")), per_day, min_coverage)


def rank_valid_years(coverage: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Ordinal of each valid year inside its station (one row per calendar year)."""
    w = Window.partitionBy(*keys).orderBy("year")
    return coverage.filter("year_is_valid").withColumn("valid_year_rank", F.row_number().over(w))


def baseline_years(coverage: DataFrame, keys: Sequence[str] = KEYS, n: int = BASELINE_YEARS) -> DataFrame:
    return rank_valid_years(coverage, keys).filter(F.col("valid_year_rank") <= n)


def baseline_window(years: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return years.groupBy(*keys).agg(
        F.min("year").alias("baseline_start_year"),
        F.max("year").alias("baseline_end_year"),
        F.count(F.lit(1)).alias("n_valid_years"),
        F.avg("coverage_frac").alias("mean_year_coverage"),
        (F.count(F.lit(1)) < BASELINE_YEARS).alias("is_partial_baseline"),
        (F.count(F.lit(1)) >= MIN_YEARS).alias("is_eligible"),
    )


def in_baseline(rows: DataFrame, years: DataFrame, window: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows, or partial rows, with a ``year`` that is a baseline year of an eligible station."""
    kept = years.select(*keys, "year").join(window.filter("is_eligible").select(*keys), list(keys), "left_semi")
    return rows.join(kept, [*keys, "year"], "left_semi")


def baseline_rows(df: DataFrame, years: DataFrame, window: DataFrame, date: str = "date", keys: Sequence[str] = KEYS) -> DataFrame:
    """Readings of eligible stations in their baseline years."""
    return in_baseline(df.withColumn("year", F.year(date)), years, window, keys)


def _balanced(years: DataFrame, measures: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return years.groupBy(*keys).agg(
        *[F.avg(c).alias(f"mean_annual_{c}") for c in measures], *[F.count(c).alias(f"n_years_{c}") for c in measures]
    )


def year_balanced_means(df: DataFrame, measures: Sequence[str], date: str = "date", keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of yearly means, so that every year weighs the same."""
    return _balanced(df.groupBy(*keys, F.year(date).alias("year")).agg(*[F.avg(c).alias(c) for c in measures]), measures, keys)


def climatology(df: DataFrame, measures: Sequence[str], date: str = "date", keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys, F.month(date).alias("month")).agg(*[F.avg(c).alias(f"{c}_mmean") for c in measures])


def seasonal_amplitude(monthly: DataFrame, measures: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    return monthly.groupBy(*keys).agg(*[stats.amplitude(f"{c}_mmean").alias(f"seasonal_amp_{c}") for c in measures])


def season_signature(monthly: DataFrame, temp: str = "water_temp_mmean", oxygen: str = "oxygen_mmean", keys: Sequence[str] = KEYS) -> DataFrame:
    """Warm and cold months about the station mean, their intensity and oxygen, and the phase lag.

    ``monthly`` has at most twelve rows per station. Months strictly above the mean are warm
    (the warmest if there is none), strictly below are cold. Of equally warm months, and of
    equally poor ones, the first is taken.
    """
    w = Window.partitionBy(*keys)
    t, o = F.col(temp), F.col(oxygen)
    marked = (
        monthly.withColumns({"_mean": F.avg(t).over(w), "_max": F.max(t).over(w), "_min": F.min(t).over(w)})
        .withColumns({"_any_warm": F.max(t > F.col("_mean")).over(w), "_any_cold": F.max(t < F.col("_mean")).over(w)})
        .withColumns(
            {
                "_warm": F.coalesce(F.when(F.col("_any_warm"), t > F.col("_mean")).otherwise(t == F.col("_max")), F.lit(False)),
                "_cold": F.coalesce(F.when(F.col("_any_cold"), t < F.col("_mean")).otherwise(t == F.col("_min")), F.lit(False)),
            }
        )
    )
    warm, cold = F.col("_warm"), F.col("_cold")
    peak = F.max_by("month", F.when(t.isNotNull(), F.struct(stats.steady(t), -F.col("month"))))
    nadir = F.min_by("month", F.when(o.isNotNull(), F.struct(stats.steady(o), F.col("month"))))
    return marked.groupBy(*keys).agg(
        peak.alias("warm_peak_month"),
        nadir.alias("oxygen_nadir_month"),
        F.pmod(nadir - peak, F.lit(12)).cast("double").alias("temp_oxygen_phase_lag"),
        F.count_if(warm).alias("warm_len_months"),
        F.count_if(cold).alias("cold_len_months"),
        F.sum(F.when(warm, t - F.col("_mean"))).alias("warm_intensity_temp"),
        F.coalesce(F.sum(F.when(cold, F.col("_mean") - t)), F.lit(0.0)).alias("cold_intensity_temp"),
        F.avg(F.when(warm, o)).alias("warm_oxygen_mean"),
        F.min(F.when(warm, o)).alias("warm_oxygen_min"),
        F.avg(F.when(cold, o)).alias("cold_oxygen_mean"),
    )


def depth_percentiles(df: DataFrame, depth: str = "depth", keys: Sequence[str] = KEYS) -> DataFrame:
    """Exact p10, median and p90 of all readings of a station, however many there are."""
    from tidepanel.operators.ordered import quantile_columns

    spec = {"p10_depth": (depth, 0.10), "median_depth": (depth, 0.50), "p90_depth": (depth, 0.90)}
    return quantile_columns(df, keys, spec).withColumn("iqr_depth", F.col("p90_depth") - F.col("p10_depth"))


def coverage_counts(df: DataFrame, date: str = "date", keys: Sequence[str] = KEYS) -> DataFrame:
    years = df.groupBy(*keys, F.year(date).alias("year")).agg(F.count(F.lit(1)).alias("_n"))
    return years.groupBy(*keys).agg(F.sum("_n").alias("n_obs_total"), F.count("year").alias("n_years_present"))


def impute_group_median(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fill nulls by the median of the group, then by the median of all rows after that fill."""
    from tidepanel.operators.ordered import quantile_columns

    by_group = quantile_columns(df, group, {f"_g_{c}": (c, 0.5) for c in columns})
    filled = df.join(by_group, list(group), "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_g_{c}")) for c in columns})
    filled = filled.drop(*[f"_g_{c}" for c in columns])
    overall = quantile_columns(filled, [], {c: (c, 0.5) for c in columns})
    row = stats.one_row(overall)
    return filled.withColumns({c: F.coalesce(F.col(c), row[c]) for c in columns})


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of fill values; a column with no value at all is left out of the usable list."""
    from tidepanel.operators.ordered import quantile_columns

    return quantile_columns(df, [], {c: (c, 0.5) for c in columns})


def fixed_baseline(df: DataFrame, measures: Sequence[str], start: str, end: str, date: str = "date", keys: Sequence[str] = KEYS) -> DataFrame:
    """Means inside a fixed period, named ``<measure>_baseline``."""
    inside = F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return df.filter(inside).groupBy(*keys).agg(*[F.avg(c).alias(f"{c}_baseline") for c in measures])


def month_baseline(months: DataFrame, measures: Sequence[str], first: int, last: int, min_months: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """Station-month-of-year means over a span of years with enough months behind them."""
    return (
        months.filter(F.col("year").between(first, last))
        .groupBy(*keys, "month_num")
        .agg(F.count(F.lit(1)).alias("n_baseline_months"), *[F.avg(c).alias(f"{c}_baseline") for c in measures])
        .filter(F.col("n_baseline_months") >= min_months)
    )


def deltas(df: DataFrame, baseline: DataFrame, measures: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    joined = df.join(baseline, list(keys), "left")
    return joined.withColumns({f"delta_{c}": F.col(c) - F.col(f"{c}_baseline") for c in measures})


def station_baseline(df: DataFrame, measures: Sequence[str], window: DataFrame, date: str = "date", keys: Sequence[str] = KEYS, partials: DataFrame | None = None) -> DataFrame:
    """Everything known of a station's baseline, one row per station, joined on the same keys.

    All but the exact depth percentiles merges from ``partials``, the station-month rows of ``df``; they are made and
    staged here if none are given.
    """
    keys = list(keys)
    if partials is None:
        partials = staged(station_month_partials(df, measures, date, keys))
    monthly = merged_means(partials, measures, [*keys, "month"], "_mmean")
    parts: Mapping[str, DataFrame] = {
        "amp": seasonal_amplitude(monthly, measures, keys),
        "signature": season_signature(monthly, keys=keys),
        "depth": depth_percentiles(df, keys=keys),
        "coverage": partials.groupBy(*keys).agg(F.sum("n_rows").alias("n_obs_total"), F.count_distinct("year").alias("n_years_present")),
        "window": window.drop("is_eligible"),
    }
    out = _balanced(merged_means(partials, measures, [*keys, "year"]), measures, keys)
    for part in parts.values():
        out = out.join(part, keys, "left")
    return out
