"""Record spans, gaps and station-year screens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel import KEYS
from tidepanel.functions import dates, stats

# Thresholds of the recurring-break rule.
MIN_FULL_YEARS, MIN_RUN, YEAR_SHARE, SAME_TIME_SHARE = 3, 2, 0.50, 0.60
# A record shorter than this many years is of no use.
MIN_SPAN_YEARS = 15.0
# Least days and months of a usable station-year.
MIN_DAYS, MIN_MONTHS, MIN_WARM_DAYS, MIN_WARM_MONTHS = 120, 6, 45, 3
# Least years and temperature days of a usable station; share of stations to train on.
MIN_STATION_YEARS, MIN_STATION_DAYS, TRAIN_SHARE = 5, 1095, 0.80


def _edge(d: Column, month: int, day: int) -> Column:
    return (F.month(d) == month) & (F.dayofmonth(d) == day)


def station_span(df: DataFrame, date: str = "date", keys: Sequence[str] = KEYS) -> DataFrame:
    """First and last day, number of years seen, and the full calendar years between."""
    years = df.groupBy(*keys, F.year(date).alias("_y")).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    span = years.groupBy(*keys).agg(
        F.min("_a").alias("first_obs_date"), F.max("_b").alias("last_obs_date"), F.count("_y").alias("n_years_obs")
    )
    first, last = F.col("first_obs_date"), F.col("last_obs_date")
    return span.withColumns(
        {
            "first_full_year": F.year(first) + F.when(_edge(first, 1, 1), 0).otherwise(1),
            "last_full_year": F.year(last) - F.when(_edge(last, 12, 31), 0).otherwise(1),
        }
    ).withColumn("n_full_years", F.greatest(F.lit(0), F.col("last_full_year") - F.col("first_full_year") + 1))


def month_days(df: DataFrame, date: str = "date", keys: Sequence[str] = KEYS) -> DataFrame:
    """Different observed days per station-year-month; days collapse before they are counted."""
    days = df.select(*keys, F.col(date).alias("_d")).distinct()
    return days.groupBy(*keys, F.year("_d").alias("year"), F.month("_d").alias("month")).agg(F.count("_d").alias("n_obs_days"))


def _longest_run(mask: Column) -> Column:
    """(length, first month) of the longest run of unset month bits; the earliest of equal length."""
    zero = F.lit(0)
    start = F.struct(zero.alias("run"), zero.alias("at"), zero.alias("best"), zero.alias("best_at"))

    def step(s: Column, m: Column) -> Column:
        missing = F.call_function("shiftright", mask, m).bitwiseAND(F.lit(1)) == 0
        run = F.when(missing, s["run"] + 1).otherwise(zero)
        at = F.when(missing & (s["run"] == 0), m).otherwise(s["at"])
        longer = run > s["best"]
        return F.struct(
            run.alias("run"),
            at.alias("at"),
            F.when(longer, run).otherwise(s["best"]).alias("best"),
            F.when(longer, at).otherwise(s["best_at"]).alias("best_at"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, step)


def missing_runs(df: DataFrame, span: DataFrame, date: str = "date", keys: Sequence[str] = KEYS, min_run: int = MIN_RUN) -> DataFrame:
    """Missing whole months of every full calendar year and their longest run.

    The months seen in a year are one bit mask per station-year, so a year costs one row
    and the runs are found inside it without a grid or a window.
    """
    bit = F.call_function("shiftleft", F.lit(1), F.month(date))
    seen = df.groupBy(*keys, F.year(date).alias("year")).agg(F.bit_or(bit).alias("_mask"))
    years = span.filter(F.col("n_full_years") > 0).select(
        *keys, F.explode(F.sequence("first_full_year", "last_full_year")).alias("year")
    )
    grid = years.join(seen, [*keys, "year"], "left").withColumn("_mask", F.coalesce("_mask", F.lit(0)))
    n_seen = F.bit_count("_mask")
    return (
        grid.withColumn("_run", _longest_run(F.col("_mask")))
        .select(
            *keys,
            "year",
            (12 - n_seen).alias("n_missing_whole_months"),
            n_seen.alias("n_obs_months"),
            F.col("_run.best").alias("max_consecutive_missing_months"),
            F.when(F.col("_run.best") >= min_run, F.col("_run.best_at")).alias("long_gap_start_month"),
            (F.col("_run.best") >= min_run).alias("has_long_gap"),
        )
    )


def modal_gap(gaps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Most frequent start month of a long gap; the earliest month among equals."""
    counts = gaps.filter("has_long_gap").groupBy(*keys, "long_gap_start_month").agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("long_gap_start_month").alias("m")))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col("_b.m").alias("modal_long_gap_start_month"), (-F.col("_b.n")).alias("n_years_same_start")
    )


def seasonal_breaks(span: DataFrame, gaps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Stations whose long gap comes back at the same time of year (one row per station-year behind each median)."""
    flag = F.col("has_long_gap")
    summary = gaps.groupBy(*keys).agg(
        F.median("n_missing_whole_months").alias("median_missing_whole_months"),
        F.median("max_consecutive_missing_months").alias("median_max_consecutive_missing_months"),
        F.count_if(flag).alias("n_full_years_long_gap"),
        F.avg(flag.cast("double")).alias("pct_full_years_with_long_gap"),
    )
    joined = span.join(summary, list(keys), "left").join(modal_gap(gaps, keys), list(keys), "left")
    zeros = [c for c in joined.columns if c in {*summary.columns, "modal_long_gap_start_month", "n_years_same_start"} and c not in keys]
    share = F.when(F.col("n_full_years_long_gap") > 0, F.col("n_years_same_start") / F.col("n_full_years_long_gap")).otherwise(0.0)
    return (
        joined.fillna(0, zeros)
        .withColumn("modal_long_gap_start_share", share)
        .withColumn(
            "seasonal_break_station",
            (F.col("n_full_years") >= MIN_FULL_YEARS)
            & (F.col("pct_full_years_with_long_gap") >= YEAR_SHARE)
            & (F.col("modal_long_gap_start_share") >= SAME_TIME_SHARE),
        )
    )


def short_records(df: DataFrame, lookup: DataFrame, core: Sequence[str], date: str = "date", keys: Sequence[str] = KEYS, min_years: float = MIN_SPAN_YEARS) -> DataFrame:
    """Record length and core signal of every listed station, and whether it is of use.

    Days are collapsed first; years and dates are then plain counts over days.
    """
    has_core = stats.any_present(core)
    days = df.filter(F.col(date).isNotNull()).groupBy(*keys, F.col(date).alias("_d")).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(has_core).alias("_core")
    )
    years = days.groupBy(*keys, F.year("_d").alias("_y")).agg(
        F.sum("_rows").alias("_rows"),
        F.sum("_core").alias("_core"),
        F.count("_d").alias("_dates"),
        F.count_if(F.col("_core") > 0).alias("_core_dates"),
        F.min("_d").alias("_a"),
        F.max("_d").alias("_b"),
    )
    history = years.groupBy(*keys).agg(
        F.sum("_rows").alias("n_raw_rows"),
        F.sum("_dates").alias("n_raw_dates"),
        F.count("_y").alias("n_raw_years"),
        F.sum("_core").alias("n_core_rows"),
        F.sum("_core_dates").alias("n_core_dates"),
        F.count_if(F.col("_core_dates") > 0).alias("n_core_years"),
        F.datediff(F.max("_b"), F.min("_a")).alias("record_span_days"),
    )
    counts = [c for c in history.columns if c not in keys]
    return (
        lookup.select(*keys, "in_history")
        .distinct()
        .join(history, list(keys), "left")
        .fillna(0, counts)
        .withColumn("record_span_years", F.round(F.col("record_span_days") / 365.25, 4))
        .withColumn("lookup_preexcluded", ~F.coalesce(F.col("in_history"), F.lit(False)))
        .withColumn("short_record_span_station", F.col("record_span_years") < min_years)
        .withColumn("pointless_station", F.col("lookup_preexcluded") | F.col("short_record_span_station"))
    )


def raw_quality(daily: DataFrame, core: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    return daily.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_daily_rows"),
        stats.total([F.count(c) for c in core]).alias("n_non_null_core_water"),
    ).withColumn("has_raw_signal", F.col("n_non_null_core_water") > 0)


def station_year_quality(
    daily: DataFrame,
    core: Sequence[str],
    date: str = "date",
    keys: Sequence[str] = KEYS,
    min_days: int = MIN_DAYS,
    min_months: int = MIN_MONTHS,
    min_warm_days: int = MIN_WARM_DAYS,
    min_warm_months: int = MIN_WARM_MONTHS,
    temp: str = "water_temp",
    oxygen: str = "oxygen",
) -> DataFrame:
    """Days and months of any core reading, temperature and oxygen per station-year, in one aggregate."""
    any_core, has_t, has_o = stats.any_present(core), F.col(temp).isNotNull(), F.col(oxygen).isNotNull()
    month = F.month(date)
    warm = dates.is_warm(F.col(date))
    out = daily.groupBy(*keys, F.year(date).alias("year")).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count_if(any_core).alias("n_any_core_days"),
        F.count_if(has_t).alias("n_temp_days"),
        F.count_if(has_o).alias("n_oxygen_days"),
        stats.months_with(any_core, month).alias("n_any_core_months"),
        stats.months_with(has_t, month).alias("n_temp_months"),
        stats.months_with(has_o, month).alias("n_oxygen_months"),
        F.count_if(warm).alias("n_warm_days"),
        F.count_if(warm & has_t).alias("n_warm_temp_days"),
        F.count_if(warm & has_o).alias("n_warm_oxygen_days"),
        stats.months_with(warm & has_t, month).alias("n_warm_temp_months"),
        stats.months_with(warm & has_o, month).alias("n_warm_oxygen_months"),
    )
    model_year = (
        (F.col("n_any_core_days") >= min_days) & (F.col("n_temp_days") >= min_days) & (F.col("n_temp_months") >= min_months)
    )
    return out.withColumn("has_model_year", model_year).withColumn(
        "has_warm_oxygen_year",
        F.col("has_model_year")
        & (F.col("n_warm_oxygen_days") >= min_warm_days)
        & (F.col("n_warm_oxygen_months") >= min_warm_months),
    )


def classification_quality(daily: DataFrame, cluster: str, flip: str, keys: Sequence[str] = KEYS) -> DataFrame:
    return daily.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(cluster).alias("n_classified_days"),
        F.count_if(F.coalesce(F.col(flip), F.lit(False))).alias("n_flip_days"),
    )


def station_summary(daily: DataFrame, date: str = "date", keys: Sequence[str] = KEYS, min_years: int = MIN_STATION_YEARS, min_temp_days: int = MIN_STATION_DAYS) -> DataFrame:
    """Per station: span, years, temperature and oxygen days, keep flag and note."""
    years = daily.groupBy(*keys, F.year(date).alias("_y")).agg(
        F.min(date).alias("_a"),
        F.max(date).alias("_b"),
        F.count(F.lit(1)).alias("_n"),
        F.count("water_temp").alias("_t"),
        F.count("oxygen").alias("_o"),
    )
    keep = (F.col("n_years") >= min_years) & (F.col("n_temp_days") >= min_temp_days)
    return (
        years.groupBy(*keys)
        .agg(
            F.min("_a").alias("first_date"),
            F.max("_b").alias("last_date"),
            F.sum("_n").alias("n_daily_rows"),
            F.count("_y").alias("n_years"),
            F.sum("_t").alias("n_temp_days"),
            F.sum("_o").alias("n_oxygen_days"),
        )
        .withColumn("keep_station", keep)
        .withColumn("screen_note", F.when(F.col("keep_station"), "keep").otherwise("drop_small_station"))
    )


def station_year_screen(daily: DataFrame, date: str = "date", keys: Sequence[str] = KEYS, min_days: int = MIN_DAYS, min_months: int = MIN_MONTHS, min_warm_days: int = MIN_WARM_DAYS, min_warm_months: int = MIN_WARM_MONTHS) -> DataFrame:
    month = F.month(date)
    warm = dates.is_warm(F.col(date))
    out = daily.groupBy(*keys, F.year(date).alias("year")).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count("water_temp").alias("n_temp_days"),
        F.count("oxygen").alias("n_oxygen_days"),
        stats.months_with(F.lit(True), month).alias("n_any_months"),
        F.count(F.when(warm, F.col("oxygen"))).alias("n_warm_oxygen_days"),
        stats.months_with(warm, month).alias("n_warm_months"),
    )
    keep = (F.col("n_temp_days") >= min_days) & (F.col("n_any_months") >= min_months)
    warm_keep = (F.col("n_warm_oxygen_days") >= min_warm_days) & (F.col("n_warm_months") >= min_warm_months)
    return (
        out.withColumn("keep_year", keep)
        .withColumn("keep_warm_oxygen_year", F.col("keep_year") & warm_keep)
        .withColumn("screen_note", F.when(F.col("keep_year"), "keep").otherwise("drop_sparse_year"))
    )


def cohort_split(stations: DataFrame, group: str = "region", order: Sequence[str] = ("station",), train: float = TRAIN_SHARE) -> DataFrame:
    """First part of each region's ordered stations to train, the rest to holdout."""
    from tidepanel.operators.ordered import group_rank

    ranked = group_rank(stations, [group], list(order), "region_rank", "region_n")
    frac = F.col("region_rank") / F.col("region_n")
    return ranked.withColumn("region_frac", frac).withColumn("cohort", F.when(frac <= train, "train").otherwise("holdout"))


def every_nth_holdout(keys: DataFrame, order: Sequence[str] = KEYS, n: int = 5) -> DataFrame:
    """Every n-th station of the global order, from the first on, to holdout."""
    from tidepanel.operators.ordered import global_rank

    ranked = global_rank(keys, list(order), "_rank")
    return ranked.withColumn("cohort", F.when((F.col("_rank") - 1) % n == 0, "holdout").otherwise("train")).drop("_rank")
