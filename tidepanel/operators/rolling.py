"""Window operators over calendar-bounded panels, and time-sliced ones over raw readings.

A daily or monthly panel has at most one row per station and calendar step, so a window
partitioned by station holds a bounded number of rows. Raw readings have no such bound:
``segmented_lag`` looks back inside one station and one day, and takes the last reading of
the day before from a table with one row per station and day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidepanel import KEYS
from tidepanel.functions import dates

# Trailing windows in rows, the five-year month window and its least count, the year window.
DRIVER_WINDOWS = (1, 7, 28)
MONTHS_5Y, MIN_MONTHS_5Y, YEARS_5Y, MIN_YEARS_5Y = 60, 36, 5, 3
# Hours of the lagged driver columns.
LAG_HOURS = (1, 3, 6, 12, 24, 48, 72, 96, 120, 168)


def _ordered(keys: Sequence[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing_mean(
    df: DataFrame,
    columns: Sequence[str],
    windows: Sequence[int] = DRIVER_WINDOWS,
    keys: Sequence[str] = KEYS,
    order: str = "date",
    shift: int = 1,
) -> DataFrame:
    """``<column>_r<w>d``: mean of w rows ending ``shift`` rows before the current one (0 includes it)."""
    w = _ordered(keys, order)
    return df.withColumns(
        {f"{c}_r{n}d": F.avg(c).over(w.rowsBetween(-(n - 1) - shift, -shift)) for c in columns for n in windows}
    )


def rolling_mean(
    df: DataFrame, columns: dict[str, str], rows: int, min_count: int, keys: Sequence[str] = KEYS, order: str = "date"
) -> DataFrame:
    """Trailing mean over ``rows`` rows where at least ``min_count`` of them have a value."""
    w = _ordered(keys, order).rowsBetween(-(rows - 1), 0)
    return df.withColumns({out: F.when(F.count(c).over(w) >= min_count, F.avg(c).over(w)) for c, out in columns.items()})


def rolling_years(df: DataFrame, columns: dict[str, str], years: int = YEARS_5Y, min_count: int = MIN_YEARS_5Y, keys: Sequence[str] = KEYS, order: str = "year") -> DataFrame:
    """Trailing mean over ``years`` calendar years: a gap in the years leaves fewer values, never older ones."""
    w = _ordered(keys, order).rangeBetween(-(years - 1), 0)
    return df.withColumns({out: F.when(F.count(c).over(w) >= min_count, F.avg(c).over(w)) for c, out in columns.items()})


def rolling_coverage(df: DataFrame, has_data: Column, rows: int = MONTHS_5Y, keys: Sequence[str] = KEYS, order: str = "date") -> DataFrame:
    w = _ordered(keys, order).rowsBetween(-(rows - 1), 0)
    n = F.sum(has_data.cast("int")).over(w)
    return df.withColumns({"months_with_any_data_5y": n, "coverage_ratio_5y": n / F.lit(float(rows))})


def run_length(df: DataFrame, column: str, keys: Sequence[str] = KEYS, order: str = "date", run: str = "run_id", length: str = "run_length") -> DataFrame:
    """Runs of equal values in order; a null never continues a run. The length is that of the whole run."""
    w = _ordered(keys, order)
    before = F.lag(column).over(w)
    starts = F.coalesce((before != F.col(column)), F.lit(True)).cast("int")
    marked = df.withColumn("_starts", starts).withColumn(run, F.sum("_starts").over(w)).drop("_starts")
    return marked.withColumn(length, F.count(F.lit(1)).over(Window.partitionBy(*keys, run)))


def persistence(df: DataFrame, column: str, keys: Sequence[str] = KEYS, order: str = "date", fallbacks: Sequence[Column] = (), out: str = "pred") -> DataFrame:
    """The previous row's value as prediction, with fallbacks where there is none."""
    return df.withColumn(out, F.coalesce(F.lag(column).over(_ordered(keys, order)), *fallbacks))


def lag_matrix(df: DataFrame, column: str, lags: Sequence[int] = LAG_HOURS, keys: Sequence[str] = KEYS, order: str = "ts", unit: str = "h") -> DataFrame:
    w = _ordered(keys, order)
    return df.withColumns({f"{column}_lag_{n}{unit}": F.lag(column, n).over(w) for n in lags})


def spine(df: DataFrame, keys: Sequence[str], order: str, step: str, values: Sequence[str]) -> DataFrame:
    """Every step between a key's first and last row; steps without a row get nulls."""
    grid = (
        df.groupBy(*keys)
        .agg(F.min(order).alias("_a"), F.max(order).alias("_b"))
        .select(*keys, F.explode(F.sequence("_a", "_b", F.expr(f"INTERVAL {step}"))).alias(order))
    )
    return grid.join(df.select(*keys, order, *values), [*keys, order], "left")


def lag_scan(panel: DataFrame, driver: str, response: str, lags: Sequence[int], keys: Sequence[str], order: str) -> DataFrame:
    """Correlation of the differenced response with the differenced driver per lag.

    ``panel`` is dense, so a lag in rows is a lag in time. All lags come from one window
    pass and all correlations from one aggregate; no row is copied per lag.
    """
    w = _ordered(keys, order)
    diffs = panel.withColumns(
        {"_dx": F.col(driver) - F.lag(driver).over(w), "_dy": F.col(response) - F.lag(response).over(w)}
    )
    lagged = diffs.withColumns({f"_x{n}": F.lag("_dx", n).over(w) for n in lags})
    cells = [
        F.struct(
            F.lit(n).alias("lag"),
            F.corr(f"_x{n}", "_dy").alias("corr"),
            F.count_if(F.col(f"_x{n}").isNotNull() & F.col("_dy").isNotNull()).alias("n_pairs"),
        )
        for n in lags
    ]
    return lagged.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")


def segmented_lag(df: DataFrame, keys: Sequence[str], ts: str, out: str = "prev_ts", bucket: str = "day") -> DataFrame:
    """Time of the previous reading of the same key, without gathering a key in one task."""
    df = df.withColumn("_slot", F.date_trunc(bucket, ts))
    inside = Window.partitionBy(*keys, "_slot").orderBy(ts)
    across = Window.partitionBy(*keys).orderBy("_slot")
    tails = (
        df.groupBy(*keys, "_slot")
        .agg(F.max(ts).alias("_tail"))
        .withColumn("_carry", F.lag("_tail").over(across))
        .drop("_tail")
    )
    return (
        df.withColumn("_in", F.lag(ts).over(inside))
        .join(tails, [*keys, "_slot"])
        .withColumn(out, F.coalesce("_in", "_carry"))
        .drop("_slot", "_in", "_carry")
    )


def reading_gaps(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Different reading times per key with their copies and the gap to the one before."""
    times = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("n_copies"))
    return segmented_lag(times, keys, ts).withColumn("gap_hours", dates.hours_between(F.col(ts), F.col("prev_ts")))


def timestamp_integrity(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Per key: rows, different times, duplicates, and the largest and mean gap."""
    return reading_gaps(df, keys, ts).groupBy(*keys).agg(
        F.sum("n_copies").alias("n_rows"),
        F.count(F.lit(1)).alias("n_unique"),
        (F.sum("n_copies") - F.count(F.lit(1))).alias("n_duplicates"),
        F.max("gap_hours").alias("max_gap_hours"),
        F.avg("gap_hours").alias("mean_gap_hours"),
    )


def gap_histogram(df: DataFrame, keys: Sequence[str], ts: str, n: int = 10) -> DataFrame:
    """The most frequent gaps in whole hours; copies count as gaps of zero."""
    gaps = reading_gaps(df, keys, ts).withColumn("gap", F.round("gap_hours").cast("bigint"))
    cells = F.array(
        F.struct(F.col("gap").alias("gap"), F.lit(1).cast("bigint").alias("n")),
        F.struct(F.lit(0).cast("bigint").alias("gap"), (F.col("n_copies") - 1).alias("n")),
    )
    long = gaps.select(F.explode(cells).alias("_c")).select("_c.*").filter((F.col("n") > 0) & F.col("gap").isNotNull())
    return long.groupBy("gap").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gap").limit(n)


def order_violations(df: DataFrame, keys: Sequence[str], ts: str, position: str) -> DataFrame:
    """Readings per key that come later in file order but earlier in time.

    A reading is a violation if a reading of an earlier position has a later time. The table
    is sorted by range into even parts; the latest time of a key before a part comes from a
    table with one row per key and part.
    """
    from tidepanel.operators.ordered import sorted_slots

    keys = list(keys)
    slots = sorted_slots(df.select(*keys, position, ts), [*keys, position])
    inside = Window.partitionBy(*keys, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tails = slots.groupBy(*keys, "_part").agg(F.max(ts).alias("_m")).withColumn("_carry", F.max("_m").over(across)).drop("_m")
    seen = slots.withColumn("_in", F.max(ts).over(inside)).join(tails, [*keys, "_part"])
    latest = F.greatest("_in", "_carry")
    return seen.groupBy(*keys).agg(F.count_if(F.coalesce(F.col(ts) < latest, F.lit(False))).alias("n_order_violations"))


def step_drop(df: DataFrame, order: str, value: str) -> DataFrame:
    """Fall of a value from one step to the next and its share; for a scan table of a few rows."""
    before = F.lag(value).over(Window.orderBy(order))
    return df.withColumns({f"{value}_drop": before - F.col(value), f"{value}_drop_pct": (before - F.col(value)) / before})


def interpolate_time(df: DataFrame, column: str, order: str, keys: Sequence[str] = KEYS, out: str = "filled") -> DataFrame:
    """Linear interpolation in time between the neighbours that have a value; ends take the nearest."""
    w = _ordered(keys, order)
    point = F.when(F.col(column).isNotNull(), F.struct(F.unix_date(F.col(order).cast("date")).alias("t"), F.col(column).alias("v")))
    before = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    now = F.unix_date(F.col(order).cast("date"))
    a, b = F.col("_a"), F.col("_b")
    line = a["v"] + (b["v"] - a["v"]) * (now - a["t"]) / F.nullif(b["t"] - a["t"], F.lit(0))
    return (
        df.withColumns({"_a": before, "_b": after})
        .withColumn(out, F.coalesce(F.col(column), line, a["v"], b["v"]))
        .drop("_a", "_b")
    )


def group_size_and_median(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Group size and exact group median beside every row (joined back, not gathered)."""
    from tidepanel.operators.ordered import quantile_columns

    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("group_size"))
    medians = quantile_columns(df, group, {"group_median": (value, 0.5)})
    return df.join(sizes, list(group)).join(medians, list(group), "left")
