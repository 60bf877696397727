"""Seasonal-trend decomposition of many series and their extension to a later year.

The series are monthly, so a series is one row with an array that the calendar bounds.
Grid, interpolation, extension and summary are DataFrame expressions; only the smoothing runs
in numpy, on all series of an Arrow batch that have the same length together, as one matrix.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidepanel import KEYS
from tidepanel.operators.rolling import interpolate_time, spine
from tidepanel.session import spread_groups

# Period, least months of a series, years of trend to extend, last year.
PERIOD, MIN_MONTHS, TREND_YEARS, END_YEAR = 12, 84, 10, 2100
# Seasonal smoother span, inner passes and robustness passes.
SEASONAL_SPAN, INNER, OUTER = 7, 2, 15
#: Numbers in the matrix of windows that one call of the smoother holds (a few copies of it at 8 bytes).
CELLS = 500_000
#: Series of an Arrow batch that are numbers in Python at once.
SERIES = 512


@lru_cache(maxsize=256)
def _windows(n: int, span: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours of each point first..last of an even series of n: index, tricube weight, offset."""
    at = np.arange(first, last + 1)
    q = min(span, n)
    idx = np.clip(at - (q - 1) // 2, 0, n - q)[:, None] + np.arange(q)[None, :]
    off = (idx - at[:, None]).astype(float)
    h = np.abs(off).max(axis=1, keepdims=True) + max(span - n, 0) // 2
    r = np.abs(off) / np.maximum(h, 1e-12)
    w = np.where(r <= 0.001, 1.0, np.where(r <= 0.999, (1 - np.minimum(r, 1) ** 3) ** 3, 0.0))
    return idx, w, off


def loess(y: np.ndarray, span: int, weights: np.ndarray | None = None, pad: int = 0) -> np.ndarray:
    """Local linear smoother of even series (one per row) with tricube weights.

    ``pad`` asks for that many extra points beyond each end.
    """
    y2 = np.atleast_2d(y)
    n = y2.shape[1]
    idx, w0, off = _windows(n, span, -pad, n - 1 + pad)
    w = w0[None] if weights is None else w0[None] * np.atleast_2d(weights)[:, idx]
    total = w.sum(axis=2)
    w = w / np.where(total > 0, total, 1.0)[:, :, None]
    mx = (w * off).sum(axis=2)
    dx = off[None] - mx[:, :, None]
    sxx = (w * dx * dx).sum(axis=2)
    near = y2[:, idx]
    wide = np.sqrt(sxx) > 0.001 * max(n - 1, 1)
    slope = np.where(wide, (w * dx * near).sum(axis=2) / np.where(wide, sxx, 1.0), 0.0)
    fit = (w * near).sum(axis=2) - slope * mx
    at = np.clip(np.arange(-pad, n + pad), 0, n - 1)
    out = np.where(total > 0, fit, y2[:, at])
    return out[0] if y.ndim == 1 else out


def _moving(y: np.ndarray, n: int) -> np.ndarray:
    c = np.cumsum(np.pad(y, ((0, 0), (1, 0))), axis=1)
    return (c[:, n:] - c[:, :-n]) / n


def _smooth_cycle(x: np.ndarray, period: int, weights: np.ndarray | None) -> np.ndarray:
    """Smooth the values of each calendar position over the cycles, one cycle further at both ends."""
    m, n = x.shape
    out = np.empty((m, n + 2 * period))
    cut = n % period or period
    for rows in (range(cut), range(cut, period)):  # positions with equally many cycles go together
        if len(rows):
            sub = np.vstack([x[:, s::period] for s in rows])
            rw = None if weights is None else np.vstack([weights[:, s::period] for s in rows])
            smooth = loess(sub, SEASONAL_SPAN, rw, pad=1)
            for i, s in enumerate(rows):
                out[:, s::period][:, : smooth.shape[1]] = smooth[i * m : (i + 1) * m]
    return out


def _trend_span(period: int) -> int:
    span = int(np.ceil(1.5 * period / (1 - 1.5 / SEASONAL_SPAN)))
    return span + 1 - span % 2


def stl_many(y: np.ndarray, period: int = PERIOD, robust: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Trend and seasonal components of complete series of one length, one per row. No series touches another."""
    n = y.shape[1]
    low_span = period + 1 if period % 2 == 0 else period + 2
    trend, seasonal, rw = np.zeros(y.shape), np.zeros(y.shape), None
    for outer in range(OUTER + 1 if robust else 1):
        for _ in range(INNER if robust else 5):
            cycle = _smooth_cycle(y - trend, period, rw)
            low = loess(_moving(_moving(_moving(cycle, period), period), 3), low_span)
            seasonal = cycle[:, period : period + n] - low
            trend = loess(y - seasonal, _trend_span(period), rw)
        if not robust or outer == OUTER:
            break
        resid = np.abs(y - trend - seasonal)
        h = 6 * np.median(resid, axis=1, keepdims=True)
        u = np.where(h > 0, resid / np.where(h > 0, h, 1.0), 0.0)
        rw = np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - np.minimum(u, 1) ** 2) ** 2, 0.0))
    return trend, seasonal


def stl(y: np.ndarray, period: int = PERIOD, robust: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Trend and seasonal component of one complete series."""
    trend, seasonal = stl_many(y[None], period, robust)
    return trend[0], seasonal[0]


def stl_lists(series: Sequence[np.ndarray], period: int = PERIOD, robust: bool = True) -> tuple[list, list]:
    """Components of series of any lengths, in their order; nulls for those of fewer than two periods.

    Series of a length go together, as many as keep the matrix of their windows near ``CELLS`` numbers.
    """
    trend, seasonal = [[None] * len(y) for y in series], [[None] * len(y) for y in series]
    lengths: dict[int, list[int]] = {}
    for i, y in enumerate(series):
        lengths.setdefault(len(y), []).append(i)
    for n, members in lengths.items():
        step = max(CELLS // (n * _trend_span(period)), 1) if n >= 2 * period else 0
        for at in range(0, len(members) if step else 0, step or 1):
            some = members[at : at + step]
            for i, t, s in zip(some, *stl_many(np.array([series[i] for i in some], dtype=float), period, robust)):
                trend[i], seasonal[i] = t, s
    return trend, seasonal


def monthly_series(monthly: DataFrame, variables: Sequence[str], keys: Sequence[str] = KEYS, month: str = "month_date", min_months: int = MIN_MONTHS) -> DataFrame:
    """Dense interpolated series per station and variable; short ones are left out."""
    long = monthly.select(
        *keys,
        month,
        F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("observed")) for v in variables])).alias("_c"),
    ).select(*keys, "_c.variable", month, "_c.observed")
    group = [*keys, "variable"]
    enough = long.groupBy(*group).agg(F.count("observed").alias("_n")).filter(F.col("_n") >= min_months)
    dense = spine(long.join(enough.select(*group), group, "left_semi"), group, month, "1 MONTH", ["observed"])
    return interpolate_time(dense, "observed", month, group, "filled")


def decompose(series: DataFrame, keys: Sequence[str] = KEYS, order: str = "month_date", value: str = "filled", period: int = PERIOD, robust: bool = True) -> DataFrame:
    """Adds ``trend``, ``seasonal`` and ``fitted`` to every series of a (keys, variable) group.

    Series of fewer than two periods get nulls. One shuffle; a series travels as one row, whose other columns stay Arrow
    data: only the numbers to smooth are read in Python, those of ``SERIES`` series at once.
    """
    group = [*keys, "variable"]
    rest = [c for c in series.columns if c not in (*group, order)]
    packed = spread_groups(series, group).groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias("_rows"))
    packed = packed.withColumn("_y", F.transform("_rows", lambda r: r[value].cast("double")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float64())
        for batch in batches:
            kept = [i for i, n in enumerate(batch.schema.names) if n != "_y"]
            for at in range(0, batch.num_rows, SERIES):
                part = batch.slice(at, SERIES)
                y = part.column(part.schema.get_field_index("_y"))
                ends = np.cumsum(pc.list_value_length(y).to_numpy(zero_copy_only=False))
                parts = stl_lists(np.split(y.flatten().to_numpy(zero_copy_only=False), ends[:-1]), period, robust)
                columns = [part.column(i) for i in kept] + [pa.array(p, kind, from_pandas=True) for p in parts]
                yield pa.RecordBatch.from_arrays(columns, names=[part.schema.names[i] for i in kept] + ["_trend", "_seasonal"])

    schema = T.StructType([f for f in packed.schema.fields if f.name != "_y"])
    for c in ("_trend", "_seasonal"):
        schema = schema.add(c, T.ArrayType(T.DoubleType()))
    zipped = packed.mapInArrow(run, schema).select(*group, F.inline(F.arrays_zip("_rows", "_trend", "_seasonal")))
    return zipped.select(*group, "_rows.*", F.col("_trend").alias("trend"), F.col("_seasonal").alias("seasonal")).select(
        *series.columns, "trend", "seasonal", (F.col("trend") + F.col("seasonal")).alias("fitted")
    )


def trend_line(parts: DataFrame, keys: Sequence[str] = KEYS, month: str = "month_date", trend_years: int = TREND_YEARS, period: int = PERIOD) -> DataFrame:
    """Slope and intercept of the last years of trend, and where the series ends."""
    group = [*keys, "variable"]
    tail = max(period * trend_years, period * 3)
    back = Window.partitionBy(*group).orderBy(F.desc(month))
    last = parts.filter(F.col("trend").isNotNull()).withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= tail)
    n = F.count(F.lit(1))
    # x counts up from 0 at the start of the tail, so the last row has x = n - 1
    lines = last.groupBy(*group).agg(
        n.alias("n_tail"), F.max(month).alias("last_month"), F.regr_slope("trend", -F.col("_back")).alias("slope"), F.regr_intercept("trend", -F.col("_back")).alias("_b")
    )
    return (
        lines.filter(F.col("n_tail") >= 2 * period)
        .withColumn("intercept", F.col("_b") - F.col("slope") * F.col("n_tail"))
        .drop("_b")
    )


def extend(parts: DataFrame, keys: Sequence[str] = KEYS, month: str = "month_date", end_year: int = END_YEAR, trend_years: int = TREND_YEARS) -> DataFrame:
    """History and future of every series: the trend line plus the mean seasonal value of the month.

    Lines and seasons meet while there is one row a series; its future months are exploded last and not shuffled here.
    """
    group = [*keys, "variable"]
    lines = trend_line(parts, keys, month, trend_years).dropna(subset=group)
    template = parts.groupBy(*group, F.month(month).alias("month_num")).agg(F.avg("seasonal").alias("seasonal")).filter("month_num is not null")
    # 12 entries at most for each series
    template = template.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("month_num", "seasonal"))).alias("_s"))
    slope = [F.col("slope").alias("trend_slope_per_month"), (F.col("slope") * 12.0).alias("trend_slope_per_year")]
    end = F.lit(f"{end_year}-12-01").cast("date")
    first = F.add_months("last_month", 1)
    months = F.posexplode(F.sequence(first, end, F.expr("INTERVAL 1 MONTH"))).alias("_j", month)
    future = lines.filter(first <= end).join(template, group, "left").select(*group, "slope", "intercept", "n_tail", "_s", months)
    future = (
        future.select(
            *group, month, F.lit(None).cast("double").alias("observed"), F.lit(None).cast("double").alias("filled"),
            (F.col("intercept") + F.col("slope") * (F.col("n_tail") + F.col("_j"))).alias("trend"),
            F.coalesce(F.try_element_at("_s", F.month(month)), F.lit(0.0)).alias("seasonal"), F.lit(True).alias("is_future"), *slope,
        )
        .withColumn("fitted", F.col("trend") + F.col("seasonal"))
    )
    order = [*group, month, "observed", "filled", "trend", "seasonal", "is_future", "fitted", "trend_slope_per_month", "trend_slope_per_year"]
    history = parts.join(lines.select(*group, *slope), group).withColumn("is_future", F.lit(False))
    return history.select(*order).unionByName(future.select(*order)).withColumns({"year": F.year(month), "month_num": F.month(month)})


def extension_summary(extended: DataFrame, keys: Sequence[str] = KEYS, late_year: int = 2090, recent_years: int = 5) -> DataFrame:
    """Mean of the last observed years, of the late forecast, their difference and the slope per year."""
    group = [*keys, "variable"]
    seen = ~F.col("is_future") & F.col("observed").isNotNull()
    last = extended.filter(seen).groupBy(*group).agg(F.max("year").alias("_last"))
    recent = seen & (F.col("year") > F.col("_last") - recent_years)
    # months between the history and the late years enter no column
    used = extended.filter(~F.col("is_future") | (F.col("year") >= late_year))
    return (
        used.join(last, group)
        .groupBy(*group)
        .agg(
            F.avg(F.when(recent, F.col("observed"))).alias("recent_mean_5y"),
            F.avg(F.when(F.col("is_future") & (F.col("year") >= late_year), F.col("fitted"))).alias("forecast_mean_2090s"),
            F.max("trend_slope_per_year").alias("trend_slope_per_year"),
        )
        .withColumn("forecast_delta_2090s", F.col("forecast_mean_2090s") - F.col("recent_mean_5y"))
    )


def residuals(parts: DataFrame, value: str = "filled") -> DataFrame:
    return parts.withColumn("resid", F.col(value) - F.col("fitted"))


VARIABLE_NAMES: Mapping[str, str] = {
    "air_temp": "Air Temp",
    "precip": "Precip",
    "water_temp": "Water Temp",
    "salinity": "Salinity",
    "oxygen": "Dissolved Oxygen",
}
