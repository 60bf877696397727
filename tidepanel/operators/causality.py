"""Does the past of a driver help to predict a response? One F test per station and lag.

Both regressions of every lag need only sums of products of the two series at a distance of 0 to ``max_lag`` rows and
the first and last ``max_lag`` values. Those are one aggregate per station; what reaches Python is one row of numbers
per station, whatever the length of its series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidepanel import KEYS

MAX_LAG = 14


def f_tail(f: float, d1: int, d2: int) -> float:
    """Upper tail of the F distribution by the continued fraction of the incomplete beta function."""
    if not f > 0:
        return 1.0
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2

    def fraction(x: float, a: float, b: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x < (a + 1) / (a + b + 2):
        return front * fraction(x, a, b) / a
    return 1 - front * fraction(1 - x, b, a) / b


def _residual(m: np.ndarray, n_known: int) -> float:
    """Sum of squared residuals of the last variable on the first ``n_known``, from sums of products."""
    known, target = m[:n_known, :n_known], m[:n_known, -1]
    beta, *_ = np.linalg.lstsq(known, target, rcond=1e-13)
    return float(m[-1, -1] - target @ beta)


class Moments:
    """Sums of products of lagged values over the rows after the first p, from the sums over all rows.

    ``sums["yx"][k]`` adds y at a row times x at the row k before, over all rows that have one. Of a pair with delays
    i <= j the rows up to p are taken off at the head, and i rows at the tail.
    """

    def __init__(self, sums: dict[str, np.ndarray], heads: dict[str, np.ndarray], tails: dict[str, np.ndarray], n: int):
        self.sums, self.heads, self.tails, self.n = sums, heads, tails, n

    def total(self, a: str, i: int, p: int) -> float:
        return float(-self.heads[a][: p - i].sum() - self.tails[a][len(self.tails[a]) - i :].sum())

    def product(self, a: str, i: int, b: str, j: int, p: int) -> float:
        if i > j:
            a, i, b, j = b, j, a, i
        k = j - i
        out = self.sums[a + b][k]
        out -= self.heads[a][k : p - i] @ self.heads[b][: max(p - i - k, 0)]
        if i:
            ta, tb = self.tails[a], self.tails[b]
            out -= ta[len(ta) - i :] @ tb[len(tb) - i - k : len(tb) - k]
        return float(out)

    def matrix(self, p: int) -> np.ndarray:
        """Centred over the rows after the first p: the response's p lags, the driver's p lags, the response."""
        names = [("y", k) for k in range(1, p + 1)] + [("x", k) for k in range(1, p + 1)] + [("y", 0)]
        totals = np.array([self.total(a, i, p) for a, i in names])
        out = np.empty((len(names), len(names)))
        for r, (a, i) in enumerate(names):
            for c in range(r, len(names)):
                out[r, c] = out[c, r] = self.product(a, i, *names[c], p)
        return out - np.outer(totals, totals) / (self.n - p)


def lag_moments(panel: DataFrame, driver: str, response: str, max_lag: int, keys: Sequence[str], order: str) -> DataFrame:
    """One row per station: ``n_rows``, sums of products at distances 0 to ``max_lag``, first and last values.

    Both series are taken less their means, which changes no regression with a constant. The windows and the aggregate
    share one shuffle.
    """
    w, whole = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    values = {"y": response, "x": driver}
    rows = panel.filter(F.col(driver).isNotNull() & F.col(response).isNotNull()).select(
        *keys, *[(F.col(c).cast("double") - F.avg(c).over(whole)).alias(f"_{v}") for v, c in values.items()],
        F.row_number().over(w).alias("_at"), F.count(F.lit(1)).over(whole).alias("_n"), F.col(order).alias("_order"),
    )
    w = Window.partitionBy(*keys).orderBy("_order")
    ks = range(max_lag + 1)
    rows = rows.withColumns({f"_{v}{k}": F.lag(f"_{v}", k).over(w) for v in values for k in ks})

    def ends(v: str, near):
        return F.transform(F.sort_array(F.collect_list(F.when(near, F.struct("_at", F.col(f"_{v}").alias("value"))))), lambda s: s["value"])

    return rows.groupBy(*keys).agg(
        F.max("_n").alias("n_rows"),
        *[F.array(*[F.coalesce(F.sum(F.col(f"_{a}") * F.col(f"_{b}{k}")), F.lit(0.0)) for k in ks]).alias(a + b) for a in values for b in values],
        *[ends(v, F.col("_at") <= max_lag).alias(f"{v}_head") for v in values],
        *[ends(v, F.col("_at") > F.col("_n") - max_lag).alias(f"{v}_tail") for v in values],
    )


def granger(panel: DataFrame, driver: str, response: str, max_lag: int = MAX_LAG, keys: Sequence[str] = KEYS, order: str = "date") -> DataFrame:
    """``keys, lag, n_rows, f_stat, p_value`` for lags 1..max_lag of every station with enough rows.

    A lag counts rows that have both values. Left out are lags with no degree of freedom and responses that their own
    past and the driver's give exactly (to one part in 10**12).
    """
    keys = list(keys)
    pairs = [a + b for a in "yx" for b in "yx"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for station in pdf.to_dict("records"):
                numbers = {c: np.asarray(station[c], dtype=float) for c in (*pairs, "y_head", "x_head", "y_tail", "x_tail")}
                moments = Moments(
                    {c: numbers[c] for c in pairs}, {v: numbers[f"{v}_head"] for v in "yx"}, {v: numbers[f"{v}_tail"] for v in "yx"}, int(station["n_rows"])
                )
                for p in range(1, max_lag + 1):
                    n = moments.n - p
                    free = n - 2 * p - 1
                    if free < 1:
                        break
                    m = moments.matrix(p)
                    rss_r, rss_u = _residual(m, p), _residual(m, 2 * p)
                    if not rss_u > 1e-12 * m[-1, -1]:
                        continue
                    f = max(rss_r - rss_u, 0.0) / p / (rss_u / free)
                    rows.append((*[station[k] for k in keys], p, n, f, f_tail(f, p, free)))
            yield pd.DataFrame(rows, columns=[*keys, "lag", "n_rows", "f_stat", "p_value"])

    schema = T.StructType([panel.schema[k] for k in keys])
    schema = schema.add("lag", T.IntegerType()).add("n_rows", T.LongType()).add("f_stat", T.DoubleType()).add("p_value", T.DoubleType())
    return lag_moments(panel, driver, response, max_lag, keys, order).mapInPandas(run, schema)
