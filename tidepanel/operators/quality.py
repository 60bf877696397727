"""Range limits, quality flags, completeness and column profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import stats

# Physical limits of each measure, inclusive.
RANGE_LIMITS = {
    "n_nh4f_mg_l": (0, 1000),
    "n_no2f_mg_l": (0, 1000),
    "n_no3f_mg_l": (0, 1000),
    "n_po4f_mg_l": (0, 1000),
    "n_no23f_mg_l": (0, 1000),
    "n_chla_ug_l": (0, 1000),
    "w_temp_c": (-5, 45),
    "m_nerrs_air_temp_c": (-40, 60),
    "m_era5_air_temp_c": (-40, 60),
    "w_ph": (0, 14),
    "w_sal_psu": (0, 60),
    "w_do_pct": (0, 300),
    "w_do_mg_l": (0, 30),
    "w_depth_m": (0, 100),
    "w_cdepth_m": (0, 100),
    "w_level_m": (-10, 10),
    "w_clevel_m": (-10, 10),
    "w_turb_ntu": (0, 5000),
    "w_chlfluor_au": (0, 1000),
    "m_nerrs_solar_rad_w_m2": (0, 1500),
    "m_nerrs_par_umol_m2_s": (0, 3000),
    "m_nerrs_precip_mm": (0, 500),
}

# Quality-flag codes, their meanings and their groups.
FLAG_MEANINGS = {
    -5: "Beyond Sensor Range",
    -4: "Suspicious/Questionable",
    -3: "Corrected Data",
    -2: "Missing Data",
    -1: "Optional/Not Collected",
    0: "Passed Initial QAQC",
    1: "Suspect Data",
    2: "Reserved",
    3: "Rejected Data",
    4: "Corrected/Calculated Data",
    5: "Estimated Value",
}
GOOD_FLAGS = [0, -3, 4, 5]
BAD_FLAGS = [-5, -4, 1, 3]
MISSING_FLAGS = [-2, -1]
RESERVED_FLAGS = [2]
REJECTED_FLAG = 3
# Limits between low, mid and high absolute correlation.
CORR_BANDS = (0.30, 0.60)


def present_limits(df: DataFrame, limits: dict = RANGE_LIMITS) -> dict:
    return {c: b for c, b in limits.items() if c in df.columns}


def _out_of_range(c: str, low: float, high: float) -> Column:
    return F.col(c).isNotNull() & ~F.col(c).between(low, high)


def clamp_ranges(df: DataFrame, limits: dict = RANGE_LIMITS) -> DataFrame:
    return df.withColumns(
        {c: F.when(F.col(c).between(low, high), F.col(c)) for c, (low, high) in present_limits(df, limits).items()}
    )


def _log(df: DataFrame, rows: dict[str, dict[str, Column]], name: str) -> DataFrame:
    """One scan that computes every aggregate, laid out as one row per entry of ``rows``."""
    cells = [
        F.struct(F.lit(key).alias(name), *[v.alias(k) for k, v in values.items()]) for key, values in rows.items()
    ]
    return df.agg(F.array(*cells).alias("_rows")).select(F.explode("_rows").alias("_r")).select("_r.*")


def clamp_log(df: DataFrame, limits: dict = RANGE_LIMITS) -> DataFrame:
    rows = {
        c: {
            "low_ok": F.lit(float(low)),
            "high_ok": F.lit(float(high)),
            "n_set_to_missing": F.count_if(_out_of_range(c, low, high)),
        }
        for c, (low, high) in present_limits(df, limits).items()
    }
    return _log(df, rows, "column")


def flag_review(long: DataFrame, variable: str = "variable", value: str = "value", flag: str = "flag") -> DataFrame:
    """Flag counts per variable of a long (variable, value, flag) table."""
    f = F.col(flag)
    bad = F.coalesce(f.isin(BAD_FLAGS), F.lit(False))
    has = F.col(value).isNotNull()
    return long.groupBy(variable).agg(
        F.count_if(has).alias("non_null_values"),
        F.count_if(f.isin(GOOD_FLAGS)).alias("good_or_corrected_flags"),
        F.count_if(bad).alias("bad_or_questionable_flags"),
        F.count_if(f.isin(MISSING_FLAGS)).alias("missing_like_flags"),
        F.count_if(f.isin(RESERVED_FLAGS)).alias("reserved_flags"),
        F.round(100 * F.avg(bad.cast("double")), 3).alias("pct_bad_or_questionable"),
        F.round(100 * F.avg(F.when(has, bad.cast("double"))), 3).alias("pct_bad_when_value_present"),
    )


def flags_long(df: DataFrame, pairs: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Wide value / flag column pairs to one row per reading and variable."""
    cells = [
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value"), F.col(f).cast("int").alias("flag"))
        for v, f in pairs.items()
        if v in df.columns and f in df.columns
    ]
    return df.select(*keep, F.explode(F.array(*cells)).alias("_c")).select(*keep, "_c.*")


def row_corruption(df: DataFrame, flags: Sequence[str], threshold: int = 2) -> DataFrame:
    """Per row: bad and missing-like core flags, any rejection, and the verdict."""
    present = [f for f in flags if f in df.columns]

    def count(codes: Sequence[int]) -> Column:
        return stats.total([F.when(F.col(f).isin(list(codes)), 1).otherwise(0) for f in present])

    out = df.withColumns(
        {
            "n_bad_flags_row": count(BAD_FLAGS),
            "n_missing_like_flags_row": count(MISSING_FLAGS),
            "n_reserved_flags_row": count(RESERVED_FLAGS),
            "has_rejected_flag": count([REJECTED_FLAG]) > 0,
        }
    ).withColumn("n_bad_or_missing_flags_row", F.col("n_bad_flags_row") + F.col("n_missing_like_flags_row"))
    return out.withColumn(
        "is_highly_corrupted_record", F.col("has_rejected_flag") | (F.col("n_bad_or_missing_flags_row") >= threshold)
    )


def null_bad_values(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Values whose flag is bad become missing; an absent flag keeps the value."""
    return df.withColumns(
        {
            v: F.when(F.col(f).isNull() | ~F.col(f).isin(BAD_FLAGS), F.col(v))
            for v, f in pairs.items()
            if v in df.columns and f in df.columns
        }
    )


def null_log(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    rows = {
        v: {"flag_col": F.lit(f), "n_bad_flag_rows": F.count_if(F.col(f).isin(BAD_FLAGS))}
        for v, f in pairs.items()
        if v in df.columns and f in df.columns
    }
    return _log(df, rows, "value_col")


def column_profile(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Filled share and whether more than one value occurs, per column, with the reason it is dead weight.

    "More than one value" is read from the smallest and largest value, so no distinct
    count (and no copy of the rows per column) is needed.
    """
    rows = {
        c: {
            "non_null": F.count(F.col(c)),
            "n_rows": F.count(F.lit(1)),
            "single_value": F.coalesce(F.min(F.col(c).cast("string")) == F.max(F.col(c).cast("string")), F.lit(True)),
        }
        for c in df.columns
        if c not in skip
    }
    pct = 100 * F.col("non_null") / F.col("n_rows")
    return _log(df, rows, "column").select(
        "column",
        "non_null",
        F.round(pct, 3).alias("pct_non_null"),
        "single_value",
        F.when(F.col("single_value"), "constant_or_single_value")
        .when(pct < 1, "less_than_1pct_filled")
        .alias("why_flagged"),
    )


def distinct_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact number of different values per column, hot values collapsed before the shuffle."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns]
    long = df.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*").filter(F.col("v").isNotNull())
    return long.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("distinct_non_null"))


def drop_dead_weight(df: DataFrame, protected: Sequence[str] = ()) -> DataFrame:
    """Drop columns with one value or under one percent filled (one row per column is read back)."""
    profile = column_profile(df, protected).filter(F.col("why_flagged").isNotNull())
    return df.drop(*[r["column"] for r in profile.collect()])


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or df.columns)
    rows = {
        c: {"non_null": F.count(F.col(c)), "missing": F.count(F.lit(1)) - F.count(F.col(c)), "n_rows": F.count(F.lit(1))}
        for c in columns
    }
    return _log(df, rows, "column").select(
        "column",
        "non_null",
        "missing",
        F.round(100 * F.col("non_null") / F.col("n_rows"), 3).alias("pct_non_null"),
        (F.col("non_null") == 0).alias("fully_empty"),
    )


def readiness(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Rows in which every column of a named group is present."""
    rows = {
        name: {"n_rows": F.count(F.lit(1)), "n_ready": F.count_if(stats.all_present(cols))}
        for name, cols in groups.items()
    }
    return _log(df, rows, "column_group")


def corruption_rate(df: DataFrame, ts: str, region: str, flag: str) -> DataFrame:
    """Monthly share of flagged rows per region, labelled by the last day of the month."""
    return (
        df.filter(F.col(ts).isNotNull() & F.col(region).isNotNull())
        .groupBy(region, F.last_day(F.col(ts).cast("date")).alias("month_end"))
        .agg(F.avg(F.col(flag).cast("double")).alias("corrupted_share"))
    )


def correlation_pairs(df: DataFrame, columns: Sequence[str], min_filled: float = 0.10) -> DataFrame:
    """Upper triangle of the correlation matrix with a strength band, from one scan."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    filled = {c: F.count(F.col(c)) / F.count(F.lit(1)) for c in columns}
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("var_a"),
                F.lit(b).alias("var_b"),
                F.corr(a, b).alias("corr"),
                F.least(filled[a], filled[b]).alias("_filled"),
            )
            for a, b in pairs
        ]
    )
    size = F.abs("corr")
    return (
        df.agg(rows.alias("_rows"))
        .select(F.explode("_rows").alias("_r"))
        .select("_r.*")
        .filter(F.col("_filled") >= min_filled)
        .withColumn(
            "band",
            F.when(size < CORR_BANDS[0], "low").when(size < CORR_BANDS[1], "mid").otherwise("high"),
        )
        .drop("_filled")
    )


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per column; exact quartiles at any size."""
    from tidepanel.operators.ordered import exact_quantiles

    rows = {
        c: {
            "n": F.count(F.col(c)),
            "mean": F.avg(c),
            "std": F.stddev_samp(c),
            "min": F.min(F.col(c).cast("double")),
            "max": F.max(F.col(c).cast("double")),
        }
        for c in columns
    }
    basic = _log(df, rows, "variable")
    quart = (
        exact_quantiles(df, [], columns, [0.25, 0.5, 0.75])
        .groupBy("variable")
        .agg(
            *[
                F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
                for p, n in [(0.25, "q25"), (0.5, "q50"), (0.75, "q75")]
            ]
        )
    )
    return basic.join(quart, "variable", "left")
