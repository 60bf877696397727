"""Row-wise cleaning: names, keys, units, repairs and derived columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidepanel.functions import dates, text

# Readable names of the measures.
MEASURE_NAMES = {
    "w_temp_c": "water_temp",
    "w_sal_psu": "salinity",
    "w_do_mg_l": "oxygen",
    "w_do_pct": "oxy_saturation",
    "depth_m": "depth",
    "w_ph": "ph",
    "m_wind_ms": "wind_speed",
    "m_ssrd_kwh_m2": "solar_radiation",
    "m_precip_mmh": "precipitation",
    "m_temp_c": "air_temp",
}

# Unit conversions, target = source * times / over + plus.
UNIT_RULES = [
    ("m_era5_air_temp_k", "m_era5_air_temp_c", 1.0, 1.0, -273.15),
    ("m_era5_ssrd_j_m2", "m_era5_ssrd_kwh_m2", 1.0, 3600000.0, 0.0),
    ("m_era5_precip_m", "m_precip_mmh", 1000.0, 1.0, 0.0),
    ("pr_kg_m2_s", "precip_mm_day", 86400.0, 1.0, 0.0),
]


def rename_measures(df: DataFrame, names: dict[str, str] = MEASURE_NAMES) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[text.header_name(c) for c in df.columns])


def trim_text(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.trim(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def coerce_numbers(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: text.number(F.col(c).cast("string")) for c in columns if c in df.columns})


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def drop_duplicates_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row per key in a stated order.

    The smallest order struct is a partial aggregate, so copies collapse before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(pick).select(*keys, "_row.*").select(*df.columns)


def full_hour_rows(df: DataFrame, text_col: str, file_class: Column | None = None, out: str = "ts") -> DataFrame:
    """Keep readings taken on the full hour; classes other than ``wq`` are exempt."""
    parsed = dates.parse_timestamp(F.col(text_col))
    keep = F.coalesce(dates.is_full_hour(parsed), F.lit(False))
    if file_class is not None:
        keep = keep | (file_class != "wq")
    return df.filter(keep).withColumn(out, parsed)


def hour_filter(df: DataFrame, ts: str, hours: Sequence[int] = (8, 20)) -> DataFrame:
    return df.filter(F.hour(ts).isin(*hours))


def convert_units(df: DataFrame, rules=UNIT_RULES, drop_source: bool = True) -> DataFrame:
    """Apply every rule whose source column exists; a temperature or energy source is dropped."""
    rules = [r for r in rules if r[0] in df.columns]
    out = df.withColumns({dst: text.number(F.col(src).cast("string")) * k / q + b for src, dst, k, q, b in rules})
    return out.drop(*[r[0] for r in rules]) if drop_source else out


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def first_of(df: DataFrame, sources: Sequence[tuple[str, str]], value: str, label: str) -> DataFrame:
    """Coalesce sensors in order of preference and say which one was used."""
    present = [(c, tag) for c, tag in sources if c in df.columns]
    tag = F.lit(None).cast("string")
    for c, name in reversed(present):
        tag = F.when(F.col(c).isNotNull(), name).otherwise(tag)
    return df.withColumns({value: F.coalesce(*[F.col(c) for c, _ in present]), label: tag})


def first_available(df: DataFrame, candidates: Sequence[str], fill: object) -> Column:
    present = [F.col(c) for c in candidates if c in df.columns]
    return F.coalesce(*present, F.lit(fill))


def older_unit_column(df: DataFrame, new: str, old: str, divisor: float = 3600000.0) -> DataFrame:
    """Derive ``new`` from the older unit where it is absent, then drop the older column."""
    if old not in df.columns:
        return df
    derived = text.number(F.col(old).cast("string")) / divisor
    value = F.coalesce(F.col(new), derived) if new in df.columns else derived
    return df.withColumn(new, value).drop(old)


def keep_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])


def drop_matching(df: DataFrame, prefixes: Sequence[str] = (), suffixes: Sequence[str] = (), names: Sequence[str] = ()) -> DataFrame:
    return df.drop(
        *[
            c
            for c in df.columns
            if c.startswith(tuple(prefixes)) or c.endswith(tuple(suffixes)) or c in names
        ]
    )


def split_complete(df: DataFrame, nutrient_columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Complete cases with every column, and the broader table without the nutrients."""
    return df.dropna(), df.drop(*[c for c in nutrient_columns if c in df.columns])


def calendar_features(df: DataFrame, date: str = "date") -> DataFrame:
    d = F.col(date)
    return df.withColumns(
        {
            "year": F.year(d),
            "month_num": F.month(d),
            "doy": F.dayofyear(d),
            "is_warm_season": dates.is_warm(d),
            "doy_sin": F.sin(dates.day_angle(d)),
            "doy_cos": F.cos(dates.day_angle(d)),
            "month_sin": F.sin(dates.month_angle(d)),
            "month_cos": F.cos(dates.month_angle(d)),
        }
    )


def driver_interactions(df: DataFrame, baseline: str = "water_temp_baseline") -> DataFrame:
    """Differences and products of the driver columns that are present."""
    pairs = [
        ("air_temp_minus_water_temp_baseline", "air_temp", baseline, "-"),
        ("air_temp_r7d_minus_water_temp_baseline", "air_temp_r7d", baseline, "-"),
        ("air_temp_r28d_minus_water_temp_baseline", "air_temp_r28d", baseline, "-"),
        ("air_temp_r1d_minus_air_temp_r28d", "air_temp_r1d", "air_temp_r28d", "-"),
        ("air_temp_r7d_minus_air_temp_r28d", "air_temp_r7d", "air_temp_r28d", "-"),
        ("wind_speed_x_air_temp", "wind_speed", "air_temp", "*"),
        ("solar_x_air_temp", "solar", "air_temp", "*"),
    ]
    out = {}
    for name, a, b, op in pairs:
        if a in df.columns and b in df.columns:
            out[name] = F.col(a) - F.col(b) if op == "-" else F.col(a) * F.col(b)
    return df.withColumns(out)


def state_label(c: Column, low: float = 5.0, high: float = 20.0) -> Column:
    return F.when(c < low, "low").when(c < high, "moderate").when(c >= high, "bloom")


def unit_bins(df: DataFrame, column: str, width: float = 1.0) -> DataFrame:
    """Left-closed bins up to the ceiling of the maximum; the top edge itself gets no bin."""
    top = df.agg(F.ceil(F.max(F.col(column) / width)).alias("top")).scalar()
    scaled = F.col(column) / width
    return df.filter(F.col(column).isNotNull() & (scaled < top)).withColumn("bin", F.floor(scaled) * width)


def ordered_category(df: DataFrame, column: str, by: str) -> DataFrame:
    """Ordinal per category in order of its smallest ``by``; one row per category is ranked."""
    ranks = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(by).alias("_by"))
    w = Window.orderBy("_by", column)  # one row per category
    ranks = ranks.select(column, (F.row_number().over(w) - 1).alias(f"{column}_ord"))
    return df.join(ranks, column, "left")


def fill_flags(df: DataFrame, zero: Sequence[str] = (), false: Sequence[str] = ()) -> DataFrame:
    fills = {c: F.coalesce(F.col(c), F.lit(0)) for c in zero}
    fills.update({c: F.coalesce(F.col(c), F.lit(False)) for c in false})
    return df.withColumns(fills)


def absolute_from_delta(df: DataFrame, measures: Sequence[str], suffix: str = "_pred") -> DataFrame:
    return df.withColumns({f"{m}_abs": F.col(f"{m}_baseline") + F.col(f"delta_{m}{suffix}") for m in measures})
