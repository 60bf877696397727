"""Station dimension built from a station list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.ordered import quantile_columns


def mode_per_group(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per group; a tie goes to the smallest value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*group).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def station_coordinates(df: DataFrame, code: str = "station_code_full") -> DataFrame:
    """Median position and counts of rows, names and positions per station."""
    medians = quantile_columns(df, ["station"], {"latitude": ("latitude", 0.5), "longitude": ("longitude", 0.5)})
    pairs = df.select("station", "station_name", "latitude", "longitude", code).groupBy(
        "station", "station_name", "latitude", "longitude"
    ).agg(F.count(code).alias("_n"))
    counts = pairs.groupBy("station").agg(
        F.sum("_n").alias("n_source_rows"),
        F.count_distinct("station_name").alias("n_unique_station_names"),
        F.count_distinct(F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), F.struct("latitude", "longitude"))).alias(
            "n_unique_coordinate_pairs"
        ),
        F.count_distinct("latitude").alias("n_unique_latitudes"),
    )
    return counts.join(medians, "station", "left").withColumns(
        {c: F.round(c, 6) for c in ("latitude", "longitude")}
    )


def code_variants(df: DataFrame, code: str = "station_code_full") -> DataFrame:
    """Sorted different codes of a station joined by a bar."""
    distinct = df.select("station", code).distinct()
    return distinct.groupBy("station").agg(
        F.array_join(F.sort_array(F.collect_list(code)), "|").alias("station_code_full_variants")
    )


def with_history_flag(index: DataFrame, keys: DataFrame, on: Sequence[str], flag: str = "in_history") -> DataFrame:
    marks = keys.select(*on).distinct().withColumn(flag, F.lit(True))
    return index.join(marks, list(on), "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def build_station_index(stations: DataFrame, history_keys: DataFrame | None = None) -> DataFrame:
    index = (
        station_coordinates(stations)
        .join(mode_per_group(stations, ["station"], "region_code"), "station", "left")
        .join(mode_per_group(stations, ["region_code"], "region_name"), "region_code", "left")
        .join(mode_per_group(stations, ["station"], "station_name"), "station", "left")
        .join(code_variants(stations), "station", "left")
    )
    if history_keys is None:
        return index.withColumn("in_history", F.lit(False))
    return with_history_flag(index, history_keys, ["region_code", "station"])
