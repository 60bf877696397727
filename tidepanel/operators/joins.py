"""Dimension, key-set, as-of and lookup joins.

Small sides are left to the size-checked automatic broadcast of Spark; a hint is given only
for tables whose size is fixed (literal tables, one row, one row per partition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.functions import dates


def attach_dimension(fact: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join a dimension; columns it brings replace those of the same name."""
    overlap = [c for c in dim.columns if c in fact.columns and c not in keys]
    first = dim.groupBy(*keys).agg(F.min(F.struct(*[c for c in dim.columns if c not in keys])).alias("_d"))
    return fact.drop(*overlap).join(first, list(keys), "left").select("*", "_d.*").drop("_d")


def keep_keys(fact: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return fact.join(keys.select(*on), list(on), "left_semi")


def drop_keys(fact: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return fact.join(keys.select(*on), list(on), "left_anti")


def flag_members(fact: DataFrame, keys: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    marks = keys.select(*on).distinct().withColumn(flag, F.lit(True))
    return fact.join(marks, list(on), "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_ts: str,
    right_ts: str,
    tolerance: str = "7 days",
    age: str = "age_hours",
    bucket: str = "hour",
) -> DataFrame:
    """Backward as-of join: each left row gets the latest whole right row at or before it.

    Equal times match, the tolerance is inclusive, and nulls inside the matched row stay null.

    Rows are never gathered per key. Both sides are first reduced to one row per key and
    time (copies collapse before the shuffle), then matched inside one key and one hour; what
    reaches into an hour from earlier ones comes from a table of the last row of every hour,
    which a calendar bounds. The matched times are joined back to the left rows by equality.
    """
    by = list(by)
    payload = [c for c in right.columns if c not in by and c != right_ts]
    obs = (
        right.filter(F.col(right_ts).isNotNull())
        .groupBy(*by, F.col(right_ts).alias("_t"))
        .agg(F.max(F.struct(F.col(right_ts).alias("_at"), *payload)).alias("_m"))
    )
    probes = left.filter(F.col(left_ts).isNotNull()).select(*by, F.col(left_ts).alias("_t")).distinct()
    nothing = F.lit(None).cast(obs.schema["_m"].dataType)
    moments = (
        obs.withColumn("_tag", F.lit(0))
        .unionByName(probes.withColumns({"_m": nothing, "_tag": F.lit(1)}))
        .withColumn("_slot", F.date_trunc(bucket, "_t"))
    )
    inside = Window.partitionBy(*by, "_slot").orderBy("_t", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    tails = (
        moments.groupBy(*by, "_slot")
        .agg(F.max("_m").alias("_tail"))
        .withColumn("_carry", F.last("_tail", ignorenulls=True).over(before))
        .select(*by, "_slot", "_carry")
    )
    matched = (
        moments.withColumn("_in", F.last("_m", ignorenulls=True).over(inside))
        .filter(F.col("_tag") == 1)
        .join(tails, [*by, "_slot"])
        .withColumn("_hit", F.coalesce("_in", "_carry"))
        .filter(F.col("_hit._at") + F.expr(f"INTERVAL {tolerance}") >= F.col("_t"))
        .select(*by, F.col("_t").alias(left_ts), "_hit")
    )
    hit = left.join(matched, [*by, left_ts], "left")
    return hit.select(
        *[F.col(c) for c in left.columns],
        *[F.col(f"_hit.{c}").alias(c) for c in payload],
        F.col("_hit._at").alias(right_ts),
        dates.hours_between(F.col(left_ts), F.col("_hit._at")).alias(age),
    )


def lookup_fill(fact: DataFrame, lookup: DataFrame, on: Sequence[str], value: str, fallback: Column, out: str) -> DataFrame:
    """Map rows through a keyed value, with a fallback where the key is unknown."""
    return fact.join(lookup.select(*on, F.col(value).alias(out)), list(on), "left").withColumn(
        out, F.coalesce(F.col(out), fallback)
    )


def minus_reference(df: DataFrame, by: Sequence[str], scenario: str, reference: str, values: Sequence[str]) -> DataFrame:
    """Difference of each value to the same group's reference-scenario row."""
    ref = df.filter(F.col(scenario) == reference).select(*by, *[F.col(v).alias(f"_{v}") for v in values])
    return (
        df.join(ref, list(by), "left")
        .withColumns({f"{v}_delta": F.col(v) - F.col(f"_{v}") for v in values})
        .drop(*[f"_{v}" for v in values])
    )
