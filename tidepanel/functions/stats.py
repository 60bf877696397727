"""Aggregate and row expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def steady(c: Column) -> Column:
    """A computed value at nine places, for comparing it with a limit.

    The last bits of a distributed sum depend on the order in which parts arrive; without
    this a mean that equals the limit could fall on either side from run to run.
    """
    return F.round(c, 9)


def share_below(c: Column, threshold: float) -> Column:
    """Share of the present values below the threshold."""
    return F.avg((steady(c) < threshold).cast("double"))


def fraction_below(c: Column, threshold: Column | float) -> Column:
    """Share of all rows below the threshold; a missing value is not below."""
    return F.avg(F.coalesce(steady(c) < threshold, F.lit(False)).cast("double"))


def amplitude(c: Column | str) -> Column:
    return F.max(c) - F.min(c)


def sum_or_zero(c: Column | str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def any_present(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])


def all_present(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def total(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, list(columns))


def months_with(mask: Column, month: Column) -> Column:
    """Number of different months among the rows where ``mask`` holds.

    One bit per month keeps this a plain aggregate; a distinct count would copy the rows.
    """
    bit = F.when(mask, F.expr("1L")).otherwise(F.lit(None).cast("bigint"))
    shifted = F.call_function("shiftleft", bit, month.cast("int"))
    return F.bit_count(F.coalesce(F.bit_or(shifted), F.lit(0).cast("bigint")))


def one_row(df: DataFrame) -> Column:
    """A one-row table as a single struct value, computed once wherever it is used."""
    return df.select(F.struct(*df.columns)).scalar()


def literal_row(df: DataFrame) -> dict[str, Column]:
    """A one-row table as literals: it is computed once, and plans that use it don't contain it."""
    row = df.first()
    types = {f.name: f.dataType for f in df.schema.fields}
    return {c: F.lit(None if row is None else row[c]).cast(types[c]) for c in df.columns}


def nan_to_null(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c)).alias(c)
