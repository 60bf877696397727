"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepanel.plans import cleaning, files, modelling, regimes, relations, rollups, scenarios, stages, streams, windows  # noqa: F401
from tidepanel.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["asof_7d"](spark, sf_dir)
