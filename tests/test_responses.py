"""What a response model reads and keeps."""

import numpy as np
from pyspark.sql import functions as F

from tidepanel.operators import models
from tidepanel.plans import stages


def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (60, 2))
    return spark.createDataFrame([("R", i % 6, float(a), float(b), float(2 * a - b)) for i, (a, b) in enumerate(x)], "region string, station int, a double, b double, y double")


def test_least_squares_hash_no_row_and_keep_no_vectors(spark, monkeypatch):
    def unwanted(df):
        raise AssertionError("least squares read no hashes")

    calibrated = models.fit_response(rows(spark), ["a", "b"], "y", calibrate=True)
    monkeypatch.setattr(models, "row_hashes", unwanted)
    spark.catalog.clearCache()
    found = models.fit_response(rows(spark), ["a", "b"], "y")
    assert np.allclose(found.model.coefficients, calibrated.model.coefficients)
    assert np.allclose(found.model.coefficients, [2, -1], atol=0.1)


def test_only_the_wanted_targets_are_fitted(spark):
    names = {c for t in stages.RESPONSES for c in (t.column, *t.features)}
    rng = np.random.default_rng(3)
    data = [(*map(float, rng.normal(0, 1, len(names))), True, True, "train") for _ in range(40)]
    years = spark.createDataFrame(data, ", ".join([*[f"{c} double" for c in sorted(names)], "has_model_year boolean, has_warm_oxygen_year boolean, cohort string"]))
    wanted = [t for t in stages.RESPONSES if t.name == "delta_oxygen"]
    assert set(stages.fit_chemistry(years, wanted)) == {"delta_oxygen"}


def test_screened_days_are_stored_once_at_most(spark, sf, monkeypatch):
    """The query over screened days stores none; a linear temperature model adds to stored days without storing them again."""
    stored = []
    monkeypatch.setattr(stages, "staged", lambda df: stored.append(df.columns) or df)
    assert "water_temp" in stages.screened_days_query(spark, sf).columns and not stored
    kinds = {"region": "r", "station": 1, "cohort": "train", "has_model_year": True, "has_warm_oxygen_year": True}
    days = spark.range(60).select(
        *[
            F.lit(kinds[c]).alias(c) if c in kinds else F.expr("date_add(date'2001-01-01', cast(id as int))").alias(c) if c == "date" else ((F.col("id") * (7 + i) % 31) / 3.0).alias(c)
            for i, c in enumerate(stages.DAY_COLUMNS)
        ]
    )
    _, scored, years = stages.fit_temperature(days)
    assert len(stored) == 1 and "delta_water_temp_pred_mean" in stored[0]
    assert scored.count() == 60 and years.count() == 1
    assert scored.filter("delta_water_temp_pred is null").count() == 0
