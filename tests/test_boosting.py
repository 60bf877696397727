"""Boosted trees against MLlib's own, the patience of the source's estimator, and whole fits in the queries."""

import inspect

import numpy as np
import pytest
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tidepanel.operators import boosting, models
from tidepanel.plans import modelling


@pytest.fixture(scope="module")
def rows(spark):
    """Two numbers with zeros and signs, a hot column per place, and weights."""
    df = spark.range(900).selectExpr(
        "id", "cast(id * 37 % 61 as double) a", "cast(id * 17 % 23 - 8 as double) b", "id * 7919 % 40 as c", "1.0 + id % 3 as w",
        "sin(id * 37 % 61 / 9.0) * 5 + id * 17 % 23 + if(id * 7919 % 40 in (3, 17, 25), 6, 0) + (id * 13 % 7) / 3.0 as y",
    )
    df = OneHotEncoder(inputCols=["c"], outputCols=["hot"]).fit(df).transform(df)
    return VectorAssembler(inputCols=["a", "b", "hot"], outputCol="features").transform(df).persist()


@pytest.mark.parametrize("weight", [None, "w"])
def test_trees_are_those_of_mllib(rows, weight):
    plain = GBTRegressor(labelCol="y", maxIter=4, maxDepth=3, stepSize=models.LEARNING_RATE, maxBins=models.BINS, minInstancesPerNode=3)
    want = (plain.setWeightCol(weight) if weight else plain).fit(rows)
    got = models.fit_gbt(rows, "y", weight, 4, 3, 3)
    assert got.getNumTrees == 4 and list(got.treeWeights) == list(want.treeWeights)
    both = want.transform(rows).select("id", F.col("prediction").alias("p")).join(got.transform(rows).select("id", "prediction"), "id")
    assert both.agg(F.max(F.abs(F.col("p") - F.col("prediction")))).first()[0] < 1e-9
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray())


def test_boosting_goes_on_while_rounds_help(spark):
    """A round that lowers the error by less than a hundredth doesn't end boosting; ten rounds without any gain do."""
    df = spark.range(400).selectExpr("cast(id % 20 as double) x", "cast(id % 20 as double) + (id * 7919 % 11) / 4 as y", "id")
    ready = models.assemble(df, {"x": 0.0})
    assert models.fit_gbt(ready, "y", None, 60, 1, stop_early=True).getNumTrees == 60
    noise = models.assemble(spark.range(400).selectExpr("cast(id as double) x", "cast(id * 7919 % 11 as double) as y"), {"x": 0.0})
    few = models.fit_gbt(noise, "y", None, 60, 4, stop_early=True).getNumTrees
    assert boosting.PATIENCE < few < 60
    assert models.fit_gbt(noise, "y", None, 60, 4, stop_early=False).getNumTrees == 60


def test_tables_beyond_a_task_are_fitted_by_mllib(spark, monkeypatch):
    noise = models.assemble(spark.range(300).selectExpr("cast(id % 50 as double) x", "cast(id * 7919 % 11 as double) as y"), {"x": 0.0})
    here = models.fit_gbt(noise, "y", None, 14, 3, stop_early=True)
    monkeypatch.setattr(boosting, "HELD", 0)
    there = models.fit_gbt(noise, "y", None, 14, 3, stop_early=True)
    assert here.getNumTrees == there.getNumTrees
    assert np.allclose([r[0] for r in here.transform(noise).orderBy("x", "y").select("prediction").collect()], [r[0] for r in there.transform(noise).orderBy("x", "y").select("prediction").collect()])


def test_bins_of_many_values_and_of_none(spark):
    assert list(boosting.cuts_of(np.array([1.0, 2.0, 4.0]), np.ones(3), 5)) == [1.5, 3.0]
    values = np.arange(100.0)
    cuts = boosting.cuts_of(values, np.ones(100), 9)
    assert len(cuts) == 9 and np.allclose(np.diff(cuts), 10, atol=1)
    flat = models.fit_gbt(models.assemble(spark.range(20).selectExpr("cast(0 as double) x", "cast(id as double) y"), {"x": 0.0}), "y", None, 2, 3)
    assert flat.totalNumNodes == 2 and [r[0] for r in flat.transform(models.assemble(spark.range(1).selectExpr("1d as x"), {"x": 0.0})).select("prediction").collect()] == [9.5]
    with pytest.raises(ValueError, match="no rows"):
        models.fit_gbt(models.assemble(spark.range(0).selectExpr("1d as x", "1d as y"), {"x": 0.0}), "y", None, 2, 3)


def test_importance_comes_from_a_whole_fit(spark, sf, monkeypatch):
    """The query boosts as many rounds, and as deep, as the daily models do."""
    asked = []
    bound = inspect.signature(models.fit_gbt)
    monkeypatch.setattr(models, "fit_gbt", lambda *a, **k: asked.append(bound.bind(*a, **k)) or (_ for _ in ()).throw(KeyError("enough")))
    with pytest.raises(KeyError):
        modelling.feature_importance(spark, sf)
    asked[0].apply_defaults()
    assert tuple(asked[0].arguments[k] for k in ("rounds", "depth", "leaf")) == models.GBT_DAILY and asked[0].arguments["stop_early"] is None
