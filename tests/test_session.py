"""The shared folder, and the package on the workers."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidepanel import session
from tidepanel.operators import models, rolling

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_a_cluster_needs_a_shared_folder():
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="yarn", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context))


def test_only_local_masters_are_local():
    assert session.is_local("local[4]") and session.is_local("local") and not session.is_local("local-cluster[2,1,1024]") and not session.is_local("spark://a:7077")


def test_workers_find_the_package_from_a_foreign_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {REPO!r})
from tidepanel.session import build_session
spark = build_session("foreign", "local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
def where(batches):
    import tidepanel.operators.joins as m
    for b in batches:
        yield b.assign(path=m.__file__)
print(spark.range(2).mapInPandas(where, "id long, path string").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("2"), out.stderr[-2000:]


def test_first_place_level_is_dropped(spark):
    rows = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "region string, station string")
    got = {r["region"]: (r["region_hot"].size, r["region_hot"].toArray().sum(), r["station_hot"].size) for r in models.place_encoder(["region", "station"]).fit(rows).transform(rows).collect()}
    assert got == {"a": (2, 0.0, 1), "b": (2, 1.0, 1), "c": (2, 1.0, 1)}


def test_rolling_years_never_reach_over_a_gap(spark):
    rows = spark.createDataFrame([(1, y, float(v)) for y, v in [(2000, 1), (2001, 2), (2002, 3), (2010, 10), (2011, 20), (2012, 30)]], "k int, year int, v double")
    got = {r["year"]: r["m"] for r in rolling.rolling_years(rows, {"v": "m"}, keys=["k"]).collect()}
    assert got == {2000: None, 2001: None, 2002: 2.0, 2010: None, 2011: None, 2012: 20.0}


def test_fits_side_by_side_keep_their_order(spark):
    frames = models.side_by_side(lambda k: spark.range(k).select(F.lit(k).alias("k")), [3, 1, 2])
    assert [f.count() for f in frames] == [3, 1, 2]


def test_groups_of_large_tables_are_dealt_by_their_rows(spark):
    """A table of many rows gets partitions by its rows, a small one keeps its plan."""
    df = spark.range(100).selectExpr("id", "id % 10 as k")
    assert session.sized(df, 4 * session.ROWS_A_TASK, ["k"]) is df
    assert session.sized(df, 30 * session.ROWS_A_TASK, ["k"]).rdd.getNumPartitions() == 30
    by_key = session.sized(df, 30 * session.ROWS_A_TASK, ["k"]).groupBy("k", "id").count()
    assert by_key._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
