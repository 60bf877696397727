"""The driver contract, streaming against batch, and sources on the small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tidepanel.operators import rollup
from tidepanel.session import scratch_path
from tidepanel.sources import io
from tidepanel.sources.panels import events_panel, table
from tidepanel.streaming import jobs

SMALL = ["daily_rollup", "asof_7d", "missing_runs", "flag_review", "station_year_quality", "rolling_5y_months", "nearest_analog", "regime_crossings", "scenario_summary"]


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", SMALL)
def test_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = contract.queries()[name](spark, sf)
    cols = sorted(df.columns)
    cur = con.execute(contract.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(str(tuple(r[i] for i in at)) for r in cur.fetchall())
    got = sorted(str(tuple(r)) for r in df.select(*cols).collect())
    assert got == want and want


def test_stream_resumes_and_equals_batch(spark, sf):
    """Unordered files, one per trigger, the second half of them after the first call has ended."""
    path, root = scratch_path(spark, "in"), scratch_path(spark, "bins")
    events = table(spark, sf, "events")
    for k, order in enumerate((F.desc("ts"), F.xxhash64("event_id"))):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == k).repartitionByRange(3, order).write.mode("append").parquet(path)
        stream = jobs.read_files(spark, path, events.schema, per_trigger=1).select(F.col("user_id").alias("station"), "ts", "value")
        got = jobs.downsample(stream, root, ["station"], "ts", "4 hours", ["value"])
    streamed = {(r["station"], r["ts"]): round(r["value"], 9) for r in got.collect()}
    batch = {(r["station"], r["ts"]): round(r["value"], 9) for r in rollup.downsample(events_panel(spark, sf), ["station"], "ts", "4 hours", ["value"]).collect()}
    assert streamed == batch and batch
    again = jobs.downsample(jobs.read_files(spark, path, events.schema).select(F.col("user_id").alias("station"), "ts", "value"), root, ["station"], "ts", "4 hours", ["value"])
    assert again.count() == len(batch)


def test_stream_keys_over_several_files(spark, sf):
    path = scratch_path(spark, "in")
    table(spark, sf, "events").repartition(6).write.parquet(path)
    stream = jobs.read_files(spark, path, table(spark, sf, "events").schema, per_trigger=1).select("user_id")
    out = jobs.run_to_table(jobs.distinct_keys(stream, ["user_id"]), scratch_path(spark, "k"))
    assert out.count() == table(spark, sf, "events").select("user_id").distinct().count()


def test_station_files_need_the_class(spark, sf):
    path = scratch_path(spark, "none")
    spark.range(1).selectExpr("cast(id as string) as x").write.csv(path)
    with pytest.raises(ValueError):
        io.read_station_files(spark, path, "wq")


def test_required_columns(spark):
    with pytest.raises(ValueError, match="missing required columns"):
        io.require_columns(spark.range(1), ["absent"], "t")


def test_filter_report_counts_while_writing(spark, sf):
    path = scratch_path(spark, "kept")
    report = io.filter_report(events_panel(spark, sf), F.hour("ts") == 8, path)
    assert report["rows_in"] == events_panel(spark, sf).count()
    assert report["rows_out"] == spark.read.parquet(path).count() == report["rows_in"] - report["skipped"]
