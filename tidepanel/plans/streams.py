"""Streaming queries over the event file, drained to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.plans.registry import query, tidy
from tidepanel.plans.windows import ASOF_SQL, purchase_obs
from tidepanel.session import scratch_path
from tidepanel.sources.panels import EV_SQL, table
from tidepanel.streaming import jobs


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    stream = jobs.read_files(spark, d, schema, "events.parquet")
    code = F.get_json_object("props", "$.k").cast("int")
    return stream.select(
        (F.col("user_id") % 10).alias("region"), F.col("user_id").alias("station"), "ts", F.col("event_type").alias("variable"),
        "value", (code % 11 - 5).alias("flag"), "event_id",
    )


@query(
    "stream_downsample",
    f"""WITH {EV_SQL} SELECT region, station, time_bucket(INTERVAL '4 hours', ts) AS ts, round(avg(value), 6) AS value, arg_min(variable, ts) AS variable FROM ev
        GROUP BY 1, 2, 3""",
)
def stream_downsample(spark, d):
    return tidy(jobs.downsample(event_stream(spark, d), scratch_path(spark, "downsample"), ["region", "station"], "ts", "4 hours", ["value"], ["variable"]))


@query("stream_hour_filter", f"WITH {EV_SQL} SELECT event_id, station, ts FROM ev WHERE hour(ts) IN (8, 20)")
def stream_hour_filter(spark, d):
    return jobs.run_to_table(jobs.hour_filter(event_stream(spark, d), "ts").select("event_id", "station", "ts"), scratch_path(spark, "hours"))


@query("stream_keys", f"WITH {EV_SQL} SELECT DISTINCT region, station FROM ev")
def stream_keys(spark, d):
    return jobs.run_to_table(jobs.distinct_keys(event_stream(spark, d), ["region", "station"]), scratch_path(spark, "keys"))


@query("stream_asof", ASOF_SQL)
def stream_asof(spark, d):
    readings = event_stream(spark, d).select("event_id", "station", "ts")
    return tidy(jobs.asof_enrich(readings, scratch_path(spark, "asof"), purchase_obs(spark, d), ["station"], "ts", "obs_ts", "7 days"))
