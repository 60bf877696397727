"""The given tables read as station panels.

``events_panel`` is the dense short series (one row per reading with a quality flag),
``water_panel`` the long multi-measure history, ``sparse_panel`` the history with gaps.
The tables hold no nulls, so the water panel leaves some readings out by a fixed rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.session import sized

WATER_MEASURES = ["water_temp", "salinity", "oxygen", "ph", "depth"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("region"),
        F.col("user_id").alias("station"),
        "ts",
        F.col("event_type").alias("variable"),
        "value",
        (code % 11 - 5).alias("flag"),
        "event_id",
    )


EV_SQL = """ev AS (
  SELECT user_id % 10 AS region, user_id AS station, ts, event_type AS variable, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 11 - 5 AS flag, event_id
  FROM events)"""


def station_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station -> region name of the water panel; one row per supplier."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("station"), F.col("n_name").alias("region")
    )


def water_panel(spark: SparkSession, sf_dir: str, by_station: bool = False) -> DataFrame:
    """``by_station`` deals the stations over as many tasks as the readings ask for, for roll-ups that keep a row per day."""
    item = table(spark, sf_dir, "lineitem")
    readings = item.select(
        F.col("l_suppkey").alias("station"),
        F.to_date("l_shipdate").alias("date"),
        F.when(F.col("l_orderkey") % 11 != 0, F.col("l_quantity") * 0.6).alias("water_temp"),
        F.when(F.col("l_partkey") % 13 != 0, F.col("l_discount") * 350).alias("salinity"),
        F.when(F.col("l_linenumber") != 7, (F.col("l_partkey") % 120) / 10.0).alias("oxygen"),
        (6.5 + F.col("l_tax") * 25).alias("ph"),
        (F.col("l_suppkey") % 10 + F.col("l_linenumber") * 0.1).alias("depth"),
        (F.col("l_quantity") * 0.5 + F.col("l_linenumber")).alias("air_temp"),
        (F.col("l_extendedprice") / 1000.0).alias("solar"),
        (F.col("l_tax") * 100).alias("wind_speed"),
        (F.col("l_discount") * 10).alias("precip"),
    )
    if by_station:
        readings = sized(readings, item.count(), ["station"])  # the count comes from the files' footers
    return readings.join(station_regions(spark, sf_dir), "station").select("region", *readings.columns)


LI_SQL = """li AS (
  SELECT n_name AS region, l_suppkey AS station, CAST(l_shipdate AS DATE) AS date,
         CASE WHEN l_orderkey % 11 <> 0 THEN l_quantity * CAST(0.6 AS DOUBLE) END AS water_temp,
         CASE WHEN l_partkey % 13 <> 0 THEN l_discount * 350 END AS salinity,
         CASE WHEN l_linenumber <> 7 THEN CAST(l_partkey % 120 AS DOUBLE) / CAST(10.0 AS DOUBLE) END AS oxygen,
         CAST(6.5 AS DOUBLE) + l_tax * 25 AS ph,
         l_suppkey % 10 + l_linenumber * CAST(0.1 AS DOUBLE) AS depth,
         l_quantity * CAST(0.5 AS DOUBLE) + l_linenumber AS air_temp,
         l_extendedprice / CAST(1000.0 AS DOUBLE) AS solar,
         l_tax * 100 AS wind_speed,
         l_discount * 10 AS precip
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def sparse_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("station"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("value")
    )
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("station"), "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("region"))
    return (
        orders.join(customer, "station")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("region", "station", "date", "value")
    )


OC_SQL = """oc AS (
  SELECT n_name AS region, o_custkey AS station, CAST(o_orderdate AS DATE) AS date, o_totalprice AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def station_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station dimension: every supplier, a part of them without a name."""
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_name").alias("region"),
            F.col("s_suppkey").alias("station"),
            F.col("r_name").alias("region_name"),
            F.when(F.col("s_suppkey") % 9 != 0, F.col("s_name")).alias("station_name"),
            (F.col("s_acctbal") / 100).alias("latitude"),
            (-F.col("s_acctbal") / 50).alias("longitude"),
            (F.col("s_suppkey") % 17 != 0).alias("in_history"),
        )
    )


LOOKUP_SQL = """lk AS (
  SELECT n_name AS region, s_suppkey AS station, r_name AS region_name,
         CASE WHEN s_suppkey % 9 <> 0 THEN s_name END AS station_name,
         s_acctbal / 100 AS latitude, -s_acctbal / 50 AS longitude, s_suppkey % 17 <> 0 AS in_history
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
