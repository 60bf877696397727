"""Source and sink queries: tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions import text
from tidepanel.operators import scenario, station_index
from tidepanel.plans.registry import query, r6, tidy
from tidepanel.plans.rollups import DW_SQL, daily_water
from tidepanel.session import scratch_path
from tidepanel.sources import io
from tidepanel.sources.panels import EV_SQL, events_panel, station_lookup, table

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@query("csv_scan", "SELECT event_type, count(*) AS n, round(sum(value), 6) AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def csv_scan(spark, d):
    path = scratch_path(spark, "csv")
    table(spark, d, "events").write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    back = io.read_table(spark, path, EVENT_SCHEMA, ts_format="yyyy-MM-dd HH:mm:ss.SSSSSS")
    return back.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query("pruned_scan", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def pruned_scan(spark, d):
    keys = io.read_table(spark, f"{d}/orders.parquet", fmt="parquet", columns=["o_custkey"])
    return keys.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


STEM_SQL = """s AS (SELECT page_id, left(regexp_replace(regexp_extract(url, '://([^/]+)', 1), '[^a-z0-9]', '', 'g') || 'xxxxx', 5)
    || CASE page_id % 3 WHEN 0 THEN 'wq' WHEN 1 THEN 'NUT' ELSE 'met' END || (page_id % 30) AS stem FROM pages),
    c AS (SELECT page_id, CASE WHEN regexp_matches(lower(stem), '^[a-z0-9]{5}(wq|nut)[a-z0-9_-]*$') THEN lower(stem) END AS m FROM s)"""


@query("file_class", f"WITH {STEM_SQL} SELECT page_id, substring(m, 1, 3) AS region, substring(m, 1, 5) AS station, CASE WHEN substring(m, 6, 2) = 'wq' THEN 'wq' WHEN m IS NOT NULL THEN 'nut' END AS file_type FROM c")
def file_class(spark, d):
    host = F.regexp_replace(F.regexp_extract("url", "://([^/]+)", 1), "[^a-z0-9]", "")
    kind = F.when(F.col("page_id") % 3 == 0, "wq").when(F.col("page_id") % 3 == 1, "NUT").otherwise("met")
    stem = F.concat(F.left(F.concat(host, F.lit("xxxxx")), F.lit(5)), kind, (F.col("page_id") % 30).cast("string"))
    return table(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in io.classify_stem(stem).items()])


def station_files(spark: SparkSession, d: str) -> str:
    """Events written as station files: one folder per class, headers that differ, some spaced."""
    root = scratch_path(spark, "files")
    ev = events_panel(spark, d)
    stamp = F.date_format("ts", "M/d/yyyy H:mm:ss")
    hourly = F.when(F.col("event_id") % 3 == 0, F.date_format(F.date_trunc("hour", "ts"), "M/d/yyyy H:mm:ss")).otherwise(stamp)
    parts = {
        "abcdewq2024": (ev.filter("region < 3"), ["DateTimeStamp", " Temp ", "Flag"], [hourly, F.col("value"), F.col("flag")]),
        "fghijwq2024": (ev.filter("region between 3 and 5"), ["DatetimeStamp", "Flag", "Sal"], [hourly, F.col("flag"), F.col("value")]),
        "abcdenut2024": (ev.filter("region > 5"), ["DateTimeStamp", "PO4F", "event"], [stamp, F.col("value"), F.col("event_id")]),
        "notes2024": (ev.filter("region = 9"), ["DateTimeStamp", "x"], [stamp, F.col("value")]),
    }
    for stem, (rows, names, cols) in parts.items():
        flat = rows.select(*[c.cast("string").alias(n) for n, c in zip(names, cols)])
        io.write_named_csv(flat, f"{root}/{stem[:3]}", stem)
    return root


@query(
    "station_files_union",
    f"""WITH {EV_SQL}, w AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN date_trunc('hour', ts) ELSE date_trunc('second', ts) END AS t FROM ev)
        SELECT 'abc' AS region, 'abcde' AS station, count(*) AS n_rows, count(*) FILTER (WHERE minute(t) = 0 AND second(t) = 0) AS n_hourly, round(sum(value), 6) AS temp, NULL::DOUBLE AS sal, count(*) AS n_temp FROM w WHERE region < 3
        UNION ALL SELECT 'fgh', 'fghij', count(*), count(*) FILTER (WHERE minute(t) = 0 AND second(t) = 0), NULL, round(sum(value), 6), 0 FROM w WHERE region BETWEEN 3 AND 5""",
)
def station_files_union(spark, d):
    from tidepanel.functions import dates

    rows = io.read_station_files(spark, station_files(spark, d), "wq")
    full = F.coalesce(dates.is_full_hour(dates.parse_timestamp(F.col("datetime"))), F.lit(False))
    return tidy(
        rows.groupBy("region", "station").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_if(full).alias("n_hourly"), F.sum(text.number(F.col("Temp"))).alias("temp"),
            F.sum(text.number(F.col("Sal"))).alias("sal"), F.count_if(F.col("Temp") != "").alias("n_temp"),
        )
    )


@query("station_files_found", f"WITH {EV_SQL} SELECT 'abc' AS region, 'abcde' AS station, 'wq' AS file_type FROM ev WHERE region < 3 GROUP BY ALL UNION SELECT 'fgh', 'fghij', 'wq' FROM ev WHERE region BETWEEN 3 AND 5 UNION SELECT 'abc', 'abcde', 'nut' FROM ev WHERE region > 5")
def station_files_found(spark, d):
    return io.discover(spark, station_files(spark, d)).select("region", "station", "file_type")


@query(
    "station_list_latin1",
    """SELECT 'r' || s_nationkey AS region_code, 'st' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') || 'wq' AS station_code_full, 'st' || left(lpad(CAST(s_suppkey AS VARCHAR), 4, '0'), 3) AS station,
       s_name || ' Baía' AS station_name, 'Reserve ' || s_nationkey AS region_name, 'Active' AS status, round(s_acctbal / 100, 6) AS latitude,
       round(CASE WHEN s_suppkey % 3 = 0 THEN abs(s_acctbal / 50) ELSE -abs(s_acctbal / 50) END, 6) AS longitude FROM supplier""",
)
def station_list_latin1(spark, d):
    path = scratch_path(spark, "stations")
    key = F.lpad(F.col("s_suppkey").cast("string"), 4, "0")
    raw = table(spark, d, "supplier").select(
        F.concat(F.lit(" R"), "s_nationkey").alias("NERR Site ID "), F.concat(F.lit("ST"), key, F.lit("WQ ")).alias("Station Code"),
        F.concat("s_name", F.lit(" Baía")).alias("Station Name"), F.concat(F.lit("Reserve "), "s_nationkey").alias("Reserve Name"),
        (F.col("s_acctbal") / 100).alias("Latitude"), (F.col("s_acctbal") / 50).alias("Longitude"),
        F.when(F.col("s_suppkey") % 3 == 0, "10 E").otherwise("10 W").alias("Lat Long"), F.lit("Active").alias("Status"),
    )
    raw.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return tidy(io.station_list(spark, path))


@query("optional_source", "SELECT CAST(n_nationkey AS BIGINT) AS station, CAST(n_regionkey AS DOUBLE) AS precip_mult, 1.0::DOUBLE AS solar_mult, 0.0::DOUBLE AS air_temp_add_c FROM nation")
def optional_source(spark, d):
    fallback = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("station"), F.col("n_regionkey").alias("precip_mult"))
    defaults = {"precip_mult": 1.0, "solar_mult": 1.0, "air_temp_add_c": 0.0}
    return io.read_or(spark, f"{d}/no_such_table.parquet", fallback, defaults)


@query("table_round_trip", "SELECT o_orderstatus, year(o_orderdate) AS year, count(*) AS n, round(sum(o_totalprice), 6) AS total FROM orders GROUP BY 1, 2")
def table_round_trip(spark, d):
    path = scratch_path(spark, "orders")
    io.write_table(table(spark, d, "orders").withColumn("year", F.year("o_orderdate")), path, partition_by=["year"])
    back = spark.read.parquet(path)
    return tidy(back.groupBy("o_orderstatus", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")))


@query("json_records", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_records(spark, d):
    path = scratch_path(spark, "json")
    io.write_table(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path, "json")
    return spark.read.schema("c_custkey bigint, c_name string, c_acctbal double").json(path)


@query("append_sink", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O')")
def append_sink(spark, d):
    path = scratch_path(spark, "append")
    orders = table(spark, d, "orders")
    for status in ("F", "none", "O"):
        io.write_table(orders.filter(F.col("o_orderstatus") == status).select("o_orderkey", "o_totalprice"), path, mode="append")
    return spark.read.parquet(path)


@query("empty_sink", "SELECT 0 AS n_rows, 2 AS n_columns, count(*) - count(*) AS n FROM orders")
def empty_sink(spark, d):
    path = scratch_path(spark, "empty")
    n = io.write_table(table(spark, d, "orders").filter("o_totalprice < 0").select("o_orderkey", "o_totalprice"), path)
    back = spark.read.parquet(path)
    return tidy(back.agg(F.lit(n).alias("n_rows"), F.lit(len(back.columns)).alias("n_columns"), F.count(F.lit(1)).alias("n")))


@query("io_report", f"WITH {EV_SQL} SELECT count(*) AS rows_in, count(*) FILTER (WHERE hour(ts) IN (8, 20)) AS rows_out, count(*) FILTER (WHERE hour(ts) NOT IN (8, 20)) AS skipped, round(100.0 * count(*) FILTER (WHERE hour(ts) IN (8, 20)) / count(*), 6) AS kept_pct FROM ev")
def io_report(spark, d):
    report = io.filter_report(events_panel(spark, d), F.hour("ts").isin(8, 20), scratch_path(spark, "kept"))
    row = (report["rows_in"], report["rows_out"], report["skipped"], float(report["kept_pct"]))
    return tidy(spark.createDataFrame([row], "rows_in bigint, rows_out bigint, skipped bigint, kept_pct double"))


@query("manifest_tables", "SELECT 'assets' AS name, 4740 AS n_rows UNION ALL SELECT 'manifest', 4740 * count(*) FROM supplier UNION ALL SELECT 'stations', count(*) FROM supplier UNION ALL SELECT 'summary', 60")
def manifest_tables(spark, d):
    stations, url = station_lookup(spark, d).select("region", "station"), "https://data.example.org/climate"
    manifest, assets = scenario.asset_manifest(stations, url), scenario.needed_assets(stations, url)
    tables = {"stations": stations, "manifest": manifest, "assets": assets, "summary": scenario.manifest_summary(assets)}
    counts = io.write_tables(tables, scratch_path(spark, "manifest"))
    return spark.createDataFrame(list(counts.items()), "name string, n_rows bigint")


@query("stage_boundary", f"WITH {DW_SQL} SELECT region, count(*) AS n_days, round(avg(water_temp), 6) AS water_temp FROM dw GROUP BY region")
def stage_boundary(spark, d):
    path = scratch_path(spark, "daily")
    io.write_table(daily_water(spark, d), path)
    back = spark.read.parquet(path)
    return tidy(back.groupBy("region").agg(F.count(F.lit(1)).alias("n_days"), F.avg("water_temp").alias("water_temp")))


@query("index_with_history", "SELECT 'st' || s_suppkey AS station, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) AS in_history FROM supplier")
def index_with_history(spark, d):
    stations = table(spark, d, "supplier").select(F.concat(F.lit("st"), "s_suppkey").alias("station"))
    keys = table(spark, d, "lineitem").filter("l_quantity > 49").select(F.concat(F.lit("st"), "l_suppkey").alias("station"))
    return station_index.with_history_flag(stations, keys, ["station"])
