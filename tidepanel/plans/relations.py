"""Join, set, reshape, sort and sample queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import joins, ordered, risk, sets, station_index
from tidepanel.plans.cleaning import EVENT_TYPES
from tidepanel.plans.registry import query, r6, tidy
from tidepanel.plans.rollups import DW_SQL, daily_water
from tidepanel.plans.scenarios import SCEN_CTE, scenario_predictions
from tidepanel.sources.panels import EV_SQL, LI_SQL, LOOKUP_SQL, events_panel, station_lookup, table, water_panel


@query(
    "attach_dimension",
    f"""WITH {LI_SQL}, {LOOKUP_SQL} SELECT li.region, li.station, li.date, region_name, station_name, round(sum(ph), 6) AS ph FROM li
        LEFT JOIN lk ON li.region = lk.region AND li.station = lk.station GROUP BY ALL""",
)
def attach_dimension(spark, d):
    days = water_panel(spark, d).groupBy("region", "station", "date").agg(r6(F.sum("ph")).alias("ph"), F.lit("x").alias("region_name").alias("region_name"))
    out = joins.attach_dimension(days, station_lookup(spark, d), ["region", "station"])
    return out.select("region", "station", "date", "region_name", "station_name", "ph")


@query("keep_keys", f"WITH {DW_SQL} SELECT region, station, date, round(ph, 6) AS ph FROM dw WHERE station IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def keep_keys(spark, d):
    rich = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("station"))
    return tidy(joins.keep_keys(daily_water(spark, d), rich, ["station"]).select("region", "station", "date", "ph"))


@query("drop_keys", f"WITH {DW_SQL} SELECT region, station, date, round(ph, 6) AS ph FROM dw WHERE station NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def drop_keys(spark, d):
    rich = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("station"))
    return tidy(joins.drop_keys(daily_water(spark, d), rich, ["station"]).select("region", "station", "date", "ph"))


@query("flag_members", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS is_big FROM customer")
def flag_members(spark, d):
    big = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.flag_members(table(spark, d, "customer").select("c_custkey"), big, ["c_custkey"], "is_big")


@query("history_flag", f"WITH {LOOKUP_SQL}, {LI_SQL} SELECT lk.region, lk.station, (lk.region, lk.station) IN (SELECT DISTINCT (region, station) FROM li WHERE ph > 8.4) AS in_history FROM lk")
def history_flag(spark, d):
    keys = water_panel(spark, d).filter("ph > 8.4").select("region", "station")
    lookup = station_lookup(spark, d).select("region", "station")
    return station_index.with_history_flag(lookup, keys, ["region", "station"])


@query(
    "equi_join",
    f"""WITH {LI_SQL}, a AS (SELECT region, station, date, avg(air_temp) AS air_temp FROM li WHERE air_temp > 10 GROUP BY 1, 2, 3), w AS (SELECT region, station, date, avg(water_temp) AS water_temp FROM li WHERE water_temp IS NOT NULL GROUP BY 1, 2, 3)
        SELECT a.region, a.station, a.date, round(air_temp, 6) AS air_temp, round(water_temp, 6) AS water_temp FROM a JOIN w ON a.region = w.region AND a.station = w.station AND a.date = w.date""",
)
def equi_join(spark, d):
    keys = ["region", "station", "date"]
    li = water_panel(spark, d)
    air = li.filter("air_temp > 10").groupBy(*keys).agg(F.avg("air_temp").alias("air_temp"))
    water = li.filter("water_temp is not null").groupBy(*keys).agg(F.avg("water_temp").alias("water_temp"))
    return tidy(air.join(water, keys))


@query(
    "station_month_grid",
    f"""WITH {LI_SQL}, y AS (SELECT DISTINCT region, station, year(date) AS year FROM li), c AS (SELECT region, station, year(date) AS year, month(date) AS month, count(*) AS n FROM li GROUP BY ALL)
        SELECT y.region, y.station, y.year, m AS month, coalesce(n, 0) AS n FROM y JOIN unnest(generate_series(1, 12)) AS g(m) ON true LEFT JOIN c ON y.region = c.region AND y.station = c.station AND y.year = c.year AND c.month = m""",
)
def station_month_grid(spark, d):
    counts = water_panel(spark, d).groupBy("region", "station", F.year("date").alias("year"), F.month("date").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select("region", "station", "year").distinct().withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return tidy(grid.join(counts, ["region", "station", "year", "month"], "left").fillna(0, ["n"]))


@query(
    "minus_reference",
    f"""WITH {SCEN_CTE}, a AS (SELECT region, station, scenario, avg(oxygen) AS oxygen FROM sp GROUP BY 1, 2, 3)
        SELECT a.region, a.station, a.scenario, round(a.oxygen, 6) AS oxygen, round(a.oxygen - b.oxygen, 6) AS oxygen_delta FROM a JOIN a b ON a.region = b.region AND a.station = b.station AND b.scenario = 'baseline_ref'""",
)
def minus_reference(spark, d):
    means = scenario_predictions(spark, d).groupBy("region", "station", "scenario").agg(F.avg("oxygen").alias("oxygen"))
    return tidy(joins.minus_reference(means, ["region", "station"], "scenario", "baseline_ref", ["oxygen"]))


@query("common_keys", f"WITH {LI_SQL} SELECT region, station FROM li WHERE ph > 8.3 INTERSECT SELECT region, station FROM li WHERE water_temp > 29.5")
def common_keys(spark, d):
    li = water_panel(spark, d)
    return sets.common_keys(li.filter("ph > 8.3"), li.filter("water_temp > 29.5"), ["region", "station"])


@query("missing_keys", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 450000")
def missing_keys(spark, d):
    bought = table(spark, d, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return sets.missing_keys(table(spark, d, "customer"), bought, ["c_custkey"])


@query(
    "stack_history",
    f"""WITH {DW_SQL} SELECT region, station, year(date) AS year, 'observed_history' AS scenario, round(avg(water_temp), 6) AS water_temp, NULL::DOUBLE AS water_temp_pred FROM dw WHERE year(date) < 1999 GROUP BY ALL
        UNION ALL SELECT region, station, year(date), 'projected', NULL, round(avg(water_temp) + 1.5, 6) FROM dw WHERE year(date) >= 1999 GROUP BY ALL""",
)
def stack_history(spark, d):
    years = daily_water(spark, d).groupBy("region", "station", F.year("date").alias("year")).agg(F.avg("water_temp").alias("water_temp"))
    past = years.filter("year < 1999").withColumn("scenario", F.lit("observed_history"))
    later = years.filter("year >= 1999").select("region", "station", "year", F.lit("projected").alias("scenario"), (F.col("water_temp") + 1.5).alias("water_temp_pred"))
    return tidy(sets.stack(past, later))


@query("melt", f"WITH {DW_SQL} " + " UNION ALL ".join(f"SELECT region, station, date, '{c}' AS variable, round({c}, 6) AS value FROM dw" for c in ["water_temp", "ph"]))
def melt(spark, d):
    return tidy(sets.melt(daily_water(spark, d), ["region", "station", "date"], ["water_temp", "ph"]))


@query("spread", f"WITH {EV_SQL} SELECT station, " + ", ".join(f"round(avg(value) FILTER (WHERE variable = '{v}'), 6) AS {v}" for v in EVENT_TYPES) + " FROM ev GROUP BY station")
def spread(spark, d):
    return tidy(sets.spread(events_panel(spark, d), ["station"], "variable", EVENT_TYPES, F.avg("value")))


@query("sort_mixed", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 25")
def sort_mixed(spark, d):
    o = table(spark, d, "orders").orderBy(F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey"))
    return o.limit(25).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "nulls_last",
    f"WITH {LI_SQL} SELECT region, station, round(t, 6) AS t FROM (SELECT region, station, avg(CASE WHEN station % 4 <> 0 THEN water_temp END) AS t FROM li GROUP BY 1, 2) ORDER BY round(t, 6) DESC NULLS LAST, station",
)
def nulls_last(spark, d):
    s = water_panel(spark, d).groupBy("region", "station").agg(F.avg(F.when(F.col("station") % 4 != 0, F.col("water_temp"))).alias("t"))
    return tidy(s).orderBy(F.desc_nulls_last("t"), "station")


@query(
    "best_per_group",
    "SELECT c_mktsegment, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS best_customer, max(c_acctbal) AS best_balance FROM customer GROUP BY 1",
)
def best_per_group(spark, d):
    c = table(spark, d, "customer")
    best = F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey")))
    return c.groupBy("c_mktsegment").agg(best.alias("best_customer"), F.max("c_acctbal").alias("best_balance"))


@query("mode_per_group", "SELECT o_custkey, o_orderpriority FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1")
def mode_per_group(spark, d):
    return station_index.mode_per_group(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


@query(
    "merge_rankings",
    """WITH a AS (SELECT o_custkey, max(o_totalprice) AS v FROM orders GROUP BY 1 ORDER BY v DESC, o_custkey LIMIT 10), b AS (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1 ORDER BY v DESC, o_custkey LIMIT 10),
       u AS (SELECT o_custkey, 0 AS l, -v AS k FROM a UNION ALL SELECT o_custkey, 1, -v FROM b) SELECT o_custkey FROM (SELECT o_custkey, min((l, k)) AS o FROM u GROUP BY 1) ORDER BY o, o_custkey LIMIT 12""",
)
def merge_rankings(spark, d):
    o = table(spark, d, "orders")

    def top(value):
        v = o.groupBy("o_custkey").agg(value.cast("double").alias("v")).orderBy(F.desc("v"), "o_custkey").limit(10)
        return v.withColumn("k", -F.col("v"))

    return risk.merge_rankings(top(F.max("o_totalprice")), top(F.count(F.lit(1))), ["k"], 12, ["o_custkey"])


@query("sample_rows")
def sample_rows(spark, d):
    return sets.sample_rows(table(spark, d, "orders"), ["o_orderkey"], 500)


@query("split_fraction")
def split_fraction(spark, d):
    marked = sets.split_fraction(table(spark, d, "orders"), ["o_custkey"])
    return marked.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_custkey").alias("n_keys"))


@query(
    "split_stratified",
    """SELECT o_orderstatus, count(*) AS n_rows, CAST(round(count(*) * 0.2) AS BIGINT) AS n_test FROM orders GROUP BY 1""",
)
def split_stratified(spark, d):
    marked = sets.split_stratified(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"])
    return marked.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("split") == "test").alias("n_test"))


@query(
    "rank_in_group",
    "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders",
)
def rank_in_group(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return ordered.group_rank(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "nth", "n").drop("o_orderdate")
