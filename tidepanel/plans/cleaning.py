"""Cleaning, flag and column-profile queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions import dates, text
from tidepanel.operators import clean, joins, quality, station_index
from tidepanel.plans.registry import query, r6, tidy
from tidepanel.sources.panels import EV_SQL, LI_SQL, LOOKUP_SQL, events_panel, station_lookup, table, water_panel

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
FLAG_PAIRS = {v: f"{v}_flag" for v in EVENT_TYPES}


def raw_text_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as raw text: four timestamp layouts, a third on the full hour, some bad values."""
    ts = F.when(F.col("event_id") % 3 == 0, F.date_trunc("hour", "ts").cast("timestamp_ntz")).otherwise(F.col("ts"))
    stamp = (
        F.when(F.col("user_id") % 4 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("user_id") % 4 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm"))
        .when(F.col("user_id") % 4 == 2, F.date_format(ts, "M/d/yyyy H:mm"))
        .otherwise(F.date_format(ts, "M/d/yyyy H:mm:ss"))
    )
    return table(spark, d, "events").select(
        "event_id",
        F.concat(F.lit("  St"), F.col("user_id").cast("string"), F.lit("Wq ")).alias("station_text"),
        F.when(F.col("event_id") % 17 == 0, "not a time").otherwise(stamp).alias("time_text"),
        F.when(F.col("event_id") % 17 == 1, "<4>").otherwise(F.concat(F.lit(" "), F.col("value").cast("string"))).alias("value_text"),
        F.when(F.col("event_id") % 5 == 0, "nut").otherwise("wq").alias("file_type"),
        F.element_at(F.array(F.lit("40 N 70 W"), F.lit("40 n 70 e"), F.lit("W E"), F.lit("")), (F.col("event_id") % 4 + 1).cast("int")).alias("place_text"),
    )


RAW_SQL = """raw AS (
  SELECT event_id, '  St' || user_id || 'Wq ' AS station_text,
    CASE WHEN event_id % 17 = 0 THEN NULL
         WHEN user_id % 4 IN (1, 2) THEN date_trunc('minute', t0) ELSE date_trunc('second', t0) END AS parsed,
    CASE WHEN event_id % 17 = 1 THEN NULL ELSE value END AS value,
    CASE WHEN event_id % 5 = 0 THEN 'nut' ELSE 'wq' END AS file_type, event_id % 4 AS place
  FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN date_trunc('hour', ts) ELSE ts END AS t0 FROM events))"""


@query(
    "full_hour_rows",
    f"WITH {RAW_SQL} SELECT event_id, file_type, parsed AS ts FROM raw "
    "WHERE file_type <> 'wq' OR (minute(parsed) = 0 AND second(parsed) = 0)",
)
def full_hour_rows(spark, d):
    raw = raw_text_events(spark, d)
    return clean.full_hour_rows(raw, "time_text", F.col("file_type")).select("event_id", "file_type", "ts")


@query("coerce_numbers", f"WITH {RAW_SQL} SELECT event_id, round(value, 6) AS value_text FROM raw")
def coerce_numbers(spark, d):
    raw = raw_text_events(spark, d).select("event_id", "value_text")
    return tidy(clean.coerce_numbers(raw, ["value_text"]))


@query(
    "normalise_keys",
    """SELECT event_id, 'st' || user_id || 'wq' AS station_key, 'wq' AS station_suffix, left('st' || user_id || 'wq', 5) AS station_prefix,
       substring('st' || user_id || 'wq', 1, 3) AS region_code, 'wq' AS suffix_code,
       'st' || user_id || '.' || event_type AS composite_key FROM events""",
)
def normalise_keys(spark, d):
    raw = raw_text_events(spark, d).join(table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_id")
    key = text.key_text("station_text")
    return raw.select(
        "event_id",
        key.alias("station_key"),
        F.right(key, F.lit(2)).alias("station_suffix"),
        F.left(key, F.lit(5)).alias("station_prefix"),
        F.substring(key, 1, 3).alias("region_code"),
        text.suffix_code(F.trim("station_text")).alias("suffix_code"),
        F.concat_ws(".", F.concat(F.lit("st"), "user_id"), "event_type").alias("composite_key"),
    )


@query(
    "suffix_code",
    """SELECT p_partkey, lower(CASE WHEN regexp_extract(s, '([A-Za-z]{2})$', 1) = '' THEN right(s, 2)
         ELSE regexp_extract(s, '([A-Za-z]{2})$', 1) END) AS suffix
       FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS s FROM part)""",
)
def suffix_code(spark, d):
    s = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", text.suffix_code(s).alias("suffix"))


@query(
    "longitude_sign",
    f"WITH {RAW_SQL} SELECT event_id, round(CASE WHEN place IN (1, 2) THEN abs(value) ELSE -abs(value) END, 6) AS longitude FROM raw",
)
def longitude_sign(spark, d):
    raw = raw_text_events(spark, d)
    value = text.number(F.col("value_text"))
    return raw.select("event_id", r6(text.longitude(value, F.col("place_text"))).alias("longitude"))


@query(
    "rename_and_trim",
    "SELECT 'c' || c_custkey AS customer_key, c_name AS account_name, c_acctbal AS balance_usd FROM customer",
)
def rename_and_trim(spark, d):
    c = table(spark, d, "customer").select(
        F.concat(F.lit(" c"), "c_custkey", F.lit("  ")).alias(" Customer-Key "),
        F.concat(F.lit(" "), "c_name").alias("Account Name"),
        F.col("c_acctbal").alias("w_bal"),
    )
    c = clean.trim_text(clean.normalise_headers(c))
    return clean.rename_measures(c, {"w_bal": "balance_usd", "absent": "x"})


@query("drop_region", f"WITH {LI_SQL} SELECT region, count(*) AS n FROM li WHERE region <> 'NATION_7' GROUP BY region")
def drop_region(spark, d):
    kept = water_panel(spark, d).filter(F.col("region") != "NATION_7")
    return kept.groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query("hour_filter", f"WITH {EV_SQL} SELECT event_id, station, ts, value FROM ev WHERE hour(ts) IN (8, 20)")
def hour_filter(spark, d):
    return clean.hour_filter(events_panel(spark, d), "ts").select("event_id", "station", "ts", "value")


@query(
    "complete_cases",
    f"""WITH {LI_SQL} SELECT station, count(*) AS n_rows,
        count(*) FILTER (WHERE water_temp IS NOT NULL AND salinity IS NOT NULL AND oxygen IS NOT NULL) AS n_complete
        FROM li GROUP BY station""",
)
def complete_cases(spark, d):
    panel = water_panel(spark, d)
    strict, broad = clean.split_complete(panel, ["ph"])
    n_all = broad.groupBy("station").agg(F.count(F.lit(1)).alias("n_rows"))
    n_strict = strict.groupBy("station").agg(F.count(F.lit(1)).alias("n_complete"))
    return n_all.join(n_strict, "station", "left").fillna(0, ["n_complete"])


@query(
    "dedupe_first",
    f"""WITH {EV_SQL} SELECT station, variable, ts, value FROM ev
        QUALIFY row_number() OVER (PARTITION BY station, variable ORDER BY ts, event_id) = 1""",
)
def dedupe_first(spark, d):
    ev = events_panel(spark, d)
    first = clean.drop_duplicates_first(ev, ["station", "variable"], [F.col("ts"), F.col("event_id")])
    return first.select("station", "variable", "ts", "value")


@query("distinct_rows", "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority").distinct()


LIMITS = {"water_temp": (3, 27), "salinity": (0, 30), "oxygen": (0.5, 11), "ph": (6.6, 8)}


@query(
    "range_clamp",
    f"""WITH {LI_SQL} SELECT station, date,
        round(sum(CASE WHEN water_temp BETWEEN 3 AND 27 THEN water_temp END), 6) AS water_temp,
        round(sum(CASE WHEN salinity BETWEEN 0 AND 30 THEN salinity END), 6) AS salinity,
        round(sum(CASE WHEN oxygen BETWEEN 0.5 AND 11 THEN oxygen END), 6) AS oxygen,
        round(sum(CASE WHEN ph BETWEEN 6.6 AND 8 THEN ph END), 6) AS ph FROM li GROUP BY station, date""",
)
def range_clamp(spark, d):
    clamped = quality.clamp_ranges(water_panel(spark, d), LIMITS)
    return clamped.groupBy("station", "date").agg(*[r6(F.sum(c)).alias(c) for c in LIMITS])


def _clamp_log_sql() -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", CAST({lo} AS DOUBLE) AS low_ok, CAST({hi} AS DOUBLE) AS high_ok, "
        f"count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS n_set_to_missing FROM li"
        for c, (lo, hi) in LIMITS.items()
    ]
    return f"WITH {LI_SQL} " + " UNION ALL ".join(parts)


@query("clamp_log", _clamp_log_sql())
def clamp_log(spark, d):
    return quality.clamp_log(water_panel(spark, d), LIMITS)


@query(
    "unit_conversion",
    """SELECT event_id, round(value + 273.15 - 273.15, 6) AS m_era5_air_temp_c, round(value * 1000 / 3600000, 6) AS m_era5_ssrd_kwh_m2,
       round(value / 1000 * 1000, 6) AS m_precip_mmh, round(sqrt(value * value + (user_id * user_id)), 6) AS m_wind_ms FROM events""",
)
def unit_conversion(spark, d):
    e = table(spark, d, "events").select(
        "event_id",
        (F.col("value") + 273.15).alias("m_era5_air_temp_k"),
        (F.col("value") * 1000).alias("m_era5_ssrd_j_m2"),
        (F.col("value") / 1000).alias("m_era5_precip_m"),
        clean.wind_speed(F.col("value"), F.col("user_id")).alias("m_wind_ms"),
    )
    return tidy(clean.convert_units(e))


@query(
    "sensor_coalesce",
    f"""WITH {LI_SQL} SELECT station, temp_source, count(*) AS n, round(sum(temp), 6) AS temp_sum FROM (
        SELECT station, coalesce(water_temp, air_temp) AS temp,
          CASE WHEN water_temp IS NOT NULL THEN 'local' WHEN air_temp IS NOT NULL THEN 'reanalysis' END AS temp_source FROM li)
        GROUP BY station, temp_source""",
)
def sensor_coalesce(spark, d):
    both = clean.first_of(water_panel(spark, d), [("water_temp", "local"), ("air_temp", "reanalysis")], "temp", "temp_source")
    return both.groupBy("station", "temp_source").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("temp")).alias("temp_sum"))


@query(
    "first_available",
    f"""WITH {LI_SQL} SELECT station, date, round(sum(coalesce(oxygen, salinity, 0)), 6) AS v,
        round(sum(coalesce(water_temp, ph / 3600000)), 6) AS w FROM li GROUP BY station, date""",
)
def first_available(spark, d):
    li = water_panel(spark, d).withColumn("v", clean.first_available(water_panel(spark, d), ["absent", "oxygen", "salinity"], 0.0))
    li = clean.older_unit_column(li, "water_temp", "ph")
    return li.groupBy("station", "date").agg(r6(F.sum("v")).alias("v"), r6(F.sum("water_temp")).alias("w"))


def hourly_flags(spark: SparkSession, d: str) -> DataFrame:
    """One row per station hour with the first value and flag of every variable."""
    ev = events_panel(spark, d).withColumn("hour_ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    first = F.struct("ts", "event_id")
    aggs = []
    for v in EVENT_TYPES:
        here = F.when(F.col("variable") == v, first)
        aggs += [F.min_by("value", here).alias(v), F.min_by("flag", here).alias(f"{v}_flag")]
    return ev.groupBy("region", "station", "hour_ts").agg(*aggs)


WIDE_SQL = (
    EV_SQL
    + ", wide AS (SELECT region, station, date_trunc('hour', ts) AS hour_ts, "
    + ", ".join(
        f"arg_min(value, (ts, event_id)) FILTER (WHERE variable = '{v}') AS \"{v}\", "
        f"arg_min(flag, (ts, event_id)) FILTER (WHERE variable = '{v}') AS {v}_flag"
        for v in EVENT_TYPES
    )
    + " FROM ev GROUP BY 1, 2, 3)"
)


@query(
    "flag_review",
    f"""WITH {EV_SQL} SELECT variable, count(value) AS non_null_values,
        count(*) FILTER (WHERE flag IN (0, -3, 4, 5)) AS good_or_corrected_flags,
        count(*) FILTER (WHERE flag IN (-5, -4, 1, 3)) AS bad_or_questionable_flags,
        count(*) FILTER (WHERE flag IN (-2, -1)) AS missing_like_flags,
        count(*) FILTER (WHERE flag = 2) AS reserved_flags,
        round(100 * avg(CAST(flag IN (-5, -4, 1, 3) AS INT)), 3) AS pct_bad_or_questionable,
        round(100 * avg(CASE WHEN value IS NOT NULL THEN CAST(flag IN (-5, -4, 1, 3) AS INT) END), 3) AS pct_bad_when_value_present
        FROM ev GROUP BY variable""",
)
def flag_review(spark, d):
    return quality.flag_review(events_panel(spark, d))


@query(
    "flags_long",
    f"WITH {WIDE_SQL} "
    + " UNION ALL ".join(
        f"SELECT station, '{v}' AS variable, count(\"{v}\") AS n_values, count({v}_flag) AS n_flags, CAST(sum({v}_flag) AS BIGINT) AS flag_sum FROM wide GROUP BY station"
        for v in EVENT_TYPES
    ),
)
def flags_long(spark, d):
    long = quality.flags_long(hourly_flags(spark, d), FLAG_PAIRS, ["station"])
    return long.groupBy("station", "variable").agg(
        F.count("value").alias("n_values"), F.count("flag").alias("n_flags"), F.sum("flag").alias("flag_sum")
    )


def _corruption_sql(select: str, tail: str) -> str:
    def n(codes: str) -> str:
        return " + ".join(f"CASE WHEN {v}_flag IN ({codes}) THEN 1 ELSE 0 END" for v in EVENT_TYPES)

    return f"""WITH {WIDE_SQL}, c AS (SELECT region, station, hour_ts, {n('-5, -4, 1, 3')} AS n_bad, {n('-2, -1')} AS n_missing,
        {n('3')} AS n_rejected FROM wide), r AS (SELECT *, n_rejected > 0 OR n_bad + n_missing >= 2 AS corrupted FROM c)
        SELECT {select} FROM r {tail}"""


@query(
    "row_corruption",
    _corruption_sql(
        "station, hour_ts, CAST(n_bad AS BIGINT) AS n_bad_flags_row, CAST(n_missing AS BIGINT) AS n_missing_like_flags_row, "
        "n_rejected > 0 AS has_rejected_flag, corrupted AS is_highly_corrupted_record",
        "",
    ),
)
def row_corruption(spark, d):
    rows = quality.row_corruption(hourly_flags(spark, d), list(FLAG_PAIRS.values()))
    return tidy(
        rows.select(
            "station", "hour_ts", "n_bad_flags_row", "n_missing_like_flags_row", "has_rejected_flag", "is_highly_corrupted_record"
        )
    )


@query(
    "corruption_rate",
    _corruption_sql(
        "region, last_day(CAST(hour_ts AS DATE)) AS month_end, round(avg(CAST(corrupted AS INT)), 6) AS corrupted_share",
        "GROUP BY region, last_day(CAST(hour_ts AS DATE))",
    ),
)
def corruption_rate(spark, d):
    rows = quality.row_corruption(hourly_flags(spark, d), list(FLAG_PAIRS.values()))
    return tidy(quality.corruption_rate(rows, "hour_ts", "region", "is_highly_corrupted_record"))


@query(
    "corrupted_rows_top",
    _corruption_sql(
        "station, hour_ts, CAST(n_bad AS BIGINT) AS n_bad_flags_row",
        "WHERE corrupted ORDER BY n_bad DESC, hour_ts, station LIMIT 10",
    ),
)
def corrupted_rows_top(spark, d):
    rows = quality.row_corruption(hourly_flags(spark, d), list(FLAG_PAIRS.values()))
    worst = rows.filter("is_highly_corrupted_record").orderBy(F.desc("n_bad_flags_row"), "hour_ts", "station").limit(10)
    return tidy(worst.select("station", "hour_ts", "n_bad_flags_row"))


@query(
    "null_flagged",
    f"WITH {WIDE_SQL} SELECT station, "
    + ", ".join(
        f"count(CASE WHEN {v}_flag IS NULL OR {v}_flag NOT IN (-5, -4, 1, 3) THEN \"{v}\" END) AS {v}_kept" for v in EVENT_TYPES
    )
    + " FROM wide GROUP BY station",
)
def null_flagged(spark, d):
    cleaned = quality.null_bad_values(hourly_flags(spark, d), FLAG_PAIRS)
    return cleaned.groupBy("station").agg(*[F.count(v).alias(f"{v}_kept") for v in EVENT_TYPES])


@query(
    "null_log",
    f"WITH {WIDE_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{v}' AS value_col, '{v}_flag' AS flag_col, count(*) FILTER (WHERE {v}_flag IN (-5, -4, 1, 3)) AS n_bad_flag_rows FROM wide"
        for v in EVENT_TYPES
    ),
)
def null_log(spark, d):
    return quality.null_log(hourly_flags(spark, d), FLAG_PAIRS)


PROFILE_COLUMNS = ["region", "water_temp", "salinity", "oxygen", "ph", "fixed", "rare"]
PROFILE_EXTRA = "li2 AS (SELECT *, 7 AS fixed, CASE WHEN station % 200 = 1 AND depth > 1.65 THEN depth END AS rare FROM li)"


def profile_panel(spark: SparkSession, d: str) -> DataFrame:
    li = water_panel(spark, d)
    return li.select(
        *PROFILE_COLUMNS[:5],
        F.lit(7).alias("fixed"),
        F.when((F.col("station") % 200 == 1) & (F.col("depth") > 1.65), F.col("depth")).alias("rare"),
    )


def _profile_sql(cell: str) -> str:
    return f"WITH {LI_SQL}, {PROFILE_EXTRA}, p AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS nn, count(*) AS n, count(DISTINCT {c}) AS nd FROM li2" for c in PROFILE_COLUMNS
    ) + f") SELECT {cell} FROM p"


@query(
    "column_profile",
    _profile_sql(
        "\"column\", nn AS non_null, round(100.0 * nn / n, 3) AS pct_non_null, nd <= 1 AS single_value, "
        "CASE WHEN nd <= 1 THEN 'constant_or_single_value' WHEN 100.0 * nn / n < 1 THEN 'less_than_1pct_filled' END AS why_flagged"
    ),
)
def column_profile(spark, d):
    return quality.column_profile(profile_panel(spark, d))


@query("distinct_profile", _profile_sql("\"column\", nd AS distinct_non_null"))
def distinct_profile(spark, d):
    return quality.distinct_profile(profile_panel(spark, d), PROFILE_COLUMNS)


@query(
    "completeness",
    _profile_sql(
        "\"column\", nn AS non_null, n - nn AS missing, round(100.0 * nn / n, 3) AS pct_non_null, nn = 0 AS fully_empty"
    ),
)
def completeness(spark, d):
    return quality.completeness(profile_panel(spark, d))


@query(
    "drop_dead_weight",
    f"WITH {LI_SQL} SELECT region, round(sum(water_temp), 6) AS water_temp, round(sum(salinity), 6) AS salinity, "
    "round(sum(oxygen), 6) AS oxygen, round(sum(ph), 6) AS ph FROM li GROUP BY region",
)
def drop_dead_weight(spark, d):
    kept = quality.drop_dead_weight(profile_panel(spark, d), ["region"])
    return kept.groupBy("region").agg(*[r6(F.sum(c)).alias(c) for c in kept.columns if c != "region"])


@query(
    "readiness",
    f"""WITH {LI_SQL} SELECT 'core' AS column_group, count(*) AS n_rows,
        count(*) FILTER (WHERE water_temp IS NOT NULL AND oxygen IS NOT NULL) AS n_ready FROM li
        UNION ALL SELECT 'all', count(*), count(*) FILTER (WHERE water_temp IS NOT NULL AND oxygen IS NOT NULL
          AND salinity IS NOT NULL AND ph IS NOT NULL AND depth IS NOT NULL) FROM li""",
)
def readiness(spark, d):
    groups = {"core": ["water_temp", "oxygen"], "all": ["water_temp", "oxygen", "salinity", "ph", "depth"]}
    return quality.readiness(water_panel(spark, d), groups)


SUMMARY_COLUMNS = ["water_temp", "salinity", "oxygen", "ph"]


@query(
    "numeric_summary",
    f"WITH {LI_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, "
        f"round(max({c}), 6) AS max, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
        f"round(quantile_cont({c}, 0.75), 6) AS q75 FROM li"
        for c in SUMMARY_COLUMNS
    ),
)
def numeric_summary(spark, d):
    return tidy(quality.numeric_summary(water_panel(spark, d), SUMMARY_COLUMNS))


def _corr_sql() -> str:
    cols = ["water_temp", "salinity", "oxygen", "ph", "air_temp", "depth"]
    parts = [
        f"SELECT '{a}' AS var_a, '{b}' AS var_b, corr({a}, {b}) AS c FROM li" for i, a in enumerate(cols) for b in cols[i + 1 :]
    ]
    return (
        f"WITH {LI_SQL}, p AS ({' UNION ALL '.join(parts)}) SELECT var_a, var_b, round(c, 6) AS corr, "
        "CASE WHEN abs(c) < 0.3 THEN 'low' WHEN abs(c) < 0.6 THEN 'mid' ELSE 'high' END AS band FROM p"
    )


@query("correlation_pairs", _corr_sql())
def correlation_pairs(spark, d):
    cols = ["water_temp", "salinity", "oxygen", "ph", "air_temp", "depth"]
    return tidy(quality.correlation_pairs(water_panel(spark, d), cols))


@query(
    "calendar_features",
    f"""WITH {LI_SQL} SELECT DISTINCT station, date, year(date) AS year, month(date) AS month_num, dayofyear(date) AS doy,
        month(date) BETWEEN 6 AND 9 AS is_warm_season, round(sin(2 * pi() * dayofyear(date) / 365.25), 6) AS doy_sin,
        round(cos(2 * pi() * dayofyear(date) / 365.25), 6) AS doy_cos, round(sin(2 * pi() * month(date) / 12), 6) AS month_sin,
        round(cos(2 * pi() * month(date) / 12), 6) AS month_cos FROM li""",
)
def calendar_features(spark, d):
    days = water_panel(spark, d).select("station", "date").distinct()
    return tidy(clean.calendar_features(days))


@query(
    "station_labels",
    f"""WITH {LOOKUP_SQL}, {LI_SQL} SELECT DISTINCT li.station, '(' || li.region || li.station || ') ' ||
        CASE WHEN station_name IS NULL THEN region_name ELSE station_name || ', ' || region_name END AS row_label
        FROM li LEFT JOIN lk ON li.region = lk.region AND li.station = lk.station""",
)
def station_labels(spark, d):
    keys = water_panel(spark, d).select("region", "station").distinct()
    named = joins.attach_dimension(keys, station_lookup(spark, d), ["region", "station"])
    label = text.station_label(F.col("station_name"), F.col("region"), F.col("station"), F.col("region_name"))
    return named.select("station", label.alias("row_label"))


@query(
    "drop_columns",
    "SELECT o_orderkey, o_orderstatus FROM orders",
)
def drop_columns(spark, d):
    o = clean.drop_matching(table(spark, d, "orders"), ["o_cust", "o_total"], ["priority"], ["o_orderdate"])
    return clean.keep_columns(o, ["o_orderkey", "absent", "o_orderstatus"])


@query(
    "state_labels",
    f"""WITH {EV_SQL} SELECT state, count(*) AS n, round(avg(CAST(state = 'bloom' AS INT)), 6) AS bloom_rate FROM (
        SELECT CASE WHEN value / 10 < 5 THEN 'low' WHEN value / 10 < 20 THEN 'moderate' ELSE 'bloom' END AS state FROM ev) GROUP BY state""",
)
def state_labels(spark, d):
    labelled = events_panel(spark, d).select(clean.state_label(F.col("value") / 10).alias("state"))
    bloom = F.avg((F.col("state") == "bloom").cast("double"))
    return tidy(labelled.groupBy("state").agg(F.count(F.lit(1)).alias("n"), bloom.alias("bloom_rate")))


@query(
    "event_prevalence",
    f"""WITH {EV_SQL} SELECT station, count(*) AS n, round(avg(CAST(value >= 200 AS INT)), 6) AS prevalence FROM ev GROUP BY station""",
)
def event_prevalence(spark, d):
    flagged = events_panel(spark, d).withColumn("is_event", F.col("value") >= 200)
    return tidy(
        flagged.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_event").cast("double")).alias("prevalence"))
    )


@query(
    "unit_bins",
    f"""WITH {EV_SQL} SELECT CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n FROM ev
        WHERE value / 10 < (SELECT ceil(max(value / 10)) FROM ev) GROUP BY 1""",
)
def unit_bins(spark, d):
    binned = clean.unit_bins(events_panel(spark, d).select((F.col("value") / 10).alias("v")), "v")
    return binned.groupBy(F.col("bin").cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "ordered_category",
    """SELECT o_orderpriority, count(*) AS n, CAST(min(rk) AS BIGINT) AS o_orderpriority_ord FROM orders JOIN (
         SELECT o_orderpriority AS p, row_number() OVER (ORDER BY min(o_totalprice), o_orderpriority) - 1 AS rk FROM orders GROUP BY o_orderpriority)
       ON p = o_orderpriority GROUP BY o_orderpriority""",
)
def ordered_category(spark, d):
    cats = clean.ordered_category(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")
    return tidy(
        cats.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderpriority_ord").alias("o_orderpriority_ord"))
    )


@query(
    "driver_interactions",
    f"""WITH {LI_SQL} SELECT station, date, round(sum(air_temp - water_temp), 6) AS air_temp_minus_water_temp_baseline,
        round(sum(wind_speed * air_temp), 6) AS wind_speed_x_air_temp, round(sum(solar * air_temp), 6) AS solar_x_air_temp
        FROM li GROUP BY station, date""",
)
def driver_interactions(spark, d):
    li = clean.driver_interactions(water_panel(spark, d).withColumnRenamed("water_temp", "water_temp_baseline"))
    cols = ["air_temp_minus_water_temp_baseline", "wind_speed_x_air_temp", "solar_x_air_temp"]
    return li.groupBy("station", "date").agg(*[r6(F.sum(c)).alias(c) for c in cols])


@query(
    "station_index",
    """WITH s AS (SELECT 'st' || (s_suppkey % 40) AS station, 'r' || (s_suppkey % 3) AS region_code, 'Region ' || (s_suppkey % 3) AS region_name,
         'st' || (s_suppkey % 40) || '-' || s_nationkey AS code, 'Name ' || (s_nationkey % 4) AS station_name,
         s_acctbal / 100 AS latitude, -abs(s_acctbal / 50) AS longitude FROM supplier),
       m AS (SELECT station, station_name FROM (SELECT station, station_name, count(*) AS n FROM s GROUP BY ALL)
             QUALIFY row_number() OVER (PARTITION BY station ORDER BY n DESC, station_name) = 1),
       g AS (SELECT station, region_code FROM (SELECT station, region_code, count(*) AS n FROM s GROUP BY ALL)
             QUALIFY row_number() OVER (PARTITION BY station ORDER BY n DESC, region_code) = 1)
       SELECT s.station, g.region_code, 'Region ' || right(g.region_code, 1) AS region_name, m.station_name, round(median(latitude), 6) AS latitude,
         round(median(longitude), 6) AS longitude, count(*) AS n_source_rows, count(DISTINCT s.station_name) AS n_unique_station_names,
         count(DISTINCT (latitude, longitude)) AS n_unique_coordinate_pairs, count(DISTINCT latitude) AS n_unique_latitudes,
         string_agg(DISTINCT code, '|' ORDER BY code) AS station_code_full_variants, false AS in_history
       FROM s JOIN m ON s.station = m.station JOIN g ON s.station = g.station GROUP BY s.station, g.region_code, m.station_name""",
)
def station_index_query(spark, d):
    s = table(spark, d, "supplier")
    station = F.concat(F.lit("st"), (F.col("s_suppkey") % 40).cast("string"))
    rows = s.select(
        station.alias("station"),
        F.concat(F.lit("r"), (F.col("s_suppkey") % 3).cast("string")).alias("region_code"),
        F.concat(F.lit("Region "), (F.col("s_suppkey") % 3).cast("string")).alias("region_name"),
        F.concat_ws("-", station, "s_nationkey").alias("station_code_full"),
        F.concat(F.lit("Name "), (F.col("s_nationkey") % 4).cast("string")).alias("station_name"),
        (F.col("s_acctbal") / 100).alias("latitude"),
        text.longitude(F.col("s_acctbal") / 50, F.lit("W")).alias("longitude"),
    )
    return station_index.build_station_index(rows)
