"""Scenario paths, projected driver days, case pools and the climate asset manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel import KEYS
from tidepanel.functions import dates
from tidepanel.functions.stats import one_row
from tidepanel.operators.rolling import DRIVER_WINDOWS, trailing_mean
from tidepanel.session import spread_groups

# Scenario, air temperature added by the last year, and the end multipliers of
# precipitation, wind speed and solar radiation.
RAMP_SPECS = [
    ("ssp245_demo", 1.8, 1.00, 1.00, 1.00),
    ("ssp585_demo", 3.7, 0.97, 1.02, 1.00),
]
RAMP_YEARS = (2026, 2100)
# What an absent path column means.
PATH_DEFAULTS = {"air_temp_add_c": 0.0, "precip_mult": 1.0, "wind_speed_mult": 1.0, "solar_mult": 1.0}
# Benchmark scenarios (name, added air temperature, precipitation multiplier).
BENCHMARKS = [
    ("baseline_ref", 0.0, 1.00),
    ("plus1p0C_precip_same", 1.0, 1.00),
    ("plus1p5C_precip_same", 1.5, 1.00),
    ("plus2p0C_precip_same", 2.0, 1.00),
]
WET_DRY_BENCHMARKS = [
    ("baseline_ref", 0.0, 1.00),
    ("plus1p5C_precip_minus10pct", 1.5, 0.90),
    ("plus1p5C_precip_same", 1.5, 1.00),
    ("plus1p5C_precip_plus10pct", 1.5, 1.10),
]
DRIVERS = ["air_temp", "precip", "wind_speed", "solar"]
STATION_YEAR_ROWS = 40  # how many rows' work the days of a station's year count for when stations are dealt over tasks


def scenario_ramp(spark: SparkSession, specs: Sequence[tuple] = RAMP_SPECS, first: int = RAMP_YEARS[0], last: int = RAMP_YEARS[1]) -> DataFrame:
    """One row per scenario and year, every factor moving linearly to its end value."""
    schema = "scenario string, _air double, _precip double, _wind double, _solar double"
    frac = (F.col("year") - first) / F.lit(float(max(1, last - first)))
    return (
        spark.createDataFrame(list(specs), schema)
        .withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
        .select(
            "scenario",
            "year",
            (F.col("_air") * frac).alias("air_temp_add_c"),
            *[
                (1.0 + (F.col(c) - 1.0) * frac).alias(n)
                for c, n in [("_precip", "precip_mult"), ("_wind", "wind_speed_mult"), ("_solar", "solar_mult")]
            ],
        )
    )


def path_defaults(paths: DataFrame) -> DataFrame:
    return paths.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) if c in paths.columns else F.lit(v) for c, v in PATH_DEFAULTS.items()}
    )


def future_days(stations: DataFrame, paths: DataFrame, first: int, last: int) -> DataFrame:
    """Every station on every day of the scenario years, once per scenario.

    Days are exploded per station and the paths (scenarios x years) are joined by year, so nothing is crossed;
    whether they are broadcast is left to Spark, which knows their size.
    """
    day = F.explode(F.sequence(F.lit(f"{first}-01-01").cast("date"), F.lit(f"{last}-12-31").cast("date")))
    days = stations.withColumn("date", day).withColumns({"year": F.year("date"), "doy": dates.clipped_doy(F.col("date"))})
    return days.join(path_defaults(paths), "year")


def packed_climatology(history: DataFrame, drivers: Sequence[str] = DRIVERS, keys: Sequence[str] = KEYS, out: str = "_days") -> DataFrame:
    """One row per station: an array of its mean drivers on the 365 clipped days, the station's mean where a day has none.

    Sums and counts per day give both means, so the history is read once and combined before its shuffle.
    """
    doy = dates.clipped_doy(F.col("date")).alias("_doy")
    sums = [a for c in drivers for a in (F.sum(c).alias(f"_s_{c}"), F.count(c).alias(f"_n_{c}"))]
    days = history.groupBy(*keys, doy).agg(*sums)
    cell = F.struct(*[(F.col(f"_s_{c}") / F.nullif(F.col(f"_n_{c}"), F.lit(0))).alias(c) for c in drivers])
    means = F.struct(*[(F.sum(f"_s_{c}") / F.nullif(F.sum(f"_n_{c}"), F.lit(0))).alias(c) for c in drivers])
    # 365 entries at most for each station
    packed = days.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_doy", cell.alias("_c")))).alias("_m"), means.alias("_mean"))
    at = F.transform(F.sequence(F.lit(1), F.lit(365)), lambda k: F.try_element_at("_m", k))
    filled = F.transform(at, lambda d: F.struct(*[F.coalesce(d[c], F.col("_mean")[c]).alias(c) for c in drivers]))
    return packed.select(*keys, filled.alias(out))


def station_steps(history: DataFrame, stations: DataFrame, paths: DataFrame, first: int, last: int, keys: Sequence[str] = KEYS, n_stations: int = 0) -> DataFrame:
    """Every station with the steps of the paths (a scenario and year each): ``_steps``, with the one ``before`` in its scenario, and ``_days``.

    Stations meet their packed climatology and the paths (an array of scenarios x years) while there is one row each. Their
    number, if known, deals them over more tasks, so that a task that sums up years holds few of them.
    """
    factors = F.struct("year", *PATH_DEFAULTS)
    before = F.lag(factors).over(Window.partitionBy("scenario").orderBy("year"))
    steps = path_defaults(paths).filter(F.col("year").between(first, last)).withColumn("before", before)
    steps = steps.agg(F.array_sort(F.collect_list(F.struct("scenario", "year", *PATH_DEFAULTS, "before"))).alias("steps"))
    rows = stations.join(packed_climatology(history, keys=keys), list(keys), "left").withColumn("_steps", one_row(steps)["steps"])
    return spread_groups(rows, list(keys), n_stations * STATION_YEAR_ROWS * (last - first + 1))


def _year_length(year: Column) -> Column:
    return F.datediff(F.make_date(year + 1, F.lit(1), F.lit(1)), F.make_date(year, F.lit(1), F.lit(1)))


def _moved(driver: str, value: Column, n: Column, step: Column) -> Column:
    """The sum of n days of a driver's climatology, shifted or scaled by a step of the path."""
    if driver == "air_temp":
        return value + n * step["air_temp_add_c"]
    return value * step[{"precip": "precip_mult", "wind_speed": "wind_speed_mult", "solar": "solar_mult"}[driver]]


def _sum_of_days(driver: str, start: Column, n: Column) -> Column:
    """Sum of a station's climatology over n days of a year from day ``start`` (1 is the first)."""
    part = F.transform(F.sequence(start, start + n - 1), lambda i: F.element_at("_days", F.least(i, F.lit(365)))[driver])
    return F.when(n > 0, F.aggregate(part, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def _window_sums(driver: str, w: int) -> Column:
    """For every day of a year: the sum over the w days before it, as far as they lie in its year."""
    return F.transform(F.sequence(F.lit(0), F.lit(365)), lambda k: _sum_of_days(driver, k - F.least(k, F.lit(w)) + 1, F.least(k, F.lit(w))))


def _end_sums(driver: str, longest: int, length: int) -> Column:
    """The sums over the last 0 to ``longest`` days of a year of so many days."""
    return F.transform(F.sequence(F.lit(0), F.lit(longest)), lambda j: _sum_of_days(driver, length - j + 1, j))


def driver_days(
    history: DataFrame, stations: DataFrame, paths: DataFrame, first: int, last: int, keys: Sequence[str] = KEYS, windows: Sequence[int] = (),
    n_stations: int = 0,
) -> DataFrame:
    """Daily drivers of every station, scenario and day from ``first`` to ``last``: climatology, shifted and scaled by the path.

    Years and then days are exploded last, so no day is shuffled or sorted. ``windows`` adds ``<driver>_r<w>d``, the mean of
    the w days before (the paths then hold one row per scenario and year): each station sums its climatology once, over the
    days before every day of a year and over the last days of a year. A day adds its own year's part and that of the year before.
    """
    rows = station_steps(history, stations, paths, first, last, keys, n_stations)
    kept = [c for c in stations.columns if c not in DRIVERS]
    longest = max(windows, default=0)
    if longest > 365:
        raise ValueError("a window reaches back into one year before, so it has 365 days at most")

    sums = {}
    for c in DRIVERS if windows else ():
        for w in windows:
            sums[f"_s_{c}_{w}"] = _window_sums(c, w)
        for length in (365, 366):
            sums[f"_e_{c}_{length}"] = _end_sums(c, longest, length)
    rows = rows.withColumns(sums).withColumn("_p", F.explode("_steps")).drop("_steps")
    start = F.make_date(F.col("_p.year"), F.lit(1), F.lit(1))
    ends = [x for x in sums if x.startswith("_e_")]
    tails = [F.when(_year_length(F.col("_p.before.year")) == 366, F.col(f"_e_{c}_366")).otherwise(F.col(f"_e_{c}_365")).alias(f"_t_{c}") for c in DRIVERS] if windows else []
    # an exploded day is a number: generated code reads its drivers from the station's array, which isn't copied per day
    rows = rows.select(
        *kept, "_days", "_p", *[x for x in sums if x not in ends], *tails, start.alias("_start"),
        F.explode(F.sequence(F.lit(0), _year_length(F.col("_p.year")) - 1)).alias("_k"),
    )
    base = F.element_at("_days", F.least(F.col("_k") + 1, F.lit(365)))
    moved = {c: _moved(c, base[c], F.lit(1), F.col("_p")) for c in DRIVERS}
    k, p, before = F.col("_k"), F.col("_p"), F.col("_p.before")
    for c in DRIVERS if windows else ():
        for w in windows:
            own = F.least(k, F.lit(w))
            late = F.when(before.isNotNull(), w - own).otherwise(0)
            value = _moved(c, F.element_at(f"_s_{c}_{w}", k + 1), own, p)
            value = F.when(late == 0, value).otherwise(value + _moved(c, F.element_at(f"_t_{c}", late + 1), late, before))
            moved[f"{c}_r{w}d"] = value / F.nullif(own + late, F.lit(0))
    out = rows.select(
        *kept, F.col("_p.scenario").alias("scenario"), F.col("_p.year").alias("year"), F.date_add("_start", k).alias("date"),
        *[v.alias(c) for c, v in moved.items()],
    )
    return out.withColumn("doy", dates.clipped_doy(F.col("date")))


def with_angles(days: DataFrame) -> DataFrame:
    """The unclipped day of year and its angle."""
    angle = dates.day_angle(F.col("date"))
    return days.withColumns({"doy": F.dayofyear("date"), "doy_sin": F.sin(angle), "doy_cos": F.cos(angle)})


def driver_rolls(days: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Trailing driver means per station and scenario of any daily table and the unclipped day-of-year angle; it sorts the days."""
    return with_angles(trailing_mean(days, DRIVERS, keys=[*keys, "scenario"]))


def rolled_driver_days(history: DataFrame, stations: DataFrame, paths: DataFrame, first: int, last: int, keys: Sequence[str] = KEYS, n_stations: int = 0) -> DataFrame:
    """``driver_rolls`` of ``driver_days`` without sorting or shuffling a day."""
    return with_angles(driver_days(history, stations, paths, first, last, keys, DRIVER_WINDOWS, n_stations))


def benchmark_rows(
    df: DataFrame, specs: Sequence[tuple] = BENCHMARKS, add: Sequence[str] = (), scale: Sequence[str] = ()
) -> DataFrame:
    """Each row once per benchmark scenario, with the named columns shifted or scaled."""
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("scenario"), F.lit(float(t)).alias("t"), F.lit(float(p)).alias("p"))
            for n, t, p in specs
        ]
    )
    out = df.withColumn("_s", F.explode(cells)).withColumn("scenario", F.col("_s.scenario"))
    changes = {c: F.col(c) + F.col("_s.t") for c in add if c in df.columns}
    changes.update({c: F.col(c) * F.col("_s.p") for c in scale if c in df.columns})
    return out.withColumns(changes).drop("_s")


def benchmark_forcing(base: DataFrame, specs: Sequence[tuple] = WET_DRY_BENCHMARKS) -> DataFrame:
    """Forcing deltas of a station-month baseline under each benchmark scenario."""
    moved = benchmark_rows(
        base.withColumns({"_t": F.lit(0.0), "_p": F.lit(1.0)}), specs, add=["_t"], scale=["_p"]
    )
    return moved.withColumns(
        {
            "delta_air_temp": F.col("_t"),
            "delta_precipitation": F.col("precipitation_baseline") * (F.col("_p") - 1.0),
            "delta_wind_speed": F.lit(0.0),
            "delta_solar_radiation": F.lit(0.0),
        }
    ).drop("_t", "_p")


# --- cases and priority stations -----------------------------------------------------------


def case_pool(
    mode: str, events: DataFrame, meta: DataFrame, holdout: DataFrame, available: DataFrame, station_keys: DataFrame | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Stations with a transition (holdout, train or all), or an explicit list of stations."""
    if mode not in {"holdout_transition", "train_transition", "all_transition", "station_list"}:
        raise ValueError(f"unknown case pool mode: {mode}")
    keys = list(keys)
    if mode == "station_list":
        if station_keys is None:
            raise ValueError("station_keys must be given for mode station_list")
        pool = station_keys.join(meta, keys, "left").join(events, keys, "left")
    else:
        pool = events.join(meta, keys, "left")
    marks = holdout.select(*keys).distinct().withColumn("is_holdout", F.lit(True))
    pool = pool.join(marks, keys, "left").join(available.select(*keys).distinct(), keys, "left_semi")
    pool = pool.withColumn("is_holdout", F.coalesce("is_holdout", F.lit(False))).withColumn("is_train", ~F.col("is_holdout"))
    if mode == "holdout_transition":
        pool = pool.filter("is_holdout")
    elif mode == "train_transition":
        pool = pool.filter("is_train")
    return pool


def normalise_station_keys(df: DataFrame, keys: Sequence[str] = KEYS, order: str = "case_order") -> DataFrame:
    """Trimmed keys in the order given, the first of equal keys kept."""
    trimmed = df.dropna(subset=list(keys)).withColumns({k: F.trim(F.col(k).cast("string")) for k in keys})
    return trimmed.groupBy(*keys).agg(F.min(order).alias(order))


def pick_cases(pool: DataFrame, n: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """The earliest case of every cluster first, then the earliest others, up to n.

    The first of each cluster is a partial aggregate and the rest a top-n, so no task sees
    the whole pool; only n rows are numbered.
    """
    order = F.struct("event_date", *keys)
    firsts = pool.filter(F.col("cluster").isNotNull()).groupBy("cluster").agg(F.min_by(F.struct(*keys), order).alias("_k"))
    firsts = firsts.select(*[F.col(f"_k.{k}").alias(k) for k in keys], F.lit(0).alias("_tier"), F.col("cluster").alias("_c"))
    ranked = pool.join(firsts, list(keys), "left").withColumn("_tier", F.coalesce("_tier", F.lit(1)))
    sort = [F.col("_tier"), F.col("_c").asc_nulls_last(), F.col("event_date").asc_nulls_last(), *[F.col(k) for k in keys]]
    top = ranked.orderBy(*sort).limit(n)
    number = F.row_number().over(Window.orderBy(*sort))  # n rows
    return top.withColumn("case_id", F.concat(F.lit("case_"), number.cast("string"))).drop("_tier", "_c")


PRIORITY_ORDER = [
    ("is_partial_baseline", True),
    ("mean_year_coverage", False),
    ("n_years_present", False),
    ("n_obs_total", False),
    ("event_date", True),
]


def rank_priority(events: DataFrame, stations: DataFrame, exclude: Sequence[str] = (), keys: Sequence[str] = KEYS) -> tuple[DataFrame, list[Column]]:
    """Transition stations outside the excluded regions and the order that ranks their baselines."""
    pool = events.join(stations, list(keys), "left").filter(F.col("event_date").isNotNull())
    if exclude:
        pool = pool.filter(~F.lower("region").isin([e.lower() for e in exclude]))
    fills = {c: F.coalesce(F.col(c), F.lit(False if c.startswith("is_") else 0)) for c, _ in PRIORITY_ORDER[:4] if c in pool.columns}
    pool = pool.withColumns(fills)
    order = [F.col(c).asc() if up else F.col(c).desc() for c, up in PRIORITY_ORDER if c in pool.columns]
    return pool, [*order, *[F.col(k) for k in keys]]


def priority_stations(stations: DataFrame, events: DataFrame, regions: Sequence[str], with_extra: bool = True, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every station of the chosen regions and the best-ranked transition station outside them."""
    wanted = [r.lower() for r in regions]
    members = stations.filter(F.lower("region").isin(wanted)).withColumn("selection_reason", F.lit("region_member"))
    if not with_extra:
        return members
    pool, order = rank_priority(events, stations, regions, keys)
    extra = pool.orderBy(*order).limit(1).withColumn("selection_reason", F.lit("extra_complete"))
    both = members.unionByName(extra.select(*members.columns))
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max(F.struct("selection_reason", *[c for c in rest if c != "selection_reason"])).alias("_r")).select(
        *keys, "_r.*"
    )


def bounding_box(stations: DataFrame, padding: float = 0.25) -> DataFrame:
    return stations.agg(
        (F.min("longitude") - padding).alias("lon_min"),
        (F.max("longitude") + padding).alias("lon_max"),
        (F.min("latitude") - padding).alias("lat_min"),
        (F.max("latitude") + padding).alias("lat_max"),
    )


# Climate models with their members, scenario years and variables.
MODEL_MEMBERS = {
    "ACCESS-CM2": "r1i1p1f1",
    "ACCESS-ESM1-5": "r1i1p1f1",
    "BCC-CSM2-MR": "r1i1p1f1",
    "CanESM5": "r1i1p1f1",
    "MRI-ESM2-0": "r1i1p1f1",
}
SCENARIO_YEARS = {"historical": (1950, 2014), "ssp245": (2015, 2100), "ssp585": (2015, 2100)}
VARIABLE_SPECS = {
    "tas": ("air_temp", "K", "C", "target_c = tas - 273.15"),
    "pr": ("precip", "kg m-2 s-1", "mm day-1", "target_mm_day = pr * 86400"),
    "sfcWind": ("wind_speed", "m s-1", "m s-1", "no unit conversion"),
    "rsds": ("solar", "W m-2", "W m-2", "no unit conversion"),
}
ASSET_COLUMNS = ["model", "member", "scenario", "year", "variable", "target_driver", "native_units", "target_units", "conversion_note", "relative_path", "file_url"]


def asset_rows(df: DataFrame, base_url: str, members: dict = MODEL_MEMBERS, scenario_years: dict = SCENARIO_YEARS, variables: dict = VARIABLE_SPECS) -> DataFrame:
    """Each row once per model, scenario, variable and year, with the path of its file."""

    def cells(rows: list[tuple], names: list[str]) -> Column:
        return F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows]))

    out = (
        df.withColumn("_m", cells(list(members.items()), ["model", "member"]))
        .withColumn("_s", cells([(k, a, b) for k, (a, b) in scenario_years.items()], ["scenario", "first", "last"]))
        .withColumn("_v", cells([(k, *v) for k, v in variables.items()], ["variable", "target_driver", "native_units", "target_units", "conversion_note"]))
        .withColumn("year", F.explode(F.sequence(F.col("_s.first"), F.col("_s.last"))))
    )
    out = out.select(*df.columns, "_m.*", "_s.scenario", "year", "_v.*")
    name = F.format_string("%s_day_%s_%s_%s_gn_%d.nc", "variable", "model", "scenario", "member", "year")
    path = F.concat_ws("/", "model", "scenario", "member", "variable", name)
    return out.withColumn("relative_path", path).withColumn("file_url", F.concat(F.lit(base_url.rstrip("/") + "/"), "relative_path"))


def asset_manifest(
    stations: DataFrame, base_url: str, members: dict = MODEL_MEMBERS, scenario_years: dict = SCENARIO_YEARS, variables: dict = VARIABLE_SPECS
) -> DataFrame:
    """One row per station, model, scenario, variable and year, with the path of its file.

    Files don't depend on the station, so their paths are made once, as one array that every station explodes. Stations are
    dealt over all tasks before that, since a small table comes as one.
    """
    files = asset_rows(stations.sparkSession.range(1).select(), base_url, members, scenario_years, variables)
    step = F.array_sort(F.collect_list(F.struct(*files.columns)))
    rows = spread_groups(stations, stations.columns).withColumn("_a", F.explode(one_row(files.agg(step.alias("a")))["a"]))
    return rows.select(*stations.columns, "_a.*")


def needed_assets(stations: DataFrame, base_url: str, members: dict = MODEL_MEMBERS, scenario_years: dict = SCENARIO_YEARS, variables: dict = VARIABLE_SPECS) -> DataFrame:
    """The files that the manifest of these stations names, each once: those of any one station, since all need the same."""
    some = stations.agg(F.count(F.lit(1)).alias("_n")).filter("_n > 0").select()
    return asset_rows(some, base_url, members, scenario_years, variables).select(*ASSET_COLUMNS)


def unique_assets(manifest: DataFrame) -> DataFrame:
    return manifest.select(*[c for c in ASSET_COLUMNS if c in manifest.columns]).distinct()


def manifest_summary(assets: DataFrame) -> DataFrame:
    return assets.groupBy("model", "scenario", "variable").agg(
        F.count("file_url").alias("n_files"), F.min("year").alias("year_start"), F.max("year").alias("year_end")
    )
