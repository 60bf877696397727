"""Projected days against plain loops, and the plan they come from."""

import datetime as dt
import random
from collections import defaultdict

from tidepanel.operators import scenario


def test_projected_days(spark):
    rng = random.Random(5)
    rows = []
    for station in (1, 2):
        for k in range(0, 900, 3 if station == 1 else 41):
            day = dt.date(2019, 1, 1) + dt.timedelta(days=k)
            rows.append(("R", station, day, *(None if rng.random() < 0.1 else rng.uniform(0, 30) for _ in range(4))))
    rows.append(("R", 3, dt.date(2020, 2, 2), None, 1.0, 2.0, 3.0))
    history = spark.createDataFrame(rows, "region string, station int, date date, air_temp double, precip double, wind_speed double, solar double")
    stations = spark.createDataFrame([("R", s, s * 1.5) for s in (1, 2, 3, 4)], "region string, station int, depth double")
    paths = spark.createDataFrame([("a", 2027, 1.0), ("a", 2028, 2.0), ("b", 2028, 0.5), ("b", 2040, 9.0)], "scenario string, year int, air_temp_add_c double")
    days = scenario.driver_days(history, stations, paths, 2026, 2030)
    assert days.columns == ["region", "station", "depth", "scenario", "year", "date", *scenario.DRIVERS, "doy"]

    by_day, overall = defaultdict(list), defaultdict(list)
    for _, station, day, *values in rows:
        for name, v in zip(scenario.DRIVERS, values, strict=True):
            if v is not None:
                by_day[station, name, min(day.timetuple().tm_yday, 365)].append(v)
                overall[station, name].append(v)

    def mean(values):
        return sum(values) / len(values) if values else None

    want = {}
    for station in (1, 2, 3, 4):
        for name, year, add in (("a", 2027, 1.0), ("a", 2028, 2.0), ("b", 2028, 0.5)):
            for k in range(366 if year == 2028 else 365):
                day = dt.date(year, 1, 1) + dt.timedelta(days=k)
                base = [mean(by_day[station, d, min(k + 1, 365)] or overall[station, d]) for d in scenario.DRIVERS]
                base[0] = None if base[0] is None else base[0] + add
                want[station, name, day] = (station * 1.5, *base)
    got = {(r["station"], r["scenario"], r["date"]): (r["depth"], *(r[d] for d in scenario.DRIVERS)) for r in days.collect()}
    assert got.keys() == want.keys()
    for key, values in want.items():
        for a, b in zip(got[key], values, strict=True):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)


def test_no_day_is_shuffled(spark):
    history = spark.range(2000).selectExpr("concat('R', id % 3) as region", "id % 5 as station", "date_add(date'2020-01-01', cast(id as int)) as date", *[f"cast(id as double) as {c}" for c in scenario.DRIVERS])
    stations = history.select("region", "station").distinct()
    rolled = scenario.driver_rolls(scenario.driver_days(history, stations, scenario.scenario_ramp(spark), 2026, 2100))
    plan = rolled.groupBy("region", "station", "scenario", "year").max("air_temp_r7d")._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "Window" in above and "Exchange" not in above


def test_manifest_names_each_stations_files(spark):
    """Paths are made once and every station gets them all; the files needed are the manifest's different ones."""
    stations = spark.createDataFrame([("R", i) for i in range(5)] + [("R", 4), (None, 7)], "region string, station int").coalesce(1)
    few = dict(members={"M": "r1", "N": "r2"}, scenario_years={"past": (2000, 2002)}, variables={"tas": ("air_temp", "K", "C", "note")})
    man = scenario.asset_manifest(stations, "https://x/", **few)
    rows = man.collect()
    assert len(rows) == 7 * 6 and man.columns == ["region", "station", *(c for c in scenario.asset_rows(stations, "", **few).columns if c not in stations.columns)]
    assert {r["file_url"] for r in rows if r["station"] == 7} == {f"https://x/{m}/past/{v}/tas/tas_day_{m}_past_{v}_gn_{y}.nc" for m, v in few["members"].items() for y in (2000, 2001, 2002)}
    assert man.rdd.getNumPartitions() > 1
    needed = scenario.needed_assets(stations, "https://x/", **few)
    assert sorted(map(tuple, needed.collect())) == sorted(map(tuple, scenario.unique_assets(man).collect()))
    assert scenario.needed_assets(stations.limit(0), "https://x/", **few).count() == 0


def test_rolls_without_a_sort_are_those_of_windows(spark):
    """Trailing means come from sums made once per station; a year before is met by its last days, leap or not."""
    rng = random.Random(6)
    rows = [("R" if s != 3 else None, s, dt.date(2019, 1, 1) + dt.timedelta(days=7 * k), *(None if s == 2 and c == 0 else rng.uniform(0, 30) for c in range(4))) for s in (1, 2, 3) for k in range(120)]
    history = spark.createDataFrame(rows, "region string, station int, date date, air_temp double, precip double, wind_speed double, solar double")
    stations = history.select("region", "station").distinct()
    steps = [("a", 2027, 1.0, 0.5), ("a", 2028, 2.0, None), ("a", 2029, None, 2.0), ("b", 2026, 0.5, 1.5), ("b", 2029, 9.0, 0.1), ("c", 2024, 1.0, 1.0), (None, 2027, 1.0, 3.0)]
    paths = spark.createDataFrame(steps, "scenario string, year int, air_temp_add_c double, precip_mult double")
    want = scenario.driver_rolls(scenario.driver_days(history, stations, paths, 2026, 2029))
    got = scenario.rolled_driver_days(history, stations, paths, 2026, 2029)
    assert sorted(got.columns) == sorted(want.columns)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString().split("Generate explode(sequence")[0]
    key = lambda r: (r["station"], r["scenario"] or "", r["date"])
    got, want = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert len(got) == len(want) == 3 * (365 * 6 + 1)
    for a, b in zip(got, want, strict=True):
        for c in b.asDict():
            assert a[c] == b[c] or abs(a[c] - b[c]) < 1e-9, (c, a, b)
