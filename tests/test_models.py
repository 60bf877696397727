"""Regimes, neighbours, density, decomposition and models against brute force or closed forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import causality, clusters, decompose, density, evaluate, models, neighbours, regime, risk
from tidepanel.session import scratch_path


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(7)
    pts = np.vstack([rng.normal(0, 0.3, (60, 3)), rng.normal(4, 0.3, (50, 3)), rng.uniform(-3, 8, (15, 3))])
    pts = np.vstack([pts, np.repeat(pts[:1], 40, axis=0)])  # one point forty times over
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id long, a double, b double, c double")
    return pts, neighbours.as_vectors(df, "id", ["a", "b", "c"])


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)


def test_knn_distance(cloud, small_blocks):
    pts, vec = cloud
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    for k in (5, 45):
        got = {r["id"]: r["kth_distance"] for r in neighbours.knn_distance(vec, k).collect()}
        want = np.sort(d, axis=1)[:, k - 1]
        assert [got[i] for i in range(len(pts))] == pytest.approx(list(want))


def test_range_counts(cloud, small_blocks):
    pts, vec = cloud
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    got = {r["id"]: r["n_neighbours"] for r in neighbours.range_counts(vec, 0.5).collect()}
    assert [got[i] for i in range(len(pts))] == list((d <= 0.5).sum(1))


def brute_dbscan(pts, eps, m):
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1)) <= eps
    core = d.sum(1) >= m
    label = np.full(len(pts), -1)
    n = 0
    for i in range(len(pts)):
        if not core[i] or label[i] >= 0:
            continue
        stack = [i]
        label[i] = n
        while stack:
            j = stack.pop()
            for q in np.nonzero(d[j])[0]:
                if label[q] < 0:
                    label[q] = n
                    if core[q]:
                        stack.append(q)
        n += 1
    return core, label


def test_vectors_of_many_dimensions_meet_in_blocks(spark, monkeypatch):
    """The bounds spare nothing here: no query is copied once per cell, and rounding decides nothing."""
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rng = np.random.default_rng(4)
    pts = rng.integers(-2, 3, (300, 24)) / 4.0 + 100.0
    pts = np.vstack([pts, pts[:1]])
    vec = neighbours.as_vectors(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "id long, v array<double>"), "id", "v")
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    eps = float(np.sort(d, axis=1)[7, 5])  # many distances equal it
    cells = neighbours.Cells(neighbours.merge_copies(vec), 1, eps)
    assert cells.visits(vec).count() == len(pts)
    got = {r["id"]: r["n_neighbours"] for r in neighbours.range_counts(vec, eps).collect()}
    assert [got[i] for i in range(len(pts))] == list((d <= eps).sum(1))
    near = {r["id"]: r["kth_distance"] for r in neighbours.knn_distance(vec, 6).collect()}
    assert [near[i] for i in range(len(pts))] == pytest.approx(list(np.sort(d, axis=1)[:, 5]))
    core, label = brute_dbscan(pts, eps, 4)
    found = {r["id"]: (r["is_core"], r["cluster"]) for r in density.dbscan(vec, eps, 4).collect()}
    assert [found[i] for i in range(len(pts))] == list(zip(core, label))


def test_closest_keeps_ties_and_odd_rows():
    a = np.array([[0.0] * 9, [np.nan] * 9, [1.0] * 9])
    b = np.array([[1.0] * 9, [0.0] * 9, [1.0] * 9, [np.inf] + [0.0] * 8])
    for width in (9, 3):
        i, j, d = neighbours.closest(a[:, :width], b[:, :width], 2)
        got = {n: list(j[i == n]) for n in range(3)}
        assert got == {0: [1, 0], 1: [0, 1], 2: [0, 2]}
        assert list(d[i == 2]) == [0, 0] and np.isnan(d[i == 1]).all()


@pytest.mark.parametrize("eps,m", [(0.35, 6), (0.6, 5), (0.05, 3)])
def test_dbscan(cloud, small_blocks, eps, m):
    pts, vec = cloud
    core, label = brute_dbscan(pts, eps, m)
    got = {r["id"]: (r["is_core"], r["cluster"]) for r in density.dbscan(vec, eps, m).collect()}
    assert [got[i][0] for i in range(len(pts))] == list(core)
    assert [got[i][1] for i in range(len(pts))] == list(label)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (200, 200)], "a long, b long")
    got = {r["node"]: r["component"] for r in density.components(links).collect()}
    assert {got[i] for i in range(61)} == {0} and got[101] == 100 and got[200] == 200


def test_nearest_within_group(spark, small_blocks):
    rng = random.Random(2)
    pts = [(i, i % 3, rng.random(), rng.random()) for i in range(120)]
    df = spark.createDataFrame(pts, "id long, m int, x double, y double")
    q = neighbours.as_vectors(df.filter("id < 30"), "id", ["x", "y"], "m")
    p = neighbours.as_vectors(df.filter("id >= 30"), "id", ["x", "y"], "m")
    got = {r["id"]: (r["neighbour"], r["distance"]) for r in neighbours.nearest(q, p, 1).filter("rank = 1").collect()}
    for i, m, x, y in pts[:30]:
        d, j = min((math.dist((x, y), (a, b)), j) for j, n, a, b in pts[30:] if n == m)
        assert got[i][0] == j and got[i][1] == pytest.approx(d)


def test_centroid_states(spark):
    features = ["a", "b", "c", "d"]
    centers = spark.createDataFrame([(0, -1.0, -1.0, -1.0, -1.0), (1, 1.0, 1.0, 1.0, 1.0)], "cluster int, a double, b double, c double, d double")
    scale = spark.createDataFrame([tuple([0.0] * 4 + [1.0] * 4)], [f"{f}_mu" for f in features] + [f"{f}_sd" for f in features])
    rows = [(1.0, 1.0, 1.0, 1.0, 0.9), (0.5, 0.5, 0.5, None, 0.9), (1.0, 1.0, None, None, 0.9), (1.0, 1.0, 1.0, 1.0, 0.5), (0.0, 0.0, 0.0, 0.0, 0.9), (1.0, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, cov double")
    out = regime.nearest_centroid(df, features, centers, scale, "cov").collect()
    assert [r["assignment_state"] for r in out] == ["classified_full", "classified_partial", "insufficient_features", "insufficient_coverage", "classified_full", "insufficient_coverage"]
    assert [r["implied_cluster"] for r in out] == [1, 1, None, None, 0, None]  # a tie goes to the lower cluster
    assert out[1]["dist_best"] == pytest.approx(math.sqrt(0.75)) and out[4]["margin"] == 0.0
    assert [r["n_features_used"] for r in out] == [4, 3, 2, 0, 4, 0]


def test_flat_feature_is_a_scaling_issue(spark):
    centers = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "cluster int, a double, b double, c double")
    scale = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0, 1.0, 0.0)], ["a_mu", "b_mu", "c_mu", "a_sd", "b_sd", "c_sd"])
    df = spark.createDataFrame([(1.0, 1.0, 1.0)], "a double, b double, c double")
    row = regime.nearest_centroid(df, ["a", "b", "c"], centers, scale).first()
    assert row["assignment_state"] == "scaling_issue" and row["implied_cluster"] is None


def test_crossing_needs_both_sides(spark):
    rows = [("r", "s", "x", 2026, 1, 1), ("r", "s", "x", 2031, 2, 1), ("r", "s", "x", 2040, 3, 1), ("r", "t", "x", 2030, None, 1), ("r", "u", "x", 2030, 2, None)]
    df = spark.createDataFrame(rows, "region string, station string, scenario string, year int, regime_roll5y int, cluster int")
    out = risk.crossings(df, 2026).collect()
    assert [(r["station"], r["first_regime_cross_year"], r["first_regime_cross_decade"]) for r in out] == [("s", 2031, 2030)]


def test_hypoxia_fills(spark):
    h = spark.createDataFrame([("r", "s", 2000, None, None)], "region string, station string, year int, oxygen_warm_hypoxic_day_share_abs double, oxygen_warm_min_abs double")
    f = spark.createDataFrame([("r", "s", "x", 2095, 0.06, None)], "region string, station string, scenario string, year int, oxygen_warm_hypoxic_day_share_abs double, oxygen_warm_min_abs double")
    r = risk.hypoxia_change(h, f).first()
    assert (r["hist_hypoxia_any"], r["new_hypoxia_flag"], r["hypoxia_intensifies_flag"]) == (False, True, True)


@pytest.mark.parametrize("weighted", [False, True])
def test_ridge_matches_the_closed_form(spark, weighted):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.2]
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=200)
    w = rng.choice([1.0, 2.0, 3.0], 200) if weighted else np.ones(200)
    df = spark.createDataFrame([(*map(float, r), float(t), float(v)) for r, t, v in zip(x, y, w)], "a double, b double, c double, y double, w double")
    m = models.fit_ridge(models.assemble(df, {"a": 0.0, "b": 0.0, "c": 0.0}), "y", "w" if weighted else None)
    mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    xc, yc = x - mx, y - my
    beta = np.linalg.solve((xc * w[:, None]).T @ xc + np.eye(3), (xc * w[:, None]).T @ yc)
    assert m.coefficients.toArray() == pytest.approx(beta, abs=1e-6)
    assert m.intercept == pytest.approx(my - mx @ beta, abs=1e-6)


@pytest.fixture(scope="module")
def grouped(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s in range(12):
        for _ in range(10 + 8 * s):
            a = float(rng.normal())
            rows.append(("r", f"s{s}", a, float(2 * a + 1 + rng.normal() * 0.1)))
    return spark.createDataFrame(rows, "region string, station string, a double, y double")


def test_folds_never_part_a_station(grouped):
    folds = models.group_folds(grouped).collect()
    assert len(folds) == 12 and {f["fold"] for f in folds} == set(range(5))
    oof = models.oof_predictions(models.ridge, models.assemble(grouped, {"a": 0.0}), "y")
    assert oof.count() == grouped.count()
    assert oof.groupBy("station").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    scores = evaluate.regression_scores(oof, "y", "oof").first()
    assert scores["r2"] > 0.98 and abs(scores["bias"]) < 0.05


def test_single_group_predicts_in_sample(grouped):
    one = grouped.filter("station = 's3'")
    assert models.oof_predictions(models.ridge, models.assemble(one, {"a": 0.0}), "y").filter("oof is null").count() == 0


def test_persisted_model_scores_alike(spark, grouped):
    r = models.fit_response(grouped, ["a"], "y", calibrate=True)
    root = scratch_path(spark, "m")
    models.save_models(spark, {"m": r}, root, "1")
    back = models.load_model(spark, root, "m")
    a = [x["p"] for x in r.predict(grouped, "p").orderBy("a").collect()]
    b = [x["p"] for x in back.predict(grouped, "p").orderBy("a").collect()]
    assert a == pytest.approx(b)
    with pytest.raises(ValueError):
        models.load_model(spark, root, "nope")


def test_weights(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "y double")
    low = [r["weight"] for r in models.tail_weights(df, "y", "oxygen_warm_min").orderBy("y").collect()]
    assert low == [3.0, 2.0, 2.0] + [1.0] * 7
    high = [r["weight"] for r in models.tail_weights(df, "y", "oxygen_warm_hypoxic_day_share").orderBy("y").collect()]
    assert high == [1.0] * 7 + [2.0, 2.0, 3.0]
    both = [r["weight"] for r in models.tail_weights(df, "y", "delta_ph").orderBy("y").collect()]
    assert both == [1.75, 1.75] + [1.0] * 6 + [1.75, 1.75]
    few = df.filter("y < 8")
    assert {r["weight"] for r in models.tail_weights(few, "y", "delta_ph").collect()} == {1.0}


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, s double")
    assert evaluate.roc_auc(df, "y", "s").first()["value"] == 0.875


def test_stl_recovers_a_seasonal_line(spark):
    t = np.arange(120)
    season = 3 * np.sin(2 * np.pi * t / 12)
    trend, seasonal = decompose.stl(10 + 0.05 * t + season)
    assert np.abs(trend - (10 + 0.05 * t)).max() < 0.05 and np.abs(seasonal - season).max() < 0.05
    y = 10 + 0.05 * t + season
    y[50] += 30  # one wild value must not move a robust fit
    rt, rs = decompose.stl(y)
    assert abs(rt[50] - (10 + 0.05 * 50)) < 0.3


def test_series_decomposed_together_stay_apart(spark):
    """Series of equal and unequal lengths, a constant one, copies, one too short; each as if it were alone, in any partitioning."""
    rng = np.random.default_rng(6)
    series = {f"s{i}": 5 + np.sin(np.arange(n) / 1.9) + rng.normal(size=n) for i, n in enumerate((60, 60, 60, 25, 24, 23, 1))}
    series |= {"flat": np.full(60, 2.0), "copy": series["s1"]}
    rows = [("r", s, "v", i, float(y), f"n{i}") for s, ys in series.items() for i, y in enumerate(ys)]
    df = spark.createDataFrame(rows, "region string, station string, variable string, k int, filled double, note string").orderBy(F.rand(3)).repartition(3)
    df = df.select("note", "region", "station", "variable", F.add_months(F.lit("2000-01-01").cast("date"), F.col("k")).alias("month_date"), "filled")
    got = decompose.decompose(df)
    assert got.columns == [*df.columns, "trend", "seasonal", "fitted"]
    for s, ys in series.items():
        part = got.filter(F.col("station") == s).orderBy("month_date").collect()
        assert [r["filled"] for r in part] == ys.tolist() and [r["note"] for r in part] == [f"n{i}" for i in range(len(ys))]
        if len(ys) < 24:
            assert all(r["trend"] is None and r["seasonal"] is None and r["fitted"] is None for r in part)
        else:
            trend, seasonal = decompose.stl(ys)
            assert [r["trend"] for r in part] == pytest.approx(trend, abs=1e-9) and [r["seasonal"] for r in part] == pytest.approx(seasonal, abs=1e-9)
    assert decompose.decompose(df.limit(0)).count() == 0


def test_extension_continues_the_line(spark):
    rows = [("r", "s", "v", 24 * 12 + i, float(i), 0.0) for i in range(36)]
    df = spark.createDataFrame(rows, "region string, station string, variable string, k int, trend double, seasonal double")
    df = df.withColumn("month_date", F.add_months(F.lit("1976-01-01").cast("date"), F.col("k")))
    df = df.withColumns({"observed": F.col("trend"), "filled": F.col("trend"), "fitted": F.col("trend")}).drop("k")
    out = decompose.extend(df, end_year=2003).filter("is_future").orderBy("month_date").collect()
    assert len(out) == 12 and [r["trend"] for r in out] == pytest.approx([36.0 + i for i in range(12)])
    assert out[0]["trend_slope_per_year"] == pytest.approx(12.0)


def test_f_tail_values():
    assert causality.f_tail(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert causality.f_tail(2.866081, 4, 20) == pytest.approx(0.05, abs=1e-6)
    assert causality.f_tail(0.0, 2, 5) == 1.0


def test_granger_finds_the_driver(spark):
    import datetime as dt

    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    y = np.zeros(300)
    for i in range(1, 300):
        y[i] = 0.3 * y[i - 1] + 0.8 * x[i - 1] + rng.normal() * 0.2
    z = rng.normal(size=300)
    rows = [("r", "s", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(x[i]), float(y[i]), float(z[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "region string, station string, date date, x double, y double, z double")
    p = {r["lag"]: r["p_value"] for r in causality.granger(df, "x", "y", 2).collect()}
    q = {r["lag"]: r["p_value"] for r in causality.granger(df, "z", "y", 2).collect()}
    assert p[1] < 1e-6 and q[1] > 0.001


def test_granger_equals_plain_least_squares(spark):
    """Series of several lengths, too short ones, gaps, a constant driver and an exact response; every lag by brute force."""
    import datetime as dt

    rng = np.random.default_rng(4)
    series = {name: (rng.normal(size=n).cumsum() + 20, rng.normal(size=n).cumsum() + 5) for name, n in {"a": 200, "b": 41, "c": 12, "d": 4, "e": 1}.items()}
    series["flat"] = (np.full(60, 3.0), rng.normal(size=60))
    line = rng.normal(size=80)
    series["exact"] = (line, np.concatenate([[0.0], line[:-1]]))
    rows = [("r", s, dt.date(2020, 1, 1) + dt.timedelta(days=2 * i), float(x), None if s == "a" and i % 17 == 3 else float(y)) for s, (xs, ys) in series.items() for i, (x, y) in enumerate(zip(xs, ys))]
    df = spark.createDataFrame(rows, "region string, station string, date date, x double, y double").repartition(5)
    got = {(r["station"], r["lag"]): (r["n_rows"], r["f_stat"]) for r in causality.granger(df, "x", "y", 6).collect()}
    want = {}
    for s in series:
        pts = [(x, y) for _, name, _, x, y in rows if name == s and y is not None]
        x, y = np.array([v[0] for v in pts]), np.array([v[1] for v in pts])
        for p in range(1, 7):
            n = len(pts) - p
            if n - 2 * p - 1 < 1 or s == "exact":
                continue
            lagged = lambda v: [v[p - k : len(v) - k] for k in range(1, p + 1)]
            small = np.column_stack([np.ones(n), *lagged(y)])
            rss = [float(((y[p:] - m @ np.linalg.lstsq(m, y[p:], rcond=None)[0]) ** 2).sum()) for m in (small, np.column_stack([small, *lagged(x)]))]
            want[s, p] = (n, (rss[0] - rss[1]) / p / (rss[1] / (n - 2 * p - 1)))
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], rel=1e-6, abs=1e-9) for k in want)
    assert causality.granger(df.limit(0), "x", "y", 3).count() == 0


def test_k_scan_prefers_the_true_k(spark):
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.normal(c, 0.1, (40, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "a double, b double")
    scan = clusters.k_scan(clusters.z_vectors(df, ["a", "b"]), range(2, 6))
    assert clusters.best_k(scan) == 3
    assert [r["inertia_drop"] is None for r in scan.orderBy("k").collect()] == [True, False, False, False]


def test_kmeans_settles_on_its_sample_first(spark, monkeypatch):
    """Few rounds over all vectors, and each result is still a fixed point of a round over all of them."""
    rng = np.random.default_rng(5)
    pts = rng.normal(size=(3000, 6))
    df = clusters.array_vectors(spark.createDataFrame([(p.tolist(),) for p in pts], "v array<double>").repartition(4), "v")
    monkeypatch.setattr(clusters, "START_SAMPLE", 3000)
    passes, plain = [], clusters._round
    monkeypatch.setattr(clusters, "_round", lambda v, m: passes.append(len(m)) or plain(v, m))
    model = clusters.fit_kmeans(df, 5, starts=4)
    assert len(passes) <= 3
    at = ((pts[:, None] - model.centres[None]) ** 2).sum(-1).argmin(1)
    assert np.allclose(model.centres, [pts[at == i].mean(0) for i in range(5)])
    assert model.cost == pytest.approx(((pts - model.centres[at]) ** 2).sum())


def test_series_stay_arrow_data(spark, monkeypatch):
    """Slices of a batch, series of several lengths, a short one and one with a gap."""
    monkeypatch.setattr(decompose, "SERIES", 2)
    rng = np.random.default_rng(6)
    lengths = [30, 48, 30, 5, 48]
    data = [(1, s, "v", i, float(rng.normal() + i % 12), f"t{i}") for s, n in enumerate(lengths) for i in range(n)]
    df = spark.createDataFrame(data, "region int, station int, variable string, month_date int, filled double, note string")
    got = {(r["station"], r["month_date"]): r for r in decompose.decompose(df).collect()}
    assert len(got) == sum(lengths) and all(r["note"] == f"t{r['month_date']}" for r in got.values())
    for s, n in enumerate(lengths):
        y = np.array([x[4] for x in data if x[1] == s])
        if n < 24:
            assert all(got[s, i]["trend"] is None for i in range(n))
        else:
            trend, seasonal = decompose.stl(y)
            assert np.allclose([got[s, i]["trend"] for i in range(n)], trend) and np.allclose([got[s, i]["seasonal"] for i in range(n)], seasonal)


def test_kmeans_keeps_the_best_of_many_starts(spark):
    """Against plain rounds from each start in numpy; one far point, copies, and fewer different points than centres."""
    rng = np.random.default_rng(8)
    pts = np.vstack([rng.normal(c, 0.4, (n, 2)) for c, n in (((0, 0), 90), ((3, 0), 10), ((0, 3), 25), ((3.5, 0.5), 6))] + [[[50.0, 50.0]], np.zeros((20, 2))])
    df = clusters.array_vectors(spark.createDataFrame([(p.tolist(),) for p in pts], "v array<double>").repartition(4), "v")
    got = clusters.fit_many(df, [2, 4], starts=8, seed=1)
    hashed = np.array([r["v"] for r in df.orderBy(F.xxhash64("v"), "v").collect()])
    for k, model in got.items():
        costs = []
        for i in range(8):
            c = clusters._first_centres(hashed, k, np.random.default_rng((1, k, i)))
            for _ in range(200):
                at = ((pts[:, None] - c[None]) ** 2).sum(-1).argmin(1)
                c = np.array([pts[at == j].mean(0) if (at == j).any() else c[j] for j in range(k)])
            costs.append(((pts - c[at]) ** 2).sum())
        assert model.cost == pytest.approx(min(costs), rel=1e-9) and max(costs) >= min(costs)
        near = model.transform(df).collect()
        assert all(r["cluster"] == ((np.array(r["v"]) - model.centres) ** 2).sum(-1).argmin() for r in near)
    same = clusters.array_vectors(spark.createDataFrame([([1.0, 2.0],)] * 5, "v array<double>"), "v")
    assert clusters.fit_kmeans(same, 3, starts=2).cost == 0
    with pytest.raises(ValueError, match="no vectors"):
        clusters.fit_kmeans(same.limit(0), 2)


def test_rows_of_boosting_travel_narrow(spark):
    """Trees get their vector, label and two hashes, whatever else a row holds; many rows share some partitions per core."""
    df = spark.range(600).selectExpr("id", "id % 7 as x", "cast(id % 5 as double) as y", "'long text' as other", "id * 2 as more")
    ready = models.row_hashes(models.assemble(df, {"x": 0.0}))
    assert models.row_hashes(ready) is ready
    narrow, wide = ready.select("features", "y", *models.ROW_HASHES), models.assemble(df, {"x": 0.0})
    a, b = (models.fit_gbt(t, "y", None, 5, 3, stop_early=True) for t in (narrow, wide))
    assert a.toDebugString.split("\n")[1:] == b.toDebugString.split("\n")[1:]
    cores = spark.sparkContext.defaultParallelism
    assert models.dealt(narrow, 10_000_000).rdd.getNumPartitions() <= max(models.TASKS_A_CORE * cores, 40)
    assert models.dealt(narrow, 20_000).rdd.getNumPartitions() == 2


def test_linear_predictions_build_no_vectors(spark):
    df = spark.createDataFrame([(1.0, 2, 3.0), (None, 5, 4.0), (4.0, None, 9.0), (2.5, 1, 2.0)], "a double, b int, y double")
    response = models.fit_response(df, ["a", "b"], "y", name="line")
    got = response.predict(df, "p")
    assert "UDF" not in got._jdf.queryExecution().optimizedPlan().toString() and got.columns == ["a", "b", "y", "p"]
    want = response.model.transform(models.assemble(df, response.fills))
    for g, w in zip(got.collect(), want.collect(), strict=True):
        assert abs(g["p"] - w["prediction"]) < 1e-12
    odd = spark.createDataFrame([(float("nan"), 1, 0.0)], df.schema)
    with pytest.raises(Exception, match="NaN"):
        response.predict(odd, "p").collect()


def test_kmeans_settles_on_all_vectors_a_task_can_hold(spark, monkeypatch):
    """Beyond the sample, too, few rounds go over the table; with more vectors than a task holds, they all do, to the same result."""
    rng = np.random.default_rng(15)
    pts = np.vstack([rng.normal(c, 1.0, (400, 3)) for c in ((0, 0, 0), (3, 0, 1), (0, 3, 2), (2, 2, 0))])
    df = clusters.array_vectors(spark.createDataFrame([(p.tolist(),) for p in pts], "v array<double>").repartition(4), "v")
    monkeypatch.setattr(clusters, "START_SAMPLE", 200)
    passes, plain = [], clusters._round
    monkeypatch.setattr(clusters, "_round", lambda v, m: passes.append(len(m)) or plain(v, m))
    held = clusters.fit_kmeans(df, 6, starts=4)
    few = len(passes)
    monkeypatch.setattr(clusters, "HELD", 1000)
    table = clusters.fit_kmeans(df, 6, starts=4)
    assert few <= 3 < len(passes) - few
    assert np.allclose(held.centres, table.centres) and held.cost == pytest.approx(table.cost)
    at = ((pts[:, None] - held.centres[None]) ** 2).sum(-1).argmin(1)
    assert np.allclose(held.centres, [pts[at == i].mean(0) for i in range(6)])
    odd = clusters.array_vectors(spark.createDataFrame([([1.0, float(i)],) for i in range(300)] + [([1.0],)], "v array<double>"), "v")
    with pytest.raises(Exception, match="different lengths|inhomogeneous"):
        clusters.fit_kmeans(odd, 2, starts=1)
