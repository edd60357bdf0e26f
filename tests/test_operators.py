"""Operators on small tables, with gaps, ties and empty input."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from galeframe.functions import cdf
from galeframe.functions.constants import QCOLS
from galeframe.operators import assemble, boosting, experiments, grid, metrics, ml, networks, observations, ordered, publish, qc, quantiles, reshape, schema, spatial

NAN = float("nan")


def test_aliases_and_missing_columns(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 3.0)], "SITE_ID string, z int, Latitude double, lng double")
    assert schema.aliased(df, ["station_id", "height_m", "lat", "lon"], ["name"]).columns == ["station_id", "height_m", "lat", "lon", "name"]
    with pytest.raises(ValueError, match="datetime"):
        schema.aliased(df, ["datetime"])
    with pytest.raises(ValueError, match="quantile"):
        schema.quantile_columns(df)


def test_filled(spark):
    df = spark.createDataFrame([(NAN, " ", None), (float("inf"), "x", 2)], "a double, b string, c int")
    assert [tuple(r) for r in schema.filled(df, zero_strings=True).collect()] == [(0, "0", 0), (0, "x", 2)]
    assert schema.filled(df, numeric_only=True).first()["b"] == " "
    assert schema.filled(df, replace_infinite=False).collect()[1]["a"] == float("inf")


def months(spark, counts):
    rows = [("s", 10.0, f"2020-{m:02d}-01 00:00:00") for m, n in enumerate(counts, 1) for _ in range(n)]
    return spark.createDataFrame(rows, "site_id string, height double, t string").withColumn("datetime", F.col("t").cast("timestamp")).drop("t")


@pytest.mark.parametrize(("counts", "kept", "reason"), [([100] * 12, True, "ok"), ([100] * 11 + [1], False, "insufficient_months_ge_threshold"), ([100] * 11 + [0], False, "insufficient_months_present")])
def test_month_balance(spark, counts, kept, reason):
    r = observations.month_balance(months(spark, counts)).first()
    assert (r["kept"], r["reason"], r["median_nonzero"], r["threshold"]) == (kept, reason, 100.0, 50.0)


def test_samples_per_day_takes_the_smaller_of_equal_counts(spark):
    rows = [("s", f"2021-01-0{d} {h:02d}:00:00") for d, n in ((1, 3), (2, 3), (3, 5), (4, 5)) for h in range(n)]
    df = spark.createDataFrame(rows, "s string, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert observations.expected_per_day(df, ["s"], "t").first()["per_day"] == 3


def test_complete_year_boundary(spark):
    hours = spark.range(8760).select(F.lit("s").alias("s"), F.expr("timestamp'2021-01-01' + make_interval(0, 0, 0, 0, cast(id as int))").alias("t"))
    assert observations.complete_years(hours.where("t < timestamp'2021-12-13 18:00:00'"), ["s"], "t").first()["n"] == 8322
    assert observations.complete_years(hours.where("t < timestamp'2021-12-13 17:00:00'"), ["s"], "t").isEmpty()


def test_normalised_samples(spark):
    df = spark.createDataFrame([("a", "10", "2020-01-01 00:00:00", "-1", "1", "2"), (None, "10", "2020-01-01", "1", "1", "2"), ("b", "10", "bad", "1", "1", "2")], "station_id string, z string, timestamp string, speed string, latitude string, longitude string")
    got = observations.normalised(df).collect()
    assert len(got) == 1 and got[0]["ws_observed"] is None and got[0]["name"] == "a_10.0"


def sites(spark, n=300, seed=1):
    r = random.Random(seed)
    rows = [(f"s{i}", r.uniform(24, 50), r.uniform(-125, -66), r.choice(["GS", "asos"])) for i in range(n)]
    rows += [("e1", 10.0, 179.99, "GS"), ("e2", 10.0, -179.99, "GS"), ("p1", 89.9, 0.0, "GS"), ("p2", 89.9, 170.0, "GS"), ("n", None, 1.0, "GS")]
    return spark.createDataFrame(rows, "station_id string, lat double, lon double, observation_type string"), rows


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("radius", [10.0, 150.0, 900.0])
def test_radius_pairs_are_all_pairs(spark, radius):
    df, rows = sites(spark)
    rows = [r for r in rows if r[1] is not None]
    got = {tuple(r) for r in spatial.radius_pairs(df.withColumnRenamed("station_id", "a"), df, radius, "a", "station_id").select("a", "station_id").collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if km(a, b) <= radius}


def test_neighbour_lists_leave_out_the_site_itself(spark):
    df = spark.createDataFrame([("b", 40.0, -100.0, "gs"), ("a", 40.01, -100.0, "ASOS"), ("c", 45.0, -100.0, "GS")], "station_id string, lat double, lon double, observation_type string")
    assert {r[0]: (r[1], r[2]) for r in spatial.neighbour_lists(df).collect()} == {"b": ("a", 1), "c": ("", 0)}


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_is_brute_force(spark, k):
    rng = np.random.default_rng(3)
    g = [(int(i), float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 10, (200, 2)))]
    p = [(int(i), float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-5, 15, (60, 2)))]
    got = spatial.nearest(spark.createDataFrame(p, "pid long, x double, y double"), spark.createDataFrame(g, "gid long, x double, y double"), k, "pid", "gid")
    have = {(r["pid"], r["rank"]): r["gid"] for r in got.collect()}
    for i, x, y in p:
        want = sorted(g, key=lambda q: (math.hypot(q[1] - x, q[2] - y), q[0]))[:k]
        assert [have[i, j + 1] for j in range(k)] == [w[0] for w in want]


def test_idw_weights(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 1), ("a", 2, 5.0, 2), ("b", 1, 2.0, 1), ("b", 2, 2.0, 2)], "p string, g int, distance double, rank int")
    assert {(r["p"], r["g"]): r["weight"] for r in spatial.idw_weights(df, "p").collect()} == pytest.approx({("a", 1): 1, ("a", 2): 0, ("b", 1): 0.5, ("b", 2): 0.5})


def test_bilinear(spark):
    g = spark.createDataFrame([(float(a), float(b), a + 10.0 * b) for a in range(3) for b in range(3)], "lat double, lon double, u double")
    p = spark.createDataFrame([(1, 0.5, 0.25), (2, 2.0, 2.0), (3, 2.5, 1.0)], "id int, lat double, lon double")
    assert {r[0]: r[1] for r in spatial.bilinear(p, g, 1.0, ["u"]).collect()} == {1: pytest.approx(3.0), 2: 22.0, 3: None}
    assert {r[0]: r[1] for r in spatial.bilinear(p, g, 1.0, ["u"], how="nearest").collect()}[1] == 0.0


def test_nearest_height_takes_the_lower_of_two(spark):
    assert spark.range(1).select(spatial.nearest_height(F.lit(50.0), [40, 60])).first()[0] == 40


def test_ranks_over_ranges_are_the_global_ranks(spark):
    r = random.Random(5)
    xs = [(i, r.choice([None, *map(float, range(50))])) for i in range(500)]
    df = spark.createDataFrame(xs, "i long, x double")
    got = {row["i"]: row["rank"] for row in ordered.ranked(df, "x", "i", range_rows=8).collect()}
    want = sorted(xs, key=lambda t: (t[1] is None, t[1] or 0, t[0]))
    assert [got[i] for i, _ in want] == list(range(1, 501))


def test_a_value_in_half_the_table_is_many_ranges(spark):
    laid = []

    def write(df):
        laid.append(ordered.cut(df))
        return laid[-1]

    df = spark.range(0, 20000, 1, 8).select("id", F.when(F.col("id") % 2 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("x"), F.when(F.col("id") % 3 > 0, "a").alias("g"))
    got = ordered.positions(df, [F.col("x").asc()], ["g"], range_rows=1000, write=write).collect()
    assert max(r["count"] for r in laid[0].groupBy(F.shiftright("_at", 33)).count().collect()) <= 3000
    for g in ("a", None):
        rows = sorted((r["position"], r["x"]) for r in got if r["g"] == g)
        assert [p for p, _ in rows] == list(range(len(rows)))
        assert [x for _, x in rows] == sorted(x for _, x in rows)
    assert ordered.positions(df.where("false"), [F.col("x").asc()], ["g"]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 100, 257])
def test_ranked_quantiles_are_numpy_percentiles(spark, n):
    rng = np.random.default_rng(n)
    xs = {"a": rng.integers(0, 20, n).astype(float), "b": rng.normal(size=2 * n), None: np.full(3, 2.0)}
    rows = [(k, float(x)) for k, v in xs.items() for x in v] + [("a", NAN), ("c", None)]
    got = quantiles.ranked_quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", range_rows=8).collect()
    assert len(got) == 303
    for k, v in xs.items():
        assert [r["value"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["qnum"])] == pytest.approx(list(np.percentile(v, np.arange(101))), abs=1e-9)


def test_runs_over_span_borders(spark):
    xs = [1, 2, 3, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 20, 31, 32]
    got = sorted(tuple(r) for r in ordered.runs(spark.createDataFrame([(x,) for x in xs], "x long"), "x", span=4).collect())
    assert got == [(1, 4), (7, 18), (20, 21), (31, 33)]


def test_balanced(spark):
    df = spark.createDataFrame([(i, "a" if i < 30 else "b") for i in range(40)], "i long, c string")
    count = lambda s: {r[0]: r[1] for r in ordered.balanced(df, "c", "i", strategy=s).groupBy("c").count().collect()}
    assert count("downsample") == {"a": 10, "b": 10} and count("upsample") == {"a": 30, "b": 30}
    with pytest.raises(ValueError, match="strategy"):
        ordered.balanced(df, "c", "i", strategy="x")


def test_dense_axes_keep_rows(spark):
    df = spark.createDataFrame([(40.0000001, -100.0), (40.0000002, -100.0), (41.0, -99.0)], "lat double, lon double")
    assert sorted(r["grid_id"] for r in ordered.dense_axes(df).collect()) == ["000001", "001000", "001000"]


def wide(spark, rows):
    return spark.createDataFrame([(s, h, 40.0, -100.0, *[k / 10 * f for k in range(101)]) for s, h, f in rows], "station_id string, height_m double, lat double, lon double, " + ", ".join(f"{q} double" for q in QCOLS))


def test_pivot_undoes_unpivot(spark):
    w = wide(spark, [("a", 10.0, 1.0), ("b", 50.0, 2.0)])
    back = reshape.to_wide(reshape.to_long(w)[0], ["station_id", "height_m"], "value")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, w.drop("lat", "lon").collect()))


def test_cohort_keeps_the_keys_of_era5(spark):
    c = assemble.cohort("GS", wide(spark, [("a", 10.0, 1.0)]), wide(spark, [("a", 10.0, 2.0), ("z", 10.0, 3.0)]), {"wtk": wide(spark, [("b", 10.0, 1.0)])})
    assert c.count() == 101 and c.where("station_id <> 'a' or wtk is not null or hrrr is not null").isEmpty()
    assert c.agg(F.max("observation")).first()[0] == 20.0


def test_unique_keys_are_enforced(spark):
    with pytest.raises(Exception, match="unique"):
        reshape.unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"]).collect()


def test_union_of_different_columns(spark):
    u = reshape.union_all([spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3, 4)], "a int, c int")])
    assert sorted(map(str, map(tuple, u.collect()))) == ["(1, 2, None)", "(3, None, 4)"]


def test_only_complete_profiles_become_arrays(spark):
    long = spark.range(101).select(F.lit("a").alias("s"), F.col("id").cast("int").alias("qnum"), F.col("id").cast("double").alias("v")).unionByName(spark.range(5).select(F.lit("b").alias("s"), F.col("id").cast("int").alias("qnum"), F.col("id").cast("double").alias("v")))
    got = reshape.to_arrays(long, ["s"], ["v"]).collect()
    assert [r["s"] for r in got] == ["a"] and got[0]["v"][50] == 50


def test_group_difference(spark):
    df = spark.createDataFrame([("s", 10, 5.0, 5.1, 7.0), ("t", 10, NAN, 1.0, 1.0)], "station_id string, height_m int, observation double, pred_observation double, era5 double")
    got = metrics.group_differences(df, "era5").collect()
    assert len(got) == 1 and got[0]["diff"] == pytest.approx(-1.9)


def test_summary_needs_a_positive_observed_mean(spark):
    site = spark.createDataFrame([("GS", 0.0, 1.0), ("GS", 4.0, -1.0), ("GS", 5.0, NAN)], "observation_type string, mean_observation double, bias_x double")
    r = metrics.summary(site, ["x"]).first()
    assert (r["n_sites"], r["median_bias"], r["mean_abs_pct_bias"]) == (1, -1.0, 25.0)


def test_interval_of_one_value(spark):
    r = metrics.interval(spark.createDataFrame([("a", 1.0)], "k string, v double"), ["k"], "v").first()
    assert (r["mean"], r["low"], r["high"], r["n"]) == (1.0, None, None, 1)


def test_robust_z(spark):
    z = lambda xs: [r[1] for r in qc.robust_z(spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double"), "x").select("i", "zscore").orderBy("i").collect()]
    assert z([1.0, 1.0, 1.0]) == [None] * 3
    assert z([1.0, 2.0, 3.0])[2] == pytest.approx(1 / 1.4826)
    assert z([1.0, 1.0, 1.0, 5.0])[3] == pytest.approx(4 / np.std([1, 1, 1, 5]))


def test_only_asos_outliers_go(spark):
    df = spark.createDataFrame([("a", "ASOS"), ("a", "GS"), ("b", "asos")], "station_id string, observation_type string")
    st = spark.createDataFrame([("a", True), ("b", False)], "station_id string, is_outlier boolean")
    assert sorted(map(tuple, qc.without_outliers(df, st).collect())) == [("a", "GS"), ("b", "asos")]


def test_levels_needed():
    assert grid.needed_levels([50, 60], [10, 40, 60, 80]) == [40, 60]
    assert grid.needed_levels([5, 100], [10, 40, 60, 80]) == [10, 40, 60, 80]


def test_profiles_have_all_target_heights(spark):
    w = wide(spark, [("7", 50.0, 1.0)]).withColumnRenamed("station_id", "index")
    p = publish.profiles(w, 33)
    last = p.where("probability = 1").first()
    assert p.count() == 33 and last["index"] == "000007" and last["windspeed_50m"] == 10.0
    assert last["windspeed_100m"] == pytest.approx(10 * 2 ** (1 / 7))
    assert publish.equal_neighbours(p, ["windspeed_50m"]).first()["windspeed_50m"] == 0


def test_boosting_learns_and_stays_monotone():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 10, (800, 2))
    y = 2 * x[:, 0] + np.sin(x[:, 1]) + rng.normal(0, 0.5, 800)
    m = boosting.fit(x, y, [1, 0], trees=60)
    assert np.sqrt(np.mean((m.predict(x) - y) ** 2)) < 1.0
    line = np.stack([np.linspace(0, 10, 200), np.full(200, 3.0)], axis=1)
    assert (np.diff(m.predict(line)) >= -1e-12).all()
    falling = boosting.fit(x, y, [-1, 0], trees=10)
    assert (np.diff(falling.predict(line)) <= 1e-12).all()
    gaps = np.where(rng.random(x.shape) < 0.2, NAN, x)
    assert np.isfinite(boosting.fit(gaps, y, trees=5, loss="absolute").predict(gaps)).all()


def long_rows(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s in range(6):
        shift = rng.normal()
        for q in range(0, 101, 5):
            v = q / 8 + shift
            rows.append((f"S{s}", 50.0, q, v, v + 1.0 + rng.normal(0, 0.1), "GS" if s < 3 else "ASOS", "S1" if s == 0 else ""))
    return spark.createDataFrame(rows, "station_id string, height_m double, qnum int, observation double, era5 double, observation_type string, neighbors_km_site_ids string")


def test_leave_one_out_folds(spark):
    t = long_rows(spark)
    ex = ml.neighbour_map(t)
    assert sorted(map(tuple, ex.collect())) == [("S0", "S0"), ("S0", "S1"), ("S1", "S1"), ("S2", "S2")]
    table, names, signs = ml.features(t, ["era5"])
    got = ml.leave_one_out(table, names, signs, ex, parameters={"trees": 14, "depth": 3, "rate": 0.3}).collect()
    assert len(got) == 63 and math.sqrt(np.mean([(r["predicted"] - r["observed"]) ** 2 for r in got])) < 1.5
    same = [sorted(map(tuple, ml.leave_one_out(t, names, signs, ex, parameters={"trees": 3, "depth": 3, "rows": 0.7, "columns": 0.7}).collect())) for t in (table, table.repartition(1))]
    assert same[0] == same[1]
    few = ml.leave_one_out(table, names, signs, ex, least_rows=10_000).collect()
    assert all(r["predicted"] is None for r in few)


def test_model_and_network_score(spark):
    table, names, signs = ml.features(long_rows(spark), ["era5"])
    model = ml.train(table, names, signs, parameters={"trees": 16, "rate": 0.4})
    scored = ml.monotone_predictions(ml.predict(table, model, names), ["station_id", "height_m"])
    assert scored.agg(F.sqrt(F.avg(F.pow(F.col("pred_observation") - F.col("observation"), F.lit(2))))).first()[0] < 1.0
    assert ml.importance(spark, model, names).where("rank_gain = 1").count() == 1
    net = ml.network_predictions(table, ml.network(table, names, hidden=(8,), epochs=80, rate=0.05, dropout=0.0, validation=0.0), names)
    assert net.agg(F.sqrt(F.avg(F.pow(F.col("pred_observation") - F.col("observation"), F.lit(2))))).first()[0] < 1.5
    assert ml.predict(table.drop("era5"), model, names).where("pred_observation is null").isEmpty()


def test_models_on_a_table_are_those_on_arrays(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.uniform(0, 10, (300, 3)), 1)
    x[rng.random(x.shape) < 0.1] = NAN
    y = np.nan_to_num(x[:, 0]) + np.sin(np.nan_to_num(x[:, 1])) + np.where(np.isnan(x[:, 2]), 3.0, 0.0)
    values = [[float(v) if np.isfinite(v) else None for v in r] for r in x]
    rows = [(*v, float(t), [0, 1, 2] if k % 3 else [0, 1, 1]) for k, (v, t) in enumerate(zip(values, y, strict=True))] + [(1.0, 1.0, 1.0, None, [0]), (1.0, 1.0, 1.0, 99.0, [])]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, models array<int>").repartition(3)
    settings = [{"trees": 12, "depth": 3, "rate": 0.3}, {"trees": 2, "depth": 1, "rate": 1.0}, {"trees": 4, "depth": 2, "least": 40}, {"trees": 3}]
    for loss in ("absolute", "squared"):
        got = boosting.fit_many(df, ["a", "b", "c"], [1, 0, 0], settings, [[0, 1, 2], [0, 1, 2], [1, 2], [0]], loss=loss)
        twice, some = np.concatenate([np.arange(300), np.arange(0, 300, 3)]), np.flatnonzero(np.arange(300) % 3)
        of = {0: np.arange(300), 1: twice, 2: some}
        for m, at in of.items():
            own = x[at] if m < 2 else np.where(np.arange(3) == 0, NAN, x[at])
            want = boosting.fit(own, y[at], [1, 0, 0], loss=loss, **settings[m])
            if m == 0:
                assert np.allclose(got[m].predict(x), want.predict(x))
            assert abs(np.abs(got[m].predict(own) - y[at]).mean() - np.abs(want.predict(own) - y[at]).mean()) < 0.15
        line = np.stack([np.linspace(0, 10, 50), np.full(50, 3.0), np.full(50, 3.0)], axis=1)
        assert (np.diff(got[0].predict(line)) >= -1e-12).all() and got[3] is None
        assert got[1].depth == 1 or len(got[1].roots) == 2


def test_sweep_and_subsets(spark):
    assert ml.feature_subsets(["a", "b", "c"]) == [["a"], ["b"], ["c"], ["a", "b"], ["a", "c"], ["b", "c"], ["a", "b", "c"]]
    t = long_rows(spark)
    t = t.withColumn("wtk", F.when(F.col("qnum") != 50, F.col("era5") + 1))
    runs = ml.sweep(t, [["era5"]], [], ml.neighbour_map(t), parameters={"trees": 5})
    assert [(r["label"], r["n"]) for r in runs.collect()] == [("era5", 63)]
    more = ml.sweep(t, ml.feature_subsets(["era5", "wtk"]), [], ml.neighbour_map(t), done=runs, parameters={"trees": 1, "depth": 2})
    assert {r["label"]: r["n"] for r in more.collect()} == {"era5": 63, "wtk": 60, "era5+wtk": 60}
    assert more.where("label = 'era5'").first() == runs.first()


@pytest.mark.parametrize("name", ["baseline", "enriched", "cdf_context", "wide", "hybrid", "network", "convolution"])
def test_experiments_beat_no_correction(spark, name):
    t = long_rows(spark)
    small = {"network": {"epochs": 300, "dropout": 0.0}, "convolution": {"epochs": 300, "dropout": 0.0}}.get(name, {"trees": 14, "depth": 3, "rate": 0.3})
    if name in ("wide",):
        small = {"trees": 10, "depth": 1, "least": 1}
    got = experiments.run(name, t, ["era5"], ml.neighbour_map(t), small, balance=None).collect()
    assert len(got) == 63 and all(r["predicted"] is not None for r in got)
    assert math.sqrt(np.mean([(r["predicted"] - r["observed"]) ** 2 for r in got])) < 2.0
    if name == "convolution":
        by = sorted((r["station_id"], r["qnum"], r["predicted"]) for r in got)
        assert all(a[2] <= b[2] + 1e-9 for a, b in zip(by, by[1:], strict=False) if a[0] == b[0])


def test_experiment_names_and_reports(spark):
    with pytest.raises(ValueError, match="experiment"):
        experiments.prepared("x", long_rows(spark), ["era5"])
    rows = [("s", 1.0, q, 1.0, 1.0 + e) for q, e in ((0, 0.5), (1, -0.5))]
    df = lambda f: spark.createDataFrame([(s, h, q, o, o + (p - o) * f) for s, h, q, o, p in rows], "station_id string, height_m double, qnum int, observed double, predicted double")
    got = {r["dataset"]: r["change_pct"] for r in experiments.report({"a": df(1.0), "b": df(2.0)}, "a").collect()}
    assert got == {"pred_base": 0, "pred_b": pytest.approx(100)}


def test_means_of_wide_tables(spark):
    m = assemble.wide_means(wide(spark, [("a", 10.0, 1.0)]).withColumn("q050", F.lit(None).cast("double"))).first()
    assert m["mean_ws"] == pytest.approx(4.9)


def test_points_of_one_file_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "TASK_POINTS", 10)
    p = spark.range(200).select(F.col("id"), (F.col("id") % 20).cast("double").alias("x"), (F.col("id") / 20).alias("y")).coalesce(1)
    got = spatial.nearest(p, p.withColumnRenamed("id", "g"), 2, "id", "g")
    assert "Repartition 20, true" in got._jdf.queryExecution().analyzed().toString()
    assert got.where("rank = 1 and id = g").count() == 200


def test_blocks_of_groups_are_exact(spark):
    rows = [("a", float(v)) for v in range(7)] * 3 + [("b", 2.0), ("b", 2.0), (None, 1.0), (None, 4.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {r["k"]: r["q"] for r in df.groupBy("k").agg(cdf.quantile_block(F.col("v")).alias("q")).collect()}
    got = {r["k"]: r["q"] for r in quantiles.blocks(df, ["k"], "v", "q").collect()}
    assert got.keys() == want.keys() and got["c"] is None and want["c"] is None
    assert all(got[k] == pytest.approx(want[k]) for k in ("a", "b", None))


def test_the_cohort_reads_its_samples_once(spark):
    from galeframe.plans.base import long_table

    plan = long_table(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_extendedprice" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("rounds, copies", [(4, 1), (1, 1), (4, 5)])
def test_quantiles_of_uneven_groups_of_any_size(spark, monkeypatch, rounds, copies):
    """Outliers, values far apart, both zeros, one value repeated, missing values and a NULL key: by bins, by bins cut again, by ranges, and counted first."""
    rng = np.random.default_rng(3)
    xs = {"even": rng.random(300), "far": 10.0 ** np.arange(-150, 150), "huge": np.array([-1.7e308, 1.7e308, *rng.random(200)]), "same": np.full(250, 7.25), "mostly": np.array([1.0] * 200 + [2.0, 1e9]), None: np.array([-0.0, 0.0, 5e-324, 1e-323] * 20), "one": np.array([3.0])}
    xs = {k: np.repeat(v, copies) for k, v in xs.items()}
    rows = [(k, float(x)) for k, v in xs.items() for x in rng.permutation(v)] + [("even", None), ("even", NAN), ("none", float("inf"))]
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    monkeypatch.setattr(quantiles, "MOST_ROUNDS", rounds)
    monkeypatch.setattr(quantiles, "MOST_BINS", 64)
    monkeypatch.setattr(quantiles, "PART", 1)
    got = quantiles.ranked_quantiles(df, ["k"], "x", 11, range_rows=20).collect()
    assert len(got) == 11 * len(xs)
    for k, v in xs.items():
        v, at = np.sort(v), np.arange(11) / 10 * (len(v) - 1)
        low, high = v[np.floor(at).astype(int)], v[np.ceil(at).astype(int)]
        with np.errstate(over="ignore"):
            want = low + (high - low) * (at - np.floor(at))
        assert [r["value"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["qnum"])] == pytest.approx(list(want), rel=1e-12)


def test_large_groups_are_not_sorted_whole(spark, monkeypatch):
    """Of a large group of distinct values, only the bins that hold an asked place are read on."""
    left = []
    picked = quantiles._picked
    monkeypatch.setattr(quantiles, "_picked", lambda x, keys, *more: left.append(x.count()) or picked(x, keys, *more))
    df = spark.range(200_000).select((F.col("id") % 2).alias("k"), (F.col("id") * 0.37).alias("x"))
    got = quantiles.ranked_quantiles(df, ["k"], "x", 5, range_rows=50_000).groupBy("k").agg(F.max("value").alias("v")).collect()
    assert {r["k"]: r["v"] for r in got} == {0: pytest.approx(199_998 * 0.37), 1: pytest.approx(199_999 * 0.37)}
    assert left[0] == 200_000 and len(left) == 2 and left[1] < 1000


def test_experiments_of_the_query_run_in_full(spark, monkeypatch):
    """q90_experiments hands each method its full settings, whole epochs and all trees, and nothing over them."""
    from galeframe.plans import learning

    asked = {}
    monkeypatch.setattr(ml, "leave_one_out", lambda table, *_, method, parameters, **more: asked.update({method: parameters | more}) or table)
    monkeypatch.setattr(experiments, "report", lambda runs, base: runs)
    assert list(learning.q90_experiments(spark, "/root/testdata/sf0.001")) == ["baseline", "hybrid", "wide", "network", "convolution"]
    assert all((asked[m]["trees"], asked[m]["depth"]) == (500, 20) for m in ("boosting", "hybrid", "wide"))
    assert (asked["network"]["epochs"], asked["network"]["hidden"], asked["network"]["batch"]) == (100, (128, 64), 512)
    assert (asked["convolution"]["epochs"], asked["convolution"]["filters"], asked["convolution"]["batch"]) == (300, (32, 64, 128), 32)


@pytest.mark.parametrize("loss", ["absolute", "squared"])
def test_deep_trees_are_the_same_by_jobs_and_in_tasks(spark, monkeypatch, loss):
    """Trees of depth 20 that see parts of rows and features: in tasks, by jobs, and by jobs that sum some nodes at a time."""
    rng = np.random.default_rng(5)
    x = np.round(rng.uniform(0, 10, (160, 3)), 2)
    x[rng.random(x.shape) < 0.1] = NAN
    y = np.nan_to_num(x[:, 0]) + 3 * np.sin(np.nan_to_num(x[:, 1])) + rng.normal(0, 0.1, 160)
    rows = [(*[float(v) if np.isfinite(v) else None for v in r], float(t), [0, 2] if k % 2 else [0, 1, 1, 2]) for k, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, models array<int>").repartition(3)
    settings = [{"trees": 2, "depth": 20, "least": 1.5, "rows": 0.8}, {"trees": 1, "depth": 20, "columns": 0.6, "rate": 0.5}, {"trees": 0}]
    got = []
    for most, cells in ((boosting.TASK_ROWS, boosting.MOST_CELLS), (1, boosting.MOST_CELLS), (100, 3 * 65 * 4)):
        monkeypatch.setattr(boosting, "TASK_ROWS", most)
        monkeypatch.setattr(boosting, "MOST_CELLS", cells)
        got.append(boosting.fit_many(df, ["a", "b", "c"], [1, 0, 0], settings, loss=loss))
    assert got[0][0].depth > 4 and got[0][0].feature.size > 30 and got[0][2].predict(x[:2]).tolist() == [got[0][2].base] * 2
    for other in got[1:]:
        for a, b in zip(got[0], other, strict=True):
            assert np.allclose(a.predict(x), b.predict(x)) and np.allclose(a.gain, b.gain) and (a.weight == b.weight).all()


def test_nets_take_steps_of_a_number_of_rows(spark, monkeypatch):
    steps = []
    descend = networks.descend
    monkeypatch.setattr(networks, "descend", lambda w, s, sums: steps.append(s.batches) or descend(w, s, sums))
    n = np.arange(100)
    rows = networks.Rows(n[:, None] / 10.0, np.zeros((100, 0)), n[:, None] / 5.0, n, n)
    networks.fit_arrays(networks.Perceptron(1, (4,)), rows, networks.Settings(epochs=2, validation=0.0), 32)
    networks.fit_arrays(networks.Perceptron(1, (4,)), rows, networks.Settings(epochs=2, validation=0.0, batches=2))
    assert steps == [4, 2]


def test_each_fold_of_a_net_is_a_task(spark):
    t = long_rows(spark)
    table, names, signs = ml.features(t, ["era5"])
    got = ml.leave_one_out(table, names, signs, ml.neighbour_map(t), method="network", parameters={"epochs": 1})
    assert {r[0] for r in got.select(F.spark_partition_id()).distinct().collect()} == {0, 1, 2}
