"""Nets: gradients against differences, the same weights however rows are dealt, and the search of parameters."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from galeframe.operators import ml, networks


def rows(n=12, channels=2, points=9, aux=3, seed=0):
    rng = np.random.default_rng(seed)
    y = np.cumsum(rng.uniform(0, 1, (n, points)), axis=1)
    return networks.Rows(y[:, None] * rng.uniform(0.8, 1.2, (n, channels, 1)) + 1, rng.normal(size=(n, aux)), y, np.arange(n), np.arange(n) // 2)


@pytest.mark.parametrize("aux", [0, 3])
@pytest.mark.parametrize("filters", [(4,), (3, 4), (3, 4, 5)])
def test_convolution_gradients(aux, filters):
    r = rows(aux=aux)
    net = networks.Convolution(2, 9, aux, filters, 4, (6, 5))
    w = net.start(np.random.default_rng(1), r.y.mean(axis=0))
    check(net, w, r)


def test_perceptron_gradients():
    r = rows()
    r = networks.Rows(r.x[:, 0], r.aux, r.y[:, :1], r.row_id, r.station)
    net = networks.Perceptron(9, (7, 5))
    check(net, net.start(np.random.default_rng(1), np.array([2.0])), r)


def check(net, w, r):
    w = {k: v + np.random.default_rng(3).normal(0, 0.05, v.shape) for k, v in w.items()}
    weight = np.random.default_rng(2).normal(size=r.y.shape)
    loss = lambda w: float((net.forward(w, r)[0] * weight).sum())
    _, cache = net.forward(w, r)
    g = net.backward(w, cache, weight)
    assert g.keys() == w.keys()
    rng = np.random.default_rng(4)
    for k, v in w.items():
        for _ in range(4):
            at, e = tuple(rng.integers(0, s) for s in v.shape), 1e-6
            up, down = ({**w, k: v + e * s * (np.indices(v.shape) == np.array(at).reshape(-1, *[1] * v.ndim)).all(axis=0)} for s in (1, -1))
            assert g[k][at] == pytest.approx((loss(up) - loss(down)) / 2 / e, rel=1e-3, abs=1e-5), k


def test_profiles_rise_and_are_not_negative():
    net = networks.Convolution(3, 101, 4)
    w = net.start(np.random.default_rng(0), np.linspace(-3, 5, 101))
    rng = np.random.default_rng(1)
    w = {k: v + rng.normal(0, 1, v.shape) for k, v in w.items()}
    out, _ = net.forward(w, networks.Rows(rng.normal(0, 9, (16, 3, 101)), rng.normal(0, 9, (16, 4)), np.zeros((16, 101)), np.arange(16), np.arange(16)))
    assert out.shape == (16, 101) and (np.diff(out, axis=1) >= 0).all() and (out >= 0).all()


def test_convolution_learns_in_batches_and_stops_early():
    r = rows(80)
    fitted = networks.fit_arrays(networks.Convolution(2, 9, 3, (6,), 4, (12,)), r, networks.Settings(epochs=400, batches=3, dropout=0.05, patience=30, validation=0.25))
    kept = networks.uniform(r.station, 0, 1) < 0.25
    assert kept.any() and len(set(r.station[kept]) & set(r.station[~kept])) == 0
    got = fitted.predict(r.x, r.aux)
    mean = np.abs(r.y[~kept].mean(axis=0) - r.y[kept]).mean()
    assert np.abs(got[kept] - r.y[kept]).mean() == pytest.approx(min(fitted.history)) and min(fitted.history) < mean
    assert len(fitted.history) < 400 and fitted.history.index(min(fitted.history)) == len(fitted.history) - 1 - 30


def test_weights_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = np.abs(x[:, 0]) + x[:, 1]
    data = [(f"S{k // 20}", float(k), *(None if c == 2 and k % 9 == 0 else float(v) for c, v in enumerate(r)), float(t)) for k, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*data, ("S0", -1.0, 1.0, 1.0, 1.0, None)], "station_id string, k double, a double, b double, c double, y double")
    s = networks.Settings(epochs=12, batches=2, dropout=0.2)
    one, four = (networks.fit_table(networks.Perceptron(3, (8, 4)), df.repartition(n), ["a", "b", "c"], "y", s, key=["k"]) for n in (1, 4))
    for k, v in one.weights.items():
        assert np.allclose(v, four.weights[k], atol=1e-6)
    assert one.history == pytest.approx(four.history)
    scored = networks.predictions(df, four, ["a", "b", "c"], "p")
    start = scored.agg(F.avg(F.abs(F.col("y") - F.col("p")))).first()[0]
    assert start < np.abs(y - np.median(y)).mean()


def test_parzen_is_its_sql():
    points, at = np.array([0.1, 0.15, 0.7]), np.linspace(0, 1, 11)
    con = duckdb.connect()
    sql = f"""with c as (select unnest({points.tolist()}) m, {1 / 4} s union all select 0.5, 1.0), a as (select unnest({at.tolist()}) x)
    select avg(exp(-pow((x - m) / s, 2) / 2) / (s * sqrt(2 * pi()))) from a, c group by x order by x"""
    assert np.allclose([r[0] for r in con.execute(sql).fetchall()], ml.parzen(points, at))


def test_search_beats_chance():
    space = {"a": (0.01, 100.0), "b": (1, 1000), "c": (0.1, 10.0)}
    loss = lambda p: math.log(p["a"] / 3) ** 2 + math.log(p["b"] / 50) ** 2 + math.log(p["c"]) ** 2
    better = 0
    for seed in range(10):
        found = ml.tpe(lambda asked: [loss(p) for p in asked], space, 48, 4, seed)
        assert len(found) == 48 and found == sorted(found, key=lambda r: r["loss"]) and isinstance(found[0]["b"], int)
        rng = np.random.default_rng(1000 + seed)
        chance = min(loss({k: math.exp(rng.uniform(math.log(a), math.log(b))) for k, (a, b) in space.items()}) for _ in range(48))
        better += found[0]["loss"] < chance
    assert better >= 9


def test_search_and_sweep_of_parameters(spark):
    from tests.test_operators import long_rows

    t = long_rows(spark)
    table, names, signs = ml.features(t, ["era5"])
    ex = ml.neighbour_map(t)
    got = ml.parameter_sweep(table, names, signs, ex, {"trees": [1, 4], "depth": [1]}, {"trees": 2, "rate": 0.5}).collect()
    assert {(r["parameter"], r["value"]): r["n"] for r in got} == {("trees", 1.0): 63, ("trees", 4.0): 63, ("depth", 1.0): 63}
    runs = ml.search(table, names, signs, ex, trials=3, side_by_side=2, space={"trees": (1, 3), "rate": (0.3, 0.9)})
    assert len(runs) == 3 and runs[0]["rmse"] <= runs[-1]["rmse"] and all(1 <= r["trees"] <= 3 for r in runs)
