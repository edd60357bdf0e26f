"""Worked values of the column functions."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galeframe.functions import cdf, geo, labels, wind


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def array(*xs):
    return F.array(*[F.lit(x).cast("double") for x in xs])


def ramp():
    return F.transform(F.sequence(F.lit(0), F.lit(100)), lambda i: i / 10.0)


def without(k):
    return F.transform(ramp(), lambda x, i: F.when(i != k, x))


def points(a):
    return F.transform(a, lambda x, i: F.struct(i.cast("double").alias("q"), x.alias("v")))


@pytest.mark.parametrize(("gap", "want"), [(999, (5.0, 5.0, 5.0, 5.0)), (50, (None, 4.9, 4.95, 5.0)), (100, (None, 4.9005, 4.9005, 4.95))])
def test_four_means(spark, gap, want):
    a = without(gap)
    got = one(spark, cdf.mean_complete(a), cdf.mean_adjacent(a), cdf.mean_dense(points(a)), cdf.mean_normalised(points(a)))
    assert got == pytest.approx(want)


def test_means_of_too_few_points(spark):
    a = array(None, 3.0, None)
    assert one(spark, cdf.mean_complete(a), cdf.mean_adjacent(a), cdf.mean_dense(points(a)), cdf.mean_normalised(points(a))) == (None,) * 4


def test_finite_and_number(spark):
    assert one(spark, cdf.finite(F.lit(float("nan"))), cdf.finite(F.lit(float("inf"))), cdf.number(F.lit("x")), cdf.number(F.lit(" 2.5"))) == (None, None, None, 2.5)


def test_interpolation_and_running_maximum(spark):
    assert one(spark, cdf.interpolated(array(None, 1, None, 3, None))) == [1, 1, 2, 3, 3]
    assert one(spark, cdf.interpolated(array(None, None))) == [None, None]
    assert one(spark, cdf.cumulative_max(array(0, 2, 1, 3))) == [0, 2, 2, 3]
    assert one(spark, cdf.monotone(array(None, None))) == [0, 0]
    assert one(spark, cdf.cumulative_sum(array(1, 2, 3))) == [1, 3, 6]


def test_counts_of_neighbours(spark):
    assert one(spark, cdf.count_equal(array(1, 1, 2, 2, 3))) == 2
    assert one(spark, cdf.count_drops(array(1, None, 0, 2, 2, 1.5))) == 2
    assert one(spark, cdf.count_drops(array(1, None, 0, 2, 2, 1.5), 0.5)) == 1
    assert one(spark, cdf.count_equal(array()), cdf.count_drops(array(1.0))) == (0, 0)


def test_resampling(spark):
    got = one(spark, cdf.resampled(ramp(), 33))
    assert got == pytest.approx(list(np.interp(np.linspace(0, 1, 33), np.linspace(0, 1, 101), np.arange(101) / 10)))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(0, 50, allow_subnormal=False), min_size=2, max_size=30))
def test_quantile_block_is_numpy_percentile(spark, xs):
    got = spark.createDataFrame([(x,) for x in xs], "x double").agg(cdf.quantile_block(F.col("x")).alias("q")).first()[0]
    assert got == pytest.approx(list(np.percentile(xs, np.arange(101))), abs=1e-9)
    assert all(a <= b + 1e-9 for a, b in zip(got, got[1:], strict=False))


def test_reports(spark):
    want = {"090,5,N,50,5": 5.0, "090,5,N,9999,5": None, "090,5": None, "garbage": None, "1,2,3,x,5": None}
    assert {k: one(spark, wind.packed_speed(F.lit(k))) for k in want} == want


@pytest.mark.parametrize(("speed", "low", "high"), [(0.0, 0.0, 1.028888), (5.14444, 4.629996, 5.14444)])
def test_dequantised_range(spark, speed, low, high):
    got = [r[0] for r in spark.range(200).select(wind.dequantized(F.lit(speed), F.col("id"))).collect()]
    assert low < min(got) and max(got) <= high + 1e-9 and len(set(got)) == 200


@pytest.mark.parametrize(("z", "want"), [(60, (True, 60, 60)), (50, (False, 40, 60)), (5, (False, 10, 40)), (150, (False, 80, 100))])
def test_brackets(spark, z, want):
    assert tuple(one(spark, wind.bracket(F.lit(float(z)), [10, 40, 60, 80, 100]))) == want


def test_power_law(spark):
    law = lambda z, *u: one(spark, wind.power_law(F.lit(float(z)), [10, 50, 100], [F.lit(x).cast("double") for x in u]))
    exact = lambda z: 4 * (z / 10) ** 0.2
    assert law(50, 3, 4, 5) == 4
    assert law(70, exact(10), exact(50), exact(100)) == pytest.approx(exact(70))
    assert law(5, exact(10), exact(50), exact(100)) == pytest.approx(exact(5))
    assert law(200, exact(10), exact(50), exact(100)) == pytest.approx(exact(200))
    assert law(50, 0, None, 5) == pytest.approx(5 * 40 / 90)
    assert law(70, None, 4, None) == 4
    assert law(70, None, None, None) is None
    assert one(spark, wind.fitted(F.lit(70.0), [F.lit(exact(h)) for h in (10, 50, 100, 150)])) == pytest.approx(exact(70))
    assert one(spark, wind.fitted(F.lit(70.0), [F.lit(None).cast("double"), F.lit(7.0), F.lit(-1.0), F.lit(0.0)])) == 7


def test_shear(spark):
    assert one(spark, wind.shear(F.lit(0.0), F.lit(5.0))) == pytest.approx(1 / 7)
    assert one(spark, wind.shear(F.lit(5.0), F.lit(5 * 10**0.2))) == pytest.approx(0.2)
    assert one(spark, wind.at_height(F.lit(5.0), F.lit(0.3), F.lit(100.0))) == 5
    assert one(spark, wind.clipped_shear(F.lit(0.0), F.lit(5.0), F.lit(10.0), F.lit(20.0))) == 2


def test_components_keep_the_magnitude(spark):
    u, v = wind.components(F.lit(7.0), F.lit(-500.0))
    assert one(spark, wind.magnitude(u, v)) == pytest.approx(7)


def test_distances_and_projections(spark):
    km = one(spark, geo.haversine_km(F.lit(40.7128), F.lit(-74.006), F.lit(34.0522), F.lit(-118.2437)))
    assert abs(km - 3944) < 50
    assert one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(math.pi * 6371.0088)
    assert one(spark, *geo.web_mercator(F.lit(0.0), F.lit(180.0))) == pytest.approx((20037508.342789244, 0), abs=1e-6)
    assert one(spark, *geo.conic(F.lit(38.47240422490422), F.lit(-96.0))) == pytest.approx((0, 0), abs=1e-6)
    assert one(spark, geo.wrap_180(F.lit(180.0)), geo.wrap_360(F.lit(-90.0))) == (-180, 270)


def test_rounding_is_half_even_and_never_negative_zero(spark):
    assert one(spark, geo.rounded(F.lit(0.125), 2), geo.rounded(F.lit(0.375), 2)) == (0.12, 0.38)
    assert math.copysign(1, one(spark, geo.rounded(F.lit(-0.001), 2))) == 1


def test_tiles(spark):
    assert one(spark, geo.tile_id(F.lit(3), F.lit(-1))) == (3 << 32) | 0xFFFFFFFF
    assert one(spark, geo.tile_of_line(F.lit("3, 4")), geo.tile_of_line(F.lit("77")), geo.tile_of_line(F.lit("x"))) == ((3 << 32) | 4, 77, None)


def test_labels(spark):
    t = lambda c, x: one(spark, c(F.lit(x).cast("string")))
    assert [t(labels.observation_type, x) for x in (" gs ", "GoldStandard", "asos", " other", None)] == ["GS", "GS", "ASOS", "other", ""]
    assert [t(labels.dataset, x) for x in ("WTK-LED Climate", "my hrrr", "WTK", "Foo ")] == ["wtk_led_conus", "hrrr", "wtk", "foo"]
    assert [t(labels.padded_index, x) for x in ("1", "123.0", "000123")] == ["000001", "000123", "000123"]
    assert t(labels.years_of, "2007, x,2009,2007") == [2007, 2009]
    assert t(labels.ids_of, "") == [] and t(labels.ids_of, "a, b,") == ["a", "b"]
    assert t(labels.features_of, "a+b") == ["a", "b"] and t(labels.features_of, "none") == []
    assert t(lambda c: labels.fold_seed(42, c), "S001") == 1180684884
    assert t(lambda c: labels.label_of_path(c, "ml_results_xgb_"), "/x/ml_results_xgb_era5+wtk.csv") == "era5+wtk"


@pytest.mark.parametrize("bad", ["1234567", "x", None])
def test_bad_index_is_an_error(spark, bad):
    with pytest.raises(Exception, match="six digits"):
        spark.createDataFrame([(bad,)], "x string").select(labels.padded_index(F.col("x"))).collect()
