"""Readers, sinks and small operators that no query covers."""

import gzip
import re

import pytest
from pyspark.sql import functions as F

from galeframe.functions import geo, labels
from galeframe.functions.constants import QCOLS
from galeframe.operators import assemble, grid, metrics, ml, observations, ordered, publish, schema, spatial
from galeframe.sources import tables
from tests.test_operators import long_rows, wide


def test_site_lists(spark, tmp_path):
    (tmp_path / "s.csv").write_text("ID,Name,LAT,LON,z\na,n2,1,2,10\na,n1,1,2,50\nb,,x,2,10\n")
    assert [tuple(r) for r in tables.read_sites(spark, str(tmp_path / "s.csv")).collect()] == [("a", 1.0, 2.0, "n1")]
    assert tables.read_sites(spark, str(tmp_path / "s.csv"), with_height=True).count() == 2


def test_grids_get_ids(spark, tmp_path):
    (tmp_path / "g.csv").write_text("latitude,longitude\n40,-100\n41,-100\n40,-101\n")
    assert {(r["lat"], r["lon"]): r["grid_id"] for r in tables.read_grid(spark, str(tmp_path / "g.csv")).collect()} == {(41.0, -100.0): "000000", (40.0, -101.0): "000001", (40.0, -100.0): "000002"}


def test_station_catalogue(spark, tmp_path):
    (tmp_path / "c.csv").write_text("USAF,WBAN,STATION NAME,CTRY,LAT,LON,ELEV(M),BEGIN,END\n123,45,A,US,1,2,3,20070101,20201231\n123,45,A,US,1,2,3,20070101,20201231\n999999,45,B,US,1,2,3,20070101,20201231\n1,2,C,CA,1,2,3,20070101,20201231\n")
    assert [tuple(r) for r in tables.station_catalogue(spark, str(tmp_path / "c.csv")).collect()] == [("00012300045", "A", 1.0, 2.0, 3.0, 2007, 2020)]


def test_reports_take_the_station_from_the_file(spark, tmp_path):
    (tmp_path / "72345.csv").write_text('DATE,WND\n2020-01-01 00:00:00,"090,5,N,50,5"\n')
    r = observations.station_reports(tables.read_reports(spark, str(tmp_path))).first()
    assert (r["station_id"], r["reported"]) == ("72345", 5.0) and 4.6 < r["speed"] <= 5.2


def test_predictions_and_features(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Latitude,Longitude,height_m,q000\n1,2,50,3\n")
    r = tables.read_predictions(spark, str(tmp_path / "p.csv")).first()
    assert (r["lat"], r["lon"], r["q000"], r["q100"]) == (1.0, 2.0, 3.0, None)
    (tmp_path / "f.csv").write_text("feature,gain,weight\nera5,2,3\n")
    assert tables.feature_table(spark, str(tmp_path / "f.csv")).first()["total_gain"] == 6.0


def test_location_files(spark, tmp_path):
    w = wide(spark, [("7", 50.0, 1.0), ("7", 100.0, 2.0)]).withColumnsRenamed({"station_id": "index", "lat": "latitude", "lon": "longitude"})
    tables.write_locations(publish.profiles(w), str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("index=000007/*.csv.gz"))
    assert len(files) == 1
    text = gzip.open(files[0], "rt").read().split()
    assert len(text) == 102 and text[0].startswith("probability,windspeed_30m") and text[-1].startswith("1.0,")
    assert [tuple(r) for r in publish.location_index(w).collect()] == [("000007", 40.0, -100.0)]


def test_latex(spark):
    df = spark.createDataFrame([("a_b", 1.23456), ("c", None)], "dataset string, x double")
    assert publish.latex_rows(df, ["c", "a_b", "z"], ["x"], 2) == [r"c & -- \\", r"a\_b & 1.23 \\"]


def test_gwa_joins_dont_multiply_rows(spark):
    long = spark.createDataFrame([("a", 10.0), ("b", 10.0)], "station_id string, height_m double")
    gwa = spark.createDataFrame([("a", 10.0, 5.0), ("a", 10.0, 4.0), (None, 10.0, 1.0)], "station_id string, height_m double, gwa_interp double")
    assert sorted(map(tuple, assemble.with_gwa(long, gwa).collect()), key=str) == [("a", 10.0, 4.0), ("b", 10.0, None)]
    assert [r["station_id"] for r in assemble.with_gwa(long, gwa, covered_only=True).collect()] == ["a"]


def test_distinct_places_are_computed_once(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 50.0), (1.0000000001, 2.0, 100.0)], "lat double, lon double, height_m double")
    places = spark.createDataFrame([(1.0, 2.0, 3.0, None, 6.0, None)], "lat double, lon double, gwa_10 double, gwa_50 double, gwa_100 double, gwa_150 double")
    got = assemble.gwa_distinct(rows, places, [f"gwa_{h}" for h in (10, 50, 100, 150)]).orderBy("height_m").collect()
    assert got[1]["gwa_fit"] == pytest.approx(6.0) and got[0]["gwa_fit"] == pytest.approx(3 * 5 ** 0.30103, rel=1e-4)
    assert spatial.once_per_key(rows, ["lon"], lambda k: k.withColumn("x", F.lit(1))).where("x = 1").count() == 2


def test_filters(spark):
    df = spark.createDataFrame([(29.6, 40.0, -100.0), (35.4, 10.0, -100.0), (35.4, None, 0.0)], "height_m double, lat double, lon double")
    assert schema.at_heights(df, [30, 40]).count() == 1
    assert schema.in_box(df, 25, 50, -125, -66).count() == 1
    assert schema.with_coordinates(df).count() == 2 and schema.finite_rows(df, ["lat", "lon"]).count() == 2
    t = spark.createDataFrame([("GoldStandard", "1"), ("asos", "1.0"), (None, "x")], "observation_type string, v string")
    assert schema.gs_rows(t, "observation_type", "gs").count() == 1 and schema.gs_rows(t, "v", "1").count() == 2
    assert schema.ordered(wide(spark, [("a", 1.0, 1.0)]), ["height_m"]).columns[:4] == ["height_m", "lat", "lon", "station_id"]


def test_unique_sites_and_neighbours(spark):
    t = spark.createDataFrame([("a", "GS", 1.0, 2.0), ("a", "GS", 3.0, 2.0), ("b", "ASOS", 1.0, 1.0)], "station_id string, observation_type string, lat double, lon double")
    assert assemble.unique_sites(t).where("station_id = 'a'").first()["lat"] == 2.0
    lists = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "station_id string, neighbors_km_site_ids string, neighbors_km_count int")
    assert {(r["station_id"], r["neighbors_km_site_ids"], r["neighbors_km_count"]) for r in assemble.with_neighbours(t, lists).collect()} == {("a", "b", 1), ("b", "", 0)}


def test_small_helpers(spark):
    assert tables.yearly_paths("/d/", "era5_{year}.grib", [2007, 2008]) == ["/d/era5_2007.grib", "/d/era5_2008.grib"]
    assert labels.dataset_spec("era5: ERA5 :#123456") == ("era5", "ERA5", "#123456")
    with pytest.raises(ValueError, match="colour"):
        labels.dataset_spec("era5")
    r = spark.range(1).select(labels.processed_at(), labels.station_code(F.lit("12"), F.lit("3")), labels.year_prefix(F.lit("20070101")), labels.display_name(F.lit("x"), {"x": "X"}), labels.display_name(F.lit("y"), {"x": "X"}), labels.header(F.lit('# {"a": 1}'), "a int")).first()
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", r[0]) and tuple(r)[1:5] == ("00001200003", 2007, "X", "y") and r[5]["a"] == 1
    assert spark.range(1).select(geo.in_polygon(F.lit(1.0), F.lit(1.0), [(0, 0), (2, 0), (2, 2), (0, 2)])).first()[0] is True


def test_histogram_and_samples(spark):
    df = spark.createDataFrame([(i, i / 10) for i in range(11)], "i int, x double")
    assert {r["bin"]: r["n"] for r in observations.range_histogram(df, "x", 0.0, 1.0, 2).collect()} == {0: 5, 1: 6}
    assert [r["i"] for r in ordered.sample_rows(df, 4, "i").collect()] == [r["i"] for r in ordered.sample_rows(df.repartition(3), 4, "i").collect()]


def test_speeds_at_height(spark):
    df = spark.createDataFrame([(3.0, 4.0, 6.0, 8.0, 100.0), (0.0, 0.0, 6.0, 8.0, 50.0)], "u10 double, v10 double, u100 double, v100 double, height_m double")
    assert [r["speed"] for r in grid.surface_speeds(df).collect()] == [10.0, pytest.approx(10 * 0.5 ** (1 / 7))]
    assert grid.projected(spark.createDataFrame([(38.47240422490422, -96.0)], "lat double, lon double")).first()["x"] == 0


def test_search_returns_the_best_first(spark):
    t = long_rows(spark)
    table, names, signs = ml.features(t, ["era5"])
    runs = ml.search(table, names, signs, ml.neighbour_map(t), trials=2, space={"trees": (2, 20), "depth": (1, 3)})
    assert len(runs) == 2 and runs[0]["rmse"] <= runs[1]["rmse"] and isinstance(runs[0]["trees"], int)


def test_tail_and_distribution_limits(spark):
    df = spark.createDataFrame([(float(i), float(-i)) for i in range(101)], "a double, b double")
    r = metrics.limits(df, ["a", "b"], 0.05).first()
    assert r["low"] == pytest.approx(-r["high"]) and r["symmetric"] == pytest.approx(r["high"])
    assert metrics.axis_limit(df.limit(0), ["a"]).first()["x_max"] == 20.0


def test_wide_columns_from_arrays(spark):
    df = spark.range(1).select(F.lit("a").alias("k"), F.transform(F.sequence(F.lit(0), F.lit(100)), lambda i: i * 1.0).alias("q"))
    r = schema.wide_from_array(df, "q", ["k"]).first()
    assert r["q050"] == 50.0 and len(r) == 1 + len(QCOLS)


def test_command_line_lists_queries(capsys):
    from galeframe.__main__ import main

    main([])
    assert "q01_quantile_block" in capsys.readouterr().out
