"""HDF5, GRIB and GeoTIFF files written byte by byte, and read."""

import json
import struct
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from galeframe.plans import encode
from galeframe.sources import connectors, grib, hdf5, ranges, tiff


def series_file(path, year=2007, hours=100, places=37, chunk=(24, 8), deflate=True, break_chunk=False):
    rng = np.random.default_rng(year)
    raw = rng.integers(0, 3000, (hours, places)).astype("<i2")
    times = np.array([(datetime(year, 1, 1) + timedelta(hours=h)).strftime("%Y-%m-%d %H:%M:%S").encode() for h in range(hours)])
    coordinates = np.stack([np.linspace(30, 40, places), np.linspace(-100, -90, places)], axis=1).astype("<f4")
    data = encode.hdf5({"windspeed_10m": raw, "time_index": times, "coordinates": coordinates}, {"windspeed_10m": {"scale_factor": 100.0, "add_offset": -1.0}}, {"windspeed_10m": chunk} if chunk else None, deflate)
    if break_chunk:
        at = data.index(b"\x78\x9c", 100)
        data = data[:at] + b"\0\0\0\0\0\0" + data[at + 6 :]
    path.write_bytes(data)
    return raw, times


@pytest.mark.parametrize(("chunk", "deflate"), [((24, 8), True), ((24, 8), False), ((7, 50), True), (None, False)])
def test_series_of_several_years(spark, tmp_path, chunk, deflate):
    raws = {y: series_file(tmp_path / f"wtk_conus_{y}.h5", y, chunk=chunk, deflate=deflate) for y in (2007, 2008)}
    files = ranges.yearly_files(str(tmp_path), [2007, 2008, 2009], ["conus-{year}.h5", "wtk_conus_{year}.h5"], missing="skip")
    assert sorted(files) == [2007, 2008]
    with pytest.raises(FileNotFoundError):
        ranges.yearly_files(str(tmp_path), [2009], ["wtk_conus_{year}.h5"])
    df = hdf5.read_series(spark, list(files.values()), "windspeed_10m", values=600)
    rows = df.collect()
    assert len(rows) == 2 * 100 * 37 and df.rdd.getNumPartitions() > 2
    for r in rows:
        raw, times = raws[int(r["file"][-7:-3])]
        h = int((datetime.fromisoformat(r["time"]) - datetime(int(r["time"][:4]), 1, 1)).total_seconds() // 3600)
        assert times[h].decode() == r["time"] and r["value"] == pytest.approx(float(raw[h, r["gid"]]) / 100 - 1)


def test_filters_reach_the_chunks(spark, tmp_path):
    raw, times = series_file(tmp_path / "a.h5", chunk=(24, 8))
    path = str(tmp_path / "a.h5")
    all_rows = hdf5.read_series(spark, [path], "windspeed_10m")
    want = lambda keep: {(g, times[h].decode()) for h in range(100) for g in range(37) if keep(g, times[h].decode())}
    cases = [
        (F.col("gid").isin(3, 17, 36, 99), lambda g, t: g in (3, 17, 36)),
        ((F.col("gid") >= 30) & (F.col("gid") < 33) & (F.col("time") >= "2007-01-02 03:00:00") & (F.col("time") < "2007-01-02 20:00:00"), lambda g, t: 30 <= g < 33 and "2007-01-02 03:00:00" <= t < "2007-01-02 20:00:00"),
        ((F.col("gid") == 5) & (F.col("gid") > 7), lambda g, t: False),
        (F.col("time") == "2007-01-01 05:00:00", lambda g, t: t == "2007-01-01 05:00:00"),
    ]
    for condition, keep in cases:
        assert {(r["gid"], r["time"]) for r in all_rows.where(condition).collect()} == want(keep)
    reader = hdf5.H5Reader({"files": json.dumps([path]), "variable": "windspeed_10m"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan

    left = list(reader.pushFilters([EqualTo(("gid",), 9), GreaterThan(("time",), "2007-01-04"), LessThan(("value",), 1.0)]))
    assert [type(f).__name__ for f in left] == ["GreaterThan", "LessThan"]
    (part,) = reader.partitions()
    assert part.value[1:] == ((72, 100), [(9, 10)])
    batches = list(reader.read(part))
    assert sum(b.num_rows for b in batches) == 28
    low = hdf5.H5Reader({"files": json.dumps([path]), "variable": "windspeed_10m"})
    assert list(low.pushFilters([GreaterThanOrEqual(("gid",), 40)])) == [] and low.partitions() == []
    stepped = hdf5.read_series(spark, [path], "windspeed_10m", step=5, gids="[1, 2]")
    assert stepped.count() == 40
    with pytest.raises(Exception, match="has no 'windspeed_80m'"):
        hdf5.read_series(spark, [path], "windspeed_80m").collect()


def test_a_broken_chunk_costs_only_its_own_values(spark, tmp_path):
    series_file(tmp_path / "a.h5", break_chunk=True)
    with pytest.raises(Exception, match="while decompressing"):
        hdf5.read_series(spark, [str(tmp_path / "a.h5")], "windspeed_10m").collect()
    got = hdf5.read_series(spark, [str(tmp_path / "a.h5")], "windspeed_10m", unreadable="null")
    assert got.count() == 3700 and got.where("value is null").count() == 24 * 8


def test_places(spark, tmp_path):
    series_file(tmp_path / "a.h5")
    got = hdf5.read_places(spark, str(tmp_path / "a.h5"), places=10).orderBy("gid").collect()
    assert len(got) == 37 and got[0]["lat"] == 30.0 and got[36]["lon"] == -90.0


def test_newer_headers_are_understood(tmp_path):
    """Superblock 2, an object header of version 2 with a continuation, links, and a contiguous dataset."""
    values = np.arange(6, dtype="<f4").reshape(2, 3)
    message = lambda kind, data: struct.pack("<BHB", kind, len(data), 0) + data
    out = bytearray(48) + values.tobytes()
    space = message(0x01, struct.pack("<BBBB2Q", 2, 2, 0, 1, 2, 3))
    kind = message(0x03, encode._hdf_type(values.dtype))
    layout = message(0x08, struct.pack("<BBQQ", 3, 1, 48, values.nbytes))
    name = b"add_offset"
    v3 = struct.pack("<BBHHHB", 3, 0, len(name) + 1, 20, 12, 0) + name + b"\0" + encode._hdf_type(np.dtype("<f8")) + struct.pack("<BBBBQ", 2, 1, 0, 1, 1) + struct.pack("<d", 4.5)
    more = b"OCHK" + layout + message(0x0C, v3) + b"\0" * 4
    more_at = len(out)
    out += more
    body = space + kind + message(0x10, struct.pack("<QQ", more_at, len(more)))
    data_at = len(out)
    out += b"OHDR" + struct.pack("<BBB", 2, 0, len(body)) + body + b"\0" * 4
    link = message(0x06, struct.pack("<BBB", 1, 0, 1) + b"x" + struct.pack("<Q", data_at))
    root = len(out)
    out += b"OHDR" + struct.pack("<BBB", 2, 0, len(link)) + link + b"\0" * 4
    out[:48] = hdf5.SIGNATURE + struct.pack("<BBBBQQQQI", 2, 8, 8, 0, 0, encode.UNDEFINED, len(out), root, 0)
    (tmp_path / "n.h5").write_bytes(bytes(out))
    with ranges.Ranges(str(tmp_path / "n.h5")) as source:
        f = hdf5.File(source)
        d = f.dataset("x")
        assert (f.whole(d) == values).all() and d.scale() == (1.0, 4.5)


def fields(shape=(5, 7), seed=0, gaps=False):
    x = np.round(np.random.default_rng(seed).uniform(-20, 20, shape), 2)
    if gaps:
        x[1, 2] = x[4, 6] = np.nan
    return x


@pytest.mark.parametrize("edition", [1, 2])
@pytest.mark.parametrize("bits", [12, 16, 24])
def test_fields_merge_by_time(spark, tmp_path, edition, bits):
    times = [datetime(1999, 12, 31, 23), datetime(2000, 1, 1, 0), datetime(2000, 1, 1, 1)]
    values = {(v, t): fields(seed=3 * k + n, gaps=k == 1) for k, t in enumerate(times) for n, v in enumerate(("u10", "v10"))}
    encoded = lambda v, t: encode.grib1(values[v, t], {"u10": 165, "v10": 166}[v], t, 50.0, -3.0, 0.25, bits) if edition == 1 else encode.grib2(values[v, t], {"u10": 2, "v10": 3}[v], 10, t, 50.0, -3.0, 0.25, bits)
    (tmp_path / "u.grib").write_bytes(b"".join(encoded("u10", t) for t in times))
    (tmp_path / "v.grib").write_bytes(b"junk" + b"".join(encoded("v10", t) for t in times[:2]))
    files = [str(tmp_path / n) for n in ("u.grib", "v.grib")]
    df = grib.read_fields(spark, files, ["u10", "v10", "u100"], messages=2)
    rows = df.collect()
    assert len(rows) == 3 * 35 and df.rdd.getNumPartitions() > 1
    for r in rows:
        t = datetime.fromisoformat(r["time"])
        i, j = round((50 - r["lat"]) / 0.25), round((r["lon"] + 3) / 0.25)
        for v in ("u10", "v10"):
            want = values[v, t][i, j] if (v, t) != ("v10", times[2]) else np.nan
            assert r[v] is None if np.isnan(want) else r[v] == pytest.approx(want, abs=1e-4)
        assert r["u100"] is None
    near = df.where("time >= '2000-01-01T00:00:00' and lat > 49.3 and lon <= -2.0").collect()
    assert {(r["time"], r["lat"], r["lon"]) for r in near} == {(r["time"], r["lat"], r["lon"]) for r in rows if r["time"] >= "2000" and r["lat"] > 49.3 and r["lon"] <= -2.0}
    with ranges.Ranges(files[1]) as source:
        assert [(m.variable, m.time) for m in grib.messages(source)] == [("v10", "1999-12-31T23:00:00"), ("v10", "2000-01-01T00:00:00")]


def test_whole_globe_and_numbers():
    assert grib.ibm_float(encode._ibm(-118.625)) == -118.625 and grib.ibm_float(b"\0\0\0\0") == 0
    assert grib.signed(b"\x80\x05") == -5
    assert grib.unpacked(np.packbits([1, 0, 1, 0, 1, 1, 0, 0]).tobytes(), 3, 2).tolist() == [5, 3]
    lat, lon = grib._grid(4, 2, 90.0, 0.0, -90.0, 270.0, 0).axes()
    assert lat.tolist() == [90, -90] and lon.tolist() == [0, 90, 180, -90]


@pytest.mark.parametrize("tile", [16, None])
@pytest.mark.parametrize(("dtype", "compression", "predictor"), [("<f4", 1, 1), ("<f4", 8, 3), ("<i2", 8, 2), ("<f8", 8, 1), ("<u1", 1, 1)])
def test_raster_samples(spark, tmp_path, tile, dtype, compression, predictor):
    rng = np.random.default_rng(1)
    cells = rng.integers(0, 100, (45, 70)).astype(dtype)
    cells[rng.random(cells.shape) < 0.2] = 77
    if dtype == "<f4":
        cells[0, 0] = -1e30
    path = tmp_path / "r.tif"
    path.write_bytes(encode.tiff(cells, -110.0, 45.0, 0.5, tile, 77.0, compression, predictor))
    n = 4000
    points = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(20, 47, n), rng.uniform(-112, -73, n), strict=True))] + [(-1, None, 1.0), (-2, 45.0, -110.0)] + [(-10 - k, 44.9, -109.9 + k / 1e4) for k in range(500)]
    df = spark.createDataFrame(points, "id int, lat double, lon double").withColumn("s", F.lit("kept"))
    got = {r["id"]: r["v"] for r in tiff.sample_raster(df, str(path), "v", points_of_range=300).collect()}
    assert len(got) == len(points)
    for k, lat, lon in points:
        i, j = (int(np.floor((45 - lat) / 0.5)), int(np.floor((lon + 110) / 0.5))) if lat is not None else (-1, -1)
        want = float(cells[i, j]) if 0 <= i < 45 and 0 <= j < 70 else None
        assert got[k] == (None if want is None or want == 77 or want < -1e20 else want)


def test_only_tiles_with_points_are_read(spark, tmp_path):
    cells = np.arange(64 * 64, dtype="<f4").reshape(64, 64)
    data = bytearray(encode.tiff(cells, 0.0, 64.0, 1.0, 16, compression=8))
    path = tmp_path / "r.tif"
    path.write_bytes(bytes(data))
    r = tiff.directory(str(path))
    for k in range(1, 16):
        data[r.offsets[k] : r.offsets[k] + 4] = b"\0\0\0\0"
    path.write_bytes(bytes(data))
    points = spark.createDataFrame([(63.5, 0.5), (60.5, 15.5)], "lat double, lon double")
    assert sorted(x["v"] for x in tiff.sample_raster(points, str(path), "v").collect()) == [0.0, 3 * 64 + 15.0]
    two = tiff.sample_rasters(points.unionByName(points), {50: str(path), 100: None})
    assert two.count() == 4 and two.where("gwa_100 is null and gwa_50 is not null").count() == 4


def test_lzw():
    # 7 9 7 9 7 9: codes 256 7 9 258 258 257
    bits = "".join(format(c, "09b") for c in (256, 7, 9, 258, 258, 257))
    data = int(bits.ljust(56, "0"), 2).to_bytes(7, "big")
    assert tiff.lzw(data) == bytes([7, 9, 7, 9, 7, 9])


def test_register_knows_all_formats(spark):
    connectors.register(spark)
    assert spark.read.format("grib").options(files="[]").load().columns == ["time", "lat", "lon", "u10", "v10", "u100", "v100"]


def test_fields_of_a_wide_range_keep_every_digit():
    """More than 2^20 hundredths apart, from a smallest value that neither edition's reference holds."""
    values, at = np.array([[53_000_001.25, 88_000_007.5], [61_000_000.0, 60_000_123.75]]), datetime(2001, 5, 1)
    one, two = encode.grib1(values, 165, at, 50.0, -125.0, 0.5, bits=20), encode.grib2(values, 2, 10, at, 50.0, -125.0, 0.5, bits=20)
    for got in (grib._field_1(one)[1], grib._field_2(two)[1]):
        assert got.ravel().tolist() == values.ravel().tolist()
