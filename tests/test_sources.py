"""Files, connectors and streams."""

import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from galeframe.functions.constants import QCOLS
from galeframe.sources import connectors, hdf5, named, tables, tiff
from galeframe.streaming import ingest


def test_tables_by_extension(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    for name in ("t.parquet", "t.pq", "t.csv"):
        tables.write_table(df, str(tmp_path / name))
        assert tables.read_table(spark, str(tmp_path / name)).select(F.col("x").cast("int"), "y").first() == (1, "a")
    assert tables.read_optional(spark, str(tmp_path / "none.csv")) is None
    assert tables.read_optional(spark, None, "x int").count() == 0


def test_per_height_files(spark, tmp_path):
    (tmp_path / "hrrr_quantiles_40m.csv").write_text("lat,lon,q000,q100\n1,2,3,4\n")
    (tmp_path / "wtk_led_quantiles_60m.csv").write_text("lat,lon,height_m,q000\n1,2,,x\n")
    (tmp_path / "other.csv").write_text("a\n1\n")
    got = {r["source"]: (r["height_m"], r["q000"], r["q100"]) for r in tables.read_per_height(spark, str(tmp_path)).collect()}
    assert got == {"hrrr": (40.0, 3.0, 4.0), "wtk_led": (60.0, None, None)}


def test_tiles_have_all_quantiles(spark, tmp_path):
    (tmp_path / "a.csv").write_text("grid_id,lat,lon,height_m,q000\n1,40,-100,50,2\n2,,-100,50,2\n")
    r = tables.read_tiles(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0]["q000"] == 2.0 and r[0]["q100"] is None


def test_station_files(spark, tmp_path):
    body = "\n".join(f"{q},{q / 10}" for q in range(101) if q not in (0, 50))
    (tmp_path / "s.csv").write_text('# {"station_id": "S1", "years": "2007,2008"}\nquantile,wind_speed_m_s\n' + body + "\n")
    r = tables.station_rows(tables.read_station_quantiles(spark, str(tmp_path / "s.csv"), "station_id string, years string")).first()
    assert (r["station_id"], r["q050"], r["q000"], r["q100"]) == ("S1", 5.0, 0.1, 10.0)
    tables.write_station_files(spark.createDataFrame([("S1", *[float(i) for i in range(101)])], "station_id string, " + ", ".join(f"{q} double" for q in QCOLS)), str(tmp_path / "out"), ["station_id"])
    back = tables.read_station_quantiles(spark, str(tmp_path / "out/*/*.txt"), "station_id string").first()
    assert back["header"]["station_id"] == "S1" and len(back["points"]) == 101


def test_append_is_safe_to_repeat(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.append(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, ["k"])
    tables.append(spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string"), path, ["k"])
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_only_given_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_partitions(spark.createDataFrame([(1, 1), (2, 2)], "h int, v int"), path, ["h"])
    tables.write_partitions(spark.createDataFrame([(2, 9)], "h int, v int"), path, ["h"])
    assert sorted((r["h"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 9)]


def test_features_of_a_model():
    assert tables.model_features('["a"]') == ["a"] and tables.model_features('{"features": ["b"]}') == ["b"] and tables.model_features("x") is None


def test_fetch_tries_again():
    waits, answers = [], [urllib.error.HTTPError("u", 503, "busy", {}, None), io.BytesIO(b"ok")]

    def opener(url, timeout):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert connectors.fetch("u", opener=opener, sleep=waits.append) == "ok" and waits == [0.75]
    answers.append(urllib.error.HTTPError("u", 404, "none", {}, None))
    with pytest.raises(urllib.error.HTTPError):
        connectors.fetch("u", opener=opener, sleep=waits.append)


def test_paged_source(spark, tmp_path):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.rpartition("=")[2])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(f"row{page}".encode() if page < 2 else b"")

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    connectors.register(spark)
    df = spark.read.format("paged").options(path=f"http://127.0.0.1:{server.server_port}/x", keys=json.dumps(["a", "b"])).load()
    assert sorted(map(tuple, df.collect())) == [("a", 0, "row0"), ("a", 1, "row1"), ("b", 0, "row0"), ("b", 1, "row1")]
    server.shutdown()


def test_paged_stream_goes_on_where_it_stopped(spark, tmp_path):
    import http.server
    import threading
    from urllib.parse import parse_qs, urlparse

    there = {"a": 3, "b": 0, "c": 40}
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append((q["key"], int(q["page"])))
            page = int(q["page"])
            if q["key"] == "c":
                page = min(page, there["c"] - 1)  # repeats its last page
            self.send_response(200)
            self.end_headers()
            self.wfile.write(f"{q['key']}{page}".encode() if page < there[q["key"]] else b"")

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    connectors.register(spark)

    def run():
        s = spark.readStream.format("paged").options(path=f"http://127.0.0.1:{server.server_port}/x", keys=json.dumps(["a", "b", "c"]), pages="16").load()
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        q.stop()
        return sorted((r["key"], r["page"], r["body"]) for r in spark.read.schema("key string, page int, body string").parquet(str(tmp_path / "out")).collect())

    want = lambda: sorted((k, p, f"{k}{p}") for k, n in there.items() for p in range(n))
    assert run() == want()
    first = len(asked)
    assert run() == want() and len(asked) - first < 40
    there |= {"a": 5, "b": 2, "c": 41}
    assert run() == want()
    server.shutdown()


def test_files_with_exact_names(spark, tmp_path):
    rows = spark.createDataFrame([(f"S{k}", "a,b" if k else None, *[float(i + k) for i in range(101)]) for k in range(3)], "station_id string, name string, " + ", ".join(f"{q} double" for q in QCOLS)).repartition(3)
    named.export_stations(rows, str(tmp_path / "s"), ["station_id", "name"])
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["S0_quantiles.csv", "S1_quantiles.csv", "S2_quantiles.csv"]
    text = (tmp_path / "s/S1_quantiles.csv").read_text().split("\n")
    assert json.loads(text[0][2:]) == {"station_id": "S1", "name": "a,b"} and text[1:4] == ["quantile,wind_speed_m_s", "0,1.0", "1,2.0"] and len(text) == 104
    named.export_stations(rows.withColumn("q000", F.lit(-1.0)).where("station_id <> 'S2'"), str(tmp_path / "s"), ["station_id"])
    assert (tmp_path / "s/S1_quantiles.csv").read_text().split("\n") == text
    with pytest.raises(Exception, match="S0_quantiles.csv"):
        named.export_stations(rows, str(tmp_path / "s"), ["station_id"], existing="error")
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["S0_quantiles.csv", "S1_quantiles.csv", "S2_quantiles.csv"]
    back = tables.station_rows(tables.read_station_quantiles(spark, str(tmp_path / "s/*.csv"), "station_id string")).orderBy("station_id").collect()
    assert [(r["station_id"], r["q100"]) for r in back] == [("S0", 100.0), ("S1", 101.0), ("S2", 102.0)]

    tiles = spark.createDataFrame([(2, "x\"y", 1.5), (1, "b", None), (1, "a", 0.5)], "tile int, grid_id string, v double")
    named.export_tiles(tiles, str(tmp_path / "t"), "tile", ["grid_id", "v"], ["grid_id"])
    assert (tmp_path / "t/tile_1.csv").read_text() == "grid_id,v\na,0.5\nb,\n" and (tmp_path / "t/tile_2.csv").read_text() == 'grid_id,v\n"x""y",1.5\n'
    import gzip

    from galeframe.functions.constants import TARGET_HEIGHTS

    p = spark.createDataFrame([("000007", k / 4, *[float(h) for h in TARGET_HEIGHTS]) for k in range(5)], "index string, probability double, " + ", ".join(f"windspeed_{h}m double" for h in TARGET_HEIGHTS))
    named.export_locations(p, str(tmp_path / "l"))
    lines = gzip.decompress((tmp_path / "l/000007.csv.gz").read_bytes()).decode().split("\n")
    assert lines[0].startswith("probability,windspeed_30m") and len(lines) == 7 and lines[5].startswith("1.0,30.0")


def test_a_killed_task_leaves_no_file(tmp_path):
    import pyarrow as pa

    batch = lambda *rows: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["name", "line"])

    def killed():
        yield batch(("a.csv", "1"), ("b.csv.gz", "2"))
        raise RuntimeError("executor lost")

    w = named.NamedWriter({"path": str(tmp_path / "o")}, False)
    with pytest.raises(RuntimeError):
        w.write(killed())
    assert [p.name for p in (tmp_path / "o").iterdir() if not p.name.startswith("_staging")] == []
    done = w.write(iter([batch(("a.csv", "1"), ("b.csv.gz", "2")), batch(("b.csv.gz", "3"))]))
    w.commit([done])
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["a.csv", "b.csv.gz"] and done.files == 2
    with pytest.raises(ValueError, match="next to each other"):
        named.NamedWriter({"path": str(tmp_path / "p")}, False).write(iter([batch(("a", "1"), ("b", "1"), ("a", "1"))]))


def test_runs_of_ids():
    assert hdf5.runs([1, 2, 3, 7, 9, 10]) == [(1, 4), (7, 8), (9, 11)] and hdf5.runs([]) == []


def test_lookup_with_fallback_and_failures(spark):
    def ask(lat, lon, size):
        if lat > 2:
            raise TimeoutError
        return None if size < 30 else lat * 100

    pts = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (3.0, 1.0)], "lat double, lon double")
    got = connectors.looked_up(pts, ask, partitions=2)
    assert sorted((r["lat"], r["elevation_m"], r["reason"]) for r in got.where("lat < 2").collect()) == [(1.0, 100.0, None)] * 2
    assert connectors.failures(got).first()["reason"] == "TimeoutError"
    assert tiff.sample_raster(pts, None, "g").where("g is not null").isEmpty()


def test_streams_resume(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text('station_id,DATE,WND\nS1,2020-01-01 00:00:00,"090,5,N,50,5"\nS1,2020-01-01 00:00:00,"090,5,N,50,5"\n')
    run = lambda: ingest.append_once(ingest.speeds(ingest.reports(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    (tmp_path / "in/b.csv").write_text('station_id,DATE,WND\nS1,2020-01-01 01:00:00,"090,5,N,60,5"\n')
    run()
    run()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("time").collect()
    assert [r["reported"] for r in got] == [5.0, 6.0]


def test_windows_and_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text('station_id,DATE,WND\nS1,2020-01-01 00:10:00,"090,5,N,50,5"\nS1,2020-01-01 00:20:00,"090,5,N,70,5"\nS1,2020-01-02 00:20:00,"090,5,N,70,5"\n')
    s = ingest.reports(spark, str(tmp_path / "in")).withColumn("v", F.split("WND", ",")[3].cast("double"))
    ingest.append_once(ingest.windowed(s, "DATE", "v", ["station_id"]), str(tmp_path / "w"), str(tmp_path / "cw")).awaitTermination()
    assert [tuple(r)[3:5] for r in spark.read.parquet(str(tmp_path / "w")).collect()] == [(2, 60.0)]
    ingest.transform_in_batches(s, lambda b: b.groupBy("station_id").count(), str(tmp_path / "b"), str(tmp_path / "cb")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "b")).first()["count"] == 3
