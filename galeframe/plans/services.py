"""Station reports, streams of files, outside services, orders and artifacts: what stands between the tables and the models."""

from __future__ import annotations

import contextlib
import http.server
import json
import threading
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions import labels
from galeframe.operators import ml, ordered, spatial
from galeframe.operators.cut import cut, scratch
from galeframe.plans.base import places, r, rounded, table
from galeframe.plans.learning import ORACLES as LEARNING
from galeframe.plans.learning import _training
from galeframe.sources import connectors, named, tables
from galeframe.streaming import ingest


def q138_raw_reports(spark: SparkSession, d: str) -> DataFrame:
    """Raw reports of each station in a file of its name, read back with the station from the name."""
    path = scratch(spark)
    o = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("s"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("DATE"), F.concat_ws(",", F.lit("090"), F.col("o_orderpriority"), (F.col("o_orderkey") % 500).cast("string")).alias("WND"), "o_orderkey")
    named.write_named(o, path, F.concat(F.lit("72"), F.lpad("s", 4, "0"), F.lit(".csv")), named.csv_line(F.col("DATE"), F.col("WND"), F.col("o_orderkey")), [F.col("o_orderkey")], "DATE,WND,extra")
    got = tables.read_reports(spark, path)
    return got.select("station_id", F.date_format("DATE", "yyyy-MM-dd").alias("day"), "WND")


def q139_stream_of_files(spark: SparkSession, d: str) -> DataFrame:
    """CSV files as they come, joined with the elevation of their places in batches; asked twice, each batch is there once."""
    path, t = scratch(spark), table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") * 1.0).alias("lat"), F.col("c_acctbal").alias("speed"))
    t.repartition(4).write.option("header", True).csv(f"{path}/in")
    high = table(spark, d, "nation").where("n_nationkey <> 7").select((F.col("n_nationkey") * 1.0).alias("lat"), (F.col("n_regionkey") * 100.0).alias("elevation_m"))
    for _ in range(2):
        s = spark.readStream.schema("c_custkey long, lat double, speed double").option("header", True).option("maxFilesPerTrigger", 2).csv(f"{path}/in")
        ingest.transform_in_batches(s, lambda b: b.join(F.broadcast(high), "lat", "left"), f"{path}/out", f"{path}/ck").awaitTermination()
    return rounded(spark.read.parquet(f"{path}/out").drop("batch"))


def q140_outside_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Elevations of an outside service, asked once for each place: coarser pixels where there is no value, a reason where there is none at all."""

    def ask(lat: float, lon: float, size: float) -> float | None:
        k = round(lat) % 4
        if k == 0:
            raise TimeoutError
        return lat * 10 if k == 1 or k == 2 and size > 10 else None

    k = F.col("c_custkey")
    p = table(spark, d, "customer").select("c_custkey", (k % 23).cast("double").alias("lat"), F.when(k % 11 > 0, (k % 3).cast("double")).alias("lon"))
    return rounded(connectors.looked_up(p, ask, partitions=4).select("c_custkey", "elevation_m", "reason"))


def q141_once_per_key(spark: SparkSession, d: str) -> DataFrame:
    """What depends on the place only is computed for distinct places, and joined back to all rows."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 19).alias("lon"), (F.col("l_suppkey") % 7).alias("lat"))
    return rounded(spatial.once_per_key(li, ["lon", "lat"], lambda p: p.withColumn("value", F.sqrt(F.col("lon") * F.col("lon") + F.col("lat") * F.col("lat")))))


def q142_total_order(spark: SparkSession, d: str) -> DataFrame:
    """The place of each row in the order of a sink, by four keys."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    return ordered.positions(li, [F.col("l_quantity").asc(), F.col("l_shipdate").asc(), F.col("l_orderkey").asc(), F.col("l_linenumber").asc()]).select("l_orderkey", "l_linenumber", "position")


def q143_yearly_paths(spark: SparkSession, d: str) -> DataFrame:
    """A file for each year there are orders of."""
    years = sorted(row["y"] for row in table(spark, d, "orders").select(F.year("o_orderdate").alias("y")).distinct().collect())
    return spark.createDataFrame([(p,) for p in tables.yearly_paths("/era5/", "era5_{year}.grib", years)], "path string")


def q144_importance(spark: SparkSession, d: str) -> DataFrame:
    """Importance of a stump's features: the one that it splits has all of the gain."""
    t, names, signs = ml.features(_training(spark, d), ["era5", "wtk"])
    model = ml.train(t, names, signs, balance=None, parameters={"trees": 1, "depth": 1, "rate": 1.0})
    return rounded(ml.importance(spark, model, names).select("feature", "gain", "weight", "total_gain", "rank_gain"), 3)


@contextlib.contextmanager
def _served(rows: dict[str, list[str]], host: str):
    """A service with the pages of each key."""

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            pages, page = rows.get(q["key"], []), int(q["page"])
            self.send_response(200)
            self.end_headers()
            self.wfile.write((pages[page] if page < len(pages) else "").encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer((host, 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://{host}:{server.server_port}/pages"
    finally:
        server.shutdown()


def q145_paged_service(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a service, in one read and as a stream that is stopped and goes on: each row once in both."""
    n = table(spark, d, "nation").orderBy("n_regionkey", "n_nationkey").collect()  # 25 rows
    pages: dict[str, list[str]] = {}
    for row in n:
        lines = pages.setdefault(str(row["n_regionkey"]), [])
        if not lines or lines[-1].count("\n") == 1:
            lines.append(row["n_name"])
        else:
            lines[-1] += "\n" + row["n_name"]
    keys, path = json.dumps(sorted(pages)), scratch(spark)
    connectors.register(spark)
    with _served(pages, "127.0.0.1") as url:
        whole = cut(spark.read.format("paged").options(path=url, keys=keys).load())
        for _ in range(2):
            s = spark.readStream.format("paged").options(path=url, keys=keys, pages="1").load()
            q = s.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").start()
            q.processAllAvailable()
            q.stop()
    split = lambda df, how: df.select(F.lit(how).alias("how"), F.col("key").cast("bigint").alias("n_regionkey"), F.explode(F.split("body", "\n")).alias("n_name"))
    return split(whole, "read").unionByName(split(spark.read.parquet(f"{path}/out"), "stream"))


def q146_parameter_sweep(spark: SparkSession, d: str) -> DataFrame:
    """One parameter changed at a time, all folds of all values side by side; models of no tree, whose errors are those of the fold medians."""
    t, names, signs = ml.features(_training(spark, d), ["era5", "wtk"])
    return rounded(ml.parameter_sweep(t, names, signs, ml.neighbour_map(t), {"rate": [0.1, 0.3], "depth": [2, 4, 6]}, {"trees": 0}))


def q147_fold_seeds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", labels.fold_seed(42, F.col("s_name")).alias("seed"))


def q148_place_samples(spark: SparkSession, d: str) -> DataFrame:
    """Places in the order of a hash, the first hundred: the same ones every time."""
    return rounded(ordered.sample_rows(places(table(spark, d, "customer"), "c_custkey"), 100, "id").select("id", "lat", "lon"))


QUERIES = {k: f for k, f in globals().items() if k[0] == "q" and k[1:3].isdigit()}

_STUMP = LEARNING["q98_stump"]
_MEDIANS = LEARNING["q97_fold_medians"]

ORACLES = {
    "q138_raw_reports": "select '72' || lpad((o_custkey % 40)::varchar, 4, '0') station_id, strftime(o_orderdate, '%Y-%m-%d') as day, '090,' || o_orderpriority || ',' || (o_orderkey % 500) as \"WND\" from orders",
    "q139_stream_of_files": f"select c_custkey, (c_nationkey * 1.0)::double lat, {r('c_acctbal')} speed, {r('n_regionkey * 100.0')} elevation_m from customer left join nation on n_nationkey = c_nationkey and n_nationkey <> 7",
    "q140_outside_lookup": f"select c_custkey, case when c_custkey % 11 > 0 and c_custkey % 23 % 4 in (1, 2) then {r('c_custkey % 23 * 10.0')} end elevation_m, case when c_custkey % 11 > 0 then case c_custkey % 23 % 4 when 0 then 'TimeoutError' when 3 then 'no_value' end end reason from customer",
    "q141_once_per_key": f"select l_orderkey, l_linenumber::bigint l_linenumber, (l_suppkey % 19)::bigint lon, (l_suppkey % 7)::bigint lat, {r('sqrt(pow(l_suppkey % 19, 2) + pow(l_suppkey % 7, 2))')} as value from lineitem",
    "q142_total_order": "select l_orderkey, l_linenumber::bigint l_linenumber, row_number() over (order by l_quantity, l_shipdate, l_orderkey, l_linenumber) - 1 as position from lineitem",
    "q143_yearly_paths": "select distinct '/era5/era5_' || year(o_orderdate) || '.grib' as path from orders",
    "q144_importance": _STUMP[: _STUMP.index("best as (")] + f"best as (select f, gain from z order by gain desc, f, c limit 1), names as (select unnest([1, 2, 3]) f, unnest(['era5', 'wtk', 'qnum']) feature), g as (select feature, coalesce(gain, 0) gain, case when gain is null then 0.0 else 1.0 end w from names left join best using (f)) select feature, {r('gain', 3)} gain, w::double as weight, {r('gain', 3)} total_gain, row_number() over (order by gain desc, feature)::bigint rank_gain from g",
    "q145_paged_service": "select how, n_regionkey::bigint n_regionkey, n_name from nation, (select unnest(['read', 'stream']) how)",
    "q146_parameter_sweep": _MEDIANS[: _MEDIANS.rindex("select station_id")] + f", e as (select predicted - observation e from t join m on fold = station_id where typ = 'GS' and era5 is not null and wtk is not null), v as (select unnest(['rate', 'rate', 'depth', 'depth', 'depth']) as parameter, unnest([0.1, 0.3, 2, 4, 6])::double as value) select parameter, value, {r('sqrt(avg(e * e))')} rmse, {r('avg(abs(e))')} mae, count(e)::bigint n from e, v group by 1, 2",
    "q147_fold_seeds": "select s_suppkey, cast('0x' || substr(sha1(s_name || '42'), 1, 8) as bigint) seed from supplier",
    "q148_place_samples": f"select id, {r('lat')} lat, {r('lon')} lon from (select c_custkey id, 25 + (c_custkey * 37 % 2300) / 100.0::double lat, -120 + (c_custkey * 53 % 5000) / 100.0::double lon from customer) order by sha1(id || '|42'), id limit 100",
}
