"""Readers, sinks, cleaning and filters: tables are written to a scratch folder, read back, and compared with their source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions import cdf, labels, wind
from galeframe.functions.constants import QCOLS, TARGET_HEIGHTS
from galeframe.operators import assemble, metrics, observations, ordered, publish, schema, tiles
from galeframe.operators.cut import scratch
from galeframe.operators.quantiles import blocks
from galeframe.plans.base import P101, SAMPLES, r, rounded, samples, table
from galeframe.sources import connectors, named, tables


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Sites: two places of each station, so that the first must be chosen."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("S"), (F.col("s_suppkey") % 40).cast("string")).alias("Site_ID"), F.col("s_name").alias("station name"), (25 + F.col("s_suppkey") % 17 / 4).alias("Latitude"), (-120 + F.col("s_suppkey") % 13 / 4).alias("lng"), (40 + F.col("s_suppkey") % 3 * 20).alias("z"))
    return s.withColumn("Latitude", F.when(F.col("station name").endswith("7"), None).otherwise(F.col("Latitude")))


def q100_tables(spark: SparkSession, d: str) -> DataFrame:
    """Written and read by extension; a missing optional table has no rows."""
    path, t = scratch(spark), table(spark, d, "nation").select("n_nationkey", "n_name")
    parts = [tables.read_optional(spark, f"{path}/none.csv", "kind string, n_nationkey bigint, n_name string")]
    for kind in ("csv", "pq", "parquet"):
        tables.write_table(t, f"{path}/t.{kind}")
        got = schema.require(tables.read_table(spark, f"{path}/t.{kind}", columns=["n_name", "n_nationkey"]), ["n_name"])
        parts.append(got.select(F.lit(kind).alias("kind"), F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def q101_sites(spark: SparkSession, d: str) -> DataFrame:
    """A site list with columns of other names: the first row of each station by name and place."""
    path = f"{scratch(spark)}/sites.csv"
    tables.write_table(_suppliers(spark, d), path)
    return tables.read_sites(spark, path)


def q102_sites_by_height(spark: SparkSession, d: str) -> DataFrame:
    path = f"{scratch(spark)}/sites.parquet"
    tables.write_table(_suppliers(spark, d), path)
    return tables.read_sites(spark, path, with_height=True)


def q103_grid(spark: SparkSession, d: str) -> DataFrame:
    """Places without ids are numbered from the north."""
    path = f"{scratch(spark)}/grid.csv"
    tables.write_table(table(spark, d, "customer").select((25 + F.col("c_custkey") / 1000).alias("latitude"), (F.col("c_custkey") % 100 - 120).alias("longitude"), "c_name"), path)
    return tables.read_grid(spark, path)


def _wide(spark: SparkSession, d: str, shift: float = 0.0) -> DataFrame:
    """Two quantiles of each nation's suppliers."""
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.min("s_acctbal").alias("low"), F.max("s_acctbal").alias("high"))
    return s.select(F.col("s_nationkey").alias("grid_id"), F.when(F.col("s_nationkey") != 3, 30 + F.col("s_nationkey") / 4).alias("lat"), (-100 - F.col("s_nationkey") / 4).alias("lon"), F.lit(50 + shift).alias("height_m"), (F.col("low") + shift).alias("q000"), (F.col("high") + shift).alias("q100"))


def q104_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles in several formats as one table; rows without place go."""
    path = scratch(spark)
    tables.write_table(_wide(spark, d), f"{path}/a.csv")
    tables.write_table(_wide(spark, d, 10).drop("q000"), f"{path}/b.parquet")
    return rounded(tables.read_tiles(spark, path).select("grid_id", "lat", "lon", "height_m", "q000", "q050", "q100"))


def q105_per_height(spark: SparkSession, d: str) -> DataFrame:
    """Source and height from the file name, unless the file has a height."""
    path = scratch(spark)
    tables.write_table(_wide(spark, d).drop("height_m"), f"{path}/hrrr_quantiles_40m.csv")
    tables.write_table(_wide(spark, d, 10), f"{path}/wtk_led_quantiles_80m.parquet")
    tables.write_table(_wide(spark, d, 20), f"{path}/notes.csv")
    got = tables.read_per_height(spark, path).withColumn("grid_id", F.col("grid_id").cast("bigint"))
    return rounded(got.select("source", "height_m", "grid_id", *[c for c in schema.quantile_columns(got)]))


def q106_predictions(spark: SparkSession, d: str) -> DataFrame:
    path = f"{scratch(spark)}/p.csv"
    tables.write_table(_wide(spark, d).withColumnsRenamed({"lat": "Latitude", "lon": "longitude"}), path)
    return rounded(tables.read_predictions(spark, path).select("lat", "lon", "height_m", "q000", "q001", "q100"))


def _quantiles(spark: SparkSession, d: str) -> DataFrame:
    return blocks(samples(spark, d).where("flag = 'N'"), ["station_id", "height_m"], "speed", "q")


def q107_station_files(spark: SparkSession, d: str) -> DataFrame:
    """A file with a JSON header for each station, written and read back; missing quantiles interpolated."""
    path = scratch(spark)
    q = _quantiles(spark, d).where("height_m = 60").select("station_id", F.lit("2007,2009").alias("years"), *[F.when(F.lit(i not in (0, 50)), F.get("q", F.lit(i))).alias(c) for i, c in enumerate(QCOLS)])
    tables.write_station_files(q, path, ["station_id", "years"])
    got = tables.station_rows(tables.read_station_quantiles(spark, f"{path}/*/*.txt", "station_id string, years string"))
    return rounded(got.select("station_id", F.element_at(labels.years_of(F.col("years")), 2).alias("last_year"), "q000", "q001", "q049", "q050", "q100"))


def q108_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Stations of one country with padded codes; sentinels go."""
    path = f"{scratch(spark)}/c.csv"
    c = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 10 == 0, F.lit("999999")).otherwise(F.col("c_custkey").cast("string")).alias("USAF"), (F.col("c_custkey") % 7).cast("string").alias("WBAN"), F.col("c_name").alias("STATION NAME"), F.when(F.col("c_nationkey") < 12, "US").otherwise("CA").alias("CTRY"), F.lit("40.5").alias("LAT"), F.lit("x").alias("LON"), F.lit("7").alias("ELEV(M)"), F.lit("19990203").alias("BEGIN"), F.lit("20201231").alias("END"))
    tables.write_table(c, path)
    return rounded(tables.station_catalogue(spark, path))


def q109_append(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping parts appended one after another: each key once."""
    path, t = scratch(spark), table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    tables.append(t.where("o_orderkey % 3 < 2"), path, ["o_orderkey"])
    tables.append(t.where("o_orderkey % 3 > 0"), path, ["o_orderkey"])
    tables.append(t, path, ["o_orderkey"])
    return spark.read.parquet(path)


def q110_partitions(spark: SparkSession, d: str) -> DataFrame:
    """A table by height; written again, only the given heights are replaced."""
    path, t = scratch(spark), samples(spark, d).groupBy("station_id", "height_m").agg(F.count("*").alias("n"))
    tables.write_partitions(t, path, ["height_m"])
    tables.write_partitions(t.where("height_m = 60").withColumn("n", -F.col("n")), path, ["height_m"])
    return spark.read.parquet(path).withColumn("height_m", F.col("height_m").cast("bigint"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    n = F.substring("station_id", 2, 9).cast("int")
    return _quantiles(spark, d).select(n.alias("index"), (30 + n / 4).alias("latitude"), (-100 - n / 4).alias("longitude"), F.col("height_m").cast("double").alias("height_m"), *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(QCOLS)])


def q111_locations(spark: SparkSession, d: str) -> DataFrame:
    """One gzipped file for each location, read back; heights that the table has are as they were."""
    path = scratch(spark)
    tables.write_locations(publish.profiles(_places(spark, d)), path)
    got = spark.read.option("header", True).schema("probability double, " + ", ".join(f"windspeed_{h}m double" for h in TARGET_HEIGHTS) + ", index string").csv(path)
    return rounded(got.select(F.col("index").cast("bigint").alias("place"), "probability", "windspeed_40m", "windspeed_60m", "windspeed_100m"))


def q112_location_index(spark: SparkSession, d: str) -> DataFrame:
    return publish.location_index(_places(spark, d))


def q113_decoded(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", wind.decoded(F.col("l_partkey"), (F.col("l_linenumber") - 3).cast("double"), F.col("l_tax")).alias("value")))


def q114_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Series with columns of other names: numbers read lossily, negative speeds missing, rows without key, place or time dropped."""
    k = F.col("o_orderkey")
    t = table(spark, d, "orders").select(F.when(k % 11 != 0, (k % 5).cast("string")).alias("Station"), F.when(k % 13 == 0, "high").otherwise((k % 4 * 10).cast("string")).alias("z"), F.when(k % 17 != 0, F.col("o_orderdate").cast("string")).alias("time"), (F.col("o_totalprice") / 1000 - 50).cast("string").alias("wind_speed"), F.lit("40").alias("latitude"), F.lit(-100).alias("lng"), k.alias("Elev"))
    got = observations.normalised(t)
    return rounded(got.select("site_id", "height", F.year("datetime").alias("year"), F.month("datetime").alias("month"), F.date_format(F.to_date("datetime"), "yyyy-MM-dd").alias("day"), "ws_observed", "lat", "lon", "name", "elev_m"))


def q115_filters(spark: SparkSession, d: str) -> DataFrame:
    """Rows with place, at the target heights, inside a box."""
    k = F.col("p_partkey")
    t = table(spark, d, "part").select("p_partkey", F.when(k % 9 == 0, "none").otherwise((k % 50 + 10).cast("string")).alias("lat"), (-k % 60 - 80.5).alias("lon"), (k % 120 + 0.4).alias("height_m"))
    return rounded(schema.in_box(schema.at_heights(schema.with_coordinates(t), TARGET_HEIGHTS), 20, 45, -120, -85))


def q116_finite_features(spark: SparkSession, d: str) -> DataFrame:
    """Derived features of the rows whose features are all finite."""
    k = F.col("s_suppkey")
    t = table(spark, d, "supplier").select("s_suppkey", F.when(k % 5 == 0, float("nan")).when(k % 7 == 0, float("inf")).otherwise(F.col("s_acctbal")).alias("era5"), F.when(k % 3 != 0, F.col("s_acctbal") / 2).alias("wtk"), F.when(k % 2 == 0, "gold standard").otherwise("Asos ").alias("observation_type"), (k % 360).alias("aspect_deg"))
    return rounded(schema.derived_features(schema.finite_rows(t, ["era5", "wtk"])).select("s_suppkey", "is_gs", "aspect_sin", "aspect_cos"))


def q117_gs_rows(spark: SparkSession, d: str) -> DataFrame:
    """A column compared as numbers where both are, else as canonical text."""
    k = F.col("s_suppkey")
    t = table(spark, d, "supplier").select("s_suppkey", F.when(k % 4 == 0, "Gold-Standard").when(k % 4 == 1, "GS").otherwise("ASOS").alias("kind"), (k % 3 / 1).alias("number"))
    return schema.gs_rows(t, "kind", "gs").select("s_suppkey", F.lit("kind").alias("by")).unionByName(schema.gs_rows(t, "number", "1").select("s_suppkey", F.lit("number").alias("by")))


def _long(spark: SparkSession, d: str) -> DataFrame:
    return _quantiles(spark, d).select("station_id", "height_m", F.posexplode("q").alias("qnum", "observation"))


def _gwa(spark: SparkSession, d: str) -> DataFrame:
    n = F.substring("station_id", 2, 9).cast("int")
    g = _quantiles(spark, d).where(n % 3 != 0).select("station_id", "height_m", (n / 4 + 5).alias("gwa_interp"))
    return g.unionByName(g.where("height_m = 40").withColumn("gwa_interp", F.col("gwa_interp") + 1))


def q118_with_gwa(spark: SparkSession, d: str) -> DataFrame:
    """Atlas values by station and height, each key once: all rows, and the covered ones."""
    every, covered = (assemble.with_gwa(_long(spark, d), _gwa(spark, d), covered_only=x).groupBy("station_id", "height_m").agg(F.count("*").alias("n"), F.max("gwa_interp").alias("gwa")).withColumn("covered", F.lit(x)) for x in (False, True))
    return rounded(every.unionByName(covered))


def q119_unique_sites(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select(F.concat(F.lit("S"), (F.col("l_suppkey") % 25).cast("string")).alias("station_id"), F.col("l_linestatus").alias("observation_type"), F.col("l_quantity").alias("lat"), F.col("l_discount").alias("lon"))
    return rounded(assemble.unique_sites(p))


def q120_sample(spark: SparkSession, d: str) -> DataFrame:
    """A fixed-seed sample of 50 orders."""
    return ordered.sample_rows(table(spark, d, "orders").select("o_orderkey"), 50, "o_orderkey")


def q121_latex(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").groupBy(F.concat(F.lit("set_"), F.col("l_returnflag")).alias("dataset")).agg(F.count("*").cast("double").alias("n"), F.max("l_quantity").cast("double").alias("most"))
    return spark.createDataFrame([(x,) for x in publish.latex_rows(t, ["set_R", "set_A", "set_X"], ["n", "most"], 1)], "line string")


def q122_wide_means(spark: SparkSession, d: str) -> DataFrame:
    """The mean of each station's wide quantiles."""
    w = _quantiles(spark, d).select("station_id", F.col("height_m").alias("Height"), F.lit("40").alias("Lat"), F.lit(-100).alias("LONGITUDE"), *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(QCOLS)])
    return rounded(assemble.wide_means(w).select("station_id", "lat", "lon", "height_m", "mean_ws"))


def q123_feature_table(spark: SparkSession, d: str) -> DataFrame:
    """Importance table: the totals where they are missing."""
    path = f"{scratch(spark)}/f.csv"
    tables.write_table(table(spark, d, "part").select(F.col("p_name").alias("feature"), "p_partkey", F.col("p_size").alias("weight"), (F.col("p_retailprice") / 100).alias("gain"), F.when(F.col("p_size") > 25, 7).alias("total_gain"), F.col("p_partkey").alias("cover")), path)
    return rounded(tables.feature_table(spark, path).select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "total_gain", "total_cover"))


def q124_failures(spark: SparkSession, d: str) -> DataFrame:
    """Failed places by reason, with the first of them."""
    k = F.col("c_custkey")
    t = table(spark, d, "customer").select((k % 50).cast("double").alias("lat"), (k % 7).cast("double").alias("lon"), F.when(k % 50 % 4 == 0, "timeout").when(k % 50 % 4 == 1, "no_value").alias("reason"))
    f = connectors.failures(t, 3)
    return f.select("reason", "n", F.size("examples").cast("bigint").alias("shown"), F.col("examples")[0]["lat"].alias("lat"), F.col("examples")[2]["lon"].alias("lon"))


def q125_log_target(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "supplier").select("s_suppkey", wind.log_target(F.col("s_acctbal"), 0.5).alias("target")))


def q126_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Columns found by other names, missing optional ones NULL, an ordered layout, numbers read lossily."""
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("STATION"), F.col("n_name").alias("Time"), F.lit("1e3").alias("Z"), F.lit("?").alias("q001"), F.lit("2").alias("q000"))
    got = schema.to_numbers(schema.aliased(t, ["station_id", "height_m"], ["elev_m", "dataset"]), ["height_m", *schema.quantile_columns(t)])
    got = schema.ordered(schema.with_columns(got, ["q002"], "double"), ["height_m"])
    facts = [F.lit(",".join(got.columns)).alias("layout"), F.lit(schema.choose(t, ["datetime", "time"])).alias("time_column"), F.lit(",".join(schema.missing(got, ["lat", "q000"]))).alias("lacking"), F.lit(",".join(schema.present(got, ["lat", "q000"]))).alias("there")]
    return got.select("station_id", "height_m", "elev_m", "q000", "q001", *facts)


def q127_monotone_violations(spark: SparkSession, d: str) -> DataFrame:
    """Drops between neighbouring values of each group, and its root mean square error against a consensus of two columns."""
    t = table(spark, d, "lineitem")
    g = t.groupBy("l_suppkey").agg(cdf.collected((F.col("l_orderkey") * 10 + F.col("l_linenumber")), F.col("l_quantity")).alias("p"), F.sqrt(F.avg(F.pow(F.col("l_quantity") - (F.col("l_tax") + F.col("l_discount")) / 2, 2))).alias("rmse"), F.median(F.col("l_quantity") - F.col("l_tax")).alias("bias"))
    return rounded(g.select("l_suppkey", cdf.count_drops(F.col("p.v")).alias("drops"), "rmse", "bias"))


def q134_station_names(spark: SparkSession, d: str) -> DataFrame:
    """Station files by their exact names, read back: header, lines, and the sum of the values."""
    path = scratch(spark)
    q = _quantiles(spark, d).where("height_m = 60").select("station_id", F.lit("n").alias("kind"), *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(QCOLS)])
    named.export_stations(q, path, ["station_id", "kind"])
    named.export_stations(q.withColumn("q000", F.lit(-9.0)), path, ["station_id"])  # these have a file
    got = named.read_named(spark, path)
    value = F.split("line", ",")[1].try_cast("double")
    return rounded(got.groupBy("name").agg(F.min_by("line", "at").alias("header"), F.count("*").alias("n"), F.sum(F.when(F.col("at") > 1, value)).alias("total")))


def q135_location_names(spark: SparkSession, d: str) -> DataFrame:
    """Location files by their exact names, read back whole."""
    path = scratch(spark)
    named.export_locations(publish.profiles(_places(spark, d)), path)
    got = spark.read.option("header", True).csv(path).withColumn("name", F.col("_metadata.file_name"))
    return rounded(got.groupBy("name").agg(F.count("*").alias("n"), F.sum(F.col("windspeed_40m").cast("double")).alias("total"), F.max(F.col("probability").cast("double")).alias("last")))


def q136_height_names(spark: SparkSession, d: str) -> DataFrame:
    """A file for each height, one row of each place."""
    path = scratch(spark)
    t = _places(spark, d).withColumnRenamed("index", "grid_id")
    named.export_heights(t.unionByName(t), path, "wtk", ["grid_id", "latitude", "q050"])
    got = named.read_named(spark, path).where("at > 0")
    return rounded(got.select("name", F.split("line", ",")[0].cast("bigint").alias("grid_id"), F.split("line", ",")[2].cast("double").alias("q050")))


def q137_tile_report(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of a few customers each: those that can't be computed are reported, the others are there, and are skipped when asked for again."""

    def mean(part):
        if part.c_acctbal.min() < -990:
            raise ValueError("too low")
        return part.groupby("c_nationkey", as_index=False).c_acctbal.mean()

    path, t = scratch(spark), table(spark, d, "customer").withColumn("tile", F.floor(F.col("c_custkey") / 40))
    first = tiles.run_tiles(t.select("tile", "c_nationkey", "c_acctbal"), "tile", mean, path)
    again = tiles.run_tiles(t.select("tile", "c_nationkey", "c_acctbal"), "tile", mean, path, tries=1)
    files = named.read_named(spark, path).where("at > 0").groupBy(F.regexp_extract("name", r"tile_(\d+)\.csv", 1).alias("tile")).agg(F.count("*").alias("lines"))
    got = first.join(again.select("tile", F.col("status").alias("again")), "tile").join(files, "tile", "left")
    return got.select(F.col("tile").cast("bigint").alias("tile"), "status", "n", "error", "again", "lines")


QUERIES = {k: f for k, f in globals().items() if k[0] == "q" and k[1:3].isdigit()}

_SUP = """sup as (select 'S' || (s_suppkey % 40) station_id, s_name as "name", case when s_name like '%7' then null else 25 + s_suppkey % 17 / 4.0 end::double lat, (-120 + s_suppkey % 13 / 4.0)::double lon, (40 + s_suppkey % 3 * 20)::double height_m from supplier)"""
_WIDE = "wide as (select s_nationkey k, case when s_nationkey <> 3 then 30 + s_nationkey / 4.0 end::double lat, (-100 - s_nationkey / 4.0)::double lon, min(s_acctbal)::double low, max(s_acctbal)::double high from supplier group by s_nationkey)"
_Q = f"{SAMPLES}, qs as (select station_id, height_m, quantile_cont(speed, {P101}) q from smp where flag = 'N' group by all)"

ORACLES = {
    "q100_tables": "select kind, n_nationkey, n_name from nation, (select unnest(['csv', 'pq', 'parquet']) kind)",
    "q101_sites": f"with {_SUP}, o as (select *, row_number() over (partition by station_id order by name, lat, lon) k from sup where lat is not null) select station_id, lat, lon, name from o where k = 1",
    "q102_sites_by_height": f"with {_SUP}, o as (select *, row_number() over (partition by station_id, height_m order by name, lat, lon) k from sup where lat is not null) select station_id, lat, lon, height_m, name from o where k = 1",
    "q103_grid": "with p as (select (25 + c_custkey / 1000.0)::double lat, (c_custkey % 100 - 120)::double lon from customer) select lpad((row_number() over (order by lat desc, lon) - 1)::varchar, 6, '0') grid_id, lat, lon from p",
    "q104_tiles": f"with {_WIDE} select k::varchar grid_id, {r('lat')} lat, {r('lon')} lon, 50.0::double height_m, {r('low')} q000, null::double q050, {r('high')} q100 from wide where lat is not null union all select k::varchar, {r('lat')}, {r('lon')}, 60.0, null, null, {r('high + 10')} from wide where lat is not null",
    "q105_per_height": f"with {_WIDE} select 'hrrr' as source, 40.0::double height_m, k grid_id, {r('low')} q000, {r('high')} q100 from wide union all select 'wtk_led', 60.0, k, {r('low + 10')}, {r('high + 10')} from wide",
    "q106_predictions": f"with {_WIDE} select {r('lat')} lat, {r('lon')} lon, 50.0::double height_m, {r('low')} q000, null::double q001, {r('high')} q100 from wide",
    "q107_station_files": f"with {_Q} select station_id, 2009::bigint last_year, {r('q[2]')} q000, {r('q[2]')} q001, {r('q[50]')} q049, {r('(q[50] + q[52]) / 2')} q050, {r('q[101]')} q100 from qs where height_m = 60",
    "q108_catalogue": "select lpad(c_custkey::varchar, 6, '0') || lpad((c_custkey % 7)::varchar, 5, '0') station_id, c_name as name, 40.5::double lat, null::double lon, 7.0::double elev_m, 1999::bigint begin_year, 2020::bigint end_year from customer where c_nationkey < 12 and c_custkey % 10 <> 0",
    "q109_append": "select o_orderkey, o_orderstatus from orders",
    "q110_partitions": f"with {SAMPLES} select station_id, height_m::bigint height_m, (case when height_m = 60 then -count(*) else count(*) end)::bigint n from smp group by station_id, height_m",
    "q111_locations": f"with {_Q}, u as (select substr(station_id, 2)::bigint place, height_m, unnest(q) v, generate_subscripts(q, 1) - 1 i from qs) select place, {r('i / 100.0')} probability, {r('max(case when height_m = 40 then v end)')} windspeed_40m, {r('max(case when height_m = 60 then v end)')} windspeed_60m, {r('max(case when height_m = 100 then v end)')} windspeed_100m from u group by place, i",
    "q112_location_index": f"with {SAMPLES} select distinct lpad(substr(station_id, 2), 6, '0') as index, (30 + substr(station_id, 2)::int / 4.0)::double latitude, (-100 - substr(station_id, 2)::int / 4.0)::double longitude from smp where flag = 'N'",
    "q134_station_names": f"with {_Q} select station_id || '_quantiles.csv' as name, '# {{\"station_id\":\"' || station_id || '\",\"kind\":\"n\"}}' header, 103::bigint n, {r('list_sum(q)')} total from qs where height_m = 60",
    "q135_location_names": f"with {_Q} select lpad(substr(station_id, 2), 6, '0') || '.csv.gz' as name, 101::bigint n, {r('list_sum(q)')} total, 1.0::double as last from qs where height_m = 40",
    "q136_height_names": f"with {_Q} select 'wtk_quantiles_' || height_m || 'm.csv' as name, substr(station_id, 2)::bigint grid_id, {r('q[51]')} q050 from qs",
    "q137_tile_report": "with t as (select c_custkey // 40 tile, min(c_acctbal) < -990 bad, count(distinct c_nationkey) n from customer group by 1) select tile, case when bad then 'fail' else 'ok' end status, case when not bad then n end n, case when bad then 'ValueError: too low' end error, case when bad then 'fail' else 'skipped' end again, case when not bad then n end lines from t",
    "q113_decoded": f"select l_orderkey, l_linenumber::bigint l_linenumber, {r('l_partkey / (case when l_linenumber = 3 then 1 else l_linenumber - 3 end)::double + l_tax')} as value from lineitem",
    "q114_normalised": f"with t as (select o_orderkey k, (o_orderkey % 5)::varchar s, (o_orderkey % 4 * 10)::double h, o_orderdate, o_totalprice / 1000 - 50 w from orders where o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0 and o_orderkey % 17 <> 0) select s site_id, h height, year(o_orderdate)::bigint as year, month(o_orderdate)::bigint as month, strftime(o_orderdate, '%Y-%m-%d') as day, {r('case when w >= 0 then w end')} ws_observed, 40.0::double lat, -100.0::double lon, s || '_' || h::int || '.0' as name, k::double elev_m from t",
    "q115_filters": f"select p_partkey, (p_partkey % 50 + 10)::double lat, {r('-p_partkey % 60 - 80.5')} lon, {r('p_partkey % 120 + 0.4')} height_m from part where p_partkey % 9 <> 0 and p_partkey % 120 in (30, 40, 50, 60, 80, 100) and p_partkey % 50 + 10 between 20 and 45 and -p_partkey % 60 - 80.5 between -120 and -85",
    "q116_finite_features": f"select s_suppkey, (s_suppkey % 2 = 0)::bigint is_gs, {r('sin(radians(s_suppkey % 360))')} aspect_sin, {r('cos(radians(s_suppkey % 360))')} aspect_cos from supplier where s_suppkey % 5 <> 0 and s_suppkey % 7 <> 0 and s_suppkey % 3 <> 0",
    "q117_gs_rows": "select s_suppkey, 'kind' as by from supplier where s_suppkey % 4 < 2 union all select s_suppkey, 'number' from supplier where s_suppkey % 3 = 1",
    "q118_with_gwa": f"with {_Q}, k as (select station_id, height_m::bigint height_m, substr(station_id, 2)::int n from qs) select station_id, height_m, 101::bigint n, {r('case when n % 3 <> 0 then n / 4.0 + 5 end')} gwa, false covered from k union all select station_id, height_m, 101, {r('n / 4.0 + 5')}, true from k where n % 3 <> 0",
    "q119_unique_sites": f"select 'S' || (l_suppkey % 25) station_id, min(l_linestatus) observation_type, {r('median(l_quantity)')} lat, {r('median(l_discount)')} lon from lineitem group by 1",
    "q120_sample": "select o_orderkey from orders order by sha1(o_orderkey || '|42'), o_orderkey limit 50",
    "q121_latex": "select 'set\\_' || l_returnflag || ' & ' || format('{:.1f}', count(*)::double) || ' & ' || format('{:.1f}', max(l_quantity)::double) || ' \\\\' as line from lineitem where l_returnflag in ('A', 'R') group by l_returnflag",
    "q122_wide_means": f"with {_Q} select station_id, 40.0::double lat, -100.0::double lon, height_m::double height_m, {r('(list_sum(q) - (q[1] + q[101]) / 2) / 100')} mean_ws from qs",
    "q123_feature_table": f"select p_partkey, {r('case when p_size > 25 then 7 else p_retailprice / 100 * p_size end')} total_gain, {r('p_partkey * p_size')} total_cover from part",
    "q124_failures": "with t as (select distinct (c_custkey % 50)::double lat, (c_custkey % 7)::double lon, case c_custkey % 50 % 4 when 0 then 'timeout' when 1 then 'no_value' end reason from customer), o as (select *, row_number() over (partition by reason order by lat, lon) k from t where reason is not null) select reason, count(*) n, least(3, count(*))::bigint shown, min(lat) lat, max(case when k = 3 then lon end) lon from o group by reason",
    "q125_log_target": f"select s_suppkey, {r('ln(greatest(s_acctbal, 0.5))')} as target from supplier",
    "q126_aliases": "select n_nationkey station_id, 1000.0::double height_m, null::varchar elev_m, 2.0::double q000, null::double q001, 'height_m,Time,dataset,elev_m,station_id,q001,q000,q002' layout, 'Time' time_column, 'lat' lacking, 'q000' there from nation",
    "q127_monotone_violations": f"with o as (select l_suppkey, l_quantity, l_tax, l_discount, lag(l_quantity) over (partition by l_suppkey order by l_orderkey * 10 + l_linenumber, l_quantity) before from lineitem) select l_suppkey, count(*) filter (where l_quantity < before)::bigint drops, {r('sqrt(avg(pow(l_quantity - (l_tax + l_discount) / 2, 2)))')} rmse, {r('median(l_quantity - l_tax)')} bias from o group by l_suppkey",
}
