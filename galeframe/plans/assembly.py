"""Observations, cohorts, spatial joins, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions import geo, labels, wind
from galeframe.functions.constants import GWA_HEIGHTS, WTK_HEIGHTS
from galeframe.operators import assemble, grid, metrics, observations, ordered, reshape, schema, spatial
from galeframe.plans.base import KM, LONG, P101, POINTS, SAMPLES, SITES, long_table, places, r, rounded, samples, table
from galeframe.sources.connectors import raster_cells


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select((F.col("o_custkey") % 7).alias("site_id"), F.lit(10.0).alias("height"), F.col("o_orderdate").alias("datetime"), (F.col("o_totalprice") / 9871.3).alias("ws_observed"))


def q06_month_balance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(observations.month_balance(_orders(spark, d), 1990, 2030, 12, 0.8))


def q07_complete_years(spark: SparkSession, d: str) -> DataFrame:
    return rounded(observations.complete_years(_orders(spark, d), ["site_id"], "datetime", 0.5))


def q08_interannual(spark: SparkSession, d: str) -> DataFrame:
    return rounded(observations.interannual(_orders(spark, d), "site_id", "ws_observed", "datetime")[0])


def q62_interannual_years(spark: SparkSession, d: str) -> DataFrame:
    return rounded(observations.interannual(_orders(spark, d), "site_id", "ws_observed", "datetime")[1])


def q63_panel_stats(spark: SparkSession, d: str) -> DataFrame:
    per_year = observations.interannual(_orders(spark, d), "site_id", "ws_observed", "datetime")[1]
    return rounded(observations.panel_stats(per_year, "site_id", "mean_ws"))


def q09_cohort_merge(spark: SparkSession, d: str) -> DataFrame:
    wide = {n: reshape.quantile_table(samples(spark, d).where(F.col("flag") == f), ["station_id", "height_m"], "speed").withColumns({"lat": F.lit(40.0), "lon": F.lit(-100.0)}) for f, n in (("A", "era5"), ("N", "obs"), ("R", "wtk"))}
    out = assemble.cohort("GS", wide["era5"], wide["obs"].where("height_m <> 60"), {"wtk": wide["wtk"]})
    return rounded(out.select("station_id", "height_m", "qnum", "observation", "era5", "wtk", "lat", "observation_type"))


def q13_radius_neighbours(spark: SparkSession, d: str) -> DataFrame:
    s = places(table(spark, d, "supplier"), "s_suppkey").select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("station_id"), "lat", "lon", F.when(F.col("id") % 3 == 0, "asos").otherwise("gs").alias("observation_type"))
    return rounded(spatial.neighbour_lists(s, 150.0))


def q14_knn4_idw(spark: SparkSession, d: str) -> DataFrame:
    g = places(table(spark, d, "supplier"), "s_suppkey").withColumnsRenamed({"id": "gid", "lon": "x", "lat": "y"})
    p = places(table(spark, d, "customer"), "c_custkey").withColumnsRenamed({"lon": "x", "lat": "y"})
    w = grid.neighbour_weights(p, g, "id", "gid")
    v = table(spark, d, "supplier").select(F.col("s_suppkey").alias("gid"), F.lit(0).alias("t"), F.col("s_acctbal").alias("v"))
    return rounded(spatial.project(v, w, "id", "gid", ["t"], ["v"]).select("id", "v"), 4)


def q15_nearest_lookup(spark: SparkSession, d: str) -> DataFrame:
    sites = places(table(spark, d, "supplier"), "s_suppkey").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("mean_ms")), "id")
    sites = sites.withColumnRenamed("id", "site").withColumn("height_m", F.when(F.col("site") % 2 == 0, 40.0).otherwise(100.0))
    p = places(table(spark, d, "customer"), "c_custkey").withColumn("height_m", F.col("id") % 140 * 1.0)
    return rounded(spatial.lookup(p, sites, [40, 100], "mean_ms").select("id", "height_used", "site", "mean_ms"))


def q16_brackets(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", wind.bracket(F.col("p_size") * 4.0, WTK_HEIGHTS).alias("b"))
    return rounded(p.select("p_partkey", "b.exact", "b.lo", "b.hi"))


def q17_power_law(spark: SparkSession, d: str) -> DataFrame:
    a, e = wind.log_fit(F.col("p_size") * 1.0, F.col("p_retailprice"))
    return rounded(table(spark, d, "part").groupBy("p_brand").agg(a.alias("factor"), e.alias("exponent")))


def q64_gwa_heights(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    rows = p.select("p_partkey", (F.col("p_size") * 4.0).alias("height_m"), *[F.when(k % m != 0, F.lit(3.0 + i) + k % (11 + i) / 7.0).alias(f"gwa_{h}") for i, (h, m) in enumerate(zip(GWA_HEIGHTS, (2, 3, 5, 7), strict=True))])
    return rounded(assemble.gwa_fitted(assemble.gwa_at_height(rows)).select("p_partkey", "gwa_interp", "gwa_fit"), 5)


def q18_restart(spark: SparkSession, d: str) -> DataFrame:
    late = table(spark, d, "lineitem").where("l_shipdate >= timestamp '1998-01-01'").select(F.col("l_orderkey").alias("o_orderkey"))
    return ordered.not_done(table(spark, d, "orders").select("o_orderkey"), late, ["o_orderkey"])


def q19_kept_samples(spark: SparkSession, d: str) -> DataFrame:
    s = _orders(spark, d)
    kept = observations.kept_samples(s, observations.month_balance(s, 1990, 2030, 12, 0.8))
    return rounded(kept.groupBy("site_id").agg(F.count("*").alias("n"), F.sum("ws_observed").alias("total")), 3)


def q20_rounded_join(spark: SparkSession, d: str) -> DataFrame:
    era = places(table(spark, d, "supplier"), "s_suppkey").select("id", "lat", "lon", (F.col("id") * 1.0).alias("elevation_m"))
    pts = places(table(spark, d, "customer"), "c_custkey").withColumnRenamed("id", "c")
    return rounded(assemble.at_places(pts, era.select("lat", "lon", "elevation_m"), ["elevation_m"], 2).select("c", "elevation_m"))


def q29_dense_index(spark: SparkSession, d: str) -> DataFrame:
    p = places(table(spark, d, "supplier"), "s_suppkey").withColumns({"lat": F.floor("lat") * 1.0, "lon": F.floor("lon") * 1.0})
    return ordered.dense_axes(p).select("id", "grid_id")


def q34_tiles(spark: SparkSession, d: str) -> DataFrame:
    p = places(table(spark, d, "customer"), "c_custkey").withColumns({"x": F.col("lon") * 90_000.0, "y": F.col("lat") * 111_000.0})
    return grid.with_tiles(p).select("id", "tile_id")


def q35_labels(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    raw = F.when(F.col("c_custkey") % 4 == 0, " Gold_Standard ").when(F.col("c_custkey") % 4 == 1, "ASOS").when(F.col("c_custkey") % 4 == 2, F.col("c_mktsegment"))
    model = F.when(F.col("c_custkey") % 3 == 0, "My WTK-LED set").when(F.col("c_custkey") % 3 == 1, " HRRR").otherwise("wtk 2km")
    return c.select("c_custkey", labels.observation_type(raw).alias("cohort"), labels.dataset(model).alias("model"), labels.padded_index(F.col("c_custkey")).alias("idx"), labels.file_safe(F.concat(F.col("c_mktsegment"), F.lit("/a b"))).alias("file"))


def q36_packed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    packed = F.concat_ws(",", F.lit("090"), F.lit("5"), F.lit("N"), F.when(F.col("event_id") % 9 == 0, "9999").when(F.col("event_id") % 11 == 0, "x").otherwise((F.col("event_id") % 300).cast("string")), F.lit("1"))
    return rounded(e.select("event_id", wind.packed_speed(packed).alias("speed"), F.array_join(labels.years_of(F.concat(F.lit("2020, x,"), (F.col("event_id") % 5 + 2007).cast("string"), F.lit(",2020"))), ",").alias("years")))


def q37_union(spark: SparkSession, d: str) -> DataFrame:
    n, s = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name")), table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit(1.5).alias("q000"))
    return rounded(reshape.union_all([n, s]))


def q38_missing_tiles(spark: SparkSession, d: str) -> DataFrame:
    need = table(spark, d, "supplier").select(F.col("s_suppkey").alias("tile_id"))
    there = table(spark, d, "lineitem").where("l_quantity > 49").select((F.col("l_suppkey") * 2).alias("tile_id"))
    return grid.missing_tiles(need, there)


def q43_fold_seeds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", labels.fold_seed(42, F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))).alias("seed"))


def q46_projections(spark: SparkSession, d: str) -> DataFrame:
    p = places(table(spark, d, "customer"), "c_custkey")
    mx, my = geo.web_mercator(F.col("lat"), F.col("lon"))
    cx, cy = geo.conic(F.col("lat"), F.col("lon"))
    return rounded(p.select("id", mx.alias("mx"), my.alias("my"), cx.alias("cx"), cy.alias("cy")), 2)


def q47_wrapped(spark: SparkSession, d: str) -> DataFrame:
    lon = F.col("c_custkey") * 7.3 - 900
    return rounded(table(spark, d, "customer").select("c_custkey", geo.wrap_180(lon).alias("w180"), geo.wrap_360(lon).alias("w360"), geo.in_polygon(F.col("c_custkey") % 17 + 0.5, F.col("c_custkey") % 13 + 0.5, [(0, 0), (12, 0), (12, 10), (6, 4), (0, 10)]).alias("inside")))


def q48_components(spark: SparkSession, d: str) -> DataFrame:
    u, v = wind.components(F.col("l_quantity"), F.col("l_partkey") % 720 - 90.0)
    return rounded(table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg(u).alias("u"), F.avg(v).alias("v"), F.avg(wind.magnitude(u, v)).alias("speed")))


def q50_first_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return rounded(ordered.first_rows(o, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"), F.desc("o_totalprice")).select("o_custkey", "o_orderkey", "o_totalprice"))


def q65_shear(spark: SparkSession, d: str) -> DataFrame:
    """Speed at 80 m from 10 and 100 m, with the neutral exponent where it isn't defined."""
    p = table(spark, d, "part")
    lo, hi = F.col("p_size") % 7 * 1.0, F.col("p_size") % 11 * 1.3
    a = wind.shear(lo, hi)
    return rounded(p.select("p_partkey", a.alias("alpha"), wind.at_height(hi, a, F.lit(80.0)).alias("speed"), wind.clipped_shear(lo, hi, F.lit(10.0), F.lit(100.0)).alias("clipped")))


def q66_tile_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Weights, components, vertical interpolation and quantiles of a small synthetic grid."""
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 9).alias("gid"), F.col("l_orderkey").alias("t"), F.when(F.col("l_linenumber") % 2 == 0, 40).otherwise(60).alias("height_m"), F.col("l_quantity").alias("ws"), (F.col("l_partkey") % 360 * 1.0).alias("wd"))
    series = li.groupBy("gid", "t", "height_m").agg(F.max("ws").alias("ws"), F.max("wd").alias("wd"))
    w = spark.range(9).select(F.col("id").alias("gid"), (F.col("id") % 3).alias("point"), F.lit(1 / 3).alias("weight"))
    q = grid.tile_quantiles(grid.point_speeds(series, w, "point", "gid", "t", [50.0], WTK_HEIGHTS), "point")
    return rounded(q.select("point", "height_m", "n_hours", F.posexplode("quantiles").alias("qnum", "speed")), 3)


def q67_raster(spark: SparkSession, d: str) -> DataFrame:
    raster = spark.range(23 * 50).select(F.floor(F.col("id") / 50).alias("row"), (F.col("id") % 50).alias("col"), F.when(F.col("id") % 10 == 0, -9999.0).otherwise(F.col("id") * 1.0).alias("value"))
    return rounded(raster_cells(raster, -120.0, 48.0, 1.0, 1.0, places(table(spark, d, "customer"), "c_custkey"), nodata=-9999.0).select("id", "sample"))


def q68_bilinear(spark: SparkSession, d: str) -> DataFrame:
    g = spark.range(20 * 50).select((25 + F.floor(F.col("id") / 50)).cast("double").alias("lat"), (F.col("id") % 50 - 120).cast("double").alias("lon"), (F.col("id") % 13 * 1.0).alias("u"))
    return rounded(spatial.bilinear(places(table(spark, d, "customer"), "c_custkey"), g, 1.0, ["u"]))


def q69_site_means(spark: SparkSession, d: str) -> DataFrame:
    t = long_table(spark, d).withColumns({"lat": F.lit(40.0), "lon": F.lit(-100.0)}).where("qnum % 7 <> 3")
    return rounded(assemble.site_means(t).select("station_id", "height_m", "ws_avg"))


def q70_whole_cdf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assemble.whole_cdf(long_table(spark, d), ["era5"]).select("station_id", "height_m", "qnum", "era5", "era5_q50", "era5_q90"))


def q71_arrays(spark: SparkSession, d: str) -> DataFrame:
    a = reshape.to_arrays(long_table(spark, d), ["station_id", "height_m"], ["era5", "wtk"])
    return rounded(reshape.arrays_to_long(a, ["station_id", "height_m"], ["era5", "wtk"]))


def q72_filled(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 3 == 1, F.col("c_acctbal")).alias("v"), F.when(F.col("c_custkey") % 2 == 0, "  ").otherwise("x").alias("s"))
    return rounded(schema.filled(c, zero_strings=True))


def q73_difference_map(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).withColumns({"lat": F.substring("station_id", 2, 9).cast("double") + 25.0000001, "lon": F.lit(-100.0)})
    w = {f: reshape.quantile_table(s.where(F.col("flag") == f), ["lat", "lon", "height_m"], "speed") for f in "AN"}
    q = schema.quantile_columns(w["A"])
    return rounded(grid.difference_map(grid.height_means(w["A"], q), grid.height_means(w["N"], q)).select("lat_r", "height_m", "diff"), 3)


def q74_site_table(spark: SparkSession, d: str) -> DataFrame:
    s = _orders(spark, d).withColumns({"name": F.concat(F.lit("n"), F.col("site_id").cast("string")), "lat": F.col("site_id") + 0.5, "lon": F.lit(1.0), "elev_m": F.lit(2.0)})
    t = observations.site_table(s)
    return rounded(t.select("site_id", "name", "lat", "n", "years", F.get("quantiles", F.lit(95)).alias("q095")))


def q75_predictions_wide(spark: SparkSession, d: str) -> DataFrame:
    p = long_table(spark, d).select((F.substring("station_id", 2, 9).cast("double") + 25.00000004).alias("lat"), F.lit(-100.0).alias("lon"), "height_m", "qnum", F.col("era5").alias("pred_observation"))
    sites = spark.range(20).select(F.col("id").cast("string").alias("index"), (F.col("id") + 25.0).alias("latitude"), F.lit(-100.0).alias("longitude"))
    return rounded(reshape.predictions_wide(p, sites).select("index", "latitude", "height_m", "q000", "q050", "q100"))


def q76_subsets(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "region").agg(F.array_sort(F.collect_set("r_name")).alias("f"))
    return metrics.subsets(f, F.col("f")).select(F.array_join("subset", "+").alias("label"))


QUERIES = {k: f for k, f in globals().items() if k[0] == "q" and k[1:3].isdigit()}

_O = "o as (select o_custkey % 7 site_id, o_orderdate t, o_totalprice / 9871.3 v from orders)"
_MB = f"""{_O}, mc as (select site_id, year(t) y, month(t) m, count(*) n from o group by 1, 2, 3), md as (select site_id, y, count(*) months_present, median(n) med, sum(n) total_count from mc group by 1, 2),
mb as (select site_id, y, months_present, total_count, med, med * 0.8 thr, (select count(*) from mc where mc.site_id = md.site_id and mc.y = md.y and mc.n >= md.med * 0.8) ge from md)"""
_IA = f"""{_O}, sy as (select site_id, year(t) y, count(*) n, avg(v) m from o group by 1, 2), k as (select * from (select *, median(n) over (partition by site_id) mn from sy) where n >= 0.9 * mn),
k2 as (select * from (select *, count(*) over (partition by site_id) ny, median(m) over (partition by site_id) sm from k) where ny >= 3)"""


def _lcc() -> str:
    import math

    rad = math.radians
    t = lambda x: math.tan(math.pi / 4 + rad(x) / 2)
    n = math.log(math.cos(rad(30)) / math.cos(rad(60))) / math.log(t(60) / t(30))
    f = 6370997.0 * math.cos(rad(30)) * t(30) ** n / n
    rho0 = f / t(38.47240422490422) ** n
    rho = f"({f!r} / pow(tan(pi() / 4 + radians(lat) / 2), {n!r}))"
    return f"{r(f'{rho} * sin({n!r} * radians(lon + 96))', 2)} cx, {r(f'{rho0!r} - {rho} * cos({n!r} * radians(lon + 96))', 2)} cy"


ORACLES = {
    "q06_month_balance": f"with {_MB} select site_id, 10.0::double height, cast(y as bigint) as year, " + ", ".join(f"cast(coalesce((select n from mc where mc.site_id = mb.site_id and mc.y = mb.y and mc.m = {m}), 0) as bigint) m{m:02d}" for m in range(1, 13)) + f", cast(total_count as bigint) total_count, cast(months_present as bigint) months_present, {r('med')} median_nonzero, {r('thr')} threshold, cast(ge as bigint) months_ge_threshold, months_present >= 12 and ge >= 12 kept, case when months_present >= 12 and ge >= 12 then 'ok' when months_present < 12 then 'insufficient_months_present' else 'insufficient_months_ge_threshold' end reason from mb",
    "q07_complete_years": f"with {_O}, dy as (select site_id, t::date d, count(*) n from o group by 1, 2), f as (select site_id, n, count(*) f from dy group by 1, 2), pd as (select site_id, n per_day from (select *, row_number() over (partition by site_id order by f desc, n) k from f) where k = 1), y as (select site_id, year(t) y, count(*) n from o group by 1, 2) select site_id, cast(y as bigint) as year, cast(n as bigint) as n, cast(per_day as bigint) per_day from y join pd using (site_id) where n >= 0.5 * per_day * dayofyear(make_date(y, 12, 31))",
    "q08_interannual": f"with {_IA} select site_id, cast(count(*) as bigint) n_years, {r('min(m / sm)')} min_norm, {r('max(m / sm)')} max_norm, {r('max(m / sm) - min(m / sm)')} range_norm from k2 group by 1",
    "q62_interannual_years": f"with {_IA} select site_id, cast(y as bigint) as year, cast(n as bigint) n_samples, {r('m')} mean_ws, {r('sm')} site_median_mean, {r('m / sm')} norm_mean from k2",
    "q63_panel_stats": f"with {_IA}, g as (select site_id, min(m) low, quantile_cont(m, 0.25) q1, median(m) med, quantile_cont(m, 0.75) q3, max(m) high, count(distinct y) n from k2 group by 1) select site_id, {r('low')} low, {r('q1')} q1, {r('med')} median, {r('q3')} q3, {r('high')} high, cast(n as bigint) n_years, cast(row_number() over (order by med desc, site_id) as bigint) site_index from g",
    "q09_cohort_merge": f"with {LONG} select station_id, {r('height_m')} height_m, cast(qnum as bigint) qnum, {r('case when height_m <> 60 then observation end')} observation, {r('era5')} era5, {r('wtk')} wtk, 40.0::double lat, 'GS' observation_type from lng",
    "q13_radius_neighbours": f"with {SITES}, pr as (select a.id a, b.id b from sites a, sites b where a.id % 3 <> 0 and a.id <> b.id and {KM} <= 150), l as (select a, string_agg('s' || b, ',' order by 's' || b) s, count(*) n from pr group by 1) select 's' || id station_id, coalesce(s, '') neighbors_km_site_ids, cast(coalesce(n, 0) as bigint) neighbors_km_count from sites left join l on id = a where id % 3 <> 0",
    "q14_knn4_idw": f"with {SITES}, {POINTS}, dd as (select a.id, b.id gid, sqrt(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2)) d from points a, sites b), k as (select *, row_number() over (partition by id order by d, gid) rk from dd qualify rk <= 4), w as (select *, min(case when d <= 0 then rk end) over (partition by id) hit from k) select id, {r('sum(s_acctbal * case when hit is not null then (rk = hit)::int else 1 / (d + 1e-9) end) / sum(case when hit is not null then (rk = hit)::int else 1 / (d + 1e-9) end)', 4)} v from w join supplier on gid = s_suppkey group by id",
    "q15_nearest_lookup": f"with {SITES}, {POINTS}, p as (select id, lat, lon, case when abs(40 - id % 140) <= abs(100 - id % 140) then 40 else 100 end h from points), dd as (select a.id, a.h, b.id site, {KM} d from p a join sites b on (case when b.id % 2 = 0 then 40 else 100 end) = a.h), k as (select *, row_number() over (partition by id order by d, site) rk from dd) select id, {r('h')} height_used, site, {r('s_acctbal')} mean_ms from k join supplier on site = s_suppkey where rk = 1",
    "q16_brackets": "with h as (select unnest([10, 40, 60, 80, 100, 120, 140, 160, 200]) h), p as (select p_partkey, p_size * 4 z from part) select p_partkey, z in (select h from h) exact, cast(case when z in (select h from h) then z when z < 10 then 10 when z > 200 then 160 else (select max(h) from h where h <= z) end as bigint) lo, cast(case when z in (select h from h) then z when z < 10 then 40 when z > 200 then 200 else (select min(h) from h where h >= z) end as bigint) hi from p",
    "q17_power_law": f"select p_brand, {r('exp(regr_intercept(ln(p_retailprice), ln(p_size)))')} factor, {r('regr_slope(ln(p_retailprice), ln(p_size))')} exponent from part group by 1",
    "q64_gwa_heights": f"""with p as (select p_partkey, p_size * 4.0::double z, case when p_partkey % 2 <> 0 then 3 + p_partkey % 11 / 7.0::double end u1, case when p_partkey % 3 <> 0 then 4 + p_partkey % 12 / 7.0::double end u2, case when p_partkey % 5 <> 0 then 5 + p_partkey % 13 / 7.0::double end u3, case when p_partkey % 7 <> 0 then 6 + p_partkey % 14 / 7.0::double end u4 from part),
x as (select p_partkey, z, h, u from (select p_partkey, z, unnest([10, 50, 100, 150]) h, unnest([u1, u2, u3, u4]) u from p) where u is not null),
f as (select p_partkey, any_value(z) z, count(*) k, regr_slope(ln(u), ln(h)) al, regr_intercept(ln(u), ln(h)) a, any_value(u) one from x group by 1),
b as (select p_partkey, any_value(z) z, count(*) k, max(case when h = z then u end) same, max(case when h <= z then h end) lo, min(case when h > z then h end) hi, min(h) h1, max(h) h9 from x group by 1),
e as (select b.*, case when lo is null then h1 when hi is null then (select max(h) from x where x.p_partkey = b.p_partkey and h < h9) else lo end e1, case when lo is null then (select min(h) from x where x.p_partkey = b.p_partkey and h > h1) when hi is null then h9 else hi end e2 from b),
y as (select e.*, a.u ua, c.u ub from e left join x a on a.p_partkey = e.p_partkey and a.h = e1 left join x c on c.p_partkey = e.p_partkey and c.h = e2)
select q.p_partkey, {r("case when y.k = 1 then (select max(u) from x where x.p_partkey = q.p_partkey) when same is not null then same else ua * pow(y.z / e1, ln(ub / ua) / ln(e2 / e1)) end", 5)} gwa_interp, {r("case when f.k >= 2 then exp(f.a) * pow(f.z, f.al) else one end", 5)} gwa_fit from part q left join y using (p_partkey) left join f using (p_partkey)""",
    "q18_restart": "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_shipdate >= timestamp '1998-01-01')",
    "q19_kept_samples": f"with {_MB} select site_id, cast(count(*) as bigint) as n, {r('sum(v)', 3)} total from o where (site_id, year(t)) in (select (site_id, y) from mb where months_present >= 12 and ge >= 12) group by 1",
    "q20_rounded_join": f"with {SITES}, {POINTS} select a.id c, {r('b.id')} elevation_m from points a left join sites b on round_even(a.lat, 2) = round_even(b.lat, 2) and round_even(a.lon, 2) = round_even(b.lon, 2)",
    "q29_dense_index": f"with {SITES} select id, lpad(cast(dense_rank() over (order by floor(lat) desc) - 1 as varchar), 3, '0') || lpad(cast(dense_rank() over (order by floor(lon)) - 1 as varchar), 3, '0') grid_id from sites",
    "q34_tiles": f"with {POINTS}, m as (select min(lon * 90000) x0, min(lat * 111000) y0 from points) select id, (cast(floor((lon * 90000 - x0) / 250000) as bigint) << 32) | (cast(floor((lat * 111000 - y0) / 250000) as bigint) & 4294967295) tile_id from points, m",
    "q35_labels": "select c_custkey, case c_custkey % 4 when 0 then 'GS' when 1 then 'ASOS' when 2 then trim(c_mktsegment) else '' end cohort, case c_custkey % 3 when 0 then 'wtk_led_conus' when 1 then 'hrrr' else 'wtk' end model, lpad(c_custkey::varchar, 6, '0') idx, regexp_replace(c_mktsegment || '/a b', '[^A-Za-z0-9\\-_.]', '_', 'g') file from customer",
    "q36_packed": f"select event_id, {r('case when event_id % 9 = 0 or event_id % 11 = 0 then null else (event_id % 300) / 10.0 end')} speed, array_to_string(list_sort(list_distinct([2020, event_id % 5 + 2007])), ',') as years from events",
    "q37_union": "select cast(n_nationkey as bigint) n_nationkey, n_name as name, cast(null as double) q000 from nation union all select null, r_name, 1.5 from region",
    "q38_missing_tiles": "select s_suppkey tile_id from supplier where s_suppkey not in (select l_suppkey * 2 from lineitem where l_quantity > 49)",
    "q43_fold_seeds": "select s_suppkey, ('0x' || substr(sha1('S' || s_suppkey || '42'), 1, 8))::bigint seed from supplier",
    "q46_projections": f"with {POINTS} select id, {r('radians(lon) * 6378137', 2)} mx, {r('ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137', 2)} my, {_lcc()} from points",
    "q47_wrapped": f"""with c as (select c_custkey, c_custkey * 7.3::double - 900 lon, c_custkey % 17 + 0.5 x, c_custkey % 13 + 0.5 y from customer)
select c_custkey, {r('((lon + 180) % 360 + 360) % 360 - 180')} w180, {r('(lon % 360 + 360) % 360')} w360, (case when y < 10 and 10 > y and x < 12 then 1 else 0 end + case when y > 4 and y < 10 and x < 6 + (y - 4) then 1 else 0 end + case when y > 4 and y < 10 and x < 6 - (y - 4) then 1 else 0 end + case when y < 10 and x < 0 then 1 else 0 end) % 2 = 1 inside from c""",
    "q48_components": f"with c as (select l_returnflag, l_quantity s, radians(((270 - (l_partkey % 720 - 90)) % 360 + 360) % 360) th from lineitem) select l_returnflag, {r('avg(-s * sin(th))')} u, {r('avg(-s * cos(th))')} v, {r('avg(s)')} speed from c group by 1",
    "q50_first_rows": f"select o_custkey, o_orderkey, {r('o_totalprice')} o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc, o_totalprice desc) = 1",
    "q65_shear": f"with p as (select p_partkey, p_size % 7 * 1.0::double lo, p_size % 11 * 1.3::double hi from part), a as (select *, case when lo > 0 and hi > 0 then ln(lo / hi) / ln(0.1) else 1 / 7.0 end a from p) select p_partkey, {r('a')} alpha, {r('hi * pow(0.8, a)')} speed, {r('least(greatest(ln(greatest(hi, 1e-6) / greatest(lo, 1e-6)) / ln(10), -2), 2)')} clipped from a",
    "q66_tile_pipeline": f"""with s as (select l_suppkey % 9 gid, l_orderkey t, case when l_linenumber % 2 = 0 then 40 else 60 end h, max(l_quantity) ws, max(l_partkey % 360) wd from lineitem group by 1, 2, 3),
u as (select gid % 3 point, t, h, sum(-ws * sin(radians(((270 - wd) % 360 + 360) % 360)) / 3) u, sum(-ws * cos(radians(((270 - wd) % 360 + 360) % 360)) / 3) v from s group by 1, 2, 3),
w as (select point, t, max(case when h = 40 then sqrt(u * u + v * v) end) lo, max(case when h = 60 then sqrt(u * u + v * v) end) hi from u group by 1, 2),
z as (select point, hi * pow(50 / 60.0, case when lo > 0 and hi > 0 then ln(lo / hi) / ln(40 / 60.0) else 1 / 7.0 end) sp from w),
b as (select point, cast(count(sp) as bigint) n_hours, quantile_cont(sp, {P101}) q from z group by 1)
select point, 50.0::double height_m, n_hours, qnum, {r('v', 3)} speed from (select point, n_hours, unnest(q) v, generate_subscripts(q, 1) - 1 qnum from b)""",
    "q67_raster": f"with {POINTS}, c as (select id, cast(floor(48 - lat) as bigint) i, cast(floor(lon + 120) as bigint) j from points) select id, {r('case when i between 0 and 22 and j between 0 and 49 and (i * 50 + j) % 10 <> 0 then i * 50 + j end')} sample from c",
    "q68_bilinear": f"""with {POINTS}, c as (select id, lat, lon, floor(lat + 1e-9) a, floor(lon + 1e-9) b from points), f as (select id, a, b, greatest(lat - a, 0) fy, greatest(lon - b, 0) fx from c), k as (select id, a + i y, b + j x, (case when i = 0 then 1 - (case when fy < 1e-9 then 0 else fy end) else (case when fy < 1e-9 then 0 else fy end) end) * (case when j = 0 then 1 - (case when fx < 1e-9 then 0 else fx end) else (case when fx < 1e-9 then 0 else fx end) end) w from f, range(0, 2) ii(i), range(0, 2) jj(j))
select id, {r('case when sum(case when y between 25 and 44 and x between -120 and -71 then w else 0 end) > 1 - 1e-9 then sum(w * (((y - 25) * 50 + x + 120)::bigint % 13)) end')} u from k where w > 0 group by 1""",
    "q69_site_means": f"with {LONG}, g as (select *, lag(observation) over w p, lag(qnum) over w s from lng where qnum % 7 <> 3 window w as (partition by station_id, height_m order by qnum)) select station_id, cast(height_m as bigint) height_m, {r('sum((observation + p) / 2 * (qnum - s)) / max(qnum)')} ws_avg from g group by 1, 2",
    "q70_whole_cdf": f"with {LONG}, w as (select *, max(case when qnum = 50 then era5 end) over (partition by station_id, height_m) a, max(case when qnum = 90 then era5 end) over (partition by station_id, height_m) b from lng) select station_id, cast(height_m as bigint) height_m, cast(qnum as bigint) qnum, {r('era5')} era5, {r('a')} era5_q50, {r('b')} era5_q90 from w",
    "q71_arrays": f"with {LONG} select station_id, cast(height_m as bigint) height_m, cast(qnum as bigint) qnum, {r('era5')} era5, {r('wtk')} wtk from lng",
    "q72_filled": f"select c_custkey, {r('case when c_custkey % 3 = 1 then c_acctbal else 0 end')} v, case when c_custkey % 2 = 0 then '0' else 'x' end s from customer",
    "q73_difference_map": f"with {SAMPLES}, g as (select station_id, height_m, flag, quantile_cont(speed, {P101}) a from smp where flag in ('A', 'N') group by all), m as (select station_id, height_m, flag, (list_sum(a) - (a[1] + a[101]) / 2) / 100 m from g) select {r('substr(station_id, 2)::int + 25')} lat_r, cast(height_m as bigint) height_m, {r('max(case when flag = $A$ then m end) - max(case when flag = $N$ then m end)', 3)} diff from m group by 1, 2".replace("$", "'"),
    "q74_site_table": f"with {_O} select site_id, 'n' || site_id as name, {r('site_id + 0.5')} lat, cast(count(*) as bigint) as n, (select string_agg(y::varchar, ',' order by y) from (select distinct year(t) y from o b where b.site_id = o.site_id)) as years, {r('quantile_cont(v, 0.95)')} q095 from o group by site_id",
    "q75_predictions_wide": f"with {LONG} select substr(station_id, 2) as \"index\", {r('substr(station_id, 2)::int + 25')} latitude, cast(height_m as bigint) height_m, {r('max(case when qnum = 0 then era5 end)')} q000, {r('max(case when qnum = 50 then era5 end)')} q050, {r('max(case when qnum = 100 then era5 end)')} q100 from lng where substr(station_id, 2)::int < 20 group by station_id, height_m",
    "q76_subsets": "with f as (select list(r_name order by r_name) f from region) select array_to_string(list_filter(f, lambda x, i: (m >> (i - 1)) & 1 = 1), '+') as label from f, range(1, 32) x(m)",
}
