"""Quantile functions, their means, reshaping and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions import cdf, labels, wind
from galeframe.operators import publish, reshape
from galeframe.operators.grid import vertical_fill
from galeframe.operators.quantiles import blocks, ranked_quantiles
from galeframe.plans.base import LONG, P101, SAMPLES, long_table, r, rounded, samples, table


def q01_quantile_block(spark: SparkSession, d: str) -> DataFrame:
    """Three groups hold all rows, so they are ranked by ranges instead of being held in a task each."""
    return rounded(ranked_quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice"))


def _means(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of which every seventh point is missing."""
    g = blocks(samples(spark, d), ["station_id", "height_m"], "speed", "a")
    return g.withColumn("b", F.transform("a", lambda x, i: F.when(i % 7 != 3, x)))


def _points(c: str):
    return F.transform(c, lambda x, i: F.struct(i.cast("double").alias("q"), x.alias("v")))


def q02_mean_complete(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_means(spark, d).select("station_id", "height_m", cdf.mean_complete(F.col("a")).alias("mean_ws"), cdf.mean_complete(F.col("b")).alias("mean_gaps")))


def q03_mean_dense(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_means(spark, d).select("station_id", "height_m", cdf.mean_dense(_points("b")).alias("mean_ws")))


def q04_mean_normalised(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_means(spark, d).select("station_id", "height_m", cdf.mean_normalised(_points("b")).alias("mean_ws")))


def q05_mean_adjacent(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_means(spark, d).select("station_id", "height_m", cdf.mean_adjacent(F.col("b")).alias("mean_ws")))


def q10_unpivot(spark: SparkSession, d: str) -> DataFrame:
    wide = reshape.quantile_table(samples(spark, d), ["station_id", "height_m"], "speed").withColumns({"lat": F.lit(40.0), "lon": F.lit(-100.0)})
    return rounded(reshape.to_long(wide)[0])


def q11_pivot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reshape.to_wide(long_table(spark, d), ["station_id", "height_m"], "era5"))


def q12_prepare_inference(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5 + 30.0).alias("lat"), (F.col("l_suppkey") % 4 - 100.0).alias("lon"), (F.col("l_linenumber") * 10.0).alias("height_m"), (F.col("l_suppkey") % 5 * 10.0).alias("elevation_m"), F.col("l_shipdate"), F.when(F.col("l_returnflag") == "A", "WTK-LED CONUS").when(F.col("l_returnflag") == "N", "hrrr_v2").otherwise("WTK").alias("model"), (F.col("l_extendedprice") / 4997.3).alias("v"), (F.month("l_shipdate") % 2).alias("part"))
    q = F.percentile("v", F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)))
    wide = s.groupBy("lat", "lon", "height_m", "elevation_m", "model", "part").agg(q.alias("a")).select("lat", "lon", "height_m", "elevation_m", "model", *[F.get("a", F.lit(i)).alias(n) for i, n in enumerate(("q000", "q050", "q100"))])
    return rounded(reshape.dataset_columns(wide, ["wtk", "hrrr", "wtk_led_conus"], F.col("model")))


def q27_adjacent_equals(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.col("l_quantity"))).alias("a"))
    return rounded(g.select("l_suppkey", cdf.count_equal(F.col("a")).alias("equal"), cdf.count_equal(F.col("a"), 1.0).alias("near")))


def q26_monotone_drops(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("a"))
    return rounded(g.select("o_custkey", cdf.count_drops(F.col("a.o_totalprice"), 1000.0).alias("drops")))


def q28_cumulative_max(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("a"))
    return rounded(g.select("o_custkey", F.posexplode(cdf.cumulative_max(F.col("a.o_totalprice"))).alias("k", "value")))


def q32_interpolate_gaps(spark: SparkSession, d: str) -> DataFrame:
    hours = table(spark, d, "events").groupBy("user_id", F.hour("ts").alias("h")).agg(F.avg("value").alias("v"))
    g = hours.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("h", "v"))).alias("m"))
    g = g.withColumn("a", cdf.interpolated(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.try_element_at("m", i))))
    return rounded(g.select("user_id", F.posexplode("a").alias("h", "v")), 5)


def q33_resample(spark: SparkSession, d: str) -> DataFrame:
    g = blocks(samples(spark, d), ["station_id"], "speed", "a")
    return rounded(g.select("station_id", F.posexplode(cdf.resampled(cdf.monotone(F.col("a")), 33)).alias("k", "value")))


def q51_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Published profiles at all target heights, from those at 40, 60 and 100 m."""
    s = samples(spark, d).withColumn("index", F.substring("station_id", 2, 9))
    wide = reshape.quantile_table(s, ["index", "height_m"], "speed").withColumns({"latitude": F.lit(40.0), "longitude": F.lit(-100.0)})
    return rounded(publish.profiles(wide, 33), 5)


def q52_vertical_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of the distributions carried to other heights."""
    g = blocks(samples(spark, d).where("height_m <> 60"), ["station_id", "height_m"], "speed")
    filled = vertical_fill(g, ["station_id"], [30, 60, 80, 100])
    return rounded(filled.select("station_id", "height_m", cdf.mean_complete(F.col("profile")).alias("mean_ws")), 5)


def q53_dequantised_labels(spark: SparkSession, d: str) -> DataFrame:
    """Quantile names and numbers, knots, and complete-year arithmetic on order dates."""
    o = table(spark, d, "orders")
    n = F.col("o_orderkey") % 101
    return rounded(o.select("o_orderkey", labels.quantile_name(n).alias("q"), labels.quantile_number(labels.quantile_name(n)).alias("n"), wind.knots(F.col("o_totalprice") / 20000).alias("knots"), wind.days_in_year(F.year("o_orderdate")).alias("days"), wind.uniform(F.col("o_orderkey"), seed=7).alias("u")))


QUERIES = {f.__name__: f for f in (q01_quantile_block, q02_mean_complete, q03_mean_dense, q04_mean_normalised, q05_mean_adjacent, q10_unpivot, q11_pivot, q12_prepare_inference, q26_monotone_drops, q27_adjacent_equals, q28_cumulative_max, q32_interpolate_gaps, q33_resample, q51_profiles, q52_vertical_means, q53_dequantised_labels)}

_B = f"with {SAMPLES}, g as (select station_id, height_m, quantile_cont(speed, {P101}) a from smp group by all), u as (select station_id, height_m, unnest(a) v, generate_subscripts(a, 1) - 1 q from g), gap as (select * from u where q % 7 <> 3)"

ORACLES = {
    "q01_quantile_block": f"with g as (select l_returnflag, quantile_cont(l_extendedprice, {P101}) a from lineitem group by 1) select l_returnflag, cast(generate_subscripts(a, 1) - 1 as bigint) qnum, {r('unnest(a)')} \"value\" from g",
    "q02_mean_complete": f"{_B} select station_id, cast(height_m as bigint) height_m, {r('sum(case when q in (0, 100) then v / 2 else v end) * 0.01')} mean_ws, cast(null as double) mean_gaps from u group by 1, 2",
    "q03_mean_dense": f"{_B}, l as (select *, lag(v) over (partition by station_id, height_m order by q) p from gap) select station_id, cast(height_m as bigint) height_m, {r('sum((v + p) / 2) * 0.01')} mean_ws from l group by 1, 2",
    "q04_mean_normalised": f"{_B}, l as (select *, lag(v) over w p, lag(q) over w s from gap window w as (partition by station_id, height_m order by q)) select station_id, cast(height_m as bigint) height_m, {r('sum((v + p) / 2 * (q - s)) / max(q)')} mean_ws from l group by 1, 2",
    "q05_mean_adjacent": f"{_B}, l as (select *, lag(v) over w p, lag(q) over w s from gap window w as (partition by station_id, height_m order by q)) select station_id, cast(height_m as bigint) height_m, {r('sum(case when q - s = 1 then (v + p) / 2 end) * 0.01')} mean_ws from l group by 1, 2",
    "q10_unpivot": f"{_B} select station_id, {r('height_m')} height_m, cast(q as bigint) qnum, {r('v')} \"value\" from u",
    "q11_pivot": f"with {LONG} select station_id, cast(height_m as bigint) height_m, " + ", ".join(f"{r(f'max(case when qnum = {i} then era5 end)')} q{i:03d}" for i in range(101)) + " from lng group by 1, 2",
    "q12_prepare_inference": f"""with s as (select l_suppkey % 5 + 30.0 lat, l_suppkey % 4 - 100.0 lon, l_linenumber * 10.0 height_m, l_suppkey % 5 * 10.0 elevation_m, l_returnflag f, month(l_shipdate) % 2 part, l_extendedprice / 4997.3 v from lineitem),
g as (select lat, lon, height_m, elevation_m, f, quantile_cont(v, [0.0, 0.5, 1.0]) a from s group by lat, lon, height_m, elevation_m, f, part),
u as (select lat, lon, height_m, elevation_m, f, unnest(a) v, unnest([0, 50, 100]) qnum from g)
select {r('lat')} lat, {r('lon')} lon, {r('height_m')} height_m, {r('elevation_m')} elevation_m, {r('qnum')} qnum, {r("avg(case when f = 'R' then v end)")} wtk, {r("avg(case when f = 'N' then v end)")} hrrr, {r("avg(case when f = 'A' then v end)")} wtk_led_conus from u group by lat, lon, height_m, elevation_m, qnum""",
    "q26_monotone_drops": "with l as (select o_custkey, o_totalprice - lag(o_totalprice) over (partition by o_custkey order by o_orderkey, o_totalprice) d from orders) select o_custkey, cast(count(*) filter (where d < -1000) as bigint) drops from l group by 1",
    "q27_adjacent_equals": "with l as (select l_suppkey, l_quantity - lag(l_quantity) over (partition by l_suppkey order by l_quantity) d from lineitem) select l_suppkey, cast(count(*) filter (where d = 0) as bigint) equal, cast(count(*) filter (where d <= 1) as bigint) near from l group by 1",
    "q28_cumulative_max": f"select o_custkey, cast(row_number() over w - 1 as bigint) k, {r('max(o_totalprice) over w')} \"value\" from orders window w as (partition by o_custkey order by o_orderkey, o_totalprice rows unbounded preceding)",
    "q32_interpolate_gaps": f"""with h as (select user_id, hour(ts) h, avg(value) v from events group by 1, 2), g as (select distinct user_id, x.h from events, range(0, 24) x(h)), j as (select g.user_id, g.h, v from g left join h using (user_id, h)),
k as (select *, last_value(v ignore nulls) over p pv, last_value(case when v is not null then h end ignore nulls) over p ph, first_value(v ignore nulls) over n nv, first_value(case when v is not null then h end ignore nulls) over n nh from j
  window p as (partition by user_id order by h rows between unbounded preceding and current row), n as (partition by user_id order by h rows between current row and unbounded following))
select user_id, cast(h as bigint) h, {r('coalesce(v, pv + (nv - pv) * (h - ph) / nullif(nh - ph, 0), pv, nv)', 5)} v from k""",
    "q33_resample": f"""with {SAMPLES}, g as (select station_id, quantile_cont(speed, {P101}) a from smp group by 1)
select station_id, cast(k as bigint) k, {r('a[1 + floor(k * 100 / 32.0)::int] + (a[1 + least(floor(k * 100 / 32.0)::int + 1, 100)] - a[1 + floor(k * 100 / 32.0)::int]) * (k * 100 / 32.0 - floor(k * 100 / 32.0))')} \"value\" from g, range(0, 33) x(k)""",
    "q51_profiles": f"""with {SAMPLES}, g as (select lpad(substr(station_id, 2), 6, '0') idx, height_m, quantile_cont(speed, {P101}) a from smp group by 1, 2),
p as (select idx, height_m, k, a[1 + floor(k * 100 / 32.0)::int] + (a[1 + least(floor(k * 100 / 32.0)::int + 1, 100)] - a[1 + floor(k * 100 / 32.0)::int]) * (k * 100 / 32.0 - floor(k * 100 / 32.0)) v from g, range(0, 33) x(k)),
w as (select idx, k, max(case when height_m = 40 then v end) v40, max(case when height_m = 60 then v end) v60, max(case when height_m = 100 then v end) v100 from p group by 1, 2),
s as (select *, least(greatest(ln(greatest(v60, 1e-6) / greatest(v40, 1e-6)) / ln(60 / 40.0), -2), 2) a1, least(greatest(ln(greatest(v100, 1e-6) / greatest(v60, 1e-6)) / ln(100 / 60.0), -2), 2) a2 from w)
select idx as "index", {r('k / 32.0', 5)} probability, {r('v40 * pow(30 / 40.0, 1 / 7.0)', 5)} windspeed_30m, {r('v40', 5)} windspeed_40m, {r('v40 * pow(50 / 40.0, a1)', 5)} windspeed_50m, {r('v60', 5)} windspeed_60m, {r('v60 * pow(80 / 60.0, a2)', 5)} windspeed_80m, {r('v100', 5)} windspeed_100m from s""",
    "q52_vertical_means": f"""with {SAMPLES}, g as (select station_id, height_m, quantile_cont(speed, {P101}) a from smp where height_m <> 60 group by 1, 2), u as (select station_id, height_m, unnest(a) v, generate_subscripts(a, 1) - 1 q from g),
w as (select station_id, q, max(case when height_m = 40 then v end) lo, max(case when height_m = 100 then v end) hi from u group by 1, 2),
s as (select *, least(greatest(ln(greatest(hi, 1e-6) / greatest(lo, 1e-6)) / ln(2.5), -2), 2) al from w), z as (select unnest([30, 60, 80, 100]) h),
t as (select station_id, h, q, case h when 100 then hi when 30 then lo * pow(30 / 40.0, 1 / 7.0) else lo * pow(h / 40.0, al) end v from s, z)
select station_id, cast(h as bigint) height_m, {r('sum(case when q in (0, 100) then v / 2 else v end) * 0.01', 5)} mean_ws from t group by 1, 2""",
    "q53_dequantised_labels": f"""select o_orderkey, printf('q%03d', o_orderkey % 101) q, cast(o_orderkey % 101 as bigint) as n, {r('round_even(o_totalprice / 20000 / 0.514444, 0)')} as knots, cast(dayofyear(make_date(year(o_orderdate), 12, 31)) as bigint) as "days",
  {r("('0x' || substr(sha1(o_orderkey || '|7'), 1, 13))::bigint / 4503599627370496.0")} as u from orders""",
}
