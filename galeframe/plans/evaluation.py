"""Errors, summaries, ranks, quality control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions import labels
from galeframe.operators import metrics, ordered, qc
from galeframe.plans.base import LONG, long_table, r, rounded, table

BOTH = ["era5", "wtk"]


def _gs_long(spark: SparkSession, d: str) -> DataFrame:
    return long_table(spark, d).withColumn("observation_type", labels.observation_type(F.col("observation_type")))


def q21_row_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.row_metrics(long_table(spark, d), BOTH, "GS"))


def q22_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.summary(metrics.site_bias(long_table(spark, d), BOTH), BOTH))


def q23_height_bands(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.band_metrics(metrics.site_bias(long_table(spark, d), BOTH), BOTH, "GS", 50))


def q24_group_differences(spark: SparkSession, d: str) -> DataFrame:
    diffs = metrics.group_differences(long_table(spark, d).withColumnRenamed("wtk", "pred_observation"), "era5")
    return rounded(metrics.difference_curve(diffs, "station_id", "height_m").select("station_id", "height_m", "ml_abs_err_mean", "ds_abs_err_mean", "diff", "rank", "share", "share_better"))


def q25_robust_z(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("metric"))
    z = qc.robust_z(t, "metric").withColumn("size", F.abs("zscore"))
    return rounded(ordered.top(z, "size", 20, "l_suppkey").select("l_suppkey", "metric", "zscore"))


def q30_ranks_and_shares(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("gain"))
    return rounded(ordered.shares(t, "gain", "p_brand"))


def q31_runs(spark: SparkSession, d: str) -> DataFrame:
    return ordered.runs(table(spark, d, "orders").where("o_orderstatus = 'F'"), "o_orderkey", span=1000)


def q39_pooled_and_station(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.change(metrics.pooled_and_mean(long_table(spark, d), "station_id", BOTH), "era5", "pooled_rmse"))


def q40_intervals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.interval(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice"), 4)


def q41_bias_quartiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.bias_quartiles(long_table(spark, d), BOTH))


def q42_limits(spark: SparkSession, d: str) -> DataFrame:
    t = long_table(spark, d)
    return rounded(metrics.limits(t, ["observation", "era5"]).crossJoin(metrics.axis_limit(t, ["observation", "wtk"])))


def q44_balanced(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus in ('F', 'P')").select("o_orderkey", "o_orderstatus")
    return ordered.balanced(o, "o_orderstatus", "o_orderkey")


def q45_paired_changes(spark: SparkSession, d: str) -> DataFrame:
    """Runs are sets of return flags and line statuses; the metric is their mean price."""
    runs = table(spark, d, "lineitem").withColumn("features", F.array_sort(F.filter(F.array(F.when(F.col("l_quantity") > 25, "big"), F.when(F.col("l_discount") > 0.05, "cheap"), F.when(F.col("l_returnflag") == "A", "old")), lambda x: x.isNotNull())))
    m = runs.groupBy("features").agg(F.avg("l_extendedprice").alias("rmse"))
    return rounded(metrics.paired_changes(m, F.col("features"), "rmse"), 4)


def q49_union_of_tops(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").groupBy("p_brand").agg(F.max("p_retailprice").alias("gain"), F.sum("p_size").alias("total_gain"))
    return rounded(ordered.union_of_tops(t, ["gain", "total_gain"], 5, "p_brand"))


def q54_per_quantile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.metrics_by(long_table(spark, d), ["qnum"], BOTH))


def q55_tail_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.tail_report(long_table(spark, d), 95, BOTH))


def q56_station_flags(spark: SparkSession, d: str) -> DataFrame:
    long = long_table(spark, d).withColumns({"lat": F.lit(40.0), "lon": F.lit(-100.0)})
    m = qc.flagged(qc.station_metrics(long), min_rows=303, max_speed=20.9, z_limit=1.5)
    return rounded(m.select("station_id", "n_q", "obs_max", "obs_q95", "obs_med", "monotonic_violations", "metric", "zscore", "flag_cov", "flag_wsmax", "flag_metric"))


def q57_without_outliers(spark: SparkSession, d: str) -> DataFrame:
    long = long_table(spark, d).withColumns({"lat": F.lit(40.0), "lon": F.lit(-100.0)})
    st = qc.flagged(qc.station_metrics(long), min_rows=0, max_speed=1e9, z_limit=1.0).withColumn("is_outlier", F.col("flag_metric"))
    return qc.without_outliers(long, st).groupBy("station_id").agg(F.count("*").alias("n"))


def q58_bias_trim(spark: SparkSession, d: str) -> DataFrame:
    """Stations whose mean bias is within the trimmed symmetric limit."""
    site = metrics.site_bias(long_table(spark, d), ["era5"])
    m = site.select("station_id", "height_m", F.col("mean_era5").alias("mean_ws"))
    o = site.select("station_id", "height_m", F.col("mean_observation").alias("mean_ws"))
    b = metrics.bias_table(m, o, ["station_id", "height_m"]).withColumn("key", labels.site_height(F.col("station_id"), F.col("height_m")))
    return metrics.trimmed_stations(b, "key", 0.1)


def q59_hybrid(spark: SparkSession, d: str) -> DataFrame:
    t = metrics.hybrid(long_table(spark, d), 95, "era5", "wtk")
    return rounded(metrics.metrics_by(t, ["station_id"], ["pred_hybrid"]))


def q60_top_and_bottom(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.metrics_by(long_table(spark, d), ["station_id"], ["era5"])
    return rounded(ordered.top_and_bottom(m, "rmse", 5, "station_id").select("station_id", "rmse", "end"))


def q61_compared(spark: SparkSession, d: str) -> DataFrame:
    """An experiment that has the gold-standard stations only, against a baseline of all."""
    t = long_table(spark, d)
    base = t.select("station_id", "height_m", "qnum", "observation", F.col("era5").alias("pred_observation"))
    exp = t.where("observation_type = 'GoldStandard'").select("station_id", "height_m", "qnum", F.col("wtk").alias("pred_observation"))
    return rounded(metrics.metrics_by(metrics.compared(base, {"x": exp}, ["station_id", "height_m", "qnum"]), ["station_id"], ["pred_base", "pred_x"]))


QUERIES = {k: f for k, f in globals().items() if k[0] == "q" and k[1:3].isdigit()}

_L = f"with {LONG}"
_ERR = f"{_L}, e as (select station_id, height_m, qnum, typ, 'era5' dataset, era5 - observation error from lng union all select station_id, height_m, qnum, typ, 'wtk', wtk - observation from lng)"
_AGG = f"{r('sqrt(avg(error * error))')} rmse, {r('avg(abs(error))')} mae, {r('avg(error)')} bias, cast(count(error) as bigint) n"
_SITE = f"""{_L}, mn as (select station_id, height_m, any_value(typ) typ, """ + ", ".join(f"sum(case when qnum in (0, 100) then {c} / 2 else {c} end) * 0.01 mean_{c}" for c in ("observation", "era5", "wtk")) + """ from lng group by 1, 2),
bi as (select station_id, height_m, typ, 'era5' dataset, mean_era5 - mean_observation bias, mean_observation o from mn union all select station_id, height_m, typ, 'wtk', mean_wtk - mean_observation, mean_observation from mn)"""
_ST = f"""{_L}, rr as (select *, (era5 + wtk) / 2 ref from lng where typ = 'ASOS'),
st as (select station_id, count(observation) n_q, max(observation) obs_max, quantile_cont(observation, 0.95) obs_q95, median(observation) obs_med, sqrt(avg(pow(observation - ref, 2))) metric from rr group by 1),
dr as (select station_id, count(*) filter (where observation < p) monotonic_violations from (select station_id, observation, lag(observation) over (partition by station_id order by qnum, height_m) p from rr) group by 1),
c as (select median(metric) m from st), md as (select 1.4826 * median(abs(metric - m)) s from st, c), z as (select st.*, (metric - m) / s zscore from st, c, md)"""

ORACLES = {
    "q21_row_metrics": f"{_ERR} select dataset, {_AGG}, 'GS' subset from e where typ = 'GS' group by dataset",
    "q22_summary": f"{_SITE} select dataset, typ subset, {r('median(bias)')} median_bias, {r('avg(abs(bias))')} mean_abs_bias, {r('median(abs(bias))')} median_abs_bias, {r('avg(abs(bias) / o * 100)')} mean_abs_pct_bias, {r('median(abs(bias) / o * 100)')} median_abs_pct_bias, cast(count(*) as bigint) n_sites from bi where o > 0 group by 1, 2",
    "q23_height_bands": f"{_SITE} select dataset, round_even(height_m / 50.0, 0)::double * 50 height_band_m, {r('avg(bias)')} mean_bias, {r('avg(abs(bias))')} mean_abs_bias, {r('median(abs(bias))')} median_abs_bias, {r('avg(abs(bias) / o * 100)')} mean_abs_pct_bias, cast(count(*) as bigint) n_sites, 'GS' subset from bi where typ = 'GS' group by 1, 2",
    "q24_group_differences": f"{_L}, g as (select station_id, height_m, avg(wtk) p, avg(era5) d, avg(observation) o from lng group by 1, 2), f as (select station_id, height_m, abs(p - o) a, abs(d - o) b, abs(p - o) - abs(d - o) diff from g) select station_id, cast(height_m as bigint) height_m, {r('a')} ml_abs_err_mean, {r('b')} ds_abs_err_mean, {r('diff')} diff, cast(row_number() over (order by diff, station_id, height_m) as bigint) as rank, {r('(row_number() over (order by diff, station_id, height_m) - 0.5) / count(*) over ()')} as share, {r('avg((diff < 0)::int) over ()')} share_better from f",
    "q25_robust_z": f"with t as (select l_suppkey, avg(l_extendedprice) metric from lineitem group by 1), c as (select median(metric) m from t), s as (select 1.4826 * median(abs(metric - m)) s from t, c) select l_suppkey, {r('metric')} metric, {r('(metric - m) / s')} zscore from t, c, s order by abs((metric - m) / s) desc, l_suppkey limit 20",
    "q30_ranks_and_shares": f"with t as (select p_brand, sum(cast(l_extendedprice as decimal(18,2)))::double gain from lineitem join part on l_partkey = p_partkey group by 1) select p_brand, {r('gain')} gain, cast(dense_rank() over (order by gain desc) as bigint) as dense, cast(row_number() over (order by gain desc, p_brand) as bigint) as position, {r('gain / sum(gain) over ()')} as share from t",
    "q31_runs": 'with x as (select distinct o_orderkey k from orders where o_orderstatus = \'F\'), g as (select k, k - row_number() over (order by k) i from x) select cast(min(k) as bigint) as "start", cast(max(k) + 1 as bigint) as "end" from g group by i',
    "q39_pooled_and_station": f"""{_ERR}, s as (select dataset, station_id, sum(error * error) s2, sum(abs(error)) s1, count(error) n from e group by 1, 2),
m as (select dataset, sqrt(sum(s2) / sum(n)) pooled_rmse, sum(s1) / sum(n) pooled_mae, avg(sqrt(s2 / n)) station_rmse, avg(s1 / n) station_mae, count(*) n_stations, sum(n) n_rows from s group by 1)
select dataset, {r('pooled_rmse')} pooled_rmse, {r('pooled_mae')} pooled_mae, {r('station_rmse')} station_rmse, {r('station_mae')} station_mae, cast(n_stations as bigint) n_stations, cast(n_rows as bigint) n_rows, {r("(pooled_rmse - (select pooled_rmse from m where dataset = 'era5')) / (select pooled_rmse from m where dataset = 'era5') * 100")} change_pct from m""",
    "q40_intervals": f"select o_orderpriority, {r('avg(o_totalprice)', 4)} mean, {r('avg(o_totalprice) - 1.96 * stddev_samp(o_totalprice) / sqrt(count(*))', 4)} low, {r('avg(o_totalprice) + 1.96 * stddev_samp(o_totalprice) / sqrt(count(*))', 4)} high, cast(count(*) as bigint) n from orders group by 1",
    "q41_bias_quartiles": f"{_ERR} select cast(qnum as bigint) qnum, dataset, {r('quantile_cont(error, 0.25)')} q25, {r('quantile_cont(error, 0.5)')} median, {r('quantile_cont(error, 0.75)')} q75 from e group by 1, 2",
    "q42_limits": f'''{_L}, a as (select observation v from lng union all select era5 from lng), b as (select observation v from lng union all select wtk from lng), q as (select quantile_cont(v, 0.02) lo, quantile_cont(v, 0.98) hi from a) select {r('lo')} low, {r('hi')} high, {r('greatest(abs(lo), abs(hi))')} as "symmetric", {r('(select quantile_cont(v, 0.99) * 1.05 from b)')} x_max from q''',
    "q44_balanced": "with o as (select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by sha1(o_orderkey || '|42'), o_orderkey) k from orders where o_orderstatus in ('F', 'P')) select o_orderkey, o_orderstatus from o where k <= (select min(n) from (select count(*) n from o group by o_orderstatus))",
    "q45_paired_changes": f"""with t as (select list_filter([case when l_quantity > 25 then 'big' end, case when l_discount > 0.05 then 'cheap' end, case when l_returnflag = 'A' then 'old' end], lambda x: x is not null) f, avg(l_extendedprice) m from lineitem group by 1),
u as (select f, m, unnest(f) feature from t) select u.feature, array_to_string(t.f, '+') base, {r('u.m - t.m', 4)} change from u join t on t.f = list_filter(u.f, lambda x: x <> u.feature)""",
    "q49_union_of_tops": f"with t as (select p_brand, max(p_retailprice) gain, sum(p_size) total_gain from part group by 1) select p_brand, {r('gain')} gain, cast(total_gain as bigint) total_gain from t where p_brand in (select p_brand from t order by gain desc, p_brand limit 5) or p_brand in (select p_brand from t order by total_gain desc, p_brand limit 5)",
    "q54_per_quantile": f"{_ERR} select cast(qnum as bigint) qnum, dataset, {_AGG} from e group by 1, 2",
    "q55_tail_report": f"{_ERR}, p as (select *, unnest(['all', case when qnum >= 95 then 'tail' else 'body' end]) part from e) select part, dataset, {_AGG} from p group by 1, 2",
    "q56_station_flags": f"{_ST} select station_id, cast(n_q as bigint) n_q, {r('obs_max')} obs_max, {r('obs_q95')} obs_q95, {r('obs_med')} obs_med, cast(monotonic_violations as bigint) monotonic_violations, {r('metric')} metric, {r('zscore')} zscore, n_q < 303 flag_cov, obs_max > 20.9 flag_wsmax, abs(zscore) > 1.5 flag_metric from z join dr using (station_id)",
    "q57_without_outliers": f"{_ST} select station_id, cast(count(*) as bigint) n from lng where typ <> 'ASOS' or station_id not in (select station_id from z where abs(zscore) > 1) group by 1",
    "q58_bias_trim": f"{_SITE}, q as (select quantile_cont(bias, 0.1) lo, quantile_cont(bias, 0.9) hi from bi where dataset = 'era5') select station_id || '_' || height_m as key from bi, q where dataset = 'era5' and abs(bias) <= greatest(abs(lo), abs(hi))",
    "q59_hybrid": f"{_L}, e as (select station_id, case when qnum >= 95 then wtk else era5 end - observation error from lng) select station_id, 'pred_hybrid' dataset, {_AGG} from e group by 1",
    "q60_top_and_bottom": f"{_ERR}, m as (select station_id, sqrt(avg(error * error)) rmse from e where dataset = 'era5' group by 1) (select station_id, {r('rmse')} rmse, 'low' as \"end\" from m order by m.rmse, station_id limit 5) union all (select station_id, {r('rmse')}, 'high' from m order by m.rmse desc, station_id limit 5)",
    "q61_compared": f"{_L}, e as (select station_id, 'pred_base' dataset, era5 - observation error from lng where typ = 'GS' union all select station_id, 'pred_x', wtk - observation from lng where typ = 'GS') select station_id, dataset, {_AGG} from e group by 1, 2",
}
