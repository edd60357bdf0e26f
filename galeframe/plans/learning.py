"""Training, scoring and experiments. Folds and models aren't SQL; what surrounds them is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions import cdf, labels
from galeframe.operators import experiments, metrics, ml, reshape
from galeframe.plans.base import LONG, long_table, r, rounded

QUICK = {"trees": 8, "depth": 3, "rate": 0.3}


def _training(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours are the stations with the next even number."""
    t = long_table(spark, d).withColumn("observation_type", labels.observation_type(F.col("observation_type")))
    n = F.substring("station_id", 2, 9).cast("int")
    return t.withColumn("neighbors_km_site_ids", F.when(n % 4 == 0, F.concat(F.lit("S"), (n + 2).cast("string"))).otherwise(""))


def q80_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    t = _training(spark, d)
    table, names, signs = ml.features(t, ["era5", "wtk"])
    return ml.leave_one_out(table, names, signs, ml.neighbour_map(t), parameters=QUICK)


def q81_final_model(spark: SparkSession, d: str) -> DataFrame:
    """Rows scored by the final model, made monotone over the quantiles."""
    table, names, signs = ml.features(_training(spark, d), ["era5", "wtk"])
    model = ml.train(table, names, signs, parameters=QUICK)
    return ml.monotone_predictions(ml.predict(table, model, names), ["station_id", "height_m"]).select("station_id", "height_m", "qnum", "pred_observation")


def q82_hybrid_model(spark: SparkSession, d: str) -> DataFrame:
    table, names, signs = ml.features(_training(spark, d), ["era5", "wtk"])
    base, tail = ml.hybrid_models(table, names, signs, names, signs, parameters=QUICK)
    return ml.hybrid_predictions(table, base, tail, names, names).select("station_id", "height_m", "qnum", "pred_observation")


def q83_wide_models(spark: SparkSession, d: str) -> DataFrame:
    """Rows scored by the models of all 101 quantiles, grown side by side."""
    return _wide(spark, d, {"trees": 2, "depth": 2, "rate": 0.5})


def _wide(spark: SparkSession, d: str, parameters: dict) -> DataFrame:
    a = reshape.to_arrays(long_table(spark, d), ["station_id", "height_m"], ["observation", "era5", "wtk"])
    models = ml.wide_models(a, ["era5", "wtk"], [], "observation", ml.quantile_numbers(), parameters)
    return ml.wide_predictions(a.drop("observation"), models, ["era5", "wtk"], [], ml.quantile_numbers(), ["station_id", "height_m"])


def q84_network(spark: SparkSession, d: str) -> DataFrame:
    table, names, _ = ml.features(_training(spark, d), ["era5", "wtk"])
    return ml.network_predictions(table, ml.network(table, names, hidden=(8,), epochs=40, rate=0.05), names).select("station_id", "height_m", "qnum", "pred_observation")


def q85_neighbour_map(spark: SparkSession, d: str) -> DataFrame:
    return ml.neighbour_map(_training(spark, d))


def q86_folds(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the folds' training and test sets."""
    t = _training(spark, d)
    ex = ml.neighbour_map(t)
    f = ml.folds(t, ex)
    return f.groupBy("fold", "role").agg(F.count("*").alias("n"))


def q87_training_counts(spark: SparkSession, d: str) -> DataFrame:
    return ml.training_counts(_training(spark, d).withColumn("era5", F.when(F.col("qnum") != 50, F.col("era5"))), ["era5", "wtk"])


def q88_standardised(spark: SparkSession, d: str) -> DataFrame:
    t = _training(spark, d).withColumn("wtk", F.when(F.col("qnum") != 50, F.col("wtk")))
    return rounded(ml.standardised(t, ["era5", "wtk"]).select("station_id", "height_m", "qnum", "era5", "wtk"))


def q89_experiment_change(spark: SparkSession, d: str) -> DataFrame:
    t = _training(spark, d)
    return rounded(metrics.change(metrics.pooled_and_mean(t, "station_id", ["era5", "wtk"]), "era5", "station_rmse").select("dataset", "station_rmse", "change_pct"))


def q90_experiments(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid, wide, perceptron and convolution runs against the baseline, all in their full settings."""
    t = _training(spark, d)
    ex = ml.neighbour_map(t)
    names = ("baseline", "hybrid", "wide", "network", "convolution")
    runs = {k: experiments.run(k, t, ["era5", "wtk"], ex, experiments.FULL[experiments.EXPERIMENTS[k].method]) for k in names}
    return experiments.report(runs, "baseline")


def _winds(spark: SparkSession, d: str) -> DataFrame:
    """Five wind columns, three of them with gaps: a set of features decides which rows train and which are scored."""
    t, n = _training(spark, d), F.substring("station_id", 2, 9).cast("int")
    return t.withColumns({"hrrr": F.when(F.col("qnum") % 3 != 0, F.col("era5") + 1), "nora": F.when(n % 3 != 0, F.col("wtk")), "cerra": F.when(F.col("height_m") != 60, F.col("era5") + F.col("wtk"))})


def q128_sweep_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the median of each fold's training rows for all 31 subsets of five wind columns."""
    t = _winds(spark, d)
    return rounded(ml.sweep(t, ml.feature_subsets(["era5", "wtk", "hrrr", "nora", "cerra"]), [], ml.neighbour_map(t), parameters={"trees": 0}, balance=None))


def q91_sweep_report(spark: SparkSession, d: str) -> DataFrame:
    """Changes by feature over the manifest of q128_sweep_manifest."""
    runs = q128_sweep_manifest(spark, d).withColumn("subset", F.from_json("features", "array<string>"))
    return rounded(experiments.sweep_report(runs, "subset"))


def q92_fold_rows(spark: SparkSession, d: str) -> DataFrame:
    """What is determinate of q80_leave_one_out: each gold-standard row is predicted once, by a model without its station."""
    got = q80_leave_one_out(spark, d)
    return rounded(got.select("station_id", F.col("height_m").cast("int").alias("height_m"), "qnum", "observed", F.col("predicted").isNotNull().alias("predicted")))


def _shape(scored: DataFrame) -> DataFrame:
    """Rows, and drops over the quantiles, of each station and height."""
    g = scored.groupBy("station_id", "height_m").agg(F.count("pred_observation").alias("n"), cdf.collected(F.col("qnum"), F.col("pred_observation")).alias("p"))
    return g.select("station_id", "height_m", "n", cdf.count_drops(F.col("p.v")).alias("drops"))


def q93_final_model_shape(spark: SparkSession, d: str) -> DataFrame:
    """What is determinate of q81_final_model: a prediction for each row, never falling over the quantiles."""
    return rounded(_shape(q81_final_model(spark, d)))


def q94_network_rows(spark: SparkSession, d: str) -> DataFrame:
    """What is determinate of q84_network: a prediction for each row."""
    return rounded(_shape(q84_network(spark, d)).drop("drops"))


def q95_hybrid_rows(spark: SparkSession, d: str) -> DataFrame:
    """What is determinate of q82_hybrid_model: a prediction for each row, positive in the tail."""
    got = q82_hybrid_model(spark, d)
    return rounded(got.groupBy("station_id", "height_m").agg(F.count("pred_observation").alias("n"), F.count(F.when((F.col("qnum") >= 95) & (F.col("pred_observation") > 0), 1)).alias("positive_tail")))


def q96_wide_medians(spark: SparkSession, d: str) -> DataFrame:
    """Models of no tree: for each quantile the lower median of the observations, and then the running maximum."""
    return rounded(_wide(spark, d, {"trees": 0}))


def q133_convolution_property(spark: SparkSession, d: str) -> DataFrame:
    """Convolution folds: predictions of each profile, how many fall over the quantiles, and how many are below zero."""
    t = _training(spark, d)
    got = experiments.run("convolution", t, ["era5", "wtk"], ml.neighbour_map(t), {"epochs": 15})
    p = got.groupBy("station_id", "height_m").agg(F.count("predicted").alias("n"), F.min("predicted").alias("low"), cdf.collected(F.col("qnum"), F.col("predicted")).alias("p"))
    return rounded(p.select("station_id", F.col("height_m").cast("int").alias("height_m"), "n", cdf.count_drops(F.col("p.v")).alias("drops"), (F.col("low") < 0).alias("below_zero")))


def q97_fold_medians(spark: SparkSession, d: str) -> DataFrame:
    """Folds of no tree: the lower median of the balanced training rows of each fold."""
    t = _training(spark, d)
    table, names, signs = ml.features(t, ["era5", "wtk"])
    return rounded(ml.leave_one_out(table, names, signs, ml.neighbour_map(t), parameters={"trees": 0}).select("station_id", F.col("height_m").cast("int").alias("height_m"), "qnum", "predicted"))


def q98_stump(spark: SparkSession, d: str) -> DataFrame:
    """One tree of depth 1, absolute loss: the split with the largest gain, and the lower medians of the errors on both sides."""
    table, names, signs = ml.features(_training(spark, d), ["era5", "wtk"])
    model = ml.train(table, names, signs, balance=None, parameters={"trees": 1, "depth": 1, "rate": 1.0})
    return rounded(ml.predict(table, model, names).select("station_id", "height_m", "qnum", "pred_observation"))


QUERIES = {k: f for k, f in globals().items() if k[0] == "q" and k[1:3].isdigit()}

_T = f"with {LONG}, t as (select *, cast(substr(station_id, 2) as int) n from lng), ex as (select distinct station_id fold, station_id from t where typ = 'GS' union select distinct station_id, 'S' || (n + 2) from t where typ = 'GS' and n % 4 = 0)"

_SWEEP = """v as (select *, (era5 is not null)::int + 2 * (wtk is not null)::int + 4 * (era5 is not null and qnum % 3 <> 0)::int + 8 * (wtk is not null and n % 3 <> 0)::int + 16 * (era5 is not null and wtk is not null and height_m <> 60)::int vm from t),
sets as (select unnest(range(1, 32)) m), med as (select m, fold, quantile_disc(observation, 0.5) p from v, sets, (select distinct fold from ex) f where observation is not null and vm & m = m and not exists (select 1 from ex where ex.fold = f.fold and ex.station_id = v.station_id) group by m, fold having count(*) >= 20),
err as (select m, p - observation e from v join med on fold = station_id where typ = 'GS' and vm & m = m),
named as (select m, list_filter([case when m & 1 > 0 then 'era5' end, case when m & 2 > 0 then 'wtk' end, case when m & 4 > 0 then 'hrrr' end, case when m & 8 > 0 then 'nora' end, case when m & 16 > 0 then 'cerra' end], lambda z: z is not null) l from sets),
manifest as (select m, array_to_string(l, '+') label, '["' || array_to_string(l, '", "') || '"]' features, sqrt(avg(e * e)) rmse, avg(abs(e)) mae, count(e)::bigint n from named join err using (m) group by m, l)"""

ORACLES = {
    "q92_fold_rows": f"{_T} select station_id, height_m::bigint height_m, qnum::bigint qnum, {r('observation')} observed, true predicted from t where typ = 'GS'",
    "q93_final_model_shape": f"{_T} select station_id, height_m::bigint height_m, count(*)::bigint n, 0::bigint drops from t group by 1, 2",
    "q94_network_rows": f"{_T} select station_id, height_m::bigint height_m, count(*)::bigint n from t group by 1, 2",
    "q95_hybrid_rows": f"{_T} select station_id, height_m::bigint height_m, count(*)::bigint n, count(*) filter (where qnum >= 95)::bigint positive_tail from t group by 1, 2",
    "q96_wide_medians": f"{_T}, m as (select qnum, quantile_disc(observation, 0.5) p from t where observation is not null group by qnum) select station_id, height_m::bigint height_m, qnum::bigint qnum, {r('max(p) over (partition by station_id, height_m order by qnum)')} pred_observation from t join m using (qnum)",
    "q133_convolution_property": f"{_T} select station_id, height_m::bigint height_m, count(*)::bigint n, 0::bigint drops, false below_zero from t where typ = 'GS' group by 1, 2",
    "q97_fold_medians": f"""{_T}, p as (select distinct f.fold, t.station_id, t.height_m, typ from t, (select distinct fold from ex) f where observation is not null and era5 is not null and wtk is not null and not exists (select 1 from ex where ex.fold = f.fold and ex.station_id = t.station_id)),
q as (select *, row_number() over (partition by fold, typ order by sha1(concat(cast('0x' || substr(sha1(fold || '42'), 1, 8) as bigint), '|', station_id, '|', height_m))) k, count(*) filter (where typ <> 'GS') over (partition by fold) a, count(*) filter (where typ = 'GS') over (partition by fold) g from p),
c as (select * from q where k <= case when typ = 'GS' then (case when a = 0 then g else a end) else (case when g = 0 then a else g end) end),
m as (select fold, quantile_disc(observation, 0.5) predicted from c join t using (station_id, height_m) where observation is not null and era5 is not null and wtk is not null group by fold having count(*) >= 20)
select station_id, height_m::bigint height_m, qnum::bigint qnum, case when era5 is not null and wtk is not null then {r('predicted')} end predicted from t left join m on fold = station_id where typ = 'GS'""",
    "q98_stump": f"""{_T}, u as (select * from t where observation is not null and era5 is not null and wtk is not null), b as (select quantile_disc(observation, 0.5) base, count(*) n from u),
x as (select observation - base e, sign(base - observation) g, unnest([1, 2, 3]) f, unnest([era5, wtk, qnum]) v from u, b),
o as (select f, v, row_number() over (partition by f order by v) k, n from x, b), cuts as (select distinct f, v c from o join range(1, 64) z(i) on k = greatest(1, ceil(i * n / 64.0))),
s as (select f, c, sum(g) filter (where v <= c) gl, count(*) filter (where v <= c) nl, sum(g) gt, count(*) nt from cuts join x using (f) group by f, c),
w as (select *, -gl / (nl + 1) wl, -(gt - gl) / (nt - nl + 1) wr, -gt / (nt + 1) wt from s),
z as (select *, -(gl * wl + 0.5 * (nl + 1) * wl * wl) - ((gt - gl) * wr + 0.5 * (nt - nl + 1) * wr * wr) + (gt * wt + 0.5 * (nt + 1) * wt * wt) gain from w where nl >= 5 and nt - nl >= 5 and wr >= wl),
best as (select f, c from z order by gain desc, f, c limit 1), d as (select quantile_disc(e, 0.5) filter (where v <= c) l, quantile_disc(e, 0.5) filter (where v > c) h from x join best using (f))
select station_id, height_m::bigint height_m, qnum::bigint qnum, {r('base + case when [era5, wtk, qnum][f] <= c then least(l, (l + h) / 2) else greatest(h, (l + h) / 2) end')} pred_observation from t, b, best, d""",
    "q128_sweep_manifest": f"{_T}, {_SWEEP} select label, features, {r('rmse')} rmse, {r('mae')} mae, n from manifest",
    "q91_sweep_report": f"{_T}, {_SWEEP}, b as (select unnest([1, 2, 4, 8, 16]) b, unnest(['era5', 'wtk', 'hrrr', 'nora', 'cerra']) feature), p as (select feature, y.rmse - x.rmse c from manifest x, manifest y, b where x.m & b = 0 and y.m = x.m + b) select feature, {r('avg(c)')} mean, {r('avg(c) - 1.96 * stddev_samp(c) / sqrt(count(*))')} low, {r('avg(c) + 1.96 * stddev_samp(c) / sqrt(count(*))')} high, cast(count(*) as bigint) n from p group by 1",
    "q85_neighbour_map": f"{_T} select fold, station_id from ex",
    "q86_folds": f"{_T} select fold, 'train' as role, cast(count(*) as bigint) as n from t, (select distinct fold from ex) f where not exists (select 1 from ex where ex.fold = f.fold and ex.station_id = t.station_id) group by 1 union all select station_id, 'test', cast(count(*) as bigint) from t where typ = 'GS' group by 1",
    "q87_training_counts": f"{_T} select cast(count(*) as bigint) total, cast(count(observation) as bigint) with_target, cast(count(*) filter (where qnum <> 50) as bigint) with_features, cast(count(*) filter (where qnum <> 50 and typ = 'GS') as bigint) gs, cast(count(*) filter (where qnum <> 50 and typ <> 'GS') as bigint) asos from t",
    "q88_standardised": f"{_T} select station_id, cast(height_m as bigint) height_m, cast(qnum as bigint) qnum, {r('(era5 - (select avg(era5) from t)) / (select stddev_pop(era5) from t)')} era5, {r('coalesce((case when qnum <> 50 then wtk end - (select avg(wtk) from t where qnum <> 50)) / (select stddev_pop(wtk) from t where qnum <> 50), 0)')} wtk from t",
    "q89_experiment_change": f"{_T}, e as (select station_id, 'era5' dataset, era5 - observation e from t union all select station_id, 'wtk', wtk - observation from t), s as (select dataset, station_id, sqrt(avg(e * e)) x from e group by 1, 2), m as (select dataset, avg(x) x from s group by 1) select dataset, {r('x')} station_rmse, {r("(x - (select x from m where dataset = 'era5')) / (select x from m where dataset = 'era5') * 100")} change_pct from m",
}
