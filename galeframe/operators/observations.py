"""From speed samples to quantile tables: cleaning, completeness rules, quantiles, year-to-year variation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galeframe.functions import cdf, labels, wind
from galeframe.operators.ordered import ranked
from galeframe.operators.schema import aliased


def normalised(df: DataFrame) -> DataFrame:
    """site_id, height, datetime (UTC), ws_observed, lat, lon, name, elev_m and windsite_type; rows without key, place or time go, negative speeds become NULL."""
    d = aliased(df, ["station_id", "height_m", "datetime", "ws_observed", "lat", "lon"], ["name", "elev_m", "windsite_type"])
    t = F.col("datetime")
    stamp = {"timestamp": t, "timestamp_ntz": F.convert_timezone(F.lit("UTC"), F.lit("UTC"), t).cast("timestamp")}.get(d.schema["datetime"].dataType.simpleString(), F.try_to_timestamp(t.cast("string")))
    d = d.select(F.col("station_id").cast("string").alias("site_id"), cdf.number(F.col("height_m")).alias("height"), stamp.alias("datetime"), cdf.number(F.col("ws_observed")).alias("ws_observed"), cdf.number(F.col("lat")).alias("lat"), cdf.number(F.col("lon")).alias("lon"), F.col("name").cast("string").alias("name"), cdf.number(F.col("elev_m")).alias("elev_m"), F.col("windsite_type").cast("string").alias("windsite_type"))
    d = d.withColumn("name", F.coalesce("name", labels.site_height(F.col("site_id"), F.col("height"))))
    return d.dropna(subset=["site_id", "height", "lat", "lon", "datetime"]).withColumn("ws_observed", F.when(F.col("ws_observed") >= 0, F.col("ws_observed")))


def month_balance(samples: DataFrame, start_year: int = 2007, end_year: int = 2024, min_months: int = 12, min_share: float = 0.5, keys: tuple = ("site_id", "height"), time: str = "datetime") -> DataFrame:
    """A row for each site and year: samples of each month, and whether the year is kept and why not. One shuffle on the key."""
    at = F.col(time)
    months = [F.count(F.when(F.month(at) == m, 1)).alias(f"m{m:02d}") for m in range(1, 13)]
    kind = [F.mode("windsite_type", True).alias("windsite_type")] if "windsite_type" in samples.columns else []
    d = samples.withColumn("year", F.year(at)).where(F.col("year").between(start_year, end_year)).groupBy(*keys, "year").agg(*months, F.count("*").alias("total_count"), *kind)
    m = F.array(*[F.col(f"m{i:02d}") for i in range(1, 13)])
    busy = F.array_sort(F.filter(m, lambda x: x > 0))
    n = F.size(busy)
    d = d.withColumn("_m", m).withColumn("_b", busy).withColumn("months_present", n)
    d = d.withColumn("median_nonzero", (F.get("_b", F.floor((F.col("months_present") - 1) / 2).cast("int")) + F.get("_b", F.floor(F.col("months_present") / 2).cast("int"))) / 2.0)
    d = d.withColumn("threshold", F.col("median_nonzero") * min_share).withColumn("months_ge_threshold", F.size(F.filter("_m", lambda x: x >= F.col("threshold"))))
    d = d.withColumn("kept", (F.col("months_present") >= min_months) & (F.col("months_ge_threshold") >= min_months))
    reason = F.when(F.col("kept"), "ok").when(F.col("months_present") < min_months, "insufficient_months_present").otherwise("insufficient_months_ge_threshold")
    return d.withColumn("reason", reason).drop("_m", "_b")


def kept_samples(samples: DataFrame, balance: DataFrame, keys: tuple = ("site_id", "height"), time: str = "datetime") -> DataFrame:
    """Samples of the kept years."""
    years = balance.where("kept").select(*keys, F.col("year").alias("_year"))
    return samples.withColumn("_year", F.year(time)).join(years, [*keys, "_year"], "left_semi").drop("_year")


def site_table(samples: DataFrame, keys: tuple = ("site_id", "height"), time: str = "datetime", value: str = "ws_observed") -> DataFrame:
    """Metadata and 101 quantiles of each site and height, in one aggregation."""
    q = samples.groupBy(*keys).agg(
        F.min_by("name", time).alias("name"), *[F.median(c).alias(c) for c in ("lat", "lon", "elev_m")], F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.count("*").alias("n"),
        F.array_join(F.array_sort(F.collect_set(F.year(time).cast("string"))), ",").alias("years"), cdf.quantile_rows(F.col(value)).alias("quantiles"),
    )
    return q


def expected_per_day(samples: DataFrame, keys: list[str], time: str) -> DataFrame:
    """per_day: the most frequent number of samples a day, the smallest of equals."""
    days = samples.groupBy(*keys, F.to_date(time).alias("_day")).agg(F.count("*").alias("_n"))
    freq = days.groupBy(*keys, "_n").agg(F.count("*").alias("_f"))
    return freq.groupBy(*keys).agg(F.max_by("_n", F.struct("_f", F.negate("_n"))).alias("per_day"))


def complete_years(samples: DataFrame, keys: list[str], time: str, share: float = 0.95) -> DataFrame:
    """Years with at least the share of the expected samples."""
    years = samples.groupBy(*keys, F.year(time).alias("year")).agg(F.count("*").alias("n"))
    joined = years.join(expected_per_day(samples, keys, time), keys) if keys else years.crossJoin(F.broadcast(expected_per_day(samples, keys, time)))
    return joined.where(wind.is_complete_year(F.col("n"), F.col("per_day"), F.col("year"), share))


def station_quantiles(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, quantile 0..100, wind_speed_m_s)"""
    block = samples.groupBy(*keys).agg(cdf.quantile_rows(F.col(value)).alias("_q"))
    return block.select(*keys, F.posexplode("_q").alias("quantile", "wind_speed_m_s"))


def station_reports(reports: DataFrame, station: str = "station_id", time: str = "DATE", packed: str = "WND", seed: int = 0) -> DataFrame:
    """Raw hourly reports -> station, time and a speed spread over its reported knot."""
    d = reports.select(F.col(station).alias("station_id"), F.col(time).alias("time"), wind.packed_speed(F.col(packed)).alias("reported"))
    return d.withColumn("speed", wind.dequantized(F.col("reported"), F.col("station_id"), F.col("time"), seed=seed))


def interannual(samples: DataFrame, site: str, value: str, time: str, min_years: int = 3, share: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(per site: years, least, largest and range of the normalised means; per site and year: samples, mean and normalised mean).

    A year counts if it has the share of the site's median yearly samples, a site if it has enough such years.
    """
    years = samples.where(F.col(site).isNotNull() & cdf.finite(F.col(value)).isNotNull() & F.col(time).isNotNull()).groupBy(site, F.year(time).alias("year")).agg(F.count("*").alias("n_samples"), F.avg(value).alias("mean_ws"))
    w = Window.partitionBy(site)
    kept = years.withColumn("_m", F.median("n_samples").over(w)).where(F.col("n_samples") >= share * F.col("_m"))
    kept = kept.withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= min_years).withColumn("site_median_mean", F.median("mean_ws").over(w)).where("site_median_mean > 0")
    per_year = kept.withColumn("norm_mean", F.col("mean_ws") / F.col("site_median_mean")).select(site, "year", "n_samples", "mean_ws", "site_median_mean", "norm_mean")
    per_site = per_year.groupBy(site).agg(F.count("*").alias("n_years"), F.min("norm_mean").alias("min_norm"), F.max("norm_mean").alias("max_norm"), (F.max("norm_mean") - F.min("norm_mean")).alias("range_norm"))
    return per_site, per_year


def panel_stats(per_year: DataFrame, site: str, value: str) -> DataFrame:
    """Five numbers of each site, and its index in order of the median, largest first."""
    q = per_year.groupBy(site).agg(F.percentile(value, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("_q"), F.countDistinct("year").alias("n_years"))
    q = q.select(site, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))], "n_years")
    return ranked(q, "median", site, descending=True, name="site_index")


def range_histogram(per_site: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Sites in each of the equal-width bins between low and high; the upper edge belongs to the last bin."""
    b = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return per_site.where(F.col(value).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
