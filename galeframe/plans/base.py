"""The tables that queries share, as DataFrames and as SQL.

No wind data is at hand, so the test tables stand in: a station is a supplier group, a speed a scaled price, a dataset a
return flag, a place arithmetic on a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.operators.assemble import cohort_long
from galeframe.operators.cut import Scratch
from galeframe.operators.quantiles import blocks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Probabilities 0, 0.01, ... 1 as an SQL list.
P101 = "[" + ",".join(f"{i / 100:.2f}" for i in range(101)) + "]"
DATASETS = {"N": "observation", "A": "era5", "R": "wtk"}


def station() -> Column:
    return F.concat(F.lit("S"), (F.col("l_suppkey") % 25).cast("string"))


def height() -> Column:
    return F.when(F.col("l_linenumber") % 3 == 0, 40).when(F.col("l_linenumber") % 3 == 1, 60).otherwise(100)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station_id, height_m, dataset and speed"""
    return table(spark, sf_dir, "lineitem").select(station().alias("station_id"), height().alias("height_m"), F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") / 4997.3).alias("speed"))


def long_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station_id, height_m, qnum, observation, era5, wtk, observation_type: the cohort of the stations with all keys of era5.

    The quantiles of the samples are written, as a few rows for each station; what reads the cohort several times doesn't
    read the samples again.
    """
    work = Scratch(spark)
    block = work.write(blocks(samples(spark, sf_dir), ["station_id", "height_m", "flag"], "speed", "a"))
    rows = block.select("station_id", "height_m", "flag", F.posexplode("a").alias("qnum", "value"))
    one = {name: rows.where(F.col("flag") == flag) for flag, name in DATASETS.items()}
    out = work.write(cohort_long(one["era5"].select("station_id", "height_m", "qnum"), one))
    work.drop(block)
    return out.withColumn("observation_type", F.when(F.substring("station_id", 2, 9).cast("int") % 2 == 0, "GoldStandard").otherwise("asos"))


SAMPLES = "smp as (select 'S' || (l_suppkey % 25) station_id, case l_linenumber % 3 when 0 then 40 when 1 then 60 else 100 end height_m, l_returnflag flag, l_extendedprice / 4997.3 speed from lineitem)"
LONG = f"""{SAMPLES},
blk as (select station_id, height_m, flag, quantile_cont(speed, {P101}) a from smp group by all),
uq as (select station_id, height_m, flag, unnest(a) v, generate_subscripts(a, 1) - 1 qnum from blk),
lng as (select station_id, height_m, qnum, max(case when flag = 'N' then v end) observation, max(case when flag = 'A' then v end) era5, max(case when flag = 'R' then v end) wtk,
  case when cast(substr(station_id, 2) as int) % 2 = 0 then 'GS' else 'ASOS' end typ from uq group by station_id, height_m, qnum having count(case when flag = 'A' then 1 end) > 0)"""



def places(df: DataFrame, key: str) -> DataFrame:
    """Places of suppliers and customers."""
    k = F.col(key)
    return df.select(k.alias("id"), (25 + (k * 37 % 2300) / 100.0).alias("lat"), (-120 + (k * 53 % 5000) / 100.0).alias("lon"))


SITES = "sites as (select s_suppkey id, 25 + (s_suppkey * 37 % 2300) / 100.0::double lat, -120 + (s_suppkey * 53 % 5000) / 100.0::double lon from supplier)"
POINTS = "points as (select c_custkey id, 25 + (c_custkey * 37 % 2300) / 100.0::double lat, -120 + (c_custkey * 53 % 5000) / 100.0::double lon from customer)"
KM = "2 * 6371.0088 * asin(sqrt(least(1, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded half to even and counts as bigint, to compare with another engine."""
    kinds = dict(df.dtypes)
    return df.select(*[F.bround(F.col(c).cast("double"), digits).alias(c) if kinds[c] in ("double", "float") else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "smallint", "tinyint") else F.col(c) for c in df.columns])


def r(sql: str, digits: int = 6) -> str:
    return f"round_even(cast({sql} as double), {digits})"
