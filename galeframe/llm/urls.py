"""Operator 5, URL filters: listed rules first, then association rules over URL tokens, with DataFrame operations only.

Labelled URLs are sets of items (their host, host labels and path words). Spark's FP-growth mines the combinations that
are frequent among the bad URLs; with their number among all labelled URLs this gives the confidence of `items -> bad`.
A rule stays if it has the least support and confidence, if its bad URLs can't be chance (below), and if no shorter rule
among its subsets has as much confidence. URLs are matched through an inverted index: a rule is listed under its rarest
token and checked in full only for URLs that have this token.

Frequent combinations are exponentially many in what occurs together, so two things are decided before they are mined,
with the same result. Items of exactly the same labelled URLs are one token: a combination with two of them says no more
than with one, and a rule fits where it finds any item of each of its tokens. Tokens of bad URLs only are rules by
themselves, and no longer rule with them can be surer, so they take no part in FP-growth.

Chance: if a share p of labelled URLs is bad, then n URLs hold b bad ones or more by chance with a probability of at most
exp(-n KL(b/n || p)). A rule must have n KL(b/n || p) >= ln(m / alpha), m being the number of combinations looked at, so
that labels that don't depend on the URL yield any rule at all with a probability of alpha at most.

Defined results: a null url, or one without ://, has empty host and path; rows are judged one by one, repeated rows too;
several labels of one id are averaged; without labels, or without bad ones, there are no mined rules and all is allowed.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.llm.store import Work

#: (verdict, host, path) of the listed rules.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null. A rule fits its host, all subdomains, and all paths that start with its own."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def items_of(host: Column, path: Column) -> Column:
    """Distinct items of a URL; numbers are left out."""
    words = lambda x, kind: F.transform(F.filter(F.split(x, r"[^\p{L}\p{N}-]+"), lambda w: (w != "") & ~w.rlike("^[0-9]+$")), lambda w: F.concat(F.lit(kind), w))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("host="), host)), words(host, "name="), words(F.lower(path), "path=")))


def document_of(url: Column) -> Column:
    """The number of the document that a URL shows: that of its path's second part, as in /en/7817.html; else null."""
    return F.regexp_extract(path_of(url), "^/[a-z]+/([0-9]{1,18})(?:[^0-9]|$)", 1).try_cast("bigint")


@dataclass
class Mined:
    """rules (rule, confidence, n, key), a rule being an array of tokens and key its rarest; and tokens (item, token)."""

    rules: DataFrame
    tokens: DataFrame


def mine(pages: DataFrame, labels: DataFrame, page_key: Column, min_confidence: float = 0.5, min_support: float = 0.0005, least: int = 5, alpha: float | None = 0.05, url_col: str = "url", label_id: str = "doc_id") -> Mined:
    """Rules mined from the pages whose page_key has a label. A rule has at least `least` bad URLs, and the share min_support of all labelled ones; alpha=None: no test against chance."""
    spark, work = pages.sparkSession, Work(pages.sparkSession)
    bad = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_label")).agg(((F.coalesce(F.avg("quality"), F.lit(1.0)) < 0.5) | (F.coalesce(F.avg("toxic"), F.lit(0.0)) >= 0.5)).alias("bad"))
    seen = pages.select(page_key.alias("_page"), items_of(host_of(F.col(url_col)), path_of(F.col(url_col))).alias("items")).join(bad, F.col("_page") == F.col("_label"))
    seen = work.write(seen.select("items", "bad").withColumn("row", F.monotonically_increasing_id()))
    total, n_bad = seen.agg(F.count("*"), F.sum(F.col("bad").cast("long"))).first()
    need = max(least, math.ceil(min_support * total))
    none = Mined(spark.createDataFrame([], "rule array<string>, confidence double, n long, key string"), spark.createDataFrame([], "item string, token string"))
    if (n_bad or 0) < need:
        return none
    # Tokens: items of the same rows, told apart by their numbers and two hashes of the rows.
    rows = seen.select("row", "bad", F.explode("items").alias("item"))
    cover = rows.groupBy("item").agg(F.sum(F.col("bad").cast("long")).alias("b"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("y")).where(F.col("b") >= need)
    alike = cover.groupBy("b", "n", "x", "y").agg(F.min("item").alias("token"))
    tokens = work.write(cover.join(alike, ["b", "n", "x", "y"]).select("item", "token", "b", "n"))
    single = tokens.where("item = token").select(F.array("token").alias("rule"), "b", "n")
    mixed = tokens.where("b < n").select("item", "token")
    kept = rows.join(mixed, "item").groupBy("row", "bad").agg(F.array_sort(F.collect_set("token")).alias("items"))
    baskets = work.write(kept.groupBy("items").agg(F.sum(F.col("bad").cast("long")).alias("b"), F.count("*").alias("n")))
    bad_baskets = kept.where("bad").select("items")
    count = bad_baskets.count()
    sets = single.where("b = n")
    if count:
        frequent = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / count, minConfidence=1.0).fit(bad_baskets).freqItemsets
        frequent = work.write(frequent.select(F.array_sort("items").alias("rule"), F.col("freq").alias("b")))
        sets = sets.unionByName(frequent.join(_counted(frequent, baskets, single), "rule"))
    sets = work.write(sets)
    looked_at, share = sets.count(), n_bad / total
    sure = F.col("b") / F.col("n")
    valid = (F.col("b") >= need) & (sure >= min_confidence)
    if alpha is not None:
        rest = F.when(F.col("b") < F.col("n"), (1 - sure) * F.log((1 - sure) / F.lit(max(1 - share, 1e-12)))).otherwise(0.0)
        valid = valid & (sure > share) & (F.col("n") * (sure * F.log(sure / F.lit(share)) + rest) >= math.log(max(1, looked_at) / alpha))
    rules = _surest(sets.select("rule", "n", "b", sure.alias("confidence"), valid.alias("valid")), work)
    rare = rules.withColumn("token", F.explode("rule")).join(tokens.where("item = token").select("token", F.col("n").alias("f")), "token")
    rare = rare.groupBy("rule", "confidence", "b").agg(F.min_by("token", F.struct("f", "token")).alias("key"))
    rules = work.write(rare.select("rule", "confidence", F.col("b").alias("n"), "key"))
    used = rules.select(F.explode("rule").alias("token")).distinct()
    return Mined(rules, work.write(tokens.select("item", "token").join(used, "token", "left_semi").select("item", "token")))


def _counted(sets: DataFrame, baskets: DataFrame, single: DataFrame) -> DataFrame:
    """rule and n, the labelled rows that hold all tokens of each set: sets are listed under their rarest token, and a basket looks up its tokens."""
    often = single.select(F.element_at("rule", 1).alias("token"), F.col("n").alias("f"))
    keyed = sets.withColumn("token", F.explode("rule")).join(often, "token").groupBy("rule").agg(F.min_by("token", F.struct("f", "token")).alias("key"))
    asked = baskets.select("items", F.col("n").alias("times"), F.explode("items").alias("key"))
    hits = asked.join(keyed, "key").where(F.size(F.array_except("rule", "items")) == 0)
    return hits.groupBy("rule").agg(F.sum("times").alias("n"))


def _surest(sets: DataFrame, work: Work) -> DataFrame:
    """Valid rules that are surer than every valid rule of some of their tokens. Level by level: a set is looked up under each of its subsets that lack one token, which carry the best of theirs."""
    sets = work.write(sets.withColumn("size", F.size("rule")))
    top = sets.agg(F.max("size")).first()[0] or 0
    best = F.when(F.col("valid"), F.col("confidence")).otherwise(0.0)
    below, kept = sets.where("size = 1").select("rule", best.alias("best")), sets.where("size = 1 and valid")
    kept = kept.select("rule", "confidence", "b")
    for size in range(2, top + 1):
        level = sets.where(F.col("size") == size)
        parts = level.select("rule", F.explode(F.expr("transform(rule, x -> array_remove(rule, x))")).alias("part"))
        under = parts.join(below.select(F.col("rule").alias("part"), "best"), "part", "left").groupBy("rule").agg(F.coalesce(F.max("best"), F.lit(0.0)).alias("under"))
        level = work.write(level.join(under, "rule"))
        kept = kept.unionByName(level.where("valid and confidence > under").select("rule", "confidence", "b"))
        below = level.select("rule", F.greatest(best, F.col("under")).alias("best"))
    return kept


def judge(pages: DataFrame, mined: Mined, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, and mined_rule (the surest mined rule that blocks, where no listed rule fits), a row for each row of pages."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("_listed", listed(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("_items", F.when(F.col("_listed").isNull(), items_of(F.col("host"), F.col("path"))))
    # URLs with the same items share one lookup, so a common host is one row here.
    asked = rows.where("_items is not null").select("_items").distinct()
    told = asked.withColumn("item", F.explode("_items")).join(mined.tokens, "item").groupBy("_items").agg(F.collect_set("token").alias("_tokens"))
    hits = told.withColumn("key", F.explode("_tokens")).join(mined.rules, "key").where(F.size(F.array_except("rule", "_tokens")) == 0)
    fits = hits.groupBy("_items").agg(F.max_by("rule", F.struct("confidence", "n", "rule")).alias("mined_rule"))
    # Written, so that the join deals both sides anew and can split the rows of a common host over tasks.
    out = rows.join(Work(pages.sparkSession).write(fits), "_items", "left")
    verdict = F.coalesce("_listed.verdict", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow"))
    return out.select(id_col, "host", "path", F.col("_listed.rule").alias("rule"), verdict.alias("verdict"), F.array_join("mined_rule", " ").alias("mined_rule"))
