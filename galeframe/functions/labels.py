"""Names, codes and keys: canonical labels, padded indices, seeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the gold-standard cohort.
GOLD = ["gs", "goldstandard", "gold standard", "gold_standard", "gold-standard"]


def observation_type(c: Column) -> Column:
    """GS, ASOS, or the trimmed text; NULL gives ''."""
    t = F.trim(c)
    low = F.lower(t)
    return F.coalesce(F.when(low.isin(GOLD), "GS").when(low == "asos", "ASOS").otherwise(t), F.lit(""))


def dataset(c: Column) -> Column:
    """Canonical model name; the order of the tests matters."""
    t = F.lower(F.trim(c))
    return F.when(t.contains("wtk-led") | t.contains("wtk_led"), "wtk_led_conus").when(t.contains("hrrr"), "hrrr").when(t.contains("wtk"), "wtk").otherwise(t)


def blank_to_zero(c: Column, text: bool = True, infinite: bool = True) -> Column:
    """NULL, NaN, blank and (if asked) infinite values become 0."""
    if text:
        return F.when(F.trim(c) == "", None).otherwise(c)
    d = c.cast("double")
    bad = d.isNull() | F.isnan(d) | ((F.abs(d) == float("inf")) if infinite else F.lit(False))
    return F.when(bad, 0.0).otherwise(d)


def padded_index(c: Column) -> Column:
    """Six digits with leading zeros; 123.0 counts as 123; an error for what isn't a number or is longer."""
    n = c.cast("string").try_cast("double").cast("long")
    text = n.cast("string")
    ok = n.isNotNull() & (n >= 0) & (F.length(text) <= 6)
    return F.when(ok, F.lpad(text, 6, "0")).otherwise(F.raise_error(F.concat(F.lit("not an index of six digits: "), F.coalesce(c.cast("string"), F.lit("NULL")))))


def station_code(usaf: Column, wban: Column) -> Column:
    return F.concat(F.lpad(usaf.cast("string"), 6, "0"), F.lpad(wban.cast("string"), 5, "0"))


def year_prefix(c: Column) -> Column:
    return F.substring(c.cast("string"), 1, 4).try_cast("int")


def quantile_name(q: Column) -> Column:
    return F.format_string("q%03d", q.cast("int"))


def quantile_number(name: Column) -> Column:
    return F.substring(name, 2, 4).try_cast("int")


def years_of(c: Column) -> Column:
    """Sorted distinct years of a comma-separated text; other parts are ignored."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("int"))))


def ids_of(c: Column) -> Column:
    """The ids of a comma-separated text; '' has none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def feature_label(features: Column) -> Column:
    return F.when(F.size(features) == 0, "none").otherwise(F.array_join(features, "+"))


def features_of(label: Column) -> Column:
    return F.when(label == "none", F.array().cast("array<string>")).otherwise(F.split(label, r"\+"))


def label_of_path(path: Column, prefix: str) -> Column:
    return F.regexp_extract(path, rf"([^/]*?)(?:\.[^./]*)?$", 1).substr(F.lit(len(prefix) + 1), F.lit(1000))


def file_safe(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9\-_.]", "_")


def fold_seed(base: int, station: Column) -> Column:
    """First eight hex digits of the SHA-1 of station and base seed."""
    return F.conv(F.substring(F.sha1(F.concat(station.cast("string"), F.lit(str(base))).cast("binary")), 1, 8), 16, 10).cast("long")


def display_name(c: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)


def site_height(site: Column, height: Column) -> Column:
    return F.concat(site.cast("string"), F.lit("_"), height.cast("string"))


def header(json: Column, schema: str) -> Column:
    """The struct of a '# {...}' header line."""
    return F.from_json(F.regexp_replace(json, r"^#\s*", ""), schema)


def dataset_spec(spec: str) -> tuple[str, str, str]:
    """column, label and colour of 'column:label:#colour'."""
    parts = [p.strip() for p in spec.split(":")]
    if len(parts) != 3 or not all(parts):
        raise ValueError(f"not column:label:#colour: {spec!r}")
    return parts[0], parts[1], parts[2]


def processed_at() -> Column:
    """Time of processing, ISO 8601 in UTC; leave it out of comparisons."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
