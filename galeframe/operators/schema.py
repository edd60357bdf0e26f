"""Column discovery, aliases, required and optional columns, cleaning."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.functions import cdf, geo, labels
from galeframe.functions.constants import ALIASES, QCOLS


def choose(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate that df has, whatever the case; as df writes it."""
    have = {}
    for c in df.columns:
        have.setdefault(c.lower(), c)
    return next((have[c.lower()] for c in candidates if c.lower() in have), None)


def aliased(df: DataFrame, required: list[str], optional: list[str] = ()) -> DataFrame:
    """df with its columns renamed to the logical names; missing optional ones are NULL, missing required ones an error."""
    found = {name: choose(df, ALIASES.get(name, [name])) for name in [*required, *optional]}
    if missing := [n for n in required if found[n] is None]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    taken = {c for c in found.values() if c}
    rest = [F.col(f"`{c}`") for c in df.columns if c not in taken and c not in found]
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(n) for n, c in found.items()], *rest)


def quantile_columns(df: DataFrame) -> list[str]:
    """Columns q000.. in numeric order; q000 to q1000 too. An error without any."""
    found = sorted((c for c in df.columns if re.fullmatch(r"[qQ]\d{3,4}", c)), key=lambda c: int(c[1:]))
    if not found:
        raise ValueError("no quantile columns like q000")
    return found


def present(df: DataFrame, candidates: list[str]) -> list[str]:
    return [c for c in candidates if c in df.columns]


def missing(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require(df: DataFrame, required: list[str]) -> DataFrame:
    if lack := missing(df, required):
        raise ValueError(f"missing columns {lack}; there are {df.columns}")
    return df


def with_columns(df: DataFrame, names: list[str], kind: str = "float") -> DataFrame:
    """Adds those of the columns that df lacks, as NULLs."""
    return df.withColumns({c: F.lit(None).cast(kind) for c in missing(df, names)})


def to_numbers(df: DataFrame, names: list[str]) -> DataFrame:
    """Lossy conversion to finite doubles."""
    return df.withColumns({c: cdf.number(F.col(c)) for c in present(df, names)})


def with_coordinates(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return to_numbers(df, [lat, lon]).dropna(subset=[lat, lon])


def finite_rows(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows in which all the features are finite."""
    for c in names:
        df = df.where(cdf.finite(F.col(c)).isNotNull())
    return df


def ordered(df: DataFrame, preferred: list[str]) -> DataFrame:
    """Preferred columns first, then the others by name, then the quantiles."""
    q = [c for c in df.columns if re.fullmatch(r"q\d{3,4}", c)]
    first = present(df, preferred)
    return df.select(*first, *sorted(c for c in df.columns if c not in first and c not in q), *q)


def filled(df: DataFrame, numeric_only: bool = False, zero_strings: bool = False, replace_infinite: bool = True) -> DataFrame:
    """Missing values become 0: numbers always, blank strings as '0' if asked."""
    out = {}
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            out[name] = labels.blank_to_zero(c, text=False, infinite=replace_infinite).cast(kind)
        elif kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
            out[name] = F.coalesce(c, F.lit(0).cast(kind))
        elif kind == "string" and not numeric_only:
            blank = labels.blank_to_zero(c)
            out[name] = F.coalesce(blank, F.lit("0")) if zero_strings else blank
    return df.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def whole_quantiles(df: DataFrame, qnum: str = "qnum") -> DataFrame:
    """Finite quantile numbers, rounded half to even, between 0 and 100."""
    return df.withColumn(qnum, F.bround(cdf.number(F.col(qnum)), 0).cast("int")).where(F.col(qnum).between(0, 100))


def at_heights(df: DataFrame, heights: list[int], height: str = "height_m") -> DataFrame:
    return df.where(F.bround(F.col(height), 0).cast("int").isin(heights))


def in_box(df: DataFrame, south: float, north: float, west: float, east: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.where(geo.in_box(F.col(lat), F.col(lon), south, north, west, east))


def derived_features(df: DataFrame) -> DataFrame:
    """is_gs, aspect_sin and aspect_cos, of the columns that df has."""
    out = {}
    if "observation_type" in df.columns:
        out["is_gs"] = (labels.observation_type(F.col("observation_type")) == "GS").cast("byte")
    if "aspect_deg" in df.columns:
        angle = F.radians(cdf.number(F.col("aspect_deg")))
        out |= {"aspect_sin": F.sin(angle), "aspect_cos": F.cos(angle)}
    return df.withColumns(out)


def gs_rows(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows where the column equals the value: as numbers if both are, else as canonical text."""
    as_number = F.col(column).cast("string").try_cast("double") == F.lit(value).try_cast("double")
    return df.where(F.coalesce(as_number, labels.observation_type(F.col(column).cast("string")) == labels.observation_type(F.lit(value))))


def wide_from_array(df: DataFrame, array: str, keep: list[str]) -> DataFrame:
    """An array of 101 quantiles as columns q000 to q100."""
    return df.select(*keep, *[F.get(F.col(array), F.lit(i)).alias(c) for i, c in enumerate(QCOLS)])
