"""Wind: components, shear and heights, packed station reports."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from galeframe.functions.cdf import let
from galeframe.functions.constants import GWA_HEIGHTS, KNOT_MS, NEUTRAL_SHEAR


def components(speed: Column, direction: Column) -> tuple[Column, Column]:
    """u and v from speed and meteorological direction, in a frame that keeps the magnitude."""
    theta = F.radians(F.pmod(270 - direction, F.lit(360.0)))
    return -speed * F.sin(theta), -speed * F.cos(theta)


def magnitude(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def decoded(raw: Column, scale: Column, offset: Column) -> Column:
    """Stored integers of gridded files: raw divided by the scale factor (1 if it is 0), plus the offset."""
    return raw / F.when(scale == 0, 1.0).otherwise(scale) + offset


def packed_speed(report: Column) -> Column:
    """m/s from a report like direction,quality,type,speed,quality in tenths; 9999 and bad parts are NULL."""
    tenths = F.try_element_at(F.split(report, ","), F.lit(4)).try_cast("int")
    return F.nullif(tenths, F.lit(9999)) / 10.0


def knots(speed: Column) -> Column:
    """Whole knots, half to even."""
    return F.rint(speed / KNOT_MS)


def uniform(*key: Column, seed: int = 0) -> Column:
    """In [0, 1), fixed by the key: the first 13 hex digits of its SHA-1."""
    digest = F.sha1(F.concat_ws("|", *[k.cast("string") for k in key], F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def dequantized(speed: Column, *key: Column, seed: int = 0) -> Column:
    """A speed reported in whole knots k, spread over (k - 1, k] knots, calm over (0, 2]; fixed by the key."""
    k, r = knots(speed), 1 - uniform(*key, seed=seed)
    return F.when(k <= 0, 2 * r).otherwise(k - 1 + r) * KNOT_MS


def _log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def shear(low: Column, high: Column, z_low: float = 10.0, z_high: float = 100.0, fallback: float = NEUTRAL_SHEAR) -> Column:
    """Power-law exponent between two heights; the fallback where it isn't defined."""
    return F.coalesce(_log(F.try_divide(low, high)) / F.ln(F.lit(z_low / z_high)), F.lit(fallback))


def at_height(speed: Column, alpha: Column, z: Column, z_ref: float = 100.0) -> Column:
    """The reference speed carried to height z; unchanged at the reference height."""
    return F.when(z == z_ref, speed).otherwise(speed * F.pow(z / z_ref, alpha))


def clipped_shear(v1: Column, v2: Column, h1: Column, h2: Column) -> Column:
    """Exponent with speeds of 1e-6 at least, held to [-2, 2]."""
    step = F.ln(h2 / h1)
    a = F.ln(F.greatest(v2, F.lit(1e-6)) / F.greatest(v1, F.lit(1e-6))) / F.when(step == 0, 1.0).otherwise(step)
    return F.least(F.greatest(a, F.lit(-2.0)), F.lit(2.0))


def bracket(z: Column, heights: list[float]) -> Column:
    """struct(exact, lo, hi): the available height within 1e-6, or the two around z, held to the edge pair outside."""
    hs = sorted(heights)
    arr = F.array(*[F.lit(float(h)) for h in hs])
    exact = F.get(F.filter(arr, lambda h: F.abs(h - z) <= 1e-6), F.lit(0))
    lo = F.least(F.greatest(F.size(F.filter(arr, lambda h: h <= z)) - 1, F.lit(0)), F.lit(max(len(hs) - 2, 0)))
    hi = F.least(F.greatest(F.size(F.filter(arr, lambda h: h < z)), lo + 1), F.lit(len(hs) - 1))
    return F.struct(exact.isNotNull().alias("exact"), F.coalesce(exact, F.get(arr, lo)).cast("int").alias("lo"), F.coalesce(exact, F.get(arr, hi)).cast("int").alias("hi"))


def power_law(z: Column, heights: list[float], speeds: list[Column]) -> Column:
    """Speed at z from speeds at some heights: the exact one, between the two around z, or carried on from the edge pair.

    With a speed or height that isn't positive: linear inside, the edge speed outside. One speed stands for all
    heights; none gives NULL.
    """
    points = F.filter(F.array(*[F.struct(F.lit(float(h)).alias("h"), s.cast("double").alias("u")) for h, s in sorted(zip(heights, speeds, strict=True), key=lambda p: p[0])]), lambda p: p["u"].isNotNull())
    return let(points, lambda p: _power_law(z, p))


def _power_law(z: Column, points: Column) -> Column:
    n = F.size(points)
    exact = F.get(F.filter(points, lambda p: F.abs(p["h"] - z) <= 1e-6), F.lit(0))["u"]
    below = F.size(F.filter(points, lambda p: p["h"] <= z))
    i = F.least(F.greatest(below, F.lit(1)), F.greatest(n - 1, F.lit(1)))
    a, b = F.get(points, i - 1), F.get(points, i)
    good = (a["u"] > 0) & (b["u"] > 0) & (a["h"] > 0) & (b["h"] > 0)
    alpha = _log(F.try_divide(b["u"], a["u"])) / _log(F.try_divide(b["h"], a["h"]))
    t = (z - a["h"]) / (b["h"] - a["h"])
    inside = (below > 0) & (below < n)
    bad = F.when(inside, (1 - t) * a["u"] + t * b["u"]).when(below == 0, a["u"]).otherwise(b["u"])
    return F.when(n == 1, F.get(points, F.lit(0))["u"]).when(exact.isNotNull(), exact).when(n >= 2, F.when(good, a["u"] * F.pow(z / F.when(a["h"] > 0, a["h"]), alpha)).otherwise(bad))


def fitted(z: Column, speeds: list[Column], heights: list[float] = GWA_HEIGHTS) -> Column:
    """Speed at z by a least-squares line through the logs of the positive speeds; with one of them, that one."""
    ok = [F.when(s > 0, s) for s in speeds]
    x = [math.log(h) for h in heights]
    there = [s.isNotNull().cast("int") for s in ok]
    y = [F.coalesce(F.ln(s), F.lit(0.0)) for s in ok]
    add = lambda terms: sum(terms[1:], terms[0])
    k, sx, sy = add(there), add([t * v for t, v in zip(there, x, strict=True)]), add(y)
    sxy, sxx = add([v * w for v, w in zip(x, y, strict=True)]), add([t * (v * v) for t, v in zip(there, x, strict=True)])
    alpha = F.try_divide(k * sxy - sx * sy, k * sxx - sx * sx)
    z_ok = F.when(z > 0, z)
    nearest = F.array_min(F.array_compact(F.array(*[F.when(s.isNotNull(), F.struct(F.abs(F.lit(float(h)) - z).alias("d"), F.lit(float(h)).alias("h"), s.alias("u"))) for h, s in zip(heights, ok, strict=True)])))["u"]
    return F.when(k >= 2, F.exp(F.try_divide(sy, k) - alpha * F.try_divide(sx, k)) * F.pow(z_ok, alpha)).otherwise(nearest)


def log_fit(z: Column, u: Column) -> tuple[Column, Column]:
    """Aggregates: factor and exponent of u = factor * z ^ exponent over positive pairs; NULL with less than two."""
    ok = (z > 0) & (u > 0)
    x, y = F.when(ok, F.ln(z)), F.when(ok, F.ln(u))
    enough = F.count(x) >= 2
    return F.when(enough, F.exp(F.regr_intercept(y, x))), F.when(enough, F.regr_slope(y, x))


def days_in_year(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def is_complete_year(n: Column, per_day: Column, year: Column, share: float = 0.95) -> Column:
    return n >= F.lit(share) * per_day * days_in_year(year)


def log_target(y: Column, floor: float = 1e-3) -> Column:
    return F.ln(F.greatest(y, F.lit(floor)))
