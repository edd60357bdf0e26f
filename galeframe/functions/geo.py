"""Distances, projections, coordinate keys and tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from galeframe.functions.constants import EARTH_KM, MERCATOR_M, SPHERE_M


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of points in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))))


def web_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """x and y in m; latitudes are held to the square."""
    phi = F.radians(F.least(F.greatest(lat, F.lit(-85.05112878)), F.lit(85.05112878)))
    return F.radians(lon) * MERCATOR_M, F.ln(F.tan(math.pi / 4 + phi / 2)) * MERCATOR_M


def conic(lat: Column, lon: Column, lat1: float = 30.0, lat2: float = 60.0, lat0: float = 38.47240422490422, lon0: float = -96.0) -> tuple[Column, Column]:
    """x and y in m of the spherical Lambert conformal conic projection."""
    r = math.radians
    t = lambda d: math.tan(math.pi / 4 + r(d) / 2)
    n = math.log(math.cos(r(lat1)) / math.cos(r(lat2))) / math.log(t(lat2) / t(lat1))
    f = math.cos(r(lat1)) * t(lat1) ** n / n
    rho, rho0 = SPHERE_M * f / F.pow(F.tan(math.pi / 4 + F.radians(lat) / 2), F.lit(n)), SPHERE_M * f / t(lat0) ** n
    theta = n * F.radians(wrap_180(lon - lon0))
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def wrap_180(lon: Column) -> Column:
    """[-180, 180)"""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def wrap_360(lon: Column) -> Column:
    """[0, 360)"""
    return F.pmod(lon, F.lit(360.0))


def rounded(c: Column, digits: int) -> Column:
    """Half to even, and never -0.0, so that it can be a join key."""
    return F.bround(c, digits) + 0.0


def idw(distance: Column, power: float = 1.0) -> Column:
    """Unnormalised inverse-distance weight."""
    return 1.0 / F.pow(distance + 1e-9, F.lit(power))


def tile_id(tx: Column, ty: Column) -> Column:
    return F.shiftleft(tx.cast("long"), 32).bitwiseOR(ty.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def tile_of_line(line: Column) -> Column:
    """A tile id from 'tx,ty' or from the id itself; anything else is NULL."""
    parts = F.split(F.trim(line), ",")
    part = lambda i: F.trim(F.try_element_at(parts, F.lit(i))).try_cast("long")
    return F.when(F.size(parts) == 2, tile_id(part(1), part(2))).otherwise(part(1))


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the edges of a closed ring, as one expression without a UDF."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < F.lit(x2 - x1) * (y - y1) / F.lit(y2 - y1) + x1)
            crossings = crossings + hit.cast("int")
    return crossings % 2 == 1
