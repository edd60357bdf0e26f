"""Quantile functions as arrays: the 101-point block, four means, monotone and interpolated profiles.

Everything is a Column over an array column, so it stays in the JVM. Missing values are NULL; NaN and infinity become
NULL at every entry (finite()).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galeframe.functions.constants import N_QUANTILES


def finite(c: Column) -> Column:
    """c as a double, NULL where it is NaN or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def number(c: Column) -> Column:
    """Lossy conversion: what isn't a finite number is NULL."""
    return finite(c.try_cast("double"))


def let(value: Column, use) -> Column:
    """use(value), with value computed once a row: a lambda would compute it again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def levels(n: int = N_QUANTILES) -> Column:
    return F.array(*[F.lit(k / (n - 1)) for k in range(n)])


def quantile_block(c: Column, n: int = N_QUANTILES) -> Column:
    """Aggregate: exact quantiles by linear interpolation, as an array; NULL if there is no finite value."""
    return F.percentile(finite(c), levels(n))


def quantile_rows(c: Column, n: int = N_QUANTILES) -> Column:
    """Aggregate: the non-negative finite values' quantiles; an empty group gives an array of NULLs."""
    x = finite(c)
    return F.coalesce(F.percentile(F.when(x >= 0, x), levels(n)), F.array_repeat(F.lit(None).cast("double"), n))


def from_columns(names: list[str]) -> Column:
    return F.array(*[finite(F.col(c)) for c in names])


def collected(qnum: Column, value: Column) -> Column:
    """Aggregate of a long table: structs (q, v) in order of q; a group has as many as there are quantiles."""
    return F.array_sort(F.collect_list(F.when(qnum.isNotNull(), F.struct(qnum.cast("double").alias("q"), finite(value).alias("v")))))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean_complete(a: Column) -> Column:
    """Trapezoid over all points; NULL if any is missing."""
    return let(a, _mean_complete)


def _mean_complete(a: Column) -> Column:
    whole = ~F.exists(a, lambda x: x.isNull()) & (F.size(a) > 1)
    return F.when(whole, (_sum(a) - (F.element_at(a, 1) + F.element_at(a, -1)) / 2) / (F.size(a) - 1))


def mean_adjacent(a: Column) -> Column:
    """Trapezoid over neighbouring points that are both there; NULL with less than two points."""
    return let(a, _mean_adjacent)


def _mean_adjacent(a: Column) -> Column:
    n = F.size(a)
    pairs = F.zip_with(F.slice(a, F.lit(1), n - 1), F.slice(a, F.lit(2), n - 1), lambda x, y: F.coalesce((x + y) / 2, F.lit(0.0)))
    return F.when(F.size(F.filter(a, lambda x: x.isNotNull())) >= 2, _sum(pairs) / (n - 1))


def mean_dense(points: Column, step: float = 0.01) -> Column:
    """Of structs (q, v): what is left after dropping missing values counts as adjacent, step apart."""
    v = F.transform(F.filter(points, lambda x: x["v"].isNotNull()), lambda x: x["v"])
    return let(v, lambda v: F.when(F.size(v) >= 2, (_sum(v) - (F.element_at(v, 1) + F.element_at(v, -1)) / 2) * step))


def mean_normalised(points: Column) -> Column:
    """Of structs (q, v): true trapezoid over p = q / largest q, missing values dropped."""
    return let(F.filter(points, lambda x: x["v"].isNotNull()), _mean_normalised)


def _mean_normalised(p: Column) -> Column:
    n = F.size(p)
    area = F.zip_with(F.slice(p, F.lit(1), n - 1), F.slice(p, F.lit(2), n - 1), lambda x, y: (x["v"] + y["v"]) / 2 * (y["q"] - x["q"]))
    top = F.element_at(p, -1)["q"]
    return F.when((n >= 2) & (top > 0), _sum(area) / top)


def interpolated(a: Column) -> Column:
    """Gaps filled linearly by position, edges with the nearest value; all missing stays missing."""

    def fill(a: Column, there: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            lo, hi = F.array_max(F.filter(there, lambda j: j <= i)), F.array_min(F.filter(there, lambda j: j >= i))
            vlo, vhi = F.get(a, lo), F.get(a, hi)
            return F.coalesce(x, vlo + (vhi - vlo) * (i - lo) / F.nullif(hi - lo, F.lit(0)), vlo, vhi)

        return F.when(F.exists(a, lambda x: x.isNull()), F.transform(a, at)).otherwise(a)

    there = lambda a: F.filter(F.transform(a, lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())
    return let(a, lambda a: let(there(a), lambda t: fill(a, t)))


def cumulative_max(a: Column) -> Column:
    """Running maximum; missing values take the maximum so far."""
    start = F.array().cast("array<double>")
    return F.aggregate(a, start, lambda s, x: F.array_append(s, F.greatest(x, F.try_element_at(s, F.lit(-1)))))


def monotone(a: Column) -> Column:
    """Interpolated, then 0 for what is still missing, then the running maximum."""
    return cumulative_max(F.transform(interpolated(a), lambda x: F.coalesce(x, F.lit(0.0))))


def cumulative_sum(a: Column) -> Column:
    """Running sum: a profile that is monotone by construction, from non-negative increments."""
    start = F.array().cast("array<double>")
    return F.aggregate(a, start, lambda s, x: F.array_append(s, x + F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0))))


def resampled(a: Column, n: int) -> Column:
    """n evenly spaced points of the profile, by linear interpolation."""

    def at(a: Column, k: Column) -> Column:
        x = k * (F.size(a) - 1) / F.lit(float(n - 1))
        lo = F.floor(x).cast("int")
        hi = F.least(lo + 1, F.size(a) - 1)
        return F.get(a, lo) + (F.get(a, hi) - F.get(a, lo)) * (x - lo)

    return let(a, lambda a: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: at(a, k)))


def _pairs(a: Column, f) -> Column:
    n = F.size(a)
    return F.when(n > 1, F.zip_with(F.slice(a, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(a, F.lit(2), F.greatest(n - 1, F.lit(0))), f))


def count_drops(a: Column, tolerance: float = 0.0) -> Column:
    """Neighbours, after dropping missing values, of which the second is lower by more than the tolerance."""
    v = F.filter(a, lambda x: x.isNotNull())
    return F.coalesce(F.size(F.filter(_pairs(v, lambda x, y: y - x < -abs(tolerance)), lambda x: x)), F.lit(0))


def count_equal(a: Column, tolerance: float = 0.0) -> Column:
    """Neighbours that differ by no more than the tolerance."""
    return F.coalesce(F.size(F.filter(_pairs(a, lambda x, y: F.abs(y - x) <= max(tolerance, 0.0)), lambda x: x)), F.lit(0))
