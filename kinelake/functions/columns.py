"""Column expressions that the operators share: null handling, rounding, angles and small vectors.

Everything stays inside Catalyst. NaN is turned to null at the edge and null is the only missing value inside.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """NaN becomes null."""
    return F.when(~F.isnan(col(c)), col(c))


def r6(c: Column | str) -> Column:
    """Rounded to six places, without a negative zero: what is compared or hashed."""
    return F.round(col(c), 6) + F.lit(0.0)


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.when(col(c).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col(c))))


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is null or zero."""
    return F.when(col(b) != 0, col(a) / col(b))


def wrap180(degrees: Column | str) -> Column:
    """An angle in degrees, brought to [-180, 180)."""
    d = col(degrees) + 180.0
    return d - 360.0 * F.floor(d / 360.0) - 180.0


def norm(*parts: Column | str) -> Column:
    """Euclidean length of a vector of columns."""
    return F.sqrt(reduce(lambda a, b: a + b, [col(p) * col(p) for p in parts]))


def angle_between(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between two plane vectors; null where one has no length."""
    na, nb = norm(ax, ay), norm(bx, by)
    cosine = (ax * bx + ay * by) / (na * nb)
    return F.when((na >= 1e-10) & (nb >= 1e-10), F.degrees(F.acos(clip(cosine, -1.0, 1.0))))


def signed_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees from a to b, positive counter-clockwise in the columns' axes."""
    return F.degrees(F.atan2(ax * by - ay * bx, ax * bx + ay * by))


def interior_angle(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Degrees at b between the directions to a and to c."""
    return angle_between(ax - bx, ay - by, cx - bx, cy - by)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def symmetry_index(left: Column | str, right: Column | str) -> Column:
    """Difference of the sides as a percentage of their mean; 0 where both are 0."""
    l, r = col(left), col(right)  # noqa: E741
    return F.when(l + r == 0, F.lit(0.0)).otherwise(F.abs(l - r) / (0.5 * (l + r)) * 100.0)


def cv(values: Column | str, population: bool = False) -> Column:
    """Coefficient of variation of a group in percent (an aggregate); 0 for fewer than two values or a zero mean."""
    v = col(values)
    sd = F.stddev_pop(v) if population else F.stddev_samp(v)
    return F.when((F.count(v) < 2) | (F.avg(v) == 0), F.lit(0.0)).otherwise(sd / F.avg(v) * 100.0)


def rms(values: Column | str) -> Column:
    """Root mean square of a group (an aggregate)."""
    v = col(values)
    return F.sqrt(F.avg(v * v))


def curve_point(curve: Column | str, p: Column | float) -> Column:
    """The value of an array at a fractional index, between its neighbours in proportion."""
    c = col(curve)
    at = p if isinstance(p, Column) else F.lit(float(p))
    lower = F.floor(at).cast("int")
    upper = F.least(lower + 1, F.size(c) - 1)
    low, high = F.get(c, lower), F.get(c, upper)
    return low + (high - low) * (at - lower)


def resample(curve: Column | str, points: int = 101) -> Column:
    """An array brought to a number of equally spaced points by linear interpolation."""
    c = col(curve)
    last = (F.size(c) - 1).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda p: curve_point(c, p * last / float(points - 1)))


def filled_curve(curve: Column | str) -> Column:
    """An array with nulls replaced by linear interpolation between known values; the ends take the nearest known one."""
    c = col(curve)
    known = F.filter(F.transform(c, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda s: s["v"].isNotNull())

    def at(v: Column, i: Column) -> Column:
        earlier = F.filter(known, lambda s: s["i"] < i)
        before = F.get(earlier, F.size(earlier) - 1)
        after = F.get(F.filter(known, lambda s: s["i"] > i), F.lit(0))
        between = before["v"] + (after["v"] - before["v"]) * (i - before["i"]) / (after["i"] - before["i"])
        return F.coalesce(v, between, before["v"], after["v"])

    # Whole curves, the usual case, aren't searched.
    return F.when(F.exists(c, lambda v: v.isNull()), F.transform(c, at)).otherwise(c)
