"""Spherical Web Mercator, id-folded points and pixels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the projection: half the extent and the radius, in metres.
HALF, RADIUS = 20037508.342789244, 6378137.0
#: Fixed values of folded ids: the type nibble of a point and the largest 30-bit coordinate.
POINT_TYPE, MOST_30 = 8, (1 << 30) - 1


def x_of(lng: Column) -> Column:
    return lng * F.lit(HALF) / F.lit(180.0)


def y_of(lat: Column) -> Column:
    return F.lit(RADIUS) * F.ln(F.tan(F.lit(0.7853981633974483) + lat * F.lit(3.141592653589793) / F.lit(360.0)))


def lng_of(x: Column) -> Column:
    return x / F.lit(HALF) * F.lit(180.0)


def lat_of(y: Column) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(y / F.lit(RADIUS))) - F.lit(1.5707963267948966))


def finite(*values: Column) -> Column:
    """Neither infinite nor NaN nor null."""
    out = F.lit(True)
    for v in values:
        out = out & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.coalesce(out, F.lit(False))


def is_folded(qid: Column) -> Column:
    """Whether an id holds a point itself: its top four bits are 8."""
    return F.shiftrightunsigned(qid, 60) == F.lit(POINT_TYPE)


def folded_lng(qid: Column) -> Column:
    return qid.bitwiseAND(F.lit(MOST_30)) / F.lit(float(MOST_30)) * F.lit(360.0) - F.lit(180.0)


def folded_lat(qid: Column) -> Column:
    return F.shiftrightunsigned(qid, 30).bitwiseAND(F.lit(MOST_30)) / F.lit(float(MOST_30)) * F.lit(180.0) - F.lit(90.0)


def click_radius(zoom: Column) -> Column:
    """Search radius of a click, in Mercator units."""
    return F.lit(100.0) * F.pow(F.lit(2.0), F.lit(14.0) - zoom)


def quantize(v: Column) -> Column:
    """Tenths of a unit, cut off, as compressed caches keep them."""
    return (v * 10).cast("long") / F.lit(10.0)
