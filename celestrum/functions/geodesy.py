"""Triangles, arcs, caps and boxes on the sphere, as Columns.

A position is a tuple of three Columns or names (x, y, z) of unit length. Angles are radians here, areas steradians.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from celestrum.functions.coords import clamp, column, cross, dot


def _c(v) -> tuple[Column, Column, Column]:
    return tuple(column(x) for x in v)


def _norm(v) -> Column:
    x, y, z = _c(v)
    return F.sqrt(x * x + y * y + z * z)


def unit(v) -> tuple[Column, Column, Column]:
    size = _norm(v)
    return tuple(x / size for x in _c(v))


def determinant(a, b, c) -> Column:
    """Of three positions: positive if they turn to the left."""
    p, q = cross(a, b), _c(c)
    return p[0] * q[0] + p[1] * q[1] + p[2] * q[2]


def orientation(a, b, c) -> Column:
    """1 if a, b, c turn to the left, -1 to the right, 0 on one great circle."""
    d = determinant(a, b, c)
    return F.when(d > 1e-15, 1).when(d < -1e-15, -1).otherwise(0)


def arc(a, b) -> Column:
    """Angle between two positions, accurate for small and for large ones."""
    return F.atan2(_norm(cross(a, b)), _plain_dot(a, b))


def _plain_dot(a, b) -> Column:
    p, q = _c(a), _c(b)
    return p[0] * q[0] + p[1] * q[1] + p[2] * q[2]


def signed_area(a, b, c) -> Column:
    """Of the triangle: positive if it turns to the left."""
    return 2.0 * F.atan2(determinant(a, b, c), 1.0 + _plain_dot(a, b) + _plain_dot(b, c) + _plain_dot(c, a))


def area(a, b, c) -> Column:
    return F.abs(signed_area(a, b, c))


def angle_at(a, b, c) -> Column:
    """Of the triangle at b, 0 to pi."""
    return arc(cross(a, b), cross(c, b))


def turn_angle(a, b, c) -> Column:
    """By how much the way from a over b to c turns: positive to the left."""
    out = arc(cross(a, b), cross(b, c))
    return F.when(determinant(a, b, c) >= 0, out).otherwise(-out)


def planar_centroid(a, b, c) -> tuple[Column, Column, Column]:
    """Mean of the three corners, within the sphere."""
    return tuple((x + y + z) / 3.0 for x, y, z in zip(_c(a), _c(b), _c(c), strict=True))


# Arcs


def crosses(a, b, c, d) -> Column:
    """Whether the inner parts of the arcs ab and cd cross in one point."""
    ab, cd = orientation(a, b, c), orientation(c, d, a)
    return (ab != 0) & (cd != 0) & (ab == -orientation(a, b, d)) & (cd == -orientation(c, d, b)) & (ab == -cd)


def interpolate(a, b, share) -> tuple[Column, Column, Column]:
    """The position at a share of the arc from a to b."""
    whole, t = arc(a, b), column(share)
    first = F.when(whole < 1e-12, 1.0 - t).otherwise(F.sin((1.0 - t) * whole) / F.sin(whole))
    second = F.when(whole < 1e-12, t).otherwise(F.sin(t * whole) / F.sin(whole))
    return unit(tuple(first * x + second * y for x, y in zip(_c(a), _c(b), strict=True)))


def arc_distance(p, a, b) -> Column:
    """From a position to the nearest point of an arc shorter than half a turn."""
    n = cross(a, b)
    size = _norm(n)
    off = _plain_dot(p, n) / size
    # The foot on the great circle is in the arc if p is to the inner side of both ends' planes.
    inside = (determinant(n, a, p) >= 0) & (determinant(b, n, p) >= 0)
    ends = F.least(arc(p, a), arc(p, b))
    return F.when(size < 1e-15, ends).when(inside, F.abs(F.asin(clamp(off)))).otherwise(ends)


def line_length(points: Column) -> Column:
    """Of an array of struct(x, y, z)."""
    v = lambda p: (p["x"], p["y"], p["z"])
    steps = F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1), lambda p, q: arc(v(p), v(q)))
    return F.aggregate(steps, F.lit(0.0), lambda a, s: a + s)


def line_distance(points: Column, p) -> Column:
    """From a position to the nearest point of a line of two points or more."""
    v = lambda q: (q["x"], q["y"], q["z"])
    return F.array_min(F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1), lambda a, b: arc_distance(p, v(a), v(b))))


def loop_area(points: Column) -> Column:
    """Signed area of the loop through an array of struct(x, y, z): triangles from its first point; positive if it turns to the left."""
    v = lambda q: (q["x"], q["y"], q["z"])
    first = v(points[0])
    return F.aggregate(F.zip_with(F.slice(points, F.lit(2), F.size(points) - 2), F.slice(points, F.lit(3), F.size(points) - 2), lambda a, b: signed_area(first, v(a), v(b))), F.lit(0.0), lambda s, t: s + t)


# Caps: an axis and a height, 1 - cos(radius); below 0 a cap is empty, from 2 on it is the sphere


def cap_height(radius) -> Column:
    return 1.0 - F.cos(column(radius))


def cap_radius(height) -> Column:
    return F.when(column(height) < 0, -1.0).otherwise(2.0 * F.asin(F.sqrt(F.least(F.lit(1.0), 0.5 * column(height)))))


def cap_area(height) -> Column:
    return 2.0 * math.pi * F.greatest(F.lit(0.0), F.least(F.lit(2.0), column(height)))


def cap_contains(axis, height, p) -> Column:
    return 1.0 - dot(axis, p) <= column(height) + 1e-15


def cap_holds(axis, height, other_axis, other_height) -> Column:
    """Whether the second cap lies in the first."""
    return (column(other_height) < 0) | (column(height) >= 2) | (cap_radius(height) >= arc(axis, other_axis) + cap_radius(other_height))


def caps_meet(axis, height, other_axis, other_height) -> Column:
    return (column(height) >= 0) & (column(other_height) >= 0) & (cap_radius(height) + cap_radius(other_height) >= arc(axis, other_axis))


def cap_with_point(axis, height, p) -> Column:
    """Height of the cap of the same axis that holds a point too."""
    return F.greatest(column(height), 1.0 - dot(axis, p))


def cap_with_cap(axis, height, other_axis, other_height) -> Column:
    """Height of the cap of the first's axis that holds both."""
    both = cap_height(F.least(F.lit(math.pi), arc(axis, other_axis) + cap_radius(other_height)))
    return F.when(column(other_height) < 0, column(height)).otherwise(F.greatest(column(height), both))


def cap_complement(axis, height) -> tuple[tuple[Column, Column, Column], Column]:
    """Axis and height of the rest of the sphere; that of the sphere is empty."""
    return tuple(-x for x in _c(axis)), F.when(column(height) >= 2, -1.0).otherwise(2.0 - F.greatest(F.lit(0.0), column(height)))


# Boxes of latitude and longitude in degrees: struct(lat_min, lat_max, lon_min, lon_max); lon_min above lon_max goes over the origin


def box(lat_min, lat_max, lon_min, lon_max) -> Column:
    return F.struct(*[column(v).alias(n) for n, v in (("lat_min", lat_min), ("lat_max", lat_max), ("lon_min", lon_min), ("lon_max", lon_max))])


def box_width(b: Column) -> Column:
    return F.pmod(b["lon_max"] - b["lon_min"], F.lit(360.0))


def box_area(b: Column) -> Column:
    return F.radians(box_width(b)) * (F.sin(F.radians(b["lat_max"])) - F.sin(F.radians(b["lat_min"])))


def boxes_meet(a: Column, b: Column) -> Column:
    longitudes = (F.pmod(b["lon_min"] - a["lon_min"], F.lit(360.0)) <= box_width(a)) | (F.pmod(a["lon_min"] - b["lon_min"], F.lit(360.0)) <= box_width(b))
    return (a["lat_min"] <= b["lat_max"]) & (b["lat_min"] <= a["lat_max"]) & longitudes


def box_holds(a: Column, b: Column) -> Column:
    return (a["lat_min"] <= b["lat_min"]) & (a["lat_max"] >= b["lat_max"]) & (F.pmod(b["lon_min"] - a["lon_min"], F.lit(360.0)) + box_width(b) <= box_width(a))


def box_union(a: Column, b: Column) -> Column:
    """The smallest box that holds both: longitudes close the smaller gap."""
    from_a, from_b = F.pmod(b["lon_min"] - a["lon_min"], F.lit(360.0)), F.pmod(a["lon_min"] - b["lon_min"], F.lit(360.0))
    wide_a, wide_b = F.greatest(box_width(a), from_a + box_width(b)), F.greatest(box_width(b), from_b + box_width(a))
    use_a = wide_a <= wide_b
    low, wide = F.when(use_a, a["lon_min"]).otherwise(b["lon_min"]), F.least(F.least(wide_a, wide_b), F.lit(360.0))
    return box(F.least(a["lat_min"], b["lat_min"]), F.greatest(a["lat_max"], b["lat_max"]), low, F.pmod(low + wide, F.lit(360.0)))


def box_grown(b: Column, lat, lon) -> Column:
    """By so many degrees at each side, as far as there is sphere."""
    whole = box_width(b) + 2.0 * column(lon) >= 360.0
    return box(F.greatest(F.lit(-90.0), b["lat_min"] - column(lat)), F.least(F.lit(90.0), b["lat_max"] + column(lat)), F.when(whole, 0.0).otherwise(F.pmod(b["lon_min"] - column(lon), F.lit(360.0))), F.when(whole, 360.0 - 1e-12).otherwise(F.pmod(b["lon_max"] + column(lon), F.lit(360.0))))
