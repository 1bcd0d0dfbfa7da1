"""Regions of the sky as boolean Columns.

Each shape has `contains(vector)`, its area in square degrees, and the survey
latitude-longitude extent it lies in. Shapes combine with & and |. A shape of
one's own is a subclass that gives those three.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from celestrum.functions import coords
from celestrum.functions.cells import SKY_DEG2
from celestrum.functions.coords import TOLERANCE

XYZ = ("ux", "uy", "uz")


def _unit(theta: float, phi: float, system: str) -> tuple[float, float, float]:
    """A position of the driver: (longitude, latitude), or (lambda, eta) on the survey sphere."""
    system = coords.sphere(system)
    if system == "survey":
        lam, eta = math.radians(theta), math.radians(phi + coords.ETA_POLE_DEG)
        return -math.sin(lam), math.cos(lam) * math.cos(eta), math.cos(lam) * math.sin(eta)
    if system == "galactic":
        a, b = math.radians(theta) - coords.GALACTIC_PSI, math.radians(phi)
        across = math.cos(b) * math.sin(a)
        phi = math.degrees(math.asin(coords.GALACTIC_SIN * across + coords.GALACTIC_COS * math.sin(b)))
        theta = math.degrees(math.atan2(coords.GALACTIC_COS * across - coords.GALACTIC_SIN * math.sin(b), math.cos(b) * math.cos(a)) + coords.GALACTIC_PHI)
    if system == "ecliptic":
        e, a, b = math.radians(coords.OBLIQUITY_DEG), math.radians(theta), math.radians(phi)
        phi = math.degrees(math.asin(math.sin(b) * math.cos(e) + math.cos(b) * math.sin(e) * math.sin(a)))
        theta = math.degrees(math.atan2(math.sin(a) * math.cos(b) * math.cos(e) - math.sin(b) * math.sin(e), math.cos(a) * math.cos(b)))
    a, d = math.radians(theta - coords.NODE_DEG), math.radians(phi)
    return math.cos(a) * math.cos(d), math.sin(a) * math.cos(d), math.sin(d)


def _lit(v) -> tuple[Column, Column, Column]:
    return tuple(F.lit(float(x)) for x in v)


def _angle(axis: tuple[float, float, float], vector) -> Column:
    return F.degrees(F.acos(coords.clamp(coords.dot(_lit(axis), vector))))


class Bound:
    """A region: contains(vector) -> boolean Column, area, and extent (lambda_min, lambda_max, eta_min, eta_max), by default all of the sky."""

    area: float = SKY_DEG2

    def contains(self, vector=XYZ) -> Column:
        raise NotImplementedError

    @property
    def extent(self) -> tuple[float, float, float, float]:
        return -90.0, 90.0, -180.0, 180.0

    def may_touch(self, radius: Column, vector=XYZ) -> Column | None:
        """False only where nothing of the bound is within `radius` degrees of the position; None if the bound can't tell."""
        return None

    def __and__(self, other: Bound) -> Bound:
        return Combined(self, other, True)

    def __or__(self, other: Bound) -> Bound:
        return Combined(self, other, False)


@dataclass(frozen=True)
class Combined(Bound):
    """Intersection or union; its area is that of the smaller, or the sum: a bound from above."""

    a: Bound
    b: Bound
    both: bool

    def contains(self, vector=XYZ) -> Column:
        a, b = self.a.contains(vector), self.b.contains(vector)
        return a & b if self.both else a | b

    def may_touch(self, radius: Column, vector=XYZ) -> Column | None:
        a, b = self.a.may_touch(radius, vector), self.b.may_touch(radius, vector)
        if self.both:
            return b if a is None else a if b is None else a & b
        return None if a is None or b is None else a | b

    @property
    def area(self) -> float:
        return min(self.a.area, self.b.area) if self.both else self.a.area + self.b.area


@dataclass(frozen=True)
class Circle(Bound):
    theta: float
    phi: float
    radius: float
    system: str = "equatorial"

    @property
    def axis(self) -> tuple[float, float, float]:
        return _unit(self.theta, self.phi, self.system)

    @property
    def area(self) -> float:
        return SKY_DEG2 * (1.0 - math.cos(math.radians(self.radius))) / 2.0

    def contains(self, vector=XYZ) -> Column:
        return coords.dot(_lit(self.axis), vector) >= math.cos(math.radians(self.radius)) - TOLERANCE

    def may_touch(self, radius: Column, vector=XYZ) -> Column:
        return _angle(self.axis, vector) <= radius + self.radius + 1e-9

    def complement(self) -> Circle:
        x, y, z = self.axis
        return Circle((math.degrees(math.atan2(-y, -x)) + coords.NODE_DEG) % 360.0, -math.degrees(math.asin(z)), 180.0 - self.radius)

    @property
    def extent(self) -> tuple[float, float, float, float]:
        x, y, z = self.axis
        lam, eta = -math.degrees(math.asin(x)), math.degrees(math.atan2(z, y)) - coords.ETA_POLE_DEG
        low, high = max(-90.0, lam - self.radius), min(90.0, lam + self.radius)
        if abs(lam) + self.radius >= 90.0:
            return low, high, -180.0, 180.0
        half = math.degrees(math.asin(min(1.0, math.sin(math.radians(self.radius)) / math.cos(math.radians(lam)))))
        turn = lambda v: (v + 180.0) % 360.0 - 180.0
        return low, high, turn(eta - half), turn(eta + half)


@dataclass(frozen=True)
class Annulus(Bound):
    theta: float
    phi: float
    inner: float
    outer: float
    system: str = "equatorial"

    @property
    def area(self) -> float:
        return SKY_DEG2 * (math.cos(math.radians(self.inner)) - math.cos(math.radians(self.outer))) / 2.0

    def contains(self, vector=XYZ) -> Column:
        d = coords.dot(_lit(_unit(self.theta, self.phi, self.system)), vector)
        return (d >= math.cos(math.radians(self.outer)) - TOLERANCE) & (d <= math.cos(math.radians(self.inner)) + TOLERANCE)

    def may_touch(self, radius: Column, vector=XYZ) -> Column:
        d = _angle(_unit(self.theta, self.phi, self.system), vector)
        return (d <= radius + self.outer + 1e-9) & (d >= self.inner - radius - 1e-9)

    @property
    def extent(self) -> tuple[float, float, float, float]:
        return Circle(self.theta, self.phi, self.outer, self.system).extent


@dataclass(frozen=True)
class Wedge(Bound):
    """Part of a circle between two position angles (at most 360 degrees apart)."""

    theta: float
    phi: float
    radius: float
    angle_min: float
    angle_max: float
    system: str = "equatorial"

    @property
    def area(self) -> float:
        return Circle(self.theta, self.phi, self.radius, self.system).area * abs(self.angle_max - self.angle_min) / 360.0

    def contains(self, vector=XYZ) -> Column:
        lon, lat = (self.phi, self.theta) if coords.sphere(self.system) == "survey" else (self.theta, self.phi)
        angle = coords.position_angle(F.lit(float(lon)), F.lit(float(lat)), *coords.angles(self.system, *vector))
        low, high = sorted((self.angle_min, self.angle_max))
        from_low = F.pmod(angle - low, F.lit(360.0))
        return Circle(self.theta, self.phi, self.radius, self.system).contains(vector) & (from_low <= high - low + TOLERANCE)

    def may_touch(self, radius: Column, vector=XYZ) -> Column:
        return Circle(self.theta, self.phi, self.radius, self.system).may_touch(radius, vector)

    @property
    def extent(self) -> tuple[float, float, float, float]:
        return Circle(self.theta, self.phi, self.radius, self.system).extent


@dataclass(frozen=True)
class ConvexPolygon(Bound):
    """Vertices in order; the side of each edge's plane on which their middle lies is inside."""

    vertices: tuple[tuple[float, float], ...]
    system: str = "equatorial"

    def _points(self) -> list[tuple[float, float, float]]:
        return [_unit(a, b, self.system) for a, b in self.vertices]

    def _planes(self) -> list[tuple[float, float, float]]:
        points = self._points()
        middle = tuple(sum(p[i] for p in points) for i in range(3))
        out = []
        for a, b in zip(points, points[1:] + points[:1], strict=True):
            n = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
            size = math.sqrt(sum(v * v for v in n))
            sign = 1.0 if sum(v * w for v, w in zip(n, middle, strict=True)) >= 0 else -1.0
            out.append(tuple(sign * v / size for v in n))
        return out

    @property
    def area(self) -> float:
        planes = self._planes()
        angles = 0.0
        for a, b in zip(planes, planes[1:] + planes[:1], strict=True):
            angles += math.pi - math.acos(max(-1.0, min(1.0, sum(v * w for v, w in zip(a, b, strict=True)))))
        return (angles - (len(planes) - 2) * math.pi) * (180.0 / math.pi) ** 2

    def contains(self, vector=XYZ) -> Column:
        out = F.lit(True)
        for plane in self._planes():
            x, y, z = (coords.column(v) for v in vector)
            out = out & (x * plane[0] + y * plane[1] + z * plane[2] >= -TOLERANCE)
        return out

    def may_touch(self, radius: Column, vector=XYZ) -> Column:
        out, x, y, z = F.lit(True), *(coords.column(v) for v in vector)
        for plane in self._planes():
            out = out & (F.degrees(F.asin(coords.clamp(x * plane[0] + y * plane[1] + z * plane[2]))) >= -radius - 1e-9)
        return out


@dataclass(frozen=True)
class LoopPolygon(Bound):
    """One or more loops of vertices, holes among them: inside is what an odd number of loops hold. Each loop is star-shaped about none; even-odd crossings of the arc to a point outside decide."""

    loops: tuple[tuple[tuple[float, float], ...], ...]
    outside: tuple[float, float]
    system: str = "equatorial"

    def contains(self, vector=XYZ) -> Column:
        p = tuple(coords.column(v) for v in vector)
        q = _lit(_unit(*self.outside, self.system))
        n = coords.cross(p, q)
        crossings = F.lit(0)
        for loop in self.loops:
            points = [_lit(_unit(a, b, self.system)) for a, b in loop]
            for a, b in zip(points, points[1:] + points[:1], strict=True):
                m = coords.cross(a, b)
                side = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
                # The arcs cross if each one's ends are on different sides of the other's plane, on the same half of the sky.
                ap, aq, na, nb = side(m, p), side(m, q), side(n, a), side(n, b)
                hit = (ap * aq < 0) & (na * nb < 0) & (ap * nb > 0)
                crossings = crossings + F.when(hit, 1).otherwise(0)
        return crossings % 2 == 1

    def may_touch(self, radius: Column, vector=XYZ) -> Column:
        """Inside, or near an edge: nearer than the edge's half and the radius to its middle."""
        out = self.contains(vector)
        for loop in self.loops:
            at = [_unit(a, b, self.system) for a, b in loop]
            for a, b in zip(at, at[1:] + at[:1], strict=True):
                middle = tuple(u + v for u, v in zip(a, b, strict=True))
                size = math.sqrt(sum(v * v for v in middle))
                half = math.degrees(math.acos(max(-1.0, min(1.0, sum(u * v for u, v in zip(a, b, strict=True)))))) / 2
                out = out | (_angle(tuple(v / size for v in middle), vector) <= radius + half + 1e-9)
        return out


@dataclass(frozen=True)
class LatitudeBand(Bound):
    low: float
    high: float
    system: str = "equatorial"

    @property
    def area(self) -> float:
        return SKY_DEG2 * (math.sin(math.radians(self.high)) - math.sin(math.radians(self.low))) / 2.0

    def contains(self, vector=XYZ) -> Column:
        lat = coords.angles(self.system, *vector)[1]
        return coords.le(lat, F.lit(self.high)) & coords.ge(lat, F.lit(self.low))

    def may_touch(self, radius: Column, vector=XYZ) -> Column:
        lat = coords.angles(self.system, *vector)[1]
        return (lat <= self.high + radius + 1e-9) & (lat >= self.low - radius - 1e-9)


@dataclass(frozen=True)
class LongitudeBand(Bound):
    """From low eastwards to high; low above high goes over the origin."""

    low: float
    high: float
    system: str = "equatorial"

    @property
    def area(self) -> float:
        return SKY_DEG2 * ((self.high - self.low) % 360.0) / 360.0

    def contains(self, vector=XYZ) -> Column:
        lon = coords.angles(self.system, *vector)[0]
        after, before = coords.ge(lon, F.lit(self.low)), coords.le(lon, F.lit(self.high))
        return after & before if self.low <= self.high else after | before

    def may_touch(self, radius: Column, vector=XYZ) -> Column:
        lon, lat = coords.angles(self.system, *vector)
        out = self.contains(vector)
        for edge in (self.low, self.high):
            turn = F.abs(F.pmod(lon - edge + 180.0, F.lit(360.0)) - 180.0)
            away = F.degrees(F.asin(coords.clamp(F.cos(F.radians(lat)) * F.sin(F.radians(turn)))))
            out = out | (F.when(turn < 90.0, away).otherwise(90.0 - F.abs(lat)) <= radius + 1e-9)
        return out


@dataclass(frozen=True)
class LatLonBox(Bound):
    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float
    system: str = "equatorial"

    @property
    def area(self) -> float:
        return LatitudeBand(self.lat_min, self.lat_max).area * LongitudeBand(self.lon_min, self.lon_max).area / SKY_DEG2

    def contains(self, vector=XYZ) -> Column:
        return LatitudeBand(self.lat_min, self.lat_max, self.system).contains(vector) & LongitudeBand(self.lon_min, self.lon_max, self.system).contains(vector)

    def may_touch(self, radius: Column, vector=XYZ) -> Column:
        return LatitudeBand(self.lat_min, self.lat_max, self.system).may_touch(radius, vector) & LongitudeBand(self.lon_min, self.lon_max, self.system).may_touch(radius, vector)
