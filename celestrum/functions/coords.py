"""Positions on the sphere as Columns.

A position is its unit vector: columns ux, uy, uz. Angles are degrees unless a
name says otherwise. Spheres: survey (lambda, eta), equatorial (ra, dec),
galactic (lon, lat), ecliptic (lon, lat).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the coordinate systems.
NODE_DEG = 95.0
ETA_POLE_DEG = 32.5
GALACTIC_PSI, GALACTIC_SIN, GALACTIC_COS, GALACTIC_PHI = 0.57477043300, 0.88998808748, 0.45598377618, 4.9368292465
OBLIQUITY_DEG = 23.4392911
SPHERES = {"survey": "survey", "sdss": "survey", "eq": "equatorial", "equatorial": "equatorial", "gal": "galactic", "galactic": "galactic", "ecliptic": "ecliptic"}

TOLERANCE = 1e-15


def sphere(name: str) -> str:
    """Canonical name of a sphere; ValueError if there is none of that name."""
    try:
        return SPHERES[name.lower()]
    except KeyError:
        raise ValueError(f"no sphere named {name!r}; one of {sorted(SPHERES)}") from None


def column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def wrap_180(x: Column) -> Column:
    """Into (-180, 180], for angles at most one turn off."""
    return F.when(x > 180.0, x - 360.0).when(x <= -180.0, x + 360.0).otherwise(x)


def wrap_360(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


# Unit vectors


def survey_to_xyz(lam, eta) -> tuple[Column, Column, Column]:
    lam, eta = F.radians(column(lam)), F.radians(column(eta) + ETA_POLE_DEG)
    return -F.sin(lam), F.cos(lam) * F.cos(eta), F.cos(lam) * F.sin(eta)


def equatorial_to_xyz(ra, dec) -> tuple[Column, Column, Column]:
    a, d = F.radians(column(ra) - NODE_DEG), F.radians(column(dec))
    return F.cos(a) * F.cos(d), F.sin(a) * F.cos(d), F.sin(d)


def galactic_to_xyz(lon, lat) -> tuple[Column, Column, Column]:
    return equatorial_to_xyz(*galactic_to_equatorial(lon, lat))


def ecliptic_to_xyz(lon, lat) -> tuple[Column, Column, Column]:
    return equatorial_to_xyz(*ecliptic_to_equatorial(lon, lat))


def unit_vector(theta, phi, system: str = "equatorial") -> tuple[Column, Column, Column]:
    """(theta, phi) is (longitude, latitude), on the survey sphere (lambda, eta). Latitudes are clamped to +-90."""
    system = sphere(system)
    if system == "survey":
        return survey_to_xyz(clamp(column(theta), -90.0, 90.0), wrap_180(column(phi)))
    f = {"equatorial": equatorial_to_xyz, "galactic": galactic_to_xyz, "ecliptic": ecliptic_to_xyz}[system]
    return f(wrap_360(column(theta)), clamp(column(phi), -90.0, 90.0))


def with_position(df, theta, phi, system: str = "equatorial", names=("ux", "uy", "uz")):
    return df.withColumns(dict(zip(names, unit_vector(theta, phi, system), strict=True)))


# Angles back


def survey_lambda(ux="ux") -> Column:
    return -F.degrees(F.asin(clamp(column(ux))))


def survey_eta(uy="uy", uz="uz") -> Column:
    return wrap_180(F.degrees(F.atan2(column(uz), column(uy))) - ETA_POLE_DEG)


def right_ascension(ux="ux", uy="uy") -> Column:
    return wrap_360(F.degrees(F.atan2(column(uy), column(ux))) + NODE_DEG)


def declination(uz="uz") -> Column:
    return F.degrees(F.asin(clamp(column(uz))))


def galactic(ux="ux", uy="uy", uz="uz") -> tuple[Column, Column]:
    return equatorial_to_galactic(right_ascension(ux, uy), declination(uz))


def ecliptic(ux="ux", uy="uy", uz="uz") -> tuple[Column, Column]:
    return equatorial_to_ecliptic(right_ascension(ux, uy), declination(uz))


def angles(system: str, ux="ux", uy="uy", uz="uz") -> tuple[Column, Column]:
    """(longitude, latitude) on a sphere; survey: (eta, lambda)."""
    system = sphere(system)
    if system == "survey":
        return survey_eta(uy, uz), survey_lambda(ux)
    if system == "equatorial":
        return right_ascension(ux, uy), declination(uz)
    return galactic(ux, uy, uz) if system == "galactic" else ecliptic(ux, uy, uz)


# From sphere to sphere


def _turned(lon: Column, lat: Column, start: float, sin: float, cos: float, end: float) -> tuple[Column, Column]:
    """Rotation by Euler angles: longitudes are counted from `start` before and from `end` after it."""
    a, b = F.radians(lon) - start, F.radians(lat)
    across = F.cos(b) * F.sin(a)
    new_lat = F.asin(clamp(cos * F.sin(b) - sin * across))
    new_lon = F.atan2(cos * across + sin * F.sin(b), F.cos(b) * F.cos(a)) + end
    return wrap_360(F.degrees(new_lon)), F.degrees(new_lat)


def equatorial_to_galactic(ra, dec) -> tuple[Column, Column]:
    return _turned(column(ra), column(dec), GALACTIC_PHI, GALACTIC_SIN, GALACTIC_COS, GALACTIC_PSI)


def galactic_to_equatorial(lon, lat) -> tuple[Column, Column]:
    return _turned(column(lon), column(lat), GALACTIC_PSI, -GALACTIC_SIN, GALACTIC_COS, GALACTIC_PHI)


def _tilted(lon: Column, lat: Column, sign: int) -> tuple[Column, Column]:
    e = F.radians(F.lit(OBLIQUITY_DEG))
    a, b = F.radians(lon), F.radians(lat)
    new_lat = F.asin(clamp(F.sin(b) * F.cos(e) - sign * F.cos(b) * F.sin(e) * F.sin(a)))
    new_lon = F.atan2(F.sin(a) * F.cos(b) * F.cos(e) + sign * F.sin(b) * F.sin(e), F.cos(a) * F.cos(b))
    return wrap_360(F.degrees(new_lon)), F.degrees(new_lat)


def equatorial_to_ecliptic(ra, dec) -> tuple[Column, Column]:
    return _tilted(column(ra), column(dec), 1)


def ecliptic_to_equatorial(lon, lat) -> tuple[Column, Column]:
    return _tilted(column(lon), column(lat), -1)


def survey_to_equatorial(lam, eta) -> tuple[Column, Column]:
    x, y, z = survey_to_xyz(lam, eta)
    return right_ascension(x, y), declination(z)


def equatorial_to_survey(ra, dec) -> tuple[Column, Column]:
    """(lambda, eta)"""
    x, y, z = equatorial_to_xyz(ra, dec)
    return survey_lambda(x), survey_eta(y, z)


def survey_to_galactic(lam, eta) -> tuple[Column, Column]:
    return equatorial_to_galactic(*survey_to_equatorial(lam, eta))


def galactic_to_survey(lon, lat) -> tuple[Column, Column]:
    return equatorial_to_survey(*galactic_to_equatorial(lon, lat))


# Two positions: a and b are triples of columns or names


def dot(a, b) -> Column:
    """Clamped to [-1, 1]: equal vectors may have a product above 1."""
    (ax, ay, az), (bx, by, bz) = map(_vector, (a, b))
    return clamp(ax * bx + ay * by + az * bz)


def cross(a, b, parity: bool = False) -> tuple[Column, Column, Column]:
    """parity: with the second component's sign turned, a convention some tools have."""
    (ax, ay, az), (bx, by, bz) = map(_vector, (a, b))
    y = az * bx - ax * bz
    return ay * bz - az * by, -y if parity else y, ax * by - ay * bx


def _vector(v) -> tuple[Column, Column, Column]:
    return tuple(column(x) for x in v)


def norm(v) -> Column:
    x, y, z = _vector(v)
    return F.sqrt(x * x + y * y + z * z)


def angular_distance(a, b, parity: bool = False) -> Column:
    """Degrees. parity: the arc sine form, which folds angles above 90 degrees."""
    if parity:
        c = dot(a, b)
        return F.degrees(F.asin(F.sqrt(F.abs(1.0 - c * c))))
    return F.degrees(F.atan2(norm(cross(a, b)), dot(a, b)))


def great_circle(a, b) -> tuple[Column, Column, Column]:
    """Pole of the great circle through a and b."""
    v = cross(a, b)
    n = norm(v)
    return tuple(x / n for x in v)


def position_angle_sin(a_lon, b_lon) -> Column:
    return F.sin(F.radians(column(b_lon) - column(a_lon)))


def position_angle_cos(a_lon, a_lat, b_lon, b_lat) -> Column:
    p = F.radians(column(a_lat))
    return F.cos(p) * F.tan(F.radians(column(b_lat))) - F.sin(p) * F.cos(F.radians(column(b_lon) - column(a_lon)))


def position_angle(a_lon, a_lat, b_lon, b_lat) -> Column:
    """Of b seen from a, east of north, in (0, 360]."""
    angle = F.degrees(F.atan2(position_angle_sin(a_lon, b_lon), position_angle_cos(a_lon, a_lat, b_lon, b_lat)))
    return F.when(angle > TOLERANCE, angle).otherwise(angle + 360.0)


def rotate(v, axis, degrees) -> tuple[Column, Column, Column]:
    """v turned about axis in the sense of position angles (clockwise seen along the axis): Rodrigues' formula."""
    v, k = _vector(v), _vector(axis)
    t = -F.radians(column(degrees))
    c, s = F.cos(t), F.sin(t)
    along = (v[0] * k[0] + v[1] * k[1] + v[2] * k[2]) * (1.0 - c)
    kv = cross(k, v)
    return tuple(v[i] * c + kv[i] * s + k[i] * along for i in range(3))


def longitude_stretch(lat) -> Column:
    """Polynomial by which a longitude range is widened at a latitude; under-covers near the poles."""
    q = column(lat) * column(lat)
    return 1.0 + q * (0.000192312 - q * (1.82764e-08 + 1.28162e-11 * q))


# Tolerant comparisons


def lt(a, b) -> Column:
    return column(a) < column(b) - TOLERANCE


def le(a, b) -> Column:
    return column(a) <= column(b) + TOLERANCE


def gt(a, b) -> Column:
    return column(a) > column(b) + TOLERANCE


def ge(a, b) -> Column:
    return column(a) >= column(b) - TOLERANCE


def eq(a, b) -> Column:
    return F.abs(column(a) - column(b)) <= TOLERANCE
