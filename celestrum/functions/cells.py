"""Equal-area longitude-latitude cells as Columns.

At resolution r (a power of two from 4 to 32768; level = log2 r) there are
36 r columns x and 13 r rows y. A cell is (level, x, y); coarser cells are
prefixes of finer ones, so containment is an equality of shifted numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from celestrum.functions.coords import ETA_POLE_DEG, clamp, column, survey_eta, survey_to_xyz

# Fixed values of the grid.
NX0, NY0 = 36, 13
ETA_OFFSET_DEG = 91.25
SUPER_RES = 4
MIN_LEVEL, MAX_LEVEL = 2, 15
SUPERPIXELS = NX0 * NY0 * SUPER_RES * SUPER_RES
SKY_DEG2 = 4.0 * math.pi * (180.0 / math.pi) ** 2
SUPERPIXEL_DEG2 = SKY_DEG2 / SUPERPIXELS


def level_of(resolution: int) -> int:
    level = resolution.bit_length() - 1
    if resolution != 1 << level or not MIN_LEVEL <= level <= MAX_LEVEL:
        raise ValueError(f"resolution {resolution} is no power of two from 4 to 32768")
    return level


def cell_area(resolution) -> float | Column:
    """Square degrees; resolution: a number or a Column."""
    if isinstance(resolution, int):
        return SUPERPIXEL_DEG2 * SUPER_RES**2 / resolution**2
    return F.lit(SUPERPIXEL_DEG2 * SUPER_RES**2) / (column(resolution) * column(resolution))


def level_area(level) -> Column:
    return F.lit(SUPERPIXEL_DEG2 * SUPER_RES**2) / F.pow(F.lit(4.0), level)


def cell_x(resolution: int, uy="uy", uz="uz") -> Column:
    e = survey_eta(uy, uz) - ETA_OFFSET_DEG
    e = F.when(e <= 0, e + 360.0).otherwise(e)
    nx = NX0 * resolution
    return F.least(F.floor(e * (nx / 360.0)), F.lit(nx - 1)).cast("long")


def cell_y(resolution: int, ux="ux") -> Column:
    ny = NY0 * resolution
    return F.greatest(F.lit(0), F.least(F.floor((1.0 + clamp(column(ux))) * (ny / 2.0)), F.lit(ny - 1))).cast("long")


def with_cell(df, resolution: int, names=("x", "y"), vector=("ux", "uy", "uz")):
    level_of(resolution)
    return df.withColumns({names[0]: cell_x(resolution, vector[1], vector[2]), names[1]: cell_y(resolution, vector[0])})


def pixnum(resolution: int, x="x", y="y") -> Column:
    return NX0 * resolution * _c(y) + _c(x)


def superpixnum(resolution: int, x="x", y="y") -> Column:
    d = level_of(resolution) - 2
    return NX0 * SUPER_RES * F.shiftright(_c(y), d) + F.shiftright(_c(x), d)


def superpixnum_at(level, x="x", y="y") -> Column:
    return F.lit(NX0 * SUPER_RES) * F.floor(_c(y) / F.pow(F.lit(2.0), level - 2)).cast("long") + F.floor(_c(x) / F.pow(F.lit(2.0), level - 2)).cast("long")


def hpixnum(resolution: int, x="x", y="y") -> Column:
    h = resolution // SUPER_RES
    return h * (_c(y) % h) + _c(x) % h


def xy_of_pixnum(resolution: int, number) -> tuple[Column, Column]:
    n = NX0 * resolution
    return _c(number) % n, F.floor(_c(number) / n).cast("long")


def xy_of_hpix(resolution, hpix, superpix) -> tuple[Column, Column]:
    """resolution: a number or a Column."""
    h = (column(resolution) / SUPER_RES).cast("long") if not isinstance(resolution, int) else F.lit(resolution // SUPER_RES).cast("long")
    hpix, superpix = _c(hpix), _c(superpix)
    n = NX0 * SUPER_RES
    return (superpix % n) * h + hpix % h, F.floor(superpix / n).cast("long") * h + F.floor(hpix / h).cast("long")


def parent(v, levels: int) -> Column:
    return F.shiftright(_c(v), levels)


def children(levels: int, x="x", y="y") -> Column:
    """Array of struct(x, y): the cells so many levels finer."""
    side = (1 << levels) - 1
    xs = F.sequence(F.shiftleft(_c(x), levels), F.shiftleft(_c(x), levels) + side)
    ys = F.sequence(F.shiftleft(_c(y), levels), F.shiftleft(_c(y), levels) + side)
    return F.flatten(F.transform(ys, lambda b: F.transform(xs, lambda a: F.struct(a.alias("x"), b.alias("y")))))


def siblings(x="x", y="y") -> Column:
    """Array of struct(x, y): the three other children of the parent."""
    other = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    fx, fy = _c(x).bitwiseXOR(F.lit(1)), _c(y).bitwiseXOR(F.lit(1))
    return F.array(other(fx, _c(y)), other(_c(x), fy), other(fx, fy))


def is_first_sibling(x="x", y="y") -> Column:
    return (_c(x) % 2 == 0) & (_c(y) % 2 == 0)


def contains_cell(levels: int, x, y, sub_x, sub_y) -> Column:
    return (parent(sub_x, levels) == _c(x)) & (parent(sub_y, levels) == _c(y))


def center(resolution: int, x="x", y="y") -> tuple[Column, Column]:
    """(lambda, eta)"""
    return edge_lambda(resolution, _c(y) + 0.5), edge_eta(resolution, _c(x) + 0.5)


def edge_lambda(resolution: int, y) -> Column:
    return F.degrees(F.asin(1.0 - column(y) * (2.0 / (NY0 * resolution))))


def edge_eta(resolution: int, x) -> Column:
    eta = column(x) * (360.0 / (NX0 * resolution)) + ETA_OFFSET_DEG
    return F.when(eta >= 180.0, eta - 360.0).otherwise(eta)


def center_xyz(resolution: int, x="x", y="y") -> tuple[Column, Column, Column]:
    return survey_to_xyz(*center(resolution, x, y))


def corners(resolution: int, x="x", y="y") -> Column:
    """Array of struct(x, y, z): upper left, upper right, lower left, lower right."""
    out = []
    for dy in (0, 1):
        for dx in (0, 1):
            # Not turned into (-180, 180]: of a corner at a pole of another sphere only rounding decides the longitude.
            a, b, c = survey_to_xyz(edge_lambda(resolution, _c(y) + dy), (_c(x) + dx) * (360.0 / (NX0 * resolution)) + ETA_OFFSET_DEG)
            out.append(F.struct(a.alias("x"), b.alias("y"), c.alias("z")))
    return F.array(*out)


def bounds(resolution: int, x="x", y="y") -> dict[str, Column]:
    """lambda_min, lambda_max, eta_min, eta_max and eta_max_continuous."""
    low, high = edge_eta(resolution, _c(x)), edge_eta(resolution, _c(x) + 1)
    return {"lambda_min": edge_lambda(resolution, _c(y) + 1), "lambda_max": edge_lambda(resolution, _c(y)), "eta_min": low, "eta_max": high, "eta_max_continuous": F.when(high > low, high).otherwise(high + 360.0)}


def reach(resolution: int, x="x", y="y") -> Column:
    """Degrees from the cell's centre to its farthest corner: no point of the cell is farther."""
    at = center_xyz(resolution, x, y)
    dots = F.transform(corners(resolution, x, y), lambda c: c["x"] * at[0] + c["y"] * at[1] + c["z"] * at[2])
    return F.degrees(F.acos(clamp(F.array_min(dots)))) * 1.000001 + 1e-9


def corner_distances(resolution: int, vector=("ux", "uy", "uz"), x="x", y="y") -> tuple[Column, Column]:
    """sin^2 of the angles to the nearest and the farthest corner."""
    ux, uy, uz = (column(v) for v in vector)
    dots = F.transform(corners(resolution, x, y), lambda c: c["x"] * ux + c["y"] * uy + c["z"] * uz)
    return 1.0 - F.pow(F.array_max(dots), 2), 1.0 - F.pow(F.array_min(dots), 2)


def _edge_dots(resolution: int, ux: Column, uy: Column, uz: Column, x="x", y="y") -> tuple[Column, Column]:
    """Cosines of the angles to the nearest and to the farthest point of the cell's two meridian edges."""
    low, high = F.radians(edge_lambda(resolution, _c(y) + 1)), F.radians(edge_lambda(resolution, _c(y)))
    nearest, farthest = [], []
    for dx in (0, 1):
        eta = F.radians(edge_eta(resolution, _c(x) + dx) + ETA_POLE_DEG)
        # The dot product with the edge's point at latitude l is size * cos(l - turn).
        across = uy * F.cos(eta) + uz * F.sin(eta)
        size, turn = F.sqrt(ux * ux + across * across), F.atan2(-ux, across)
        ends = F.cos(low - turn), F.cos(high - turn)
        nearest.append(size * F.when((turn >= low) & (turn <= high), 1.0).otherwise(F.greatest(*ends)))
        opposite = F.when(turn > 0, turn - math.pi).otherwise(turn + math.pi)
        farthest.append(size * F.when((opposite >= low) & (opposite <= high), -1.0).otherwise(F.least(*ends)))
    return F.greatest(*nearest), F.least(*farthest)


def _inside_dot(resolution: int, ux: Column, uy: Column, uz: Column, x="x", y="y") -> Column:
    """Cosine of the angle to the cell's nearest point on the position's own meridian; null if the cell isn't on it."""
    low, high = edge_lambda(resolution, _c(y) + 1), edge_lambda(resolution, _c(y))
    lam, width = -F.degrees(F.asin(clamp(ux))), 360.0 / (NX0 * resolution)
    from_edge = F.pmod(survey_eta(uy, uz) - edge_eta(resolution, _c(x)), F.lit(360.0))
    return F.when(from_edge <= width, F.cos(F.radians(lam - F.greatest(low, F.least(high, lam)))))


def distances(resolution: int, vector=("ux", "uy", "uz"), x="x", y="y") -> tuple[Column, Column]:
    """Degrees to the nearest and the farthest point of the cell (0 if the position is in it)."""
    ux, uy, uz = (column(v) for v in vector)
    near, far = _edge_dots(resolution, ux, uy, uz, x, y)
    near = F.greatest(near, F.coalesce(_inside_dot(resolution, ux, uy, uz, x, y), F.lit(-1.0)))
    # The farthest point is the one nearest to the opposite position.
    far = F.least(far, -F.coalesce(_inside_dot(resolution, -ux, -uy, -uz, x, y), F.lit(-1.0)))
    return F.degrees(F.acos(clamp(near))), F.degrees(F.acos(clamp(far)))


def annulus_relation(resolution: int, theta_min, theta_max, vector=("ux", "uy", "uz"), x="x", y="y") -> Column:
    """1 if the whole cell is at angles in [theta_min, theta_max), 0 if nothing of it is, -1 if it is cut."""
    near, far = distances(resolution, vector, x, y)
    low, high = column(theta_min), column(theta_max)
    return F.when((near >= high) | (far < low), 0).when((near >= low) & (far < high), 1).otherwise(-1)


def within_box(resolution: int, lambda_min: float, lambda_max: float, eta_min: float, eta_max: float, x="x", y="y") -> Column:
    """Whether the cell is wholly in a box of the survey sphere; eta_min above eta_max: over +-180 degrees."""
    b = bounds(resolution, x, y)
    width = 360.0 / (NX0 * resolution)
    first, wide = F.pmod(edge_eta(resolution, _c(x)) - eta_min, F.lit(360.0)), (eta_max - eta_min) % 360.0 or 360.0
    return (b["lambda_min"] >= lambda_min - 1e-9) & (b["lambda_max"] <= lambda_max + 1e-9) & (F.pmod(first + 1e-9, F.lit(360.0)) + width <= wide + 2e-9)


def meets_box(resolution: int, lambda_min: float, lambda_max: float, eta_min: float, eta_max: float, x="x", y="y") -> Column:
    """Whether the cell and a box of the survey sphere have more than an edge in common."""
    b = bounds(resolution, x, y)
    width = 360.0 / (NX0 * resolution)
    first, wide = F.pmod(edge_eta(resolution, _c(x)) - eta_min, F.lit(360.0)), (eta_max - eta_min) % 360.0 or 360.0
    return (b["lambda_max"] > lambda_min + 1e-9) & (b["lambda_min"] < lambda_max - 1e-9) & ((first < wide - 1e-9) | (first + width > 360.0 + 1e-9))


def bounds_in(system: str, resolution: int, x="x", y="y") -> dict[str, Column]:
    """lon_min, lon_max, lon_max_continuous, lat_min, lat_max of the corners on any sphere. lon_max_continuous is above lon_min for cells over the origin too."""
    at = F.transform(corners(resolution, x, y), lambda c: F.struct(*[v.alias(n) for n, v in zip(("lon", "lat"), _angles(system, c["x"], c["y"], c["z"]), strict=True)]))
    lon, lat = F.transform(at, lambda p: F.pmod(p["lon"], F.lit(360.0))), F.transform(at, lambda p: p["lat"])
    over = F.array_max(lon) - F.array_min(lon) > 180.0
    # Over the origin longitudes of its far side are a turn on.
    turned = F.when(over, F.transform(lon, lambda v: F.when(v < 180.0, v + 360.0).otherwise(v))).otherwise(lon)
    low, high = F.array_min(turned), F.array_max(turned)
    return {"lon_min": low, "lon_max": F.pmod(high, F.lit(360.0)), "lon_max_continuous": high, "lat_min": F.array_min(lat), "lat_max": F.array_max(lat)}


def _angles(system: str, ux: Column, uy: Column, uz: Column) -> tuple[Column, Column]:
    from celestrum.functions.coords import angles

    return angles(system, ux, uy, uz)


def window(resolution: int, lambda_min: float, lambda_max: float, eta_min: float, eta_max: float) -> tuple[int, int, int, int]:
    """First and last column and row that a box of the survey sphere touches; the first column is above the last if it goes over column 0."""
    nx, ny = NX0 * resolution, NY0 * resolution
    row = lambda lam: min(ny - 1, max(0, math.floor((1.0 - math.sin(math.radians(lam))) * ny / 2.0)))
    col = lambda eta: math.floor(((eta - ETA_OFFSET_DEG) % 360.0) * nx / 360.0) % nx
    return col(eta_min), col(eta_max), row(lambda_max), row(lambda_min)


def of_superpixel(resolution: int, superpixel="superpixel") -> Column:
    """Array of struct(x, y): a superpixel's cells row by row."""
    h = resolution // SUPER_RES
    first_x, first_y = _c(superpixel) % (NX0 * SUPER_RES) * h, F.floor(_c(superpixel) / (NX0 * SUPER_RES)).cast("long") * h
    return F.flatten(F.transform(F.sequence(first_y, first_y + h - 1), lambda b: F.transform(F.sequence(first_x, first_x + h - 1), lambda a: F.struct(a.alias("x"), b.alias("y")))))


def next_cell(resolution: int, x="x", y="y") -> tuple[Column, Column]:
    """The cell after this one, row by row over the sky; null after the last."""
    nx, ny = NX0 * resolution, NY0 * resolution
    last = _c(x) + 1 == nx
    return F.when(~last, _c(x) + 1).when(_c(y) + 1 < ny, 0), F.when(~last, _c(y)).when(_c(y) + 1 < ny, _c(y) + 1)


def local_order(level="level", x="x", y="y") -> list[Column]:
    """Coarser cells first, then by row and column."""
    return [_c(level), _c(y), _c(x)]


def superpixel_order(level="level", x="x", y="y") -> list[Column]:
    """By superpixel, then coarser cells first, then by number in the superpixel."""
    h = F.pow(F.lit(2.0), _c(level) - 2).cast("long")
    return [superpixnum_at(_c(level), x, y), _c(level), h * (_c(y) % h) + _c(x) % h]


def stripe(resolution: int, x="x") -> Column:
    """Number of the stripe of columns, 10 at eta = -32.5 degrees."""
    eta, width = edge_eta(resolution, _c(x) + 0.5), 360.0 / (NX0 * resolution)
    first = ((eta + ETA_POLE_DEG) / width).cast("int") + 10
    middle = width * (first - 10) - ETA_POLE_DEG
    number = first + F.when(eta < middle - width / 2 + 1e-7, 1).otherwise(0) + F.when(eta > middle + width / 2 - 1e-7, 1).otherwise(0)
    return F.when(number < 0, number + NX0 * resolution).otherwise(number).cast("long")


def rows_within(resolution: int, theta, ux="ux") -> tuple[Column, Column]:
    """First and last row that a circle of radius theta degrees can reach."""
    lam = -F.degrees(F.asin(clamp(column(ux))))
    ny = NY0 * resolution
    at = lambda lat: (1.0 - F.sin(F.radians(clamp(lat, -90.0, 90.0)))) * (ny / 2.0)
    low = F.greatest(F.lit(0), F.floor(at(lam + column(theta)) - 1e-6)).cast("long")
    high = F.least(F.lit(ny - 1), F.floor(at(lam - column(theta)) + 1e-6)).cast("long")
    return low, high


def half_width(theta, lam) -> Column:
    """Half the range of eta, in degrees, of a circle of radius theta about latitude lambda; 180 if it holds a pole."""
    reach = F.abs(column(lam)) + column(theta)
    return F.when(reach >= 90.0 - 1e-9, F.lit(180.0)).otherwise(F.degrees(F.asin(clamp(F.sin(F.radians(column(theta))) / F.cos(F.radians(column(lam)))))))


def cover(df, resolution: int, theta, names=("cx", "cy"), vector=("ux", "uy", "uz")):
    """A row for each cell that a circle of radius theta degrees about the position can touch; cells may lie outside. No cell is left out."""
    nx = NX0 * resolution
    low, high = rows_within(resolution, theta, vector[0])
    eta = survey_eta(vector[1], vector[2]) - ETA_OFFSET_DEG
    half = half_width(theta, -F.degrees(F.asin(clamp(column(vector[0])))))
    first = F.floor((eta - half) * (nx / 360.0) - 1e-6).cast("long")
    last = F.floor((eta + half) * (nx / 360.0) + 1e-6).cast("long")
    span = F.least(last - first, F.lit(nx - 1))
    return df.withColumn(names[1], F.explode(F.sequence(low, high))).withColumn(names[0], F.explode(F.transform(F.sequence(first, first + span), lambda v: F.pmod(v, F.lit(nx)))))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)
