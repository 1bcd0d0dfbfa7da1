"""Fields sampled on cells of one resolution.

A field is a DataFrame with x, y, unmasked (fraction of the cell in the map),
intensity, n_points. Kinds: 'scalar', 'density', 'sampled'; they differ in what
a mean, an over-density and a coarser cell are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from celestrum.functions import cells
from celestrum.operators import area_map
from celestrum.operators.points import PROBE, candidates, within

LEAST_UNMASKED = 1e-7
KINDS = ("scalar", "density", "sampled")


def _kind(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"no field kind {kind!r}; one of {KINDS}")
    return kind


def from_points(points: DataFrame, area: DataFrame, level: int, weight: Column) -> DataFrame:
    """Weight sums and counts of the points in each cell that the map touches; points in other cells are left out."""
    base = area_map.coverage(area, level).where(F.col("weight") > LEAST_UNMASKED).select("x", "y", F.col("weight").alias("unmasked"))
    found = cells.with_cell(points, 1 << level).groupBy("x", "y").agg(F.sum(weight).alias("intensity"), F.count("*").alias("n_points"))
    return base.join(found, ["x", "y"], "left").withColumns({"intensity": F.coalesce("intensity", F.lit(0.0)), "n_points": F.coalesce("n_points", F.lit(0))})


def cell_value(kind: str, resolution: int) -> Column:
    """What a cell contributes to the mean."""
    if _kind(kind) == "scalar":
        return F.col("intensity")
    if kind == "density":
        return F.col("intensity") / (cells.cell_area(resolution) * F.col("unmasked"))
    return F.when(F.col("n_points") > 0, F.col("intensity") / F.col("n_points")).otherwise(0.0)


def mean(field: DataFrame, kind: str, resolution: int, by: str | None = None) -> DataFrame:
    """One row with `mean`, or one for each value of `by`."""
    value = cell_value(kind, resolution)
    m = F.avg(value) if kind == "density" else F.sum(value * F.col("unmasked")) / F.sum("unmasked")
    return (field.groupBy(by) if by else field).agg(m.alias("mean"))


def over_density(field: DataFrame, kind: str, resolution: int, by: str | None = None) -> DataFrame:
    """intensity becomes its excess over the mean (of the region given by `by`, if any), for densities as a fraction."""
    m = F.broadcast(mean(field, kind, resolution, by))  # a row, or one a region
    joined = field.join(m, by) if by else field.crossJoin(m)
    if kind == "density":
        expected = F.col("mean") * F.col("unmasked") * cells.cell_area(resolution)
        value = (F.col("intensity") - expected) / expected
    else:
        value = cell_value(kind, resolution) - F.col("mean")
    return joined.withColumn("intensity", value).drop("mean")


def raw_density(field: DataFrame, mean_value: float, kind: str, resolution: int) -> DataFrame:
    """The inverse of over_density for a known mean."""
    expected = F.lit(mean_value) * F.col("unmasked") * cells.cell_area(resolution)
    value = F.col("intensity") * expected + expected if _kind(kind) == "density" else F.col("intensity") + mean_value
    return field.withColumn("intensity", value)


def resample(field: DataFrame, kind: str, level: int, to_level: int) -> DataFrame:
    """Coarser cells: means by unmasked area for scalars, sums otherwise."""
    d = level - to_level
    if d < 0:
        raise ValueError("a field can't be resampled to a finer resolution")
    intensity = F.sum(F.col("intensity") * F.col("unmasked")) / F.sum("unmasked") if _kind(kind) == "scalar" else F.sum("intensity")
    return field.groupBy(F.shiftright("x", d).alias("x"), F.shiftright("y", d).alias("y")).agg((F.sum("unmasked") / (4.0**d)).alias("unmasked"), intensity.alias("intensity"), F.sum("n_points").alias("n_points"))


def totals(field: DataFrame, resolution: int) -> DataFrame:
    return field.agg(F.count("*").alias("size"), (F.sum("unmasked") * cells.cell_area(resolution)).alias("area"), F.sum("intensity").alias("intensity"), F.sum("n_points").alias("n_points"))


def densities(field: DataFrame, resolution: int) -> DataFrame:
    """Per cell: intensity, density and point density of the unmasked area."""
    a = cells.cell_area(resolution) * F.col("unmasked")
    return field.withColumns({"density": F.col("intensity") / a, "point_density": F.col("n_points") / a})


def variance(field: DataFrame) -> Column:
    """Aggregate: weight-normalised variance of over-densities."""
    w2 = F.col("unmasked") * F.col("unmasked")
    return F.sum(F.col("intensity") * F.col("intensity") * w2) / F.sum(w2)


def covariance(a: DataFrame, b: DataFrame, by: str | None = None) -> DataFrame:
    """Of over-densities on equal cells; with by: a column of a, one row for each."""
    right = b.select("x", "y", F.col("intensity").alias("_i"), F.col("unmasked").alias("_u"))
    w = F.col("unmasked") * F.col("_u")
    joined = a.join(right, ["x", "y"])
    return (joined.groupBy(by) if by else joined).agg((F.sum(F.col("intensity") * F.col("_i") * w) / F.sum(w)).alias("covariance"), F.count("*").alias("n_cells"))


def with_errors(per_region: DataFrame, value: str) -> DataFrame:
    """Mean over regions and sqrt(sum of squared differences) / n."""
    m = F.broadcast(per_region.agg(F.avg(value).alias("_m")))
    return per_region.crossJoin(m).agg(F.first("_m").alias(value), (F.sqrt(F.sum(F.pow(F.col(value) - F.col("_m"), 2))) / F.count("*")).alias("error"))


def _centred(field: DataFrame, resolution: int) -> DataFrame:
    ux, uy, uz = cells.center_xyz(resolution)
    return field.withColumns({"ux": ux, "uy": uy, "uz": uz})


def correlate(a: DataFrame, b: DataFrame | None, resolution: int, theta_min: float, theta_max: float, regions: bool = False) -> DataFrame:
    """Sums over pairs of cells at an angle in [theta_min, theta_max): pixel_wtheta and pixel_weight. b None: a with itself, each pair once.

    Fields are over-densities. With regions both have a column region, and sums
    are by region_a and region_b.
    """
    left = _centred(a, resolution).select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("intensity").alias("ia"), F.col("unmasked").alias("wa"), *([F.col("region").alias("region_a")] if regions else []), "ux", "uy", "uz")
    right = _centred(a if b is None else b, resolution).select(F.col("x").alias("bx"), F.col("y").alias("by"), F.col("intensity").alias("ib"), F.col("unmasked").alias("wb"), *([F.col("region").alias("region_b")] if regions else []), "ux", "uy", "uz")
    near = candidates(left, right, theta_max).where(within(theta_min, theta_max))
    if b is None:
        near = near.where((F.col("by") > F.col("ay")) | (F.col("by") == F.col("ay")) & (F.col("bx") > F.col("ax")))
    w = F.col("wa") * F.col("wb")
    out = near.drop("_dot", *PROBE)
    return (out.groupBy("region_a", "region_b") if regions else out).agg(F.sum(F.col("ia") * F.col("ib") * w).alias("pixel_wtheta"), F.sum(w).alias("pixel_weight"), F.count("*").alias("n_pairs"))


def neighbourhood(points: DataFrame, field: DataFrame, by: list[str], resolution: int, theta_max: float, theta_min: float = 0.0) -> DataFrame:
    """Per point, over cells whose centre is in the annulus: local area, intensity, mean, density and point density; zeros and nulls where there are none."""
    right = _centred(field, resolution).select("x", "y", "unmasked", "intensity", "n_points", "ux", "uy", "uz")
    near = candidates(points.select(*by, "ux", "uy", "uz"), right, theta_max).where(within(theta_min, theta_max))
    a = F.sum("unmasked") * cells.cell_area(resolution)
    found = near.groupBy(*by).agg(a.alias("local_area"), F.sum("intensity").alias("local_intensity"), F.avg("intensity").alias("local_mean"), (F.sum("intensity") / a).alias("local_density"), (F.sum("n_points") / a).alias("local_point_density"))
    return points.select(*by).join(found, by, "left").withColumns({"local_area": F.coalesce("local_area", F.lit(0.0)), "local_intensity": F.coalesce("local_intensity", F.lit(0.0))})
