"""Joins of point catalogs by angle.

A catalog has columns ux, uy, uz (see functions.coords) and any others. Range
joins are equi-joins on cells: each probe is sent to the cells its circle can
touch, each target to its own cell, and the dot product decides. The cell size
follows the radius, so a probe touches a few dozen cells whatever the radius;
AQE splits cells that hold much.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from celestrum.functions import cells, coords
from celestrum.functions.coords import TOLERANCE
from celestrum.sources import scratch

XYZ = ("ux", "uy", "uz")
PROBE = ("_px", "_py", "_pz")
#: Pairs that are summed as rows.
FEW = 10_000_000


def resolution_for(theta_max: float) -> int:
    """The finest resolution whose cells are about as wide as the radius: few cells for each probe, few targets in each."""
    wanted = 360.0 / cells.NX0 / max(theta_max, 1e-6)
    return 1 << max(cells.MIN_LEVEL, min(cells.MAX_LEVEL, int(math.floor(math.log2(max(wanted, 1.0))))))


def candidates(probes: DataFrame, targets: DataFrame, theta_max, resolution: int | None = None) -> DataFrame:
    """Pairs of probes' and targets' rows that share a cell, with `_dot`. theta_max: degrees, a number or a column of probes (give the resolution then).

    Probes keep their names, but their position is in _px, _py, _pz; other names must differ.
    """
    resolution = resolution or resolution_for(theta_max)
    left = cells.cover(probes, resolution, theta_max, ("_cx", "_cy"))
    left = left.withColumnsRenamed(dict(zip(XYZ, PROBE, strict=True)))
    right = cells.with_cell(targets, resolution, ("_cx", "_cy"))
    return left.join(right, ["_cx", "_cy"]).drop("_cx", "_cy").withColumn("_dot", coords.dot(PROBE, XYZ))


def within(theta_min: float, theta_max: float, parity: bool = False) -> Column:
    """_dot is in [theta_min, theta_max); parity: both ends are in."""
    low, high = math.cos(math.radians(theta_max)), math.cos(math.radians(theta_min))
    near = F.lit(True) if theta_min <= 0 else F.col("_dot") <= high + TOLERANCE
    far = F.col("_dot") >= low - TOLERANCE if parity else F.col("_dot") > low + TOLERANCE
    return near & far


def pairs(probes: DataFrame, targets: DataFrame, theta_max: float, theta_min: float = 0.0, parity: bool = False, separation: bool = False) -> DataFrame:
    """All pairs at an angle in [theta_min, theta_max); with separation, degrees too."""
    out = candidates(probes, targets, theta_max).where(within(theta_min, theta_max, parity))
    if separation:
        out = out.withColumn("separation", coords.angular_distance(PROBE, XYZ))
    return out.drop("_dot", *PROBE)


def count_pairs(probes: DataFrame, targets: DataFrame, by: list[str], theta_max: float, theta_min: float = 0.0, sums: dict[str, Column] | None = None) -> DataFrame:
    """Per probe (columns `by`): n_pairs, and sums of expressions over its pairs. Probes without pairs have 0 and nulls.

    With sums each pair is a row of a join; without, and for sums of one column of the targets (weigh_pairs), none is.
    """
    if not sums:
        from celestrum.operators import blocks

        found = blocks.counted(probes.select(*by, *XYZ), targets.select(*XYZ), by, theta_max, theta_min).drop("weight")
        return probes.select(*by).join(found, by, "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
    made = [F.sum(e).alias(n) for n, e in sums.items()]
    found = pairs(probes, targets, theta_max, theta_min).groupBy(*by).agg(F.count("*").alias("n_pairs"), *made)
    return probes.select(*by).join(found, by, "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))


def weigh_pairs(probes: DataFrame, targets: DataFrame, by: list[str], theta_max: float, theta_min: float = 0.0, factor: str | None = None) -> DataFrame:
    """Per probe (columns `by`): n_pairs, weight: the sum of its targets' column weight, and product: that of its own column `factor` with theirs. Probes without pairs have 0 and nulls.

    Up to FEW pairs, as expected of even catalogs, are rows of a join, so their sums are
    rounded as those of SQL are; more are counted by blocks, and are no rows.
    """
    from celestrum.operators import blocks

    share = (1.0 - math.cos(math.radians(min(180.0, theta_max)))) / 2.0
    if probes.count() * targets.count() * share <= FEW:
        sums = {"weight": F.col("_weight"), **({"product": F.col(factor) * F.col("_weight")} if factor else {})}
        return count_pairs(probes.select(*dict.fromkeys([*by, *([factor] if factor else []), *XYZ])), targets.select(*XYZ, F.col("weight").alias("_weight")), by, theta_max, theta_min, sums)
    kept = list(dict.fromkeys([*by, *([factor] if factor else [])]))
    found = blocks.counted(probes.select(*kept, *XYZ), targets.select(*XYZ, "weight"), kept, theta_max, theta_min)
    made = found.groupBy(*by).agg(F.sum("n_pairs").alias("n_pairs"), F.sum("weight").alias("weight"), *([F.sum(F.col(factor) * F.col("weight")).alias("product")] if factor else []))
    return probes.select(*by).join(made, by, "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))


def binned_pairs(probes: DataFrame, targets: DataFrame, edges: list[float], weight: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """bin, n_pairs, weight (of pairs) for the bins [edges[k], edges[k + 1]), and for each value of `by`.

    One join for each group of bins within a factor of four: a wide bin's large cells would flood a narrow one's.
    """
    weight = F.lit(1.0) if weight is None else weight
    out, k = None, 0
    while k < len(edges) - 1:
        j = k + 1
        while j < len(edges) - 1 and edges[j + 1] <= 4 * edges[k + 1]:
            j += 1
        bounds = [math.cos(math.radians(e)) for e in edges[k : j + 1]]
        number = F.lit(None).cast("int")
        for b in range(len(bounds) - 1):
            near = F.lit(True) if edges[k + b] <= 0 else F.col("_dot") <= bounds[b] + TOLERANCE
            number = F.when(near & (F.col("_dot") > bounds[b + 1] + TOLERANCE), k + b).otherwise(number)
        part = candidates(probes, targets, edges[j]).withColumn("bin", number).where(F.col("bin").isNotNull()).groupBy("bin", *(by or [])).agg(F.count("*").alias("n_pairs"), F.sum(weight).alias("weight"))
        out = part if out is None else out.unionByName(part)
        k = j
    return out


def count_within(probes: DataFrame, targets: DataFrame, by: list[str], radius: Column, largest: float) -> DataFrame:
    """n_pairs per probe, each with a radius of its own in degrees, none above `largest`."""
    from celestrum.operators import blocks

    own = probes.select(*by, *XYZ, F.least(radius, F.lit(largest)).cast("double").alias("own"))
    found = blocks.counted(own.where("own > 0"), targets.select(*XYZ), by, None).drop("weight")
    return probes.select(*by).join(found, by, "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))


def closest_match(probes: DataFrame, targets: DataFrame, by: list[str], target_id: str, theta_max: float) -> DataFrame:
    """The nearest target within theta_max of each probe, null if there is none; ties go to the smaller id."""
    near = _nearest(probes, _to_find(targets, target_id), by, target_id, 1, theta_max).withColumn("_angle", F.round(coords.angular_distance(PROBE, XYZ), 12))
    best = near.groupBy(*by).agg(F.min(F.struct("_angle", target_id)).alias("_best")).select(*by, F.col(f"_best.{target_id}").alias(target_id), F.col("_best._angle").alias("separation"))
    return probes.select(*by).join(best, by, "left")


def _to_find(targets: DataFrame, target_id: str) -> tuple[DataFrame, list]:
    """Blocks of targets, and the type of what is kept."""
    from celestrum.operators import blocks

    return blocks.of_points(targets, [target_id]), targets.select(target_id).schema.fields


def _nearest(probes: DataFrame, found: tuple[DataFrame, list], by: list[str], target_id: str, k: int, theta: float) -> DataFrame:
    """by, target_id and both positions: the k nearest targets of each probe within theta degrees, some others, and all that may be as near as the k-th."""
    from celestrum.operators import blocks

    targets, kept = found
    fields = StructType([*probes.select(*by).schema.fields, *kept])
    return blocks.nearest(blocks.of_points(probes, by), targets, fields, k, theta)


def k_nearest(probes: DataFrame, targets: DataFrame, by: list[str], target_id: str, k: int, start: float | None = None) -> DataFrame:
    """The k nearest targets of each probe: by, rank (from 1, nearest first), target_id, separation.

    Rings grow until each probe has k targets (or all, if they are fewer) within its
    ring, which certifies them; a ring as wide as the sky holds all. Rounds are few:
    the radius doubles. A block of targets gives k of each probe, not all in the ring.
    """
    n = targets.count()
    k = min(k, n)
    if start is None:
        start = min(180.0, 2.0 * math.degrees(math.acos(max(-1.0, 1.0 - 2.0 * min(1.0, (k + 1) / max(1, n))))))
    rank = Window.partitionBy(*by).orderBy("separation", target_id)
    open_, out, radius, held = probes, None, start, _to_find(targets, target_id)
    while True:
        near = _nearest(open_, held, by, target_id, k, radius).withColumn("separation", F.round(coords.angular_distance(PROBE, XYZ), 9))
        ranked = near.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select(*by, "rank", target_id, "separation")
        if radius >= 180.0 or n == 0:
            return ranked if out is None else out.unionByName(ranked)
        # Each round is a table, so the next ones don't compute it again.
        ranked = scratch.written(ranked, "nearest")
        full = ranked.where(F.col("rank") == k).select(*by)
        done = ranked.join(full, by, "left_semi")
        out = done if out is None else out.unionByName(done)
        open_ = scratch.written(open_.join(full, by, "left_anti"), "open")
        if open_.isEmpty():
            return out
        radius = min(180.0, 2.0 * radius)


def within_cells(points: DataFrame, some_cells: DataFrame, resolution: int, weight: Column | None = None) -> DataFrame:
    """n_points and weight of the points in each cell (x, y) of one resolution."""
    weight = F.lit(1.0) if weight is None else weight
    found = cells.with_cell(points, resolution).groupBy("x", "y").agg(F.count("*").alias("n_points"), F.sum(weight).alias("weight"))
    return some_cells.join(found, ["x", "y"], "left").withColumns({"n_points": F.coalesce("n_points", F.lit(0)), "weight": F.coalesce("weight", F.lit(0.0))})


def tree_summary(points: DataFrame, resolution: int) -> DataFrame:
    """One row: occupied cells of the base resolution, points, their weight (column weight) and the area of the cells."""
    base = cells.with_cell(points, resolution).groupBy("x", "y").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    return base.agg(F.count("*").alias("base_nodes"), F.sum("n").alias("n_points"), F.sum("w").alias("weight"), (F.count("*") * cells.cell_area(resolution)).alias("area"))


def footprint(points: DataFrame, resolution: int) -> DataFrame:
    """Cells that hold points, as a map: level, x, y, weight 1."""
    return cells.with_cell(points, resolution).select(F.lit(cells.level_of(resolution)).alias("level"), "x", "y").distinct().withColumn("weight", F.lit(1.0))


def projected_pairs(probes: DataFrame, targets: DataFrame, cosmology, redshift: str, edges: list[float]) -> DataFrame:
    """bin, n_pairs by projected radius, r = angle * angular diameter distance of the probe's redshift; edges in distance units."""
    from celestrum.operators import blocks

    distance = cosmology.angular_diameter_distance(redshift)
    # Degrees of a unit of distance: a probe's edges are multiples of it.
    own = F.when(distance > 0, F.degrees(1.0 / F.when(distance > 0, distance))).when(distance == 0, F.lit(float("inf")))
    left = probes.select(*XYZ, F.lit(1.0).alias("weight"), own.alias("own")).where("own IS NOT NULL AND NOT isnan(own)")
    made = blocks.pairs_of_blocks(blocks.of_catalog(left, scale=float(edges[-1])), blocks.of_catalog(targets.select(*XYZ, F.lit(1.0).alias("weight"))), edges, own=True)
    return made.groupBy("bin").agg(F.sum("n_pairs").alias("n_pairs"))
