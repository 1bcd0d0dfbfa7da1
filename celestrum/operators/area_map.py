"""Maps: sets of cells of several resolutions with weights.

A map is a DataFrame with level, x, y, weight in which no cell lies in another.
Operations are equi-joins on ancestors: a cell has at most 13.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from celestrum.functions import cells
from celestrum.sources import scratch

KEY = ["level", "x", "y"]
WEIGHT_TOLERANCE = 1e-6


def _up(v: str, by) -> Column:
    return F.floor(F.col(v) / F.pow(F.lit(2.0), by)).cast("long")


def ancestors(df: DataFrame, names=("a_level", "a_x", "a_y"), own: bool = True) -> DataFrame:
    """A row for each cell that holds the row's cell, itself included unless own is false."""
    last = F.col("level") if own else F.col("level") - 1
    levels = F.when(last >= cells.MIN_LEVEL, F.sequence(F.lit(cells.MIN_LEVEL), last)).otherwise(F.array().cast("array<int>"))
    out = df.withColumn(names[0], F.explode(levels.cast("array<int>")))
    return out.withColumns({names[1]: _up("x", F.col("level") - F.col(names[0])), names[2]: _up("y", F.col("level") - F.col(names[0]))})


def resolve(df: DataFrame, merge: bool = True) -> DataFrame:
    """A proper map of any cells: equal cells become one with the mean weight, cells inside others go, and four siblings of equal weight become their parent.

    Each step is one aggregation a level, fine to coarse; there are at most 13.
    """
    cells_ = df.groupBy(*KEY).agg(F.avg("weight").alias("weight"))
    inside = ancestors(cells_, own=False).join(cells_.select(F.col("level").alias("a_level"), F.col("x").alias("a_x"), F.col("y").alias("a_y")), ["a_level", "a_x", "a_y"], "left_semi").select(*KEY)
    out = cells_.join(inside.distinct(), KEY, "left_anti")
    return merge_siblings(out) if merge else out


def merge_siblings(df: DataFrame) -> DataFrame:
    """Cells of equal weight that fill a coarser cell become it, the coarsest there is.

    Of every cell that holds some, the shares held are summed (powers of a quarter, so sums are exact): two shuffles whatever the levels.
    """
    at = ["a_level", "a_x", "a_y"]
    up = ancestors(df.select(*KEY, "weight"))
    full = up.groupBy(*at).agg(F.sum(F.pow(F.lit(0.25), F.col("level") - F.col("a_level"))).alias("_share"), (F.max("weight") - F.min("weight")).alias("_spread"), F.min("weight").alias("_least"))
    full = full.where((F.col("_share") > 1 - 1e-12) & (F.col("_spread") < WEIGHT_TOLERANCE))
    best = up.join(full, at).groupBy(*KEY).agg(F.min(F.struct(*at, "_least")).alias("b"))
    return best.select(F.col("b.a_level").alias("level"), F.col("b.a_x").alias("x"), F.col("b.a_y").alias("y"), F.col("b._least").alias("weight")).distinct()


def find_location(points: DataFrame, area: DataFrame, level: int, how: str = "left") -> DataFrame:
    """points' columns and map_weight of the coarsest cell that holds the point (null outside; how='left_semi': those inside only).

    level: the map's finest. Points have ux, uy, uz. The different cells of the points are looked up once, at all the
    map's levels together, and joined back: as many shuffles for one level as for fourteen.
    """
    keyed = area.select(F.col("level").alias("a_level"), F.col("x").alias("a_x"), F.col("y").alias("a_y"), F.col("weight").alias("map_weight"))
    levels = sorted(r[0] for r in area.select("level").distinct().collect())  # at most 14
    spot = cells.with_cell(points, 1 << level, ("_x", "_y"))
    some = spot.select("_x", "_y").distinct().withColumn("a_level", F.explode(F.array(*[F.lit(a) for a in levels]).cast("array<int>")))
    some = some.withColumns({"a_x": _up("_x", F.lit(level) - F.col("a_level")), "a_y": _up("_y", F.lit(level) - F.col("a_level"))})
    found = some.join(keyed, ["a_level", "a_x", "a_y"]).groupBy("_x", "_y").agg(F.min(F.struct("a_level", "map_weight")).alias("_m"))
    found = found.select("_x", "_y", F.col("_m.map_weight").alias("map_weight"))
    if how == "left_semi":
        return spot.join(found, ["_x", "_y"], "left_semi").select(*points.columns)
    return spot.join(found, ["_x", "_y"], "left").select(*points.columns, "map_weight")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """The common area as cells (the smaller of each pair) with weights wa and wb."""
    wa = a.select(*KEY, F.col("weight").alias("wa"))
    wb = b.select(*KEY, F.col("weight").alias("wb"))
    rename = {"level": "a_level", "x": "a_x", "y": "a_y"}
    at = ["a_level", "a_x", "a_y"]
    fine_a = ancestors(wa).join(wb.withColumnsRenamed(rename), at).select(*KEY, "wa", "wb")
    fine_b = ancestors(wb, own=False).join(wa.withColumnsRenamed(rename), at).select(*KEY, "wa", "wb")
    return fine_a.unionByName(fine_b)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return overlap(a, b).select(*KEY, F.col("wa").alias("weight"))


def imprint(a: DataFrame, b: DataFrame) -> DataFrame:
    """The intersection with the weights of b."""
    return overlap(a, b).select(*KEY, F.col("wb").alias("weight"))


def ingest(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union; where both have the same cell, the mean weight, and where one's cell lies in the other's, the larger cell."""
    return resolve(a.select(*KEY, "weight").unionByName(b.select(*KEY, "weight")))


def exclude(a: DataFrame, b: DataFrame) -> DataFrame:
    """What of a is not in b. A cell of a that b covers in part is divided as far as it must be.

    What is left of it are the children, clear of b, of those cells in it that hold some of b: all are found at once, not level by level.
    """
    at = ["a_level", "a_x", "a_y"]
    back = {"a_level": "level", "a_x": "x", "a_y": "y"}
    cover = b.select(F.col("level").alias("a_level"), F.col("x").alias("a_x"), F.col("y").alias("a_y")).distinct()
    inside = ancestors(a.select(*KEY)).join(cover, at, "left_semi").select(*KEY).distinct()
    left = a.select(*KEY, "weight").join(inside, KEY, "left_anti")
    holders = ancestors(b.select(*KEY), own=False).select(*at).distinct().withColumnsRenamed(back)
    touched = holders.unionByName(cover.withColumnsRenamed(back)).distinct()
    parts = ancestors(holders).join(left.withColumnsRenamed({"level": "a_level", "x": "a_x", "y": "a_y"}), at).select(*KEY, "weight")
    pieces = parts.select((F.col("level") + 1).alias("level"), F.explode(cells.children(1)).alias("c"), "weight").select("level", "c.x", "c.y", "weight").join(touched, KEY, "left_anti")
    return left.join(holders, KEY, "left_anti").unionByName(pieces)


def combine(a: DataFrame, b: DataFrame, f, drop_single: bool = True) -> DataFrame:
    """f(wa, wb) on the common area; the rest of both keeps its weights unless dropped."""
    out = overlap(a, b).select(*KEY, f(F.col("wa"), F.col("wb")).alias("weight"))
    return out if drop_single else out.unionByName(exclude(a, b)).unionByName(exclude(b, a))


def add(a: DataFrame, b: DataFrame, drop_single: bool = True) -> DataFrame:
    return combine(a, b, lambda u, v: u + v, drop_single)


def multiply(a: DataFrame, b: DataFrame, drop_single: bool = True) -> DataFrame:
    return combine(a, b, lambda u, v: u * v, drop_single)


def scale_weight(a: DataFrame, factor: float) -> DataFrame:
    return a.withColumn("weight", F.col("weight") * factor)


def add_constant_weight(a: DataFrame, term: float) -> DataFrame:
    return a.withColumn("weight", F.col("weight") + term)


def invert_weight(a: DataFrame) -> DataFrame:
    """1 / weight, 0 where it is below 1e-15 in size."""
    return a.withColumn("weight", F.when(F.abs("weight") < 1e-15, 0.0).otherwise(1.0 / F.col("weight")))


def weight_range(a: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    out = a if low is None else a.where(F.col("weight") >= low)
    return out if high is None else out.where(F.col("weight") <= high)


def summary(a: DataFrame, by: str | None = None) -> DataFrame:
    """size, area, levels, weights, mean weight by area; of the whole, or by a column."""
    area = cells.level_area(F.col("level"))
    agg = [F.count("*").alias("size"), F.sum(area).alias("area"), F.min("level").alias("min_level"), F.max("level").alias("max_level"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"), (F.sum(F.col("weight") * area) / F.sum(area)).alias("mean_weight")]
    return (a.groupBy(by) if by else a).agg(*agg)


def by_superpixel(a: DataFrame) -> DataFrame:
    """size and area by superpixel and, with superpixel null, of the whole: one rollup."""
    keyed = a.withColumn("superpixel", cells.superpixnum_at(F.col("level")))
    return keyed.rollup("superpixel").agg(F.count("*").alias("size"), F.sum(cells.level_area(F.col("level"))).alias("area"))


def coverage(a: DataFrame, level: int) -> DataFrame:
    """Cells of one level that the map touches, weight: the fraction of each that it holds."""
    fine = a.where(F.col("level") >= level).select(_up("x", F.col("level") - level).alias("x"), _up("y", F.col("level") - level).alias("y"), F.pow(F.lit(0.25), F.col("level") - level).alias("f"))
    side = F.pow(F.lit(2.0), level - F.col("level")).cast("long")
    coarse = a.where(F.col("level") < level)
    xs = F.sequence(F.col("x") * side, (F.col("x") + 1) * side - 1)
    ys = F.sequence(F.col("y") * side, (F.col("y") + 1) * side - 1)
    coarse = coarse.select(F.explode(xs).alias("x"), ys.alias("_ys")).select("x", F.explode("_ys").alias("y"), F.lit(1.0).alias("f"))
    return fine.unionByName(coarse).groupBy("x", "y").agg(F.sum("f").alias("weight")).select(F.lit(level).alias("level"), "x", "y", "weight")


def soften(a: DataFrame, level: int, average: bool = True) -> DataFrame:
    """No cell finer than level: finer ones become their ancestor there, with the mean weight by area, or the fraction of it that the map holds."""
    fine = a.where(F.col("level") > level).select(_up("x", F.col("level") - level).alias("x"), _up("y", F.col("level") - level).alias("y"), "weight", F.pow(F.lit(0.25), F.col("level") - level).alias("f"))
    value = F.sum(F.col("weight") * F.col("f")) / F.sum("f") if average else F.sum("f")
    soft = fine.groupBy("x", "y").agg(value.alias("weight")).select(F.lit(level).alias("level"), "x", "y", "weight")
    return a.where(F.col("level") <= level).select(*KEY, "weight").unionByName(soft)


def covering(a: DataFrame, most: int) -> DataFrame:
    """Cells of one level that hold the map, at the finest level at which they are at most `most` (the coarsest if none is)."""
    out = coverage(a, cells.MIN_LEVEL)
    for level in range(cells.MIN_LEVEL, cells.MAX_LEVEL + 1):
        # A finer level has at least as many cells, and at most four times as many.
        finer = coverage(a, level)
        if finer.count() > most:
            break
        out = finer
    return out


def status(some: DataFrame, area: DataFrame) -> DataFrame:
    """some's cells with unmasked (the fraction in the map), mean_weight there (null outside) and status: 1 inside, 0 outside, -1 partly."""
    both = overlap(some.select(*KEY).withColumn("weight", F.lit(0.0)), area.select(*KEY, "weight"))
    up = ancestors(both).join(some.select(F.col("level").alias("a_level"), F.col("x").alias("a_x"), F.col("y").alias("a_y")).distinct(), ["a_level", "a_x", "a_y"])
    share = F.pow(F.lit(0.25), F.col("level") - F.col("a_level"))
    found = up.groupBy("a_level", "a_x", "a_y").agg(F.sum(share).alias("unmasked"), (F.sum(share * F.col("wb")) / F.sum(share)).alias("mean_weight"))
    out = some.select(*KEY).join(found.withColumnsRenamed({"a_level": "level", "a_x": "x", "a_y": "y"}), KEY, "left").withColumn("unmasked", F.coalesce("unmasked", F.lit(0.0)))
    return out.withColumn("status", F.when(F.col("unmasked") > 1 - 1e-9, 1).when(F.col("unmasked") > 0, -1).otherwise(0))


def _around(bound) -> tuple[float, float, float, float]:
    """The bound's extent, or that of a circle around it where the shape itself has none."""
    from celestrum.functions import bounds

    if isinstance(bound, bounds.LatLonBox):
        wide = (bound.lon_max - bound.lon_min) % 360.0
        return bounds.Circle(bound.lon_min + wide / 2, (bound.lat_min + bound.lat_max) / 2, min(180.0, (bound.lat_max - bound.lat_min + wide) / 2), bound.system).extent
    return bound.extent


def _level_of_area(area: float) -> int:
    """The coarsest level whose cells have less than a hundredth of the area."""
    level = cells.MIN_LEVEL
    while level < cells.MAX_LEVEL and area <= 100.0 * cells.cell_area(1 << level):
        level += 1
    return level


def _probes() -> tuple[Column, float]:
    """Offsets in the cell and weights of the probe points: centre, then the middle ring, the sides and the corners."""
    ring = [(0.5, 0.5, 4)] + [(x, y, 3) for x, y in ((0.25, 0.25), (0.75, 0.25), (0.25, 0.75), (0.75, 0.75))] + [(x, y, 3) for x, y in ((0.5, 0.25), (0.5, 0.75), (0.25, 0.5), (0.75, 0.5))] + [(x, y, 2) for x, y in ((0.5, 0.0), (0.5, 1.0), (0.0, 0.5), (1.0, 0.5))] + [(x, y, 1) for x, y in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0))]
    whole = float(sum(w for *_, w in ring))
    return F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(w / whole).alias("w")) for dx, dy, w in ring]), whole


def pixelize(spark, bound, level: int, start: int = 4, weight: float = 1.0, top_up: bool = False) -> DataFrame:
    """The region as a map of cells down to `level`: cells whose 17 probe points are all inside are kept, others divided as long as the bound may touch them; at the last level those with most of their score inside stay.

    Whether a bound may touch a cell follows from its distance to the cell's centre (`may_touch`), so nothing that lies between
    probe points is lost; for a bound that can't tell, cells without a probe point inside are left from two levels below
    the start on, which is a finer one the smaller the bound is. With top_up the last level's cells are taken by falling score as long
    as the map's area stays within the bound's, whole classes of equal scores at a time (scores have some dozens of values).
    """
    from celestrum.functions.coords import survey_to_xyz

    lam_min, lam_max, eta_min, eta_max = _around(bound)
    knows = bound.may_touch(F.lit(0.0)) is not None
    by_area = min(level, _level_of_area(bound.area))
    small = by_area > start and (lam_min, lam_max, eta_min, eta_max) != (-90.0, 90.0, -180.0, 180.0)
    start = min(level, by_area if small else start)
    nx, ny = cells.NX0 << start, cells.NY0 << start
    now = spark.range(ny).select(F.col("id").alias("y")).where((cells.edge_lambda(1 << start, F.col("y") + 1) <= lam_max) & (cells.edge_lambda(1 << start, F.col("y")) >= lam_min)).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nx - 1).cast("long")))).withColumn("level", F.lit(start))
    if small and eta_max - eta_min != 360.0:
        half = 180.0 / nx + 1e-9
        now = now.where(F.pmod(cells.edge_eta(1 << start, F.col("x") + 0.5) - eta_min + half, F.lit(360.0)) <= (eta_max - eta_min) % 360.0 + 2 * half)
    out, last = None, None
    probes, _ = _probes()
    for at in range(start, level + 1):
        if knows:
            now = now.where(bound.may_touch(cells.reach(1 << at), cells.center_xyz(1 << at)))

        def inside(p, at=at):
            v = survey_to_xyz(cells.edge_lambda(1 << at, F.col("y") + p["dy"]), cells.edge_eta(1 << at, F.col("x") + p["dx"]))
            return F.when(bound.contains(v), p["w"]).otherwise(0.0)

        # A table for each level, so none is computed again for the finer ones.
        now = scratch.written(now.withColumn("score", F.aggregate(probes, F.lit(0.0), lambda sums, p: sums + inside(p))), "cells")  # noqa: B023
        if at == level:
            last = now.where(F.col("score") > 0) if top_up else now.where(F.col("score") >= 0.5)
            break
        keep = F.col("score") > 1 - 1e-9
        kept = now.where(keep).select("level", "x", "y")
        out = kept if out is None else out.unionByName(kept)
        divide = ~keep if knows or at <= start + 1 else (F.col("score") > 0) & ~keep
        now = now.where(divide).select((F.col("level") + 1).alias("level"), F.explode(cells.children(1)).alias("c")).select("level", "c.x", "c.y")
    if top_up:
        done = 0.0 if out is None else out.agg(F.sum(cells.level_area(F.col("level")))).first()[0] or 0.0
        least = 2.0
        for r in last.groupBy(F.round("score", 9).alias("s")).count().orderBy(F.desc("s")).collect():  # some dozens of rows
            done += r["count"] * cells.cell_area(1 << level)
            if done > bound.area + cells.cell_area(1 << level) / 2:
                break
            least = r["s"]
        last = last.where(F.col("score") >= least - 1e-9)
    last = last.select("level", "x", "y")
    return (last if out is None else out.unionByName(last)).withColumn("weight", F.lit(weight))


def expand(a: DataFrame, level: int) -> DataFrame:
    """The map's cells divided down to one level, none of them finer: x, y, weight."""
    side = F.pow(F.lit(2.0), level - F.col("level")).cast("long")
    xs = F.sequence(F.col("x") * side, (F.col("x") + 1) * side - 1)
    ys = F.sequence(F.col("y") * side, (F.col("y") + 1) * side - 1)
    return a.select(F.explode(xs).alias("x"), ys.alias("_ys"), "weight").select("x", F.explode("_ys").alias("y"), "weight")


def dump(a: DataFrame, level: int, superpixel: int | None = None) -> DataFrame:
    """The map's cells at one level, none of the map's finer, of one superpixel or all: superpixel, hpixel, weight in the order of both."""
    fine = expand(a, level)
    r = 1 << level
    out = fine.select(cells.superpixnum(r).alias("superpixel"), cells.hpixnum(r).alias("hpixel"), "weight")
    return out if superpixel is None else out.where(F.col("superpixel") == superpixel)


def clear(a: DataFrame) -> DataFrame:
    return a.limit(0)


def occupied_superpixels(a: DataFrame) -> DataFrame:
    """superpixel, area of those that the map has area in."""
    return a.groupBy(cells.superpixnum_at(F.col("level")).alias("superpixel")).agg(F.sum(cells.level_area(F.col("level"))).alias("area"))


def same_geometry(a: DataFrame, b: DataFrame, weights: bool = False) -> bool:
    """Whether two maps, resolved, have the same cells (and weights up to the tolerance)."""
    left, right = a.select(*KEY, F.col("weight").alias("_wa")), b.select(*KEY, F.col("weight").alias("_wb"))
    far = F.col("_wa").isNull() | F.col("_wb").isNull()
    if weights:
        far = far | (F.abs(F.col("_wa") - F.col("_wb")) >= WEIGHT_TOLERANCE)
    return left.join(right, KEY, "full").where(far).isEmpty()
