"""Random points over cells, maps and regions, from hashes: the same seed gives the same points on any number of executors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from celestrum.functions import cells, coords
from celestrum.functions.coords import survey_to_xyz

#: Draws of which one at least must be inside, else a bound counts as empty.
HOPELESS = 100_000_000


def uniform(seed: int, stream: int, *key) -> Column:
    """In (0, 1), a function of the key alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), *key), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def in_cells(rows: DataFrame, key: str, resolution, seed: int = 1) -> DataFrame:
    """A uniform point (ux, uy, uz) in each row's cell (x, y); resolution: a number or a Column."""
    r = F.lit(resolution) if isinstance(resolution, int) else resolution
    z = 1.0 - (F.col("y") + uniform(seed, 1, key)) * 2.0 / (r * cells.NY0)
    eta = (F.col("x") + uniform(seed, 2, key)) * 360.0 / (r * cells.NX0) + cells.ETA_OFFSET_DEG
    ux, uy, uz = survey_to_xyz(F.degrees(F.asin(z)), eta)
    return rows.withColumns({"ux": ux, "uy": uy, "uz": uz})


def over_map(area: DataFrame, n: int, seed: int = 1, weighted: bool = False) -> DataFrame:
    """id, ux, uy, uz: n points over a map, cells drawn by area, or by weight times area.

    Cells' shares of (0, 1) are summed within superpixels and then over them, so no
    window holds more than a superpixel's cells or the superpixels. A draw finds its
    superpixel among those, and its cell there.
    """
    share = cells.level_area(F.col("level")) * (F.greatest(F.col("weight"), F.lit(0.0)) if weighted else F.lit(1.0))
    own = area.select("level", "x", "y", share.alias("share"), cells.superpixnum_at(F.col("level")).alias("s"))
    within = Window.partitionBy("s").orderBy("level", "y", "x")
    own = own.withColumn("high", F.sum("share").over(within)).withColumn("low", F.col("high") - F.col("share"))
    supers = own.groupBy("s").agg(F.sum("share").alias("total"))
    over = supers.withColumn("upto", F.sum("total").over(Window.orderBy("s"))).withColumn("_all", F.sum("total").over(Window.partitionBy()))  # at most 7,488 rows
    ranges = [(r["s"], r["upto"] - r["total"], r["_all"]) for r in over.orderBy("s").collect()]
    spark = area.sparkSession
    if not ranges or not ranges[0][2]:
        return spark.createDataFrame([], "id long, ux double, uy double, uz double")
    starts = F.array(*[F.lit(float(a)) for _, a, _ in ranges])
    names = F.array(*[F.lit(int(s)) for s, _, _ in ranges])
    draws = spark.range(n).withColumn("u", uniform(seed, 3, "id") * float(ranges[0][2]))
    at = F.size(F.filter(starts, lambda a: a <= F.col("u")))
    draws = draws.withColumn("k", at).select("id", F.element_at(names, F.col("k")).alias("s"), (F.col("u") - F.element_at(starts, F.col("k"))).alias("v"))
    # Of a superpixel's cells the draw takes the last that begins at or before it: cells and draws in one order, each draw after its cell.
    cell = F.struct("level", "x", "y")
    order = Window.partitionBy("s").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ends = own.select("s", F.col("low").alias("at"), F.lit(0).alias("kind"), cell.alias("cell"), F.lit(None).cast("long").alias("id"))
    both = ends.unionByName(draws.select("s", F.col("v").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(ends.schema["cell"].dataType).alias("cell"), "id"))
    chosen = both.withColumn("c", F.last("cell", ignorenulls=True).over(order)).where("id IS NOT NULL").select("id", "c")
    resolution = F.pow(F.lit(2.0), F.col("c.level"))
    flat = chosen.select("id", F.col("c.x").alias("x"), F.col("c.y").alias("y"), resolution.alias("_r"))
    return in_cells(flat, "id", F.col("_r"), seed).select("id", "ux", "uy", "uz")


def in_bound(spark, bound, n: int, seed: int = 1) -> DataFrame:
    """id, ux, uy, uz: n points in a region, drawn in its latitude-longitude extent and kept if inside; as many draws as it takes, or an error if none of very many is."""
    lam_min, lam_max, eta_min, eta_max = bound.extent
    z0, z1 = math.sin(math.radians(lam_min)), math.sin(math.radians(lam_max))
    width = (eta_max - eta_min) % 360.0 or 360.0
    box = (z1 - z0) / 2.0 * width / 360.0 * cells.SKY_DEG2
    draws = int(n * max(1.0, box / max(bound.area, 1e-12)) * 1.2) + 100
    while True:
        rows = spark.range(draws)
        ux, uy, uz = survey_to_xyz(F.degrees(F.asin(F.lit(z0) + (z1 - z0) * uniform(seed, 4, "id"))), F.lit(eta_min) + width * uniform(seed, 5, "id"))
        out = rows.withColumns({"ux": ux, "uy": uy, "uz": uz}).where(bound.contains())
        found = out.count()
        if found >= n:
            return out.orderBy("id").limit(n)
        if not found and draws > HOPELESS:
            raise ValueError(f"none of {draws} points of its extent is in {bound}")
        draws = int(draws * min(64.0, 1.3 * n / found + 1)) if found else draws * 16


def as_arrays(points: DataFrame, system: str = "equatorial") -> tuple[np.ndarray, np.ndarray]:
    """Longitudes and latitudes (survey: lambda and eta) on the driver, for samples that fit there."""
    lon, lat = coords.angles(system)
    first = (lat, lon) if coords.sphere(system) == "survey" else (lon, lat)
    rows = points.orderBy("id").select(first[0].alias("a"), first[1].alias("b")).toPandas()
    return rows["a"].to_numpy(), rows["b"].to_numpy()


def in_quadrant(spark, circle, quadrant: int, n: int, seed: int = 1) -> DataFrame:
    """n points in a quarter of a circle, by position angle from 0 degrees on: quadrants 0 to 3."""
    from celestrum.functions.bounds import Wedge

    return in_bound(spark, Wedge(circle.theta, circle.phi, circle.radius, 90.0 * quadrant, 90.0 * (quadrant + 1), circle.system), n, seed)


def with_copied(points: DataFrame, catalog: DataFrame, columns: list[str], seed: int = 1, buckets: int = 256) -> DataFrame:
    """Each point gets the columns of a row of the catalog, drawn by hash with replacement.

    Rows are numbered within buckets of their hashes; a draw picks a bucket by the
    buckets' sizes (the only thing the driver sees) and then a row in it.
    """
    keyed = catalog.select(*columns).withColumn("_b", F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int"))
    numbered = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(*columns)))
    sizes = {r["_b"]: r["count"] for r in keyed.groupBy("_b").count().collect()}
    if not sizes:
        return points.limit(0).select("*", *[F.lit(None).cast(catalog.schema[c].dataType).alias(c) for c in columns])
    order = sorted(sizes)
    starts = [sum(sizes[b] for b in order[:k]) for k in range(len(order))]
    at = F.floor(uniform(seed, 6, "id") * sum(sizes.values())).cast("long")
    begins, names = F.array(*[F.lit(v) for v in starts]), F.array(*[F.lit(b) for b in order])
    k = F.size(F.filter(begins, lambda v: v <= F.col("_at")))
    drawn = points.withColumn("_at", at).withColumn("_k", k).withColumns({"_b": F.element_at(names, F.col("_k")), "_n": (F.col("_at") - F.element_at(begins, F.col("_k")) + 1).cast("int")})
    return drawn.join(numbered, ["_b", "_n"]).drop("_b", "_n", "_at", "_k")
