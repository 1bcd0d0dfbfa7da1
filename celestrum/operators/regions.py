"""Regions: a map divided into parts of near-equal area, for jack-knife errors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from celestrum.functions import cells
from celestrum.sources import scratch

CELLS_PER_REGION = 50
MAX_RESOLUTION = 2048
AUTO_RESOLUTION = 1024


def region_resolution(area: float, n_regions: int) -> int:
    """The coarsest resolution with enough cells for each region, 1024 at most."""
    r = 4
    while r < AUTO_RESOLUTION and area / n_regions < CELLS_PER_REGION * cells.cell_area(r):
        r *= 2
    return r


def sections(covered: DataFrame, resolution: int, n_regions: int) -> DataFrame:
    """stripe, section: runs of neighbouring stripes, divided so that regions are about square. There are at most 36 x 2048 stripes."""
    stripes = covered.select(cells.stripe(resolution).alias("stripe")).distinct()
    n = stripes.count()
    width = max(1, int(round(n / max(1.0, np.sqrt(n_regions)))))
    order = Window.orderBy("stripe")
    island = stripes.withColumn("_i", F.sum(F.when(F.col("stripe") - F.lag("stripe").over(order) > 1, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = island.withColumn("_p", F.row_number().over(Window.partitionBy("_i").orderBy("stripe")) - 1)
    return place.withColumn("section", F.sum(F.when(F.col("_p") % width == 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).select("stripe", F.col("section").cast("int").alias("section"))


def regionate(covered: DataFrame, resolution: int, n_regions: int) -> DataFrame:
    """x, y, region, area for the cells of a coverage (x, y, weight: the fraction covered).

    Cells are in order of section (neighbouring stripes), row and column, and a
    region is closed when its area with three quarters of a mean cell would pass
    the target: the region follows from the area before the cell. That is a running
    sum over the rows of sections (some ten thousand numbers) and one within each of them.
    """
    if resolution > MAX_RESOLUTION:
        raise ValueError(f"regions have at most resolution {MAX_RESOLUTION}")
    own = scratch.written(covered.select("x", "y", (F.col("weight") * cells.cell_area(resolution)).alias("area"), cells.stripe(resolution).alias("stripe")), "cells")
    total, n = own.agg(F.sum("area"), F.count("*")).first()
    if not n:
        return own.select("x", "y", F.lit(0).alias("region"), "area")
    target, average = total / n_regions, total / n
    own = own.join(F.broadcast(sections(own, resolution, n_regions)), "stripe")
    rows = own.groupBy("section", "y").agg(F.sum("area").alias("_row"))
    upto = Window.orderBy("section", "y").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.sum("_row").over(upto), F.lit(0.0))).drop("_row")
    before = F.coalesce(F.sum("area").over(Window.partitionBy("section", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = own.withColumn("_before", before).join(F.broadcast(rows), ["section", "y"]).withColumn("_before", F.col("_before") + F.col("_start"))
    region = F.least(F.lit(n_regions - 1), F.floor((F.col("_before") + 0.75 * average) / target))
    return placed.select("x", "y", F.when(F.col("_before") > 0, region).otherwise(0).cast("int").alias("region"), "area")


def block_regions(covered: DataFrame, columns: int, rows: int, resolution: int) -> DataFrame:
    """Regions of fixed blocks of cells, numbered row by row; no walk is needed."""
    across = -(-cells.NX0 * resolution // columns)
    return covered.select("x", "y", (F.floor(F.col("y") / rows) * across + F.floor(F.col("x") / columns)).cast("int").alias("region"), (F.col("weight") * cells.cell_area(resolution)).alias("area"))


def from_bounds(covered: DataFrame, bounds: list, resolution: int) -> DataFrame:
    """Each cell goes to the bound that holds most of its five probe points, the first of equal ones; cells that none touches have no region."""
    score = None
    for k, bound in enumerate(bounds):
        held = F.lit(0)
        for dx, dy in ((0.5, 0.5), (0.25, 0.25), (0.75, 0.25), (0.25, 0.75), (0.75, 0.75)):
            from celestrum.functions.coords import survey_to_xyz

            v = survey_to_xyz(cells.edge_lambda(resolution, F.col("y") + dy), cells.edge_eta(resolution, F.col("x") + dx))
            held = held + F.when(bound.contains(v), 1).otherwise(0)
        one = F.struct(held.alias("held"), F.lit(-k).alias("k"))
        score = one if score is None else F.greatest(score, one)
    out = covered.withColumn("_s", score).where(F.col("_s.held") > 0)
    return out.select("x", "y", (-F.col("_s.k")).cast("int").alias("region"), (F.col("weight") * cells.cell_area(resolution)).alias("area"))


def find_region(points: DataFrame, regions: DataFrame, resolution: int, outside: int | None = None) -> DataFrame:
    """points' columns and region; null (or `outside`) where there is none. The region map is small and goes to all tasks if Spark finds it so."""
    keyed = cells.with_cell(points, resolution, ("_rx", "_ry"))
    out = keyed.join(regions.select(F.col("x").alias("_rx"), F.col("y").alias("_ry"), "region"), ["_rx", "_ry"], "left").drop("_rx", "_ry")
    return out if outside is None else out.withColumn("region", F.coalesce("region", F.lit(outside)))


def region_areas(regions: DataFrame) -> DataFrame:
    return regions.groupBy("region").agg(F.sum("area").alias("area"), F.count("*").alias("n_cells"))
