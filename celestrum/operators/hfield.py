"""Fields on cells of the Hilbert curve: cell, share (of it in the union), intensity, n_points, all of one level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from celestrum.functions import hcells


def from_points(points: DataFrame, union: DataFrame, level: int, weight: Column) -> DataFrame:
    """Sums of the points (column leaf) in the cells of a level that a normalized union (column cell) touches; points elsewhere in them count too."""
    fine = union.where(hcells.level_of("cell") > level).groupBy(hcells.parent("cell", level).alias("up")).agg((F.sum(hcells.size("cell")) / F.first(F.lit(1 << (2 * (hcells.MAX_LEVEL - level))))).alias("share"))
    coarse = hcells.denormalize(union.select("cell").where(hcells.level_of("cell") <= level), level).select(F.col("cell").alias("up"), F.lit(1.0).alias("share"))
    base = fine.unionByName(coarse).withColumnRenamed("up", "cell")
    found = points.groupBy(hcells.parent("leaf", level).alias("cell")).agg(F.sum(weight).alias("intensity"), F.count("*").alias("n_points"))
    return base.join(found, "cell", "left").withColumns({"intensity": F.coalesce("intensity", F.lit(0.0)), "n_points": F.coalesce("n_points", F.lit(0))})


def resample(field: DataFrame, level: int, to_level: int) -> DataFrame:
    """Coarser cells: sums, and the share of them that is held."""
    up = field.groupBy(hcells.parent("cell", to_level).alias("cell"))
    return up.agg((F.sum("share") / 4.0 ** (level - to_level)).alias("share"), F.sum("intensity").alias("intensity"), F.sum("n_points").alias("n_points"))


def densities(field: DataFrame, level: int) -> DataFrame:
    """Intensity and points by square degree of the area held (a level's mean area)."""
    area = hcells.average_area(F.lit(float(level))) * F.col("share")
    return field.withColumns({"density": F.col("intensity") / area, "point_density": F.col("n_points") / area})


def mean(field: DataFrame) -> Column:
    """Aggregate: intensity by share."""
    return F.sum("intensity") / F.sum("share")


def over_density(field: DataFrame) -> DataFrame:
    """intensity becomes its excess over what the mean gives, as a fraction of it."""
    m = F.broadcast(field.agg(mean(field).alias("_m")))  # a row
    return field.crossJoin(m).withColumn("intensity", F.col("intensity") / (F.col("_m") * F.col("share")) - 1.0).drop("_m")


def combined(a: DataFrame, b: DataFrame, factor: float = 1.0) -> DataFrame:
    """Sum of two fields' intensities (the second's times a factor) and points on all cells of either; shares are the larger."""
    right = b.select("cell", F.col("share").alias("_s"), F.col("intensity").alias("_i"), F.col("n_points").alias("_n"))
    zero = lambda c, v: F.coalesce(c, F.lit(v))
    return a.join(right, "cell", "full").select("cell", F.greatest(zero("share", 0.0), zero("_s", 0.0)).alias("share"), (zero("intensity", 0.0) + factor * zero("_i", 0.0)).alias("intensity"), (zero("n_points", 0) + zero("_n", 0)).alias("n_points"))
