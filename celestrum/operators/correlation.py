"""Bins, histograms and two-point correlation functions with jack-knife errors."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from celestrum.functions import cells
from celestrum.operators import blocks, field_map
from celestrum.sources import scratch

#: Cells of the pixel estimator are at most so large against the smallest angle of a bin.
CELL_TO_ANGLE = 0.5


@dataclass(frozen=True)
class Bins:
    """Angular (or radial) bins [edges[k], edges[k + 1]); resolution 0: pairs are counted, else cells of that resolution."""

    edges: tuple[float, ...]
    resolutions: tuple[int, ...]

    @classmethod
    def logarithmic(cls, low: float, high: float, per_decade: float) -> Bins:
        """Bins of equal width in the logarithm, on the grid of 10 ** (k / per_decade), that lie in [low, high]."""
        first = math.floor(math.log10(low) * per_decade + 1e-9)
        while 10 ** (first / per_decade) < low * (1 - 1e-9):
            first += 1
        edges = []
        k = first
        while 10 ** (k / per_decade) <= high * (1 + 1e-9):
            edges.append(10 ** (k / per_decade))
            k += 1
        return cls(tuple(edges), (0,) * max(0, len(edges) - 1))

    @classmethod
    def linear(cls, low: float, high: float, n: int) -> Bins:
        return cls(tuple(low + (high - low) * k / n for k in range(n + 1)), (0,) * n)

    def __len__(self) -> int:
        return len(self.edges) - 1

    @property
    def centers(self) -> list[float]:
        """Geometric means; the middle where a bin begins at 0."""
        return [math.sqrt(a * b) if a > 0 else (a + b) / 2 for a, b in zip(self.edges, self.edges[1:], strict=False)]

    def with_resolutions(self, coarsest: int = 4, finest: int = 256) -> Bins:
        """Wide bins go to the pixel estimator: each at the coarsest resolution whose cells are small against its smallest angle, if there is one."""
        out = []
        for low in self.edges[:-1]:
            r = coarsest
            while r <= finest and math.sqrt(cells.cell_area(r)) > CELL_TO_ANGLE * low:
                r *= 2
            out.append(r if r <= finest else 0)
        return Bins(self.edges, tuple(out))

    def using_pairs(self, above: int) -> Bins:
        """Bins of resolutions above the limit count pairs."""
        return Bins(self.edges, tuple(0 if r > above else r for r in self.resolutions))

    def find(self, angle: float) -> int | None:
        for k in range(len(self)):
            if self.edges[k] <= angle < self.edges[k + 1]:
                return k
        return None

    def of_resolution(self, resolution: int) -> list[int]:
        return [k for k, r in enumerate(self.resolutions) if r == resolution]

    def number(self, value: Column) -> Column:
        """The bin of a value, null outside."""
        out = F.lit(None).cast("int")
        for k in range(len(self)):
            out = F.when((value >= self.edges[k]) & (value < self.edges[k + 1]), k).otherwise(out)
        return out

    @staticmethod
    def resolution_order() -> list[Column]:
        """Orders a table of bins: fine resolutions first, then by angle."""
        return [F.desc("resolution"), F.col("theta_min")]

    @staticmethod
    def angle_order() -> list[Column]:
        return [F.col("theta_min")]

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(k, a, b, c, r) for k, (a, b, c, r) in enumerate(zip(self.edges, self.edges[1:], self.centers, self.resolutions, strict=False))], "bin int, theta_min double, theta_max double, theta double, resolution int")


def histogram(df: DataFrame, value: Column, weight: Column, bins: Bins) -> DataFrame:
    """bin, n, weight, mean_value for every bin, empty ones included."""
    found = df.withColumn("bin", bins.number(value)).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count("*").alias("n"), F.sum(weight).alias("weight"), F.avg(value).alias("mean_value"))
    every = df.sparkSession.range(len(bins)).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "weight": F.coalesce("weight", F.lit(0.0))})


def landy_szalay(dd: Column, dr: Column, rd: Column, rr: Column) -> Column:
    return (dd - dr - rd + rr) / rr


def pair_counts(galaxies: DataFrame, randoms: DataFrame, bins: Bins, others: DataFrame | None = None, other_randoms: DataFrame | None = None, iterations: int = 1, weight: bool = True, regions: bool = False) -> DataFrame:
    """bin, kind (DD, DR, RD, RR), n_pairs, weight [, region_a, region_b] of galaxies with others (or themselves).

    Catalogs have ux, uy, uz, weight [, region]; randoms are `iterations` times as
    many as wanted, and their counts are divided so. Pairs of a catalog with itself
    count twice, and each point with itself where a bin begins at 0.
    """
    auto = others is None
    others, other_randoms = (galaxies, randoms) if auto else (others, other_randoms)
    weighed = {id(df): df if weight else df.withColumn("weight", F.lit(1.0)) for df in (galaxies, randoms, others, other_randoms)}
    packed = {}

    def side(df: DataFrame) -> DataFrame:
        if id(df) not in packed:
            packed[id(df)] = blocks.of_catalog(weighed[id(df)], regions)
        return packed[id(df)]

    kinds = {"DD": (galaxies, others, 1), "DR": (galaxies, other_randoms, iterations), "RD": (randoms, others, iterations), "RR": (randoms, other_randoms, iterations**2)}
    by = ["bin", "region_a", "region_b"] if regions else ["bin"]
    out = None
    for kind, (a, b, divide) in kinds.items():
        if auto and kind == "RD":
            continue
        one = blocks.pairs_of_blocks(side(a), side(b), list(bins.edges)).groupBy(*by).agg(F.sum("n_pairs").alias("n_pairs"), (F.sum("weight") / divide).alias("weight")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    # Bins times pairs of regions; read by each step of an estimate.
    out = scratch.written(out, "pairs")
    if auto:
        names = {"region_a": "region_b", "region_b": "region_a"}
        turned = out.where(F.col("kind") == "DR").withColumn("kind", F.lit("RD"))
        out = out.unionByName(turned.select(*[F.col(names.get(c, c)).alias(c) for c in out.columns]))
    return out


def angular_correlation(counts: DataFrame) -> DataFrame:
    """bin, DD, DR, RD, RR, wtheta, error from counts without regions: the Landy-Szalay estimator and its Poisson error 1 / sqrt(DD)."""
    wide = counts.groupBy("bin").pivot("kind", ["DD", "DR", "RD", "RR"]).agg(F.sum("weight"))
    wide = wide.na.fill(0.0, ["DD", "DR", "RD", "RR"])
    rr = F.when(F.col("RR") != 0, F.col("RR"))
    return wide.withColumns({"wtheta": landy_szalay(F.col("DD"), F.col("DR"), F.col("RD"), rr), "error": 1.0 / F.sqrt(F.when(F.col("DD") > 0, F.col("DD")))})


def leave_one_out(counts: DataFrame, n_regions: int) -> DataFrame:
    """bin, region, DD, DR, RD, RR without the pairs that touch the region. counts have region_a and region_b.

    What touches a region is one aggregation: a pair goes to its one or two regions, and is taken from the total.
    """
    values = [F.sum(F.when(F.col("kind") == k, F.col("weight")).otherwise(0.0)).alias(k) for k in ("DD", "DR", "RD", "RR")]
    total = counts.groupBy("bin").agg(*[v.alias(f"t_{k}") for v, k in zip(values, ("DD", "DR", "RD", "RR"), strict=True)])
    touched = counts.withColumn("region", F.explode(F.array_distinct(F.array("region_a", "region_b")))).groupBy("bin", "region").agg(*values)
    every = total.crossJoin(F.broadcast(counts.sparkSession.range(n_regions).select(F.col("id").cast("int").alias("region"))))
    joined = every.join(touched, ["bin", "region"], "left")
    return joined.select("bin", "region", *[(F.col(f"t_{k}") - F.coalesce(F.col(k), F.lit(0.0))).alias(k) for k in ("DD", "DR", "RD", "RR")])


def jackknife(samples: DataFrame, value: str = "wtheta") -> DataFrame:
    """bin, mean, error over samples (bin, region, value): error = (n - 1) / n * sqrt(sum of squared differences)."""
    m = samples.groupBy("bin").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    spread = samples.join(m, "bin").groupBy("bin").agg(F.first("mean").alias("mean"), F.first("n").alias("n"), F.sum(F.pow(F.col(value) - F.col("mean"), 2)).alias("_s"))
    return spread.select("bin", "mean", ((F.col("n") - 1) / F.col("n") * F.sqrt("_s")).alias("error"))


def covariance(samples: DataFrame, value: str = "wtheta") -> DataFrame:
    """bin_a, bin_b, covariance: ((n - 1) / n) ** 2 * sum of products of differences from the mean."""
    m = samples.groupBy("bin").agg(F.avg(value).alias("_m"), F.count(value).alias("_n"))
    d = samples.join(m, "bin").select("bin", "region", (F.col(value) - F.col("_m")).alias("d"), "_n")
    a = d.select(F.col("bin").alias("bin_a"), "region", F.col("d").alias("da"), "_n")
    b = d.select(F.col("bin").alias("bin_b"), "region", F.col("d").alias("db"))
    return a.join(b, "region").groupBy("bin_a", "bin_b").agg((F.pow((F.first("_n") - 1) / F.first("_n"), 2) * F.sum(F.col("da") * F.col("db"))).alias("covariance"))


def pixel_correlation(field: DataFrame, kind: str, level: int, bins: Bins, other: DataFrame | None = None) -> DataFrame:
    """bin, wtheta, pixel_weight of a field's (or two fields') over-densities, each bin at its own resolution; bins without one are left out."""
    out = None
    for resolution in sorted({r for r in bins.resolutions if r}):
        to = cells.level_of(resolution)
        prepare = lambda f, to=to, r=resolution: field_map.over_density(field_map.resample(f, kind, level, to), kind, r)
        a, b = prepare(field), None if other is None else prepare(other)
        for k in bins.of_resolution(resolution):
            one = field_map.correlate(a, b, resolution, bins.edges[k], bins.edges[k + 1]).withColumn("bin", F.lit(k))
            out = one if out is None else out.unionByName(one)
    if out is None:
        return field.sparkSession.createDataFrame([], "bin int, wtheta double, pixel_weight double")
    return out.select("bin", (F.col("pixel_wtheta") / F.col("pixel_weight")).alias("wtheta"), "pixel_weight")


def weighted_cross_correlation(probes: DataFrame, targets: DataFrame, bins: Bins) -> DataFrame:
    """bin, weight, n_pairs, mean: the mean product of weights over pairs."""
    return blocks.binned_pairs(probes, targets, list(bins.edges)).withColumn("mean", F.col("weight") / F.col("n_pairs"))


def _estimated(counts: DataFrame, n_regions: int) -> DataFrame:
    """bin, wtheta, error: Landy-Szalay with the Poisson error, or mean and error of the leave-one-out samples."""
    if not n_regions:
        return angular_correlation(counts).select("bin", "wtheta", "error")
    rr = F.when(F.col("RR") != 0, F.col("RR"))
    samples = leave_one_out(counts, n_regions).select("bin", "region", landy_szalay(F.col("DD"), F.col("DR"), F.col("RD"), rr).alias("wtheta"))
    return jackknife(samples).select("bin", F.col("mean").alias("wtheta"), "error")


def auto_correlation(galaxies: DataFrame, randoms: DataFrame, bins: Bins, iterations: int = 1, n_regions: int = 0) -> DataFrame:
    """bin, theta, wtheta, error. With regions (columns region of both) the mean and error of the leave-one-out samples."""
    counts = pair_counts(galaxies, randoms, bins, iterations=iterations, regions=n_regions > 0)
    return bins.table(galaxies.sparkSession).select("bin", "theta").join(_estimated(counts, n_regions), "bin", "left")


def cross_correlation(galaxies: DataFrame, others: DataFrame, randoms: DataFrame, other_randoms: DataFrame, bins: Bins, iterations: int = 1, n_regions: int = 0) -> DataFrame:
    """As auto_correlation, of two catalogs with their randoms; regions as there."""
    counts = pair_counts(galaxies, randoms, bins, others, other_randoms, iterations, regions=n_regions > 0)
    return bins.table(galaxies.sparkSession).select("bin", "theta").join(_estimated(counts, n_regions), "bin", "left")


def hybrid_correlation(galaxies: DataFrame, randoms: DataFrame, field: DataFrame, kind: str, level: int, bins: Bins, iterations: int = 1) -> DataFrame:
    """bin, theta, resolution, wtheta, error: bins with a resolution (wide ones, see with_resolutions) by cells of the field, the others by pairs.

    The pixel estimator's error is that of its weight, 1 / sqrt(pixel_weight).
    """
    table = bins.table(galaxies.sparkSession).select("bin", "theta", "resolution")
    pairs = [k for k, r in enumerate(bins.resolutions) if not r]
    found = pixel_correlation(field, kind, level, bins).select("bin", "wtheta", (1.0 / F.sqrt("pixel_weight")).alias("error"))
    for k, j in _runs(pairs):
        some = Bins(bins.edges[k : j + 2], (0,) * (j + 1 - k))
        one = angular_correlation(pair_counts(galaxies, randoms, some, iterations=iterations)).select((F.col("bin") + k).cast("int").alias("bin"), "wtheta", "error")
        found = found.unionByName(one)
    return table.join(found, "bin", "left")


def _runs(numbers: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for k in numbers:
        if out and out[-1][1] == k - 1:
            out[-1] = (out[-1][0], k)
        else:
            out.append((k, k))
    return out


def combine_fields(counts: DataFrame) -> DataFrame:
    """bin, wtheta, error of several fields' counts (bin, field, DD, DR, RD, RR): each sample is the sum of all fields but one."""
    kinds = ("DD", "DR", "RD", "RR")
    total = counts.groupBy("bin").agg(*[F.sum(k).alias(f"t_{k}") for k in kinds])
    rest = counts.join(total, "bin").select("bin", "field", *[(F.col(f"t_{k}") - F.col(k)).alias(k) for k in kinds])
    rr = F.when(F.col("RR") != 0, F.col("RR"))
    samples = rest.select("bin", F.col("field").alias("region"), landy_szalay(F.col("DD"), F.col("DR"), F.col("RD"), rr).alias("wtheta"))
    return jackknife(samples).select("bin", F.col("mean").alias("wtheta"), "error")


def shuffled_weights(catalog: DataFrame, seed: int = 1) -> DataFrame:
    """The catalog with its weights dealt anew over its rows: the k-th row by one hash gets the weight of the k-th by another.

    Rows are numbered in buckets of their hashes, so no sort is global: weights stay in their bucket of a few thousand.
    """
    from pyspark.sql import Window

    n = max(1, catalog.count() // 4096)
    keyed = catalog.withColumn("_b", F.pmod(F.xxhash64("ux", "uy", "uz", "weight"), F.lit(n)))
    by = lambda k: Window.partitionBy("_b").orderBy(F.xxhash64(F.lit(seed), F.lit(k), "ux", "uy", "uz", "weight"), "ux", "uy", "uz", "weight")
    rows = keyed.withColumn("_n", F.row_number().over(by(1)))
    weights = keyed.select("_b", "weight", F.row_number().over(by(2)).alias("_n"))
    return rows.drop("weight").join(weights, ["_b", "_n"]).drop("_b", "_n").select(*catalog.columns)
