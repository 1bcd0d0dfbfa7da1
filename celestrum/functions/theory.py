"""Numerical cosmology and halo occupation, as Columns; a sampler of parameters."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from celestrum.functions.coords import column

#: Intervals of Simpson's rule.
STEPS = 64


def integral(f: Callable[[Column], Column], high, steps: int = STEPS) -> Column:
    """Of f from 0 to high, by Simpson's rule."""
    high = column(high)
    weight = lambda k: F.when((k == 0) | (k == steps), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda a, k: a + weight(k) * f(high * k / float(steps))) * high / (3.0 * steps)


def _simpson(f: Callable[[np.ndarray], np.ndarray], top: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """As integral, of a function of arrays."""
    out = np.zeros(len(top))
    with np.errstate(all="ignore"):
        for k in range(steps + 1):
            out = out + (1.0 if k in (0, steps) else 4.0 if k % 2 else 2.0) * f(top * k / float(steps))
        return out * top / (3.0 * steps)


def _summed(f: Callable[[np.ndarray], np.ndarray], high) -> Column:
    """A column of it: a lambda over an array of steps would be interpreted for each row and step."""
    high = column(high)
    return F.when(high.isNotNull(), F.pandas_udf(lambda v: pd.Series(_simpson(f, v.to_numpy(dtype=np.float64))), "double")(high.cast("double")))


@dataclass(frozen=True)
class Expansion:
    """A flat universe of matter and a constant dark energy; distances in units of 1 / h Mpc."""

    omega_m: float = 0.3

    def e(self, z) -> Column:
        z = column(z)
        return F.sqrt(self.omega_m * (1.0 + z) * (1.0 + z) * (1.0 + z) + (1.0 - self.omega_m))

    def comoving_distance(self, z) -> Column:
        m = self.omega_m
        return 2997.92458 * _summed(lambda t: 1.0 / np.sqrt(m * (1.0 + t) * (1.0 + t) * (1.0 + t) + (1.0 - m)), z)

    def omega_m_at(self, z) -> Column:
        z = column(z)
        return self.omega_m * (1.0 + z) * (1.0 + z) * (1.0 + z) / (self.e(z) * self.e(z))

    def growth(self, z) -> Column:
        """Growth factor, 1 today: by the integral over the scale factor."""
        m = self.omega_m
        f = lambda t: np.power(t / (m + (1.0 - m) * t * t * t), 1.5)
        unscaled = lambda a: F.sqrt(m / (a * a * a) + (1.0 - m)) * _summed(f, a)
        today = math.sqrt(m + (1.0 - m)) * float(_simpson(f, np.ones(1))[0])
        return unscaled(1.0 / (1.0 + column(z))) / today


@dataclass(frozen=True)
class PowerLawOccupation:
    """Of halos above the least mass one central galaxy, and satellites by a power of the mass; satellites are Poisson."""

    least: float
    one_satellite: float
    slope: float = 1.0

    def centrals(self, mass) -> Column:
        return F.when(column(mass) >= self.least, 1.0).otherwise(0.0)

    def satellites(self, mass) -> Column:
        return self.centrals(mass) * F.pow(column(mass) / self.one_satellite, self.slope)

    def mean(self, mass) -> Column:
        return self.centrals(mass) + self.satellites(mass)

    def pairs(self, mass) -> Column:
        """Mean of N (N - 1)."""
        s = self.satellites(mass)
        return 2.0 * s + s * s


def latin_hypercube(spark, n: int, names: list[str], seed: int = 1) -> DataFrame:
    """n samples in the unit cube: of each parameter every one of n equal ranges has one sample. n is that of a design of experiments: each parameter's order is one sorted task."""
    out = spark.range(n)
    for k, name in enumerate(names):
        place = F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), F.lit(k), "id"), "id")) - 1
        within = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(1000 + k), "id"), 11).cast("double") + 0.5) / float(1 << 53)
        out = out.withColumn(name, (place + within) / float(n))
    return out


def scaled(df: DataFrame, name: str, low: float, high: float) -> DataFrame:
    return df.withColumn(name, F.col(name) * (high - low) + low)


def log_grid(low: float, high: float, n: int) -> list[float]:
    return [math.exp(math.log(low) + (math.log(high) - math.log(low)) * k / (n - 1)) for k in range(n)]
