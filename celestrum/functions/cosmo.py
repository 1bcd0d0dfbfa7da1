"""Distances of an analytic flat cosmology, as Columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from celestrum.functions.coords import column

#: Coefficients of the distance fit.
LINEAR, SQUARE = 1.718, 0.315


@dataclass(frozen=True)
class Cosmology:
    """hubble_distance is 3000 / h; distances have its unit."""

    omega_m: float = 0.2736
    h: float = 0.705

    @classmethod
    def from_omega_l(cls, omega_l: float, h: float = 0.705) -> Cosmology:
        return cls(1.0 - omega_l, h)

    @property
    def omega_l(self) -> float:
        return 1.0 - self.omega_m

    @property
    def hubble_constant(self) -> float:
        return 100.0 * self.h

    @property
    def hubble_distance(self) -> float:
        return 3000.0 / self.h

    def comoving_distance(self, z) -> Column:
        z = column(z)
        return self.hubble_distance * z / F.sqrt(1.0 + LINEAR * self.omega_m * z + SQUARE * math.sqrt(self.omega_m) * z * z)

    def angular_diameter_distance(self, z) -> Column:
        return self.comoving_distance(z) / (1.0 + column(z))

    def luminosity_distance(self, z) -> Column:
        return self.comoving_distance(z) * (1.0 + column(z))

    def projected_distance(self, z, theta) -> Column:
        return F.radians(column(theta)) * self.angular_diameter_distance(z)

    def projected_angle(self, z, radius) -> Column:
        return F.degrees(column(radius) / self.angular_diameter_distance(z))
