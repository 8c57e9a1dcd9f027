"""Densities, distribution functions and carving probabilities as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the fifth-order rational approximation of erf (Abramowitz and Stegun 7.1.26).
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
_ERF_P = 0.3275911


def gauss_pdf(x: Column, mean: Column | float = 0.0, stddev: Column | float = 1.0) -> Column:
    s = F.lit(stddev) if isinstance(stddev, (int, float)) else stddev
    z = (x - mean) / s
    return F.exp(-z * z / 2) / (s * math.sqrt(2 * math.pi))


def erf(x: Column) -> Column:
    """Within 1.5e-7, JVM-side."""
    t = 1 / (1 + _ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(_ERF):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / math.sqrt(2)))


def cdf_of(distance: Column, variance: Column) -> Column:
    """Distribution function of a centred normal at a distance; a step for a variance of 0."""
    scaled = F.try_divide(distance, F.sqrt(F.greatest(variance, F.lit(0.0))))
    return F.coalesce(normal_cdf(scaled), F.when(distance > 0, 1.0).when(distance < 0, 0.0).otherwise(0.5))


def carve_probability(behind: Column, ahead: Column, lateral: Column, sensor_var: Column, point_var: Column, lateral_var: Column, size: Column) -> tuple[Column, Column]:
    """(probability that a place on a ray is empty, weight of this statement).

    behind is the distance along the ray from the sensor to the place, ahead that from the place to where the ray ended, both
    signed; lateral is the distance off the ray, and size the width of the place. A place that the ray went through is empty
    (1), one beyond its end is not (0), and what it has missed is unknown (0.5). The weight is the lateral density times the
    width; it is 0 where the lateral variance is 0.
    """
    sigma = F.sqrt(F.greatest(lateral_var, F.lit(0.0)))
    z = F.try_divide(lateral, sigma)
    weight = F.coalesce(F.try_divide(F.exp(-z * z / 2), sigma * math.sqrt(2 * math.pi)) * size, F.lit(0.0))
    reached = cdf_of(behind, sensor_var) * weight
    return reached * cdf_of(ahead, point_var) + 0.5 * (1 - reached), weight


def density(offset, cov: Column) -> Column:
    """Density of a three-dimensional normal at an offset from its mean; cov is an upper triangle. 0 where it is singular."""
    xx, xy, xz, yy, yz, zz = (F.get(cov, k) for k in range(6))
    adjugate = {(0, 0): yy * zz - yz * yz, (0, 1): xz * yz - xy * zz, (0, 2): xy * yz - xz * yy, (1, 1): xx * zz - xz * xz, (1, 2): xy * xz - xx * yz, (2, 2): xx * yy - xy * xy}
    det = xx * adjugate[0, 0] + xy * adjugate[0, 1] + xz * adjugate[0, 2]
    form = sum(adjugate[min(i, j), max(i, j)] * offset[i] * offset[j] for i in range(3) for j in range(3))
    return F.when(det > 0, F.exp(-F.try_divide(form, det) / 2) * F.try_divide(F.lit((2 * math.pi) ** -1.5), F.sqrt(det))).otherwise(0.0)


def surface_union(*parts: Column) -> Column:
    """1 - product of (1 - s)."""
    out = F.lit(1.0)
    for s in parts:
        out = out * (1 - s)
    return 1 - out


def butterworth(frequency: Column, cutoff: float, order: int) -> Column:
    return 1 / (1 + F.pow(frequency / cutoff, 2 * order))


def zoned_noise(distance: Column, cutoff=(0.1, 6.0), good=(0.5, 4.0), sigma: float = 0.01, penalty: float = 3.0) -> Column:
    """Standard deviation of a depth reading: infinite beyond the cut-offs, sigma in the good zone, and a multiple between."""
    return F.when((distance < cutoff[0]) | (distance > cutoff[1]), F.lit(float("inf"))).when(distance.between(*good), sigma).otherwise(sigma * penalty)
