"""Cameras: projection with and without lens distortion, and colours blended by quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shapes import Vector, dot, norm


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """c0 + c1 x + c2 x^2 + ..."""
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + float(c)
    return out


def rectilinear_pixel(p: Vector, fx: float, fy: float, cx: float, cy: float, radial: Sequence[float] = (), tangential: tuple[float, float] = (0.0, 0.0)) -> tuple[Column, Column]:
    """Pixel of a point in camera coordinates, z forward, with Brown's distortion; null behind the camera."""
    x, y = F.when(p[2] > 0, p[0] / p[2]), F.when(p[2] > 0, p[1] / p[2])
    r2 = x * x + y * y
    k = polynomial(r2, [1.0, *radial])
    a, b = tangential
    return (x * k + 2 * a * x * y + b * (r2 + 2 * x * x)) * fx + cx, (y * k + a * (r2 + 2 * y * y) + 2 * b * x * y) * fy + cy


def fisheye_pixel(p: Vector, inverse: Sequence[float], affine: Sequence[float], centre: tuple[float, float]) -> tuple[Column, Column]:
    """Pixel of a bearing by the polynomial of its angle to the image plane; affine is (c, d, e)."""
    flat = F.sqrt(p[0] * p[0] + p[1] * p[1])
    rho = polynomial(F.atan2(-p[2], flat), inverse)
    x, y = F.coalesce(F.try_divide(p[0], flat), F.lit(0.0)) * rho, F.coalesce(F.try_divide(p[1], flat), F.lit(0.0)) * rho
    c, d, e = (float(v) for v in affine)
    return x * c + y * d + centre[0], x * e + y + centre[1]


def fisheye_ray(u: Column, v: Column, forward: Sequence[float], affine: Sequence[float], centre: tuple[float, float]) -> list[Column]:
    """Unit bearing of a pixel: the inverse of the affine map, and z by a polynomial of the distance to the centre."""
    c, d, e = (float(x) for x in affine)
    det = c - d * e
    x, y = ((u - centre[0]) - d * (v - centre[1])) / det, (-e * (u - centre[0]) + c * (v - centre[1])) / det
    z = -polynomial(F.sqrt(x * x + y * y), forward)
    n = F.sqrt(x * x + y * y + z * z)
    return [x / n, y / n, z / n]


def view_quality(normal: Vector, ray: Vector, distance: Column) -> Column:
    """How well a surface is seen: the cosine of the angle between them over the distance; negative from behind."""
    return F.try_divide(-dot(normal, ray), norm(normal) * norm(ray) * distance)


def best_colour(candidates: DataFrame, by: list[str], quality: str, colour: str, order: str) -> DataFrame:
    """The colour of the highest quality, ties to the first in order; negative qualities don't count."""
    top = candidates.where(F.col(quality) >= 0).groupBy(*by).agg(F.max(F.struct(quality, (-F.col(order)).alias("__o"), colour)).alias("m"))
    return top.select(*by, F.col(f"m.{colour}").alias(colour), F.col(f"m.{quality}").alias(quality))


def blended_colour(candidates: DataFrame, by: list[str], quality: str, value: str, order: str, width: float) -> DataFrame:
    """One channel folded over cameras in order: within `width` of the stored quality it is mixed in linearly and that quality
    stays; a quality better by more replaces both; a worse one, or a negative one, changes nothing. Cameras of a point are few."""
    ranked = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(quality).cast("double").alias("q"), F.col(value).cast("double").alias("v"))))
    start = F.struct(F.lit(-1.0).alias("q"), F.lit(None).cast("double").alias("v"))

    def step(s, c):
        share = (c.q - s.q + width) / (2 * width)
        mixed = F.struct(s.q.alias("q"), (s.v * (1 - share) + c.v * share).alias("v"))
        return F.when(s.v.isNull() | (c.q > s.q + width), F.struct(c.q.alias("q"), c.v.alias("v"))).when(F.abs(c.q - s.q) <= width, mixed).otherwise(s)

    return candidates.where(F.col(quality) >= 0).groupBy(*by).agg(F.aggregate(ranked, start, step).alias("s")).select(*by, F.col("s.v").alias(value), F.col("s.q").alias(quality))


def antialiased(pixels: DataFrame, wanted: DataFrame, radius: int, channels: list[str], key: list[str]) -> DataFrame:
    """Mean colour of seven samples around each wanted pixel (row, col): the centre three times, and one at `radius` each way."""
    moves = F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in ((0, 0), (0, 0), (0, 0), (radius, 0), (-radius, 0), (0, radius), (0, -radius))])
    at = wanted.withColumn("m", F.explode(moves)).withColumns({"row": F.col("row") + F.col("m.r"), "col": F.col("col") + F.col("m.c")})
    return at.join(pixels, ["row", "col"]).groupBy(*key).agg(*[F.avg(c).alias(c) for c in channels])


def unmasked(pixels: DataFrame, mask: DataFrame, camera: list[str]) -> DataFrame:
    """Pixels (camera columns, row, col) that the mask of their camera (same columns, usable) lets through; a pixel that it does not list is not usable."""
    keys = [*camera, "row", "col"]
    return pixels.join(mask.where("usable").select(*keys).distinct(), keys, "left_semi")


def first_room_images(hits: DataFrame, image: str, room: str) -> DataFrame:
    """Number of images by room, each counted in the smallest room that it lies in."""
    w = Window.partitionBy(image).orderBy(room)
    return hits.select(image, room).distinct().withColumn("k", F.row_number().over(w)).where("k = 1").groupBy(room).agg(F.count("*").alias("images"))
