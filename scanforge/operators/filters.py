"""Row operators on points (x, y, z, r, g, b, index, timestamp, valid, ...): validity marks, filters and projections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import running_count

ALL, VALID, INVALID = "ALL", "VALID", "INVALID"


def in_scope(scope: str = ALL) -> Column:
    """Rows that a scope keyword takes in."""
    return {ALL: F.lit(True), VALID: F.col("valid"), INVALID: ~F.col("valid")}[scope.upper()]


def flip_valid(df: DataFrame, scope: str = ALL) -> DataFrame:
    return df.withColumn("valid", F.when(in_scope(scope), ~F.col("valid")).otherwise(F.col("valid")))


def kill(df: DataFrame, scope: str = ALL) -> DataFrame:
    return df.where(~in_scope(scope))


def decimate(df: DataFrame, every: int, order: list[str], scope: str = ALL, partition: list[str] | None = None) -> DataFrame:
    """Of the rows in scope, numbered from 0 in the given order, all but rows 0, every, 2 * every ... become invalid.

    The order is total over the data or, with `partition`, within each partition; either way the work is spread. `every` below 1
    counts as 1; the INVALID scope changes nothing.
    """
    every = max(1, int(every))
    if scope.upper() == INVALID:
        return df
    if partition:
        w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("__before", F.coalesce(F.sum(in_scope(scope).cast("long")).over(w), F.lit(0)))
    else:
        df = running_count(df, order, "__before", in_scope(scope))
    keep = F.when(in_scope(scope), F.col("__before") % every == 0).otherwise(F.col("valid"))
    return df.withColumn("valid", F.col("valid") & keep).drop("__before")


def partition_plane(df: DataFrame, normal, point) -> DataFrame:
    """Valid rows stay valid strictly on the side to which the normal points."""
    side = sum(F.lit(float(n)) * (F.col(c) - float(p)) for c, n, p in zip("xyz", normal, point))
    return df.withColumn("valid", F.col("valid") & (side > 0))


def partition_radius(df: DataFrame, centre, radius: float, scope: str = ALL) -> DataFrame:
    far = sum((F.col(c) - float(p)) * (F.col(c) - float(p)) for c, p in zip("xyz", centre)) > float(radius) ** 2
    return df.withColumn("valid", F.col("valid") & ~(in_scope(scope) & far))


def partition_cylinder(df: DataFrame, origin, direction, radius: float, scope: str = ALL) -> DataFrame:
    """Rows further than radius from an axis become invalid. The direction is used as given, not scaled to unit length."""
    d = [float(v) for v in direction]
    off = [F.col(c) - float(p) for c, p in zip("xyz", origin)]
    along = sum(o * v for o, v in zip(off, d))
    far = sum((o - along * v) * (o - along * v) for o, v in zip(off, d)) > float(radius) ** 2
    return df.withColumn("valid", F.col("valid") & ~(in_scope(scope) & far))


def partition_box(df: DataFrame, low, high, scope: str = ALL) -> DataFrame:
    """Rows outside a box, whose sides belong to it, become invalid."""
    inside = F.lit(True)
    for c, a, b in zip("xyz", low, high):
        inside = inside & F.col(c).between(float(a), float(b))
    return df.withColumn("valid", F.col("valid") & ~(in_scope(scope) & ~inside))


def _moved(df: DataFrame, scope: str, new: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(in_scope(scope), v).otherwise(F.col(c)) for c, v in new.items()})


def euler_matrix(roll: float, pitch: float, yaw: float) -> list[list[float]]:
    """Rz(yaw) Ry(pitch) Rx(roll); degrees."""
    (cr, sr), (cp, sp), (cy, sy) = ((math.cos(math.radians(a)), math.sin(math.radians(a))) for a in (roll, pitch, yaw))
    return [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]]


def quaternion_matrix(w: float, x: float, y: float, z: float, compat: bool = False) -> list[list[float]]:
    """Active rotation of a quaternion; compat gives its transpose, as older scripts expect."""
    m = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
    return [list(row) for row in zip(*m)] if compat else m


def rotate(df: DataFrame, matrix, scope: str = ALL) -> DataFrame:
    return _moved(df, scope, {c: sum(F.col(k) * float(m) for k, m in zip("xyz", row)) for c, row in zip("xyz", matrix)})


def scale(df: DataFrame, factor, scope: str = ALL) -> DataFrame:
    f = [factor] * 3 if isinstance(factor, (int, float)) else factor
    return _moved(df, scope, {c: F.col(c) * float(v) for c, v in zip("xyz", f)})


def translate(df: DataFrame, offset, scope: str = ALL) -> DataFrame:
    o = [offset] * 3 if isinstance(offset, (int, float)) else offset
    return _moved(df, scope, {c: F.col(c) + float(v) for c, v in zip("xyz", o)})


def recolor(df: DataFrame, red: int, green: int | None = None, blue: int | None = None, scope: str = ALL) -> DataFrame:
    """Constant colour; one value is a grey."""
    rgb = (red, red if green is None else green, red if blue is None else blue)
    return _moved(df, scope, {c: F.lit(int(v)) for c, v in zip("rgb", rgb)})


def statistics(df: DataFrame, scope: str = ALL, unit: float = 1.0) -> DataFrame:
    """Count and bounding box of the rows in scope."""
    box = [f(F.col(c) * unit).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    return df.where(in_scope(scope)).agg(F.count("*").alias("n"), *box)


def model_transform(df: DataFrame, factor: float, offset: float) -> DataFrame:
    """Scale, then add the same number on all axes."""
    return df.withColumns({c: F.col(c) * float(factor) + float(offset) for c in "xyz"})


def to_metres(df: DataFrame, unit: float, columns=("x", "y", "z", "bias", "stddev", "width")) -> DataFrame:
    return df.withColumns({c: F.col(c) * float(unit) for c in columns if c in df.columns})


def correct_bias(df: DataFrame) -> DataFrame:
    """Move each point along its ray from the origin by its bias; a point at the origin becomes null."""
    grown = 1 + F.try_divide(F.col("bias"), F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2))
    return df.withColumns({c: F.col(c) * grown for c in "xyz"})


def range_scan_points(df: DataFrame, distance: str = "range_mm", angle: str = "angle") -> DataFrame:
    """Points in metres and noise in metres of planar ranges in millimetres; ranges out of 500 to 30000 have infinite noise."""
    d = F.col(distance)
    ok = d.between(500, 30000)
    wild = F.lit(float("inf"))
    return df.withColumns(
        {
            "x": d / 1000 * F.cos(angle),
            "y": d / 1000 * F.sin(angle),
            "z": F.lit(0.0),
            "stddev": F.when(ok, F.when(d < 10000, 0.03).otherwise(0.05)).otherwise(wild),
            "width": F.when(ok, (F.lit(0.0006) * d + 1.48) / 1000).otherwise(wild),
        }
    )


def range_between(df: DataFrame, low: float, high: float | None = None, column: str = "range_mm") -> DataFrame:
    """Rows with a range of at least low and, if given, at most high."""
    return df.where((F.col(column) >= low) & (F.lit(True) if high is None else F.col(column) <= high))


def level_of_point(z: Column, floors: list[float], ceilings: list[float]) -> Column:
    """Storey of a height: 0 below the first ceiling, then by the midpoints between a ceiling and the next floor; else the top."""
    out = F.when(z < ceilings[0], 0)
    for i in range(1, len(floors)):
        out = out.when(z < (ceilings[i - 1] + floors[i]) / 2, i - 1)
    return out.otherwise(len(floors) - 1)


def level_of_elevation(z: Column, splits: list[float]) -> Column:
    """Index of the first split above z."""
    return F.size(F.filter(F.array(*[F.lit(float(s)) for s in splits]), lambda s: s <= z))


def is_interior(probability: Column) -> Column:
    return probability > 0.5


def is_object(probability: Column, room: Column) -> Column:
    return (probability <= 0.5) & (room >= 0)


def segmentation_interior(probability: Column, room: Column, scheme: str) -> Column:
    """Whether a leaf counts as interior under scheme ALL, OBJECTS (space around objects in rooms) or ROOM (all of a room)."""
    inside, in_room = is_interior(probability), room >= 0
    return {"ALL": inside, "OBJECTS": in_room & ~inside, "ROOM": inside | in_room}[scheme]
