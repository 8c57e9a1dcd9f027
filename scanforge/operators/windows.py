"""Operators along ordered rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import cut


def running_count(df: DataFrame, order: list[str], name: str, where: Column | None = None) -> DataFrame:
    """df with the number of rows before each in a total order that satisfy `where`, without bringing all rows to one task.

    `where` may also be a whole number for each row, of which the sum before it is taken.

    Rows are dealt into ranges of the order and counted; the counts, of which there is one a range, give where each range starts.
    """
    mark = F.lit(1) if where is None else where.cast("long")
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # stored, as the range of a row must stay the same in both uses
    dealt = cut(df.withColumn("__m", F.coalesce(mark, F.lit(0)).cast("long")).repartitionByRange(ranges, *order).withColumn("__p", F.spark_partition_id()))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__p").agg(F.sum("__m").alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.coalesce(F.sum("__m").over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = dealt.withColumn("__own", own).join(F.broadcast(starts), "__p")  # a row a range
    return counted.withColumn(name, F.col("__start") + F.col("__own")).drop("__m", "__p", "__own", "__start")


def along(time: str, by: list[str] | None = None):
    """Window of a series in time order."""
    return (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(time)


def velocities(df: DataFrame, time: str, axes: list[str], by: list[str]) -> DataFrame:
    """Forward differences over time as v_<axis>; the last row of a series, and steps of no duration, have null."""
    w = along(time, by)
    dt = F.lead(time).over(w) - F.col(time)
    return df.withColumns({f"v_{a}": F.try_divide(F.lead(a).over(w) - F.col(a), dt) for a in axes})


def angular_speed(df: DataFrame, time: str, angle: str, by: list[str]) -> DataFrame:
    """Rate of an angle in degrees, as radians a second the short way round."""
    w = along(time, by)
    turn = F.radians(F.pmod(F.lead(angle).over(w) - F.col(angle) + 180.0, F.lit(360.0)) - 180.0)
    return df.withColumn("omega", F.try_divide(turn, F.lead(time).over(w) - F.col(time)))


def out_of_order(df: DataFrame, time: str, order: list[str], by: list[str]) -> DataFrame:
    """Rows whose time is before that of the row they follow in arrival order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("previous", F.lag(time).over(w)).where(F.col(time) < F.col("previous"))


def next_values(distinct: DataFrame, column: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Distinct rows with the next value of a column: by a window within groups, and without groups by numbers and an equi-join."""
    if by:
        return distinct.withColumn(name, F.lead(column).over(Window.partitionBy(*by).orderBy(column)))
    rows = running_count(distinct.select(column), [column], "__k")
    after = rows.select(F.col(column).alias(name), (F.col("__k") - 1).alias("__k"))
    return rows.join(after, "__k", "left").drop("__k")


def frame_pairs(df: DataFrame, frame: str, point: str, by: list[str] | None = None) -> DataFrame:
    """Point i of frame k with point i + 1, and with point i of frame k + 1: columns next_point, next_frame.

    Frames follow each other in the order of their number; points that are not valid are left out before.
    """
    w = Window.partitionBy(*(by or []), frame).orderBy(point)
    following = next_values(df.select(*(by or []), frame).distinct(), frame, "next_frame", by)
    return df.withColumn("next_point", F.lead(point).over(w)).join(following, [*(by or []), frame])


def compact_index(valid: Column, order: list[str], by: list[str]) -> Column:
    """Number of valid rows before a row: the index it gets when the others are left out."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(valid.cast("long")).over(w), F.lit(0))


def nearest_valid(value: Column, order: list[str], by: list[str], back_first: bool = True) -> Column:
    """The value of the last row at or before with one, else of the first after; back_first=False looks the other way first."""
    w = Window.partitionBy(*by).orderBy(*order)
    back = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(back, ahead) if back_first else F.coalesce(ahead, back)


def slowest_in_window(df: DataFrame, speed: str, order: str, by: list[str], half: int) -> DataFrame:
    """Position of the smallest absolute speed among the rows up to `half` before and after; the first of equal ones."""
    w = Window.partitionBy(*by).orderBy(order)
    at = df.withColumn("pos", F.row_number().over(w) - 1)
    near = F.min(F.struct(F.abs(F.col(speed)).alias("s"), F.col("pos").alias("p"))).over(Window.partitionBy(*by).orderBy("pos").rowsBetween(-half, half))
    return at.withColumn("slowest", near["p"])


def sample_by_distance(df: DataFrame, axes: list[str], order: str, by: list[str], least: float) -> DataFrame:
    """Rows of each series that lie at least `least` from the last one taken, the first being taken. Sequential within a series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        keep, last = [], None
        for i, p in enumerate(pdf[axes].to_numpy()):
            if last is None or ((p - last) ** 2).sum() >= least * least:
                keep.append(i)
                last = p
        return pdf.iloc[keep]

    return df.groupBy(*by).applyInPandas(run, df.schema)


def changes(df: DataFrame, value: str, order: list[str], by: list[str]) -> DataFrame:
    """Rows at which a value differs from that of the row before: previous, value."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("previous", F.lag(value).over(w)).where(F.col("previous") != F.col(value))


def path_length(df: DataFrame, axes: list[str], order: str, by: list[str]) -> DataFrame:
    """Sum of the distances between consecutive rows of each series."""
    w = Window.partitionBy(*by).orderBy(order)
    step = F.sqrt(sum((F.col(a) - F.lag(a).over(w)) * (F.col(a) - F.lag(a).over(w)) for a in axes))
    return df.withColumn("step", step).groupBy(*by).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def local_maxima(cells: DataFrame, value: str, reach: int = 1) -> DataFrame:
    """Grid cells (i0, i1) that no neighbour within reach exceeds; of equal ones the smaller key. Numbered in key order as seed."""
    off = F.sequence(F.lit(-reach), F.lit(reach))
    other = cells.select(F.col("i0").alias("j0"), F.col("i1").alias("j1"), F.col(value).alias("o"))
    near = other.withColumn("d0", F.explode(off)).withColumn("d1", F.explode(off)).where("d0 <> 0 or d1 <> 0")
    near = near.select((F.col("j0") + F.col("d0")).alias("i0"), (F.col("j1") + F.col("d1")).alias("i1"), "o", "j0", "j1")
    beaten = cells.join(near, ["i0", "i1"]).where((F.col("o") > F.col(value)) | ((F.col("o") == F.col(value)) & (F.struct("j0", "j1") < F.struct(F.col("i0"), F.col("i1")))))
    top = cells.join(beaten.select("i0", "i1").distinct(), ["i0", "i1"], "left_anti")
    return running_count(top, ["i0", "i1"], "seed")
