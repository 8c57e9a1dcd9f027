"""Joins in time and space that Spark has no operator for, from equi-joins on buckets and window functions."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, left_time: str, right_time: str, width: float, by: list[str] | None = None, forward: bool = False, strict: bool = False, prefix: str = "") -> DataFrame:
    """left with the columns of the last right row at or before its time (forward: the first at or after); null if there is none.

    strict leaves out equal times. Of right rows at one time, the greatest by all columns counts (forward: the smallest).
    Time is cut into buckets of `width`, so that windows stay short and run in parallel even without a key: within its bucket
    a row looks among its neighbours, and otherwise takes what is carried over from the buckets before, of which there is one
    row each. Right columns are prefixed with `prefix`.
    """
    by = by or []
    bucket = lambda c: F.floor(F.col(c) / F.lit(float(width)))
    r = right.select(*by, F.col(right_time).alias("__t"), F.struct(right_time, *[c for c in right.columns if c not in by and c != right_time]).alias("__r"), bucket(right_time).alias("__b"))
    q = left.select(*by, F.col(left_time).alias("__t"), F.struct(*left.columns).alias("__l"), bucket(left_time).alias("__b"))
    pick = F.min if forward else F.max
    held = r.groupBy(*by, "__b").agg(pick("__r").alias("__c"))
    marks = q.select(*by, "__b").distinct().withColumn("__c", F.lit(None).cast(held.schema["__c"].dataType)).unionByName(held).groupBy(*by, "__b").agg(pick("__c").alias("__c"))
    key = [F.col(c) for c in by]
    order = F.col("__b").desc() if forward else F.col("__b").asc()
    carry = marks.withColumn("__c", F.last("__c", True).over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    # sides: with strict, a left row comes before right rows of its time
    side = (1, 0) if strict else (0, 1)
    both = r.withColumn("__s", F.lit(side[0])).withColumn("__l", F.lit(None).cast(q.schema["__l"].dataType)).unionByName(q.withColumn("__s", F.lit(side[1])).withColumn("__r", F.lit(None).cast(r.schema["__r"].dataType)))
    time, row = (F.col("__t").desc(), F.col("__r").desc()) if forward else (F.col("__t").asc(), F.col("__r").asc())
    w = Window.partitionBy(*key, "__b").orderBy(time, "__s", row).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("__r", F.last("__r", True).over(w)).where(F.col("__l").isNotNull())
    out = seen.join(carry.select(*by, "__b", "__c"), [*by, "__b"], "left").withColumn("__r", F.coalesce("__r", "__c"))
    fields = [right_time, *[c for c in right.columns if c not in by and c != right_time]]
    return out.select("__l.*", *[F.col(f"__r.{c}").alias(f"{prefix}{c}") for c in fields])


def as_of_clamped(left: DataFrame, right: DataFrame, left_time: str, right_time: str, width: float, by: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Backward as-of join; times before the first right row get the first one."""
    back = as_of(left, right, left_time, right_time, width, by, prefix=prefix)
    columns = [c for c in right.columns if c not in (by or [])]
    first = right.groupBy(*(by or [])).agg(F.min(F.struct(right_time, *[c for c in columns if c != right_time])).alias("__first"))
    joined = back.join(first, by, "left") if by else back.join(F.broadcast(first))  # without a key it has one row
    return joined.select(*left.columns, *[F.when(F.col(f"{prefix}{right_time}").isNull(), F.col(f"__first.{c}")).otherwise(F.col(f"{prefix}{c}")).alias(f"{prefix}{c}") for c in columns])


def nearest(left: DataFrame, right: DataFrame, left_time: str, right_time: str, width: float, by: list[str] | None = None, later_wins: bool = True, prefix: str = "") -> DataFrame:
    """left with the right row nearest in time; of two at the same distance the later, or with later_wins=False the earlier."""
    columns = [c for c in right.columns if c not in (by or [])]
    out = as_of(left, right, left_time, right_time, width, by, prefix="__p_")
    out = as_of(out, right, left_time, right_time, width, by, forward=True, strict=True, prefix="__n_")
    before, after = F.col(left_time) - F.col(f"__p_{right_time}"), F.col(f"__n_{right_time}") - F.col(left_time)
    take_previous = before.isNotNull() & (after.isNull() | ((after > before) if later_wins else (after >= before)))
    return out.select(*left.columns, *[F.when(take_previous, F.col(f"__p_{c}")).otherwise(F.col(f"__n_{c}")).alias(f"{prefix}{c}") for c in columns])


def with_next(rows: DataFrame, time: str, width: float, by: list[str] | None = None, prefix: str = "next_") -> DataFrame:
    """Each row with the columns of the next one in time."""
    return as_of(rows, rows, time, time, width, by, forward=True, strict=True, prefix=prefix)


def slerp(a: list[Column], b: list[Column], f: Column) -> list[Column]:
    """Spherical interpolation from quaternion a to b (w, x, y, z), the short way."""
    dot = sum(x * y for x, y in zip(a, b))
    flip = F.when(dot < 0, -1.0).otherwise(1.0)
    theta = F.acos(F.least(F.lit(1.0), F.abs(dot)))
    near = F.abs(dot) > 0.9999999
    wa = F.when(near, 1 - f).otherwise(F.try_divide(F.sin((1 - f) * theta), F.sin(theta)))
    wb = F.when(near, f).otherwise(F.try_divide(F.sin(f * theta), F.sin(theta))) * flip
    return [wa * x + wb * y for x, y in zip(a, b)]


def interpolate(left: DataFrame, right: DataFrame, left_time: str, right_time: str, linear: list[str], width: float, by: list[str] | None = None, quaternion: list[str] | None = None) -> DataFrame:
    """left with the `linear` columns of right interpolated at its time, and a quaternion by spherical interpolation.

    Times out of range take the first or last row. In the first interval the first row holds without interpolation, as the
    programs that this format comes from have it.
    """
    cols = [*linear, *(quaternion or [])]
    rows = right.select(*(by or []), right_time, *cols)
    steps = with_next(rows, right_time, width, by, "__n_")
    start = rows.groupBy(*(by or [])).agg(F.min(right_time).alias("__start"))
    steps = steps.join(start, by) if by else steps.join(F.broadcast(start))
    out = as_of_clamped(left, steps, left_time, right_time, width, by, prefix="__i_")
    t0, t1 = F.col(f"__i_{right_time}"), F.col(f"__i___n_{right_time}")
    hold = (t0 == F.col("__i___start")) | t1.isNull() | (F.col(left_time) <= t0)
    f = F.when(hold, 0.0).otherwise(F.try_divide(F.col(left_time) - t0, t1 - t0))
    new = {c: F.when(hold, F.col(f"__i_{c}")).otherwise(F.col(f"__i_{c}") * (1 - f) + F.col(f"__i___n_{c}") * f) for c in linear}
    if quaternion:
        mixed = slerp([F.col(f"__i_{c}") for c in quaternion], [F.col(f"__i___n_{c}") for c in quaternion], f)
        new |= {c: F.when(hold, F.col(f"__i_{c}")).otherwise(m) for c, m in zip(quaternion, mixed)}
    return out.select(*left.columns, *[v.alias(c) for c, v in new.items()])


def convert_clock(df: DataFrame, clocks: DataFrame, sensor: str, raw: str, out: str = "timestamp", default_stddev: float | None = None) -> DataFrame:
    """slope * raw + offset by sensor; the clock table (sensor, slope, offset, stddev) has a row for each sensor.

    A negative stddev is unknown and becomes default_stddev. The table is joined by key; Spark broadcasts it if it is small.
    """
    joined = df.join(clocks.select(F.col("sensor").alias(sensor), "slope", "offset", F.col("stddev").alias("clock_stddev")), sensor)
    joined = joined.withColumn(out, F.col("slope") * F.col(raw) + F.col("offset"))
    return joined.withColumn("clock_stddev", F.when(F.col("clock_stddev") < 0, F.lit(default_stddev)).otherwise(F.col("clock_stddev"))).drop("slope", "offset")


def outside_intervals(df: DataFrame, intervals: DataFrame, time: str, width: float, start: str = "t0", end: str = "t1", by: list[str] | None = None) -> DataFrame:
    """Rows whose time lies in none of the closed intervals: an anti join on the buckets that intervals touch."""
    return _interval(df, intervals, time, width, start, end, by, "left_anti")


def inside_intervals(df: DataFrame, intervals: DataFrame, time: str, width: float, start: str = "t0", end: str = "t1", by: list[str] | None = None) -> DataFrame:
    """Rows whose time lies in at least one of the closed intervals."""
    return _interval(df, intervals, time, width, start, end, by, "left_semi")


def _interval(df, intervals, time, width, start, end, by, how):
    by = by or []
    cells = intervals.select(*[F.col(c).alias(f"__{c}") for c in by], F.col(start).alias("__a"), F.col(end).alias("__z"), F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias("__cell"))
    on = (F.floor(F.col(time) / width) == F.col("__cell")) & F.col(time).between(F.col("__a"), F.col("__z"))
    for c in by:
        on = on & (F.col(c) == F.col(f"__{c}"))
    return df.join(cells, on, how)


def radius_join(left: DataFrame, right: DataFrame, radius: float, axes: list[str], prefix: str = "n_", closed: bool = False) -> DataFrame:
    """Pairs of rows nearer than radius (closed: or at it), by an equi-join on grid cells and their neighbours."""
    cell = [F.floor(F.col(a) / radius) for a in axes]
    offsets = F.sequence(F.lit(-1), F.lit(1))
    near = left
    for i, (a, c) in enumerate(zip(axes, cell)):
        near = near.withColumn(f"__c{i}", c).withColumn(f"__o{i}", F.explode(offsets)).withColumn(f"__c{i}", F.col(f"__c{i}") + F.col(f"__o{i}")).drop(f"__o{i}")
    other = right.select(*[F.col(c).alias(f"{prefix}{c}") for c in right.columns], *[c.alias(f"__c{i}") for i, c in enumerate(cell)])
    joined = near.join(other, [f"__c{i}" for i in range(len(axes))])
    d2 = sum((F.col(a) - F.col(f"{prefix}{a}")) * (F.col(a) - F.col(f"{prefix}{a}")) for a in axes)
    return joined.where(d2 <= radius * radius if closed else d2 < radius * radius).withColumn("distance", F.sqrt(d2)).drop(*[f"__c{i}" for i in range(len(axes))])


def nearest_within(left: DataFrame, right: DataFrame, radius: float, axes: list[str], left_key: list[str], right_key: str) -> DataFrame:
    """For each left key the right row nearest within radius, ties to the smaller key; left rows without one are left out."""
    pairs = radius_join(left, right, radius, axes, closed=True)
    return pairs.groupBy(*left_key).agg(F.min(F.struct("distance", F.col(f"n_{right_key}").alias(right_key))).alias("m")).select(*left_key, F.col(f"m.{right_key}").alias(right_key), F.col("m.distance").alias("distance"))


def cell_lookup(df: DataFrame, cells: DataFrame, width: float, axes: list[str], value: str, missing=None) -> DataFrame:
    """The value of the grid cell (columns i0, i1, ...) that a row lies in; `missing` where there is no such cell."""
    keys = {f"i{n}": F.floor(F.col(a) / width) for n, a in enumerate(axes)}
    joined = df.withColumns(keys).join(cells.select(*keys, value), list(keys), "left")
    return joined.withColumn(value, F.coalesce(F.col(value), F.lit(missing))).drop(*keys)


def segment_cells(df: DataFrame, start: list[str], end: list[str], width: float, before: str | None = None) -> DataFrame:
    """The grid cells that a segment crosses, as columns i0, i1, ...: one row for each, found from the crossings of grid lines.

    With `before`, a prefix, the cell before it on the segment comes along, null for the first. The cells of a segment that lie in a
    box follow on each other, so that a pair of both is met once where the cell before lies outside the box.
    """
    def crossings(a, b):
        lo, hi = F.floor(F.least(a, b) / width), F.floor(F.greatest(a, b) / width)
        lines = F.when(hi > lo, F.sequence(lo + 1, hi)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(lines, lambda k: F.coalesce(F.try_divide(k * F.lit(float(width)) - a, b - a), F.lit(0.0)))

    t = F.concat(F.array(F.lit(0.0), F.lit(1.0)), *[crossings(F.col(a), F.col(b)) for a, b in zip(start, end)])
    cut = df.withColumn("__t", F.array_sort(F.array_distinct(F.filter(t, lambda v: v.between(0.0, 1.0)))))
    middle = F.transform(F.slice(F.col("__t"), F.lit(1), F.greatest(F.lit(1), F.size("__t") - 1)), lambda v, i: F.when(F.size("__t") > 1, (v + F.get(F.col("__t"), i + 1)) / 2).otherwise(v))
    cell = lambda m: {n: F.floor((F.col(a) + (F.col(b) - F.col(a)) * m) / width) for n, (a, b) in enumerate(zip(start, end))}
    if before is None:
        cut = cut.withColumn("__m", F.explode(middle))
        return cut.withColumns({f"i{n}": c for n, c in cell(F.col("__m")).items()}).drop("__t", "__m").distinct()
    cut = cut.withColumn("__m", middle).select("*", F.posexplode("__m").alias("__k", "__v")).withColumn("__p", F.get("__m", F.col("__k") - 1))
    cells = {f"i{n}": c for n, c in cell(F.col("__v")).items()} | {f"{before}{n}": c for n, c in cell(F.col("__p")).items()}
    return cut.withColumns(cells).drop("__t", "__m", "__k", "__v", "__p")


def met_first(before: str, low: list[str], high: list[str], width: float) -> Column:
    """Whether the cell before, of segment_cells, lies outside a box."""
    return F.col(f"{before}0").isNull() | ~reduce(and_, [F.col(f"{before}{n}").between(F.floor(F.col(a) / width), F.floor(F.col(b) / width)) for n, (a, b) in enumerate(zip(low, high))])


def box_cells(df: DataFrame, low: list[str], high: list[str], width: float) -> DataFrame:
    """The grid cells that a box touches, one row for each: candidates of a spatial join, to be tested exactly afterwards."""
    out = df
    for n, (a, b) in enumerate(zip(low, high)):
        out = out.withColumn(f"i{n}", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))))
    return out


def face_neighbours(leaves: DataFrame, key: str = "leaf") -> DataFrame:
    """Pairs of leaf cubes (cx, cy, cz, hw) that share part of a face: (a, b, axis, area), b on the upper side of a.

    Leaves of all sizes meet on the planes of their faces: the equi-join is on the plane and on the cells of the larger side.
    """
    axes = "xyz"
    out = None
    top = leaves.agg(F.max(F.floor(F.log2(F.col("hw"))))).first()[0] or 0
    for n, axis in enumerate(axes):
        u, v = (axes[(n + k) % 3] for k in (1, 2))

        def side(sign, name):
            return leaves.select(F.col(key).alias(name), F.round(F.col(f"c{axis}") + sign * F.col("hw"), 9).alias("plane"), *[F.col(f"c{w}").alias(f"{name}_{w}") for w in (u, v)], F.col("hw").alias(f"{name}_hw"), F.floor(F.log2(F.col("hw"))).alias(f"{name}_d"))
        up, low = side(1, "a"), side(-1, "b")
        def meet(df, name):
            # a row meets those of its own size and larger ones in cells of the larger size; there are as many sizes as depths
            cells = {f"c{k}": F.floor(F.col(f"{name}_{w}") / F.pow(F.lit(2.0), F.col("d") + 2)) for k, w in enumerate((u, v))}
            return df.withColumn("d", F.explode(F.sequence(F.col(f"{name}_d"), F.lit(top)))).withColumns(cells)

        def spread(df):
            for k in range(2):
                df = df.withColumn(f"c{k}", F.explode(F.sequence(F.col(f"c{k}") - 1, F.col(f"c{k}") + 1)))
            return df

        pairs = spread(meet(up, "a")).join(meet(low, "b"), ["plane", "d", "c0", "c1"]).where("d = greatest(a_d, b_d)")
        over = [F.least(F.col(f"a_{w}") + F.col("a_hw"), F.col(f"b_{w}") + F.col("b_hw")) - F.greatest(F.col(f"a_{w}") - F.col("a_hw"), F.col(f"b_{w}") - F.col("b_hw")) for w in (u, v)]
        got = pairs.where((over[0] > 1e-9) & (over[1] > 1e-9)).select("a", "b", F.lit(axis).alias("axis"), (over[0] * over[1]).alias("area")).distinct()
        out = got if out is None else out.unionByName(got)
    return out


def bucket_width(span: float, buckets: int = 1024) -> float:
    """A width that cuts a span of time into about so many buckets."""
    return max(span / buckets, math.ulp(1.0))
