"""Mergeable statistics, histograms, grids and room measures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF_SUMS = ("total_weight", "prob_sum", "prob_sum_sq", "surface_sum", "corner_sum", "planar_sum")


# --- statistics of a leaf: a count and six sums, which partial aggregation merges --------------------------------------


def leaf_statistics(samples: DataFrame, by: list[str], weight="w", probability="p", surface="surface", corner="corner", planar="planar") -> DataFrame:
    w = F.col(weight)
    return samples.groupBy(*by).agg(
        F.count("*").alias("count"),
        F.sum(w).alias("total_weight"),
        F.sum(w * F.col(probability)).alias("prob_sum"),
        F.sum(w * F.col(probability) * F.col(probability)).alias("prob_sum_sq"),
        F.sum(w * F.col(surface)).alias("surface_sum"),
        F.sum(w * F.col(corner)).alias("corner_sum"),
        F.sum(w * F.col(planar)).alias("planar_sum"),
    )


def merge_leaves(states: DataFrame, by: list[str]) -> DataFrame:
    """Sums of states; the room is the highest, carved is true if any is. Columns room and carved are optional."""
    extra = [f(c).alias(c) for c, f in (("fp_room", F.max), ("carved", F.bool_or)) if c in states.columns]
    return states.groupBy(*by).agg(F.sum("count").alias("count"), *[F.sum(c).alias(c) for c in LEAF_SUMS], *extra)


def subdivide_leaf(states: DataFrame, parts: int = 8) -> DataFrame:
    """The state of one of `parts` equal parts: the count divided without rest but at least 1, sums scaled by the same ratio."""
    n = F.when(F.col("count") > 0, F.greatest(F.lit(1), F.floor(F.col("count") / parts)).cast("long")).otherwise(F.lit(0).cast("long"))
    ratio = F.coalesce(F.try_divide(n.cast("double"), F.col("count")), F.lit(0.0))
    return states.withColumns({"count": n, **{c: F.col(c) * ratio for c in LEAF_SUMS}})


def probability() -> Column:
    """Mean probability of a leaf; 0.5 where nothing was observed."""
    return F.when((F.col("count") > 0) & (F.col("total_weight") > 0), F.col("prob_sum") / F.col("total_weight")).otherwise(0.5)


def uncertainty() -> Column:
    """Variance of the probability of a leaf; 1 with fewer than two samples or no weight."""
    mean = F.try_divide("prob_sum", "total_weight")
    return F.when((F.col("count") <= 1) | (F.col("total_weight") <= 0), 1.0).otherwise(F.try_divide("prob_sum_sq", "total_weight") - mean * mean)


def mean_of(sums: str) -> Column:
    """Weighted mean of surface_sum, corner_sum or planar_sum; 0 where nothing was observed."""
    return F.coalesce(F.try_divide(sums, "total_weight"), F.lit(0.0))


def simplify_leaves(leaves: DataFrame, label: list[str], top: int = 0) -> DataFrame:
    """Merge eight leaves (depth, ix, iy, iz) of one parent into it if they agree in the label columns, depth by depth upwards."""
    depth = leaves.agg(F.max("depth")).first()[0]
    states = ["count", *LEAF_SUMS]
    for d in range(depth or 0, top, -1):
        here = leaves.where(F.col("depth") == d).withColumns({f"p{a}": F.shiftright(f"i{a}", 1) for a in "xyz"})
        family = ["px", "py", "pz"]
        agreed = here.groupBy(*family).agg(F.count("*").alias("n"), *[F.min(c).alias(f"lo_{c}") for c in label], *[F.max(c).alias(f"hi_{c}") for c in label], *[F.sum(c).alias(c) for c in states])
        same = F.col("n") == 8
        for c in label:
            same = same & F.col(f"lo_{c}").eqNullSafe(F.col(f"hi_{c}"))
        merged = agreed.where(same)
        parents = merged.select(F.lit(d - 1).cast(leaves.schema["depth"].dataType).alias("depth"), *[F.col(f"p{a}").alias(f"i{a}") for a in "xyz"], *[F.col(f"lo_{c}").alias(c) for c in label], *states)
        rest = here.join(merged.select(*family), family, "left_anti").drop(*family)
        leaves = leaves.where(F.col("depth") != d).unionByName(rest).unionByName(parents)
    return leaves


# --- histograms -------------------------------------------------------------------------------------------------------


def resolution(value: float) -> float:
    """The absolute value; zero counts as 1."""
    return abs(value) or 1.0


def histogram(df: DataFrame, value: str, res: float, weight: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """(bin, weight): bins are truncated towards zero, so that bin 0 is twice as wide."""
    at = (F.col(value) / F.lit(resolution(res))).cast("long")
    return df.groupBy(*(by or []), at.alias("bin")).agg(F.sum(F.lit(1.0) if weight is None else weight).alias("weight"))


def bin_centre(res: float) -> Column:
    return (F.col("bin") + 0.5) * F.lit(resolution(res))


def merge_histograms(a: DataFrame, a_res: float, b: DataFrame, b_res: float) -> DataFrame:
    """a with the bins of b added by their centres."""
    other = b.select((bin_centre(b_res) / F.lit(resolution(a_res))).cast("long").alias("bin"), "weight")
    return a.select("bin", "weight").unionByName(other).groupBy("bin").agg(F.sum("weight").alias("weight"))


def mode(hist: DataFrame, res: float, by: list[str] | None = None) -> DataFrame:
    """Centre of the first bin of the largest positive weight."""
    top = hist.where("weight > 0").groupBy(*(by or [])).agg(F.max(F.struct("weight", (-F.col("bin")).alias("neg"))).alias("m"))
    return top.select(*(by or []), ((-F.col("m.neg") + 0.5) * F.lit(resolution(res))).alias("mode"), F.col("m.weight").alias("weight"))


def peaks(hist: DataFrame, res: float, buffer: float, by: list[str] | None = None) -> DataFrame:
    """Bins that none within the buffer exceeds; of equal ones all are peaks."""
    n = int(-(-buffer // resolution(res)))
    w = Window.partitionBy(*(by or [])).orderBy("bin").rangeBetween(-n, n)
    return hist.withColumn("__m", F.max("weight").over(w)).where("weight >= __m").drop("__m")


def level_peaks(hist: DataFrame, res: float, buffer: float, by: list[str] | None = None) -> DataFrame:
    """Peaks whose weight also reaches mean + sqrt((sum of squares - sum) / bins)."""
    w = Window.partitionBy(*(by or []))
    gate = F.avg("weight").over(w) + F.sqrt(F.greatest(F.lit(0.0), (F.sum(F.col("weight") * F.col("weight")).over(w) - F.sum("weight").over(w)) / F.count("*").over(w)))
    return peaks(hist.withColumn("gate", gate), res, buffer, by).where("weight >= gate").drop("gate")


def pair_levels(floors: list[tuple[float, float]], ceilings: list[tuple[float, float]], least: float = 2.0) -> list[tuple[float, float]]:
    """(floor, ceiling) from peaks (height, weight) by falling weight of the floor: each takes the nearest unused ceiling above it.

    Levels do not overlap and are at least `least` high. Peaks are few: one for each storey and clutter surface.
    """
    free, out = sorted(ceilings), []
    for z, _ in sorted(floors, key=lambda f: (-f[1], f[0])):
        fits = [c for c, _ in free if c - z >= least]
        if fits and all(fits[0] <= a or z >= b for a, b in out):
            out.append((z, fits[0]))
            free = [c for c in free if c[0] != fits[0]]
    return sorted(out)


def split_heights(levels: list[tuple[float, float]]) -> list[float]:
    """Midpoints between a ceiling and the floor above it."""
    return [(a[1] + b[0]) / 2 for a, b in zip(levels, levels[1:])]


# --- grids ------------------------------------------------------------------------------------------------------------


def cell_key(value: str, res: float, origin: float = 0.0) -> Column:
    """Floor key of a wall or chunk grid."""
    return F.floor((F.col(value) - origin) / res)


def centred_key(value: str, res: float, origin: float = 0.0) -> Column:
    """Key of a grid whose cell 0 is centred on the origin."""
    return F.floor((F.col(value) - origin) / res + 0.5)


def wall_cells(df: DataFrame, res: float, weight: Column, keys: list[Column] | None = None) -> DataFrame:
    """Weighted mean position and normal, and the range of valid heights, of each cell (i0, i1) of a plan grid."""
    keys = keys or [cell_key("x", res), cell_key("y", res)]
    valid = F.col("z_min") <= F.col("z_max") if "z_min" in df.columns else F.lit(True)
    low, high = (F.col("z_min"), F.col("z_max")) if "z_min" in df.columns else (F.col("z"), F.col("z"))
    means = [F.try_divide(F.sum(weight * F.col(c)), F.sum(weight)).alias(f"mean_{c}") for c in ("x", "y", "nx", "ny") if c in df.columns]
    return df.groupBy(keys[0].alias("i0"), keys[1].alias("i1")).agg(F.sum(weight).alias("weight"), *means, F.min(F.when(valid, low)).alias("z_min"), F.max(F.when(valid, high)).alias("z_max"))


def unit_normal(df: DataFrame, a: str = "mean_nx", b: str = "mean_ny") -> DataFrame:
    """The mean normal at unit length; null where it vanishes."""
    n = F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b))
    return df.withColumns({a: F.try_divide(F.col(a), n), b: F.try_divide(F.col(b), n)})


def occupancy_cells(df: DataFrame, res: float, height_res: float = 0.1, pose: str = "pose") -> DataFrame:
    """Count, mean position, ordered set of poses and number of height bins of each cell."""
    return df.groupBy(cell_key("x", res).alias("i0"), cell_key("y", res).alias("i1")).agg(
        F.count("*").alias("num_pts"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.array_sort(F.collect_set(pose)).alias("poses"), F.count_distinct((F.col("z") / height_res).cast("long")).alias("height_bins")
    )


def wall_coverage(cells: DataFrame, least_points: int = 50, least_height: float = 2.0, height_res: float = 0.1) -> DataFrame:
    """Cells with enough points in enough height bins to be a wall."""
    return cells.where((F.col("num_pts") >= least_points) & (F.col("height_bins") >= least_height / height_res))


def with_poses(cells: DataFrame) -> DataFrame:
    return cells.where(F.size("poses") > 0)


def open_heights(leaves: DataFrame, res: float) -> DataFrame:
    """Interior histogram: open height and height range of each plan cell, from observed interior leaves (cx, cy, cz, hw).

    A leaf gives twice its half width to each cell whose centre it covers; keys are truncated towards zero.
    """
    inside = leaves.where((F.col("count") > 0) & (probability() > 0.5))
    for n, c in enumerate(("cx", "cy")):
        low, high = (F.col(c) - F.col("hw")) / res, (F.col(c) + F.col("hw")) / res
        inside = inside.withColumn(f"i{n}", F.explode(F.sequence(F.floor(low), F.ceil(high)))).where(((F.col(f"i{n}") + 0.5) >= low) & ((F.col(f"i{n}") + 0.5) < high))
    return inside.groupBy("i0", "i1").agg(F.sum(2 * F.col("hw")).alias("open_height"), F.min(F.col("cz") - F.col("hw")).alias("min_z"), F.max(F.col("cz") + F.col("hw")).alias("max_z"))


def z_buffer(df: DataFrame, res: float, order: list[str], skip_black: bool = False) -> DataFrame:
    """The highest point of each pixel gives colour and time; of equal heights the later row in the given order."""
    rows = df.where(~((F.col("r") == 0) & (F.col("g") == 0) & (F.col("b") == 0))) if skip_black else df
    top = rows.groupBy(cell_key("x", res).alias("px"), cell_key("y", res).alias("py")).agg(F.max_by(F.struct("r", "g", "b", "timestamp", "z"), F.struct("z", *order)).alias("t"))
    return top.select("px", "py", "t.*")


# --- rooms ------------------------------------------------------------------------------------------------------------


def upper_median(value: str) -> Column:
    """Element n / 2 of the sorted values, counted from 0. Exact: for groups of bounded size, such as the cells of a room."""
    values = F.array_sort(F.collect_list(value))
    return F.element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def ranked_upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The same for groups of any size: by rank in a window, which spills, rather than in an array."""
    w = Window.partitionBy(*by)
    ranked = df.where(F.col(value).isNotNull()).withColumns({"__k": F.row_number().over(w.orderBy(value)) - 1, "__n": F.count("*").over(w)})
    return ranked.where(F.col("__k") == F.floor(F.col("__n") / 2)).select(*by, F.col(value).alias("upper_median"))


def room_table(rooms: DataFrame, room: str, perimeter: str, area: str, height: str) -> DataFrame:
    """Perimeter, area and volume of each room, and a last row of totals with a null room."""
    return rooms.rollup(room).agg(F.sum(perimeter).alias("perimeter"), F.sum(area).alias("area"), F.sum(F.col(area) * F.col(height)).alias("volume"))


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def border_lengths(edges: DataFrame, a: str, b: str, length: str) -> DataFrame:
    """Total border of each pair of rooms, the smaller one first."""
    return edges.where(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias("room_a"), F.greatest(a, b).alias("room_b")).agg(F.sum(length).alias("length"))


def region_strength(area: Column, planarity: Column, nz: Column, least_area: float, most_nz: float) -> Column:
    """area * planarity * (1 - |nz|); 0 for small regions and those that are not upright."""
    return F.when((area < least_area) | (F.abs(nz) > most_nz), 0.0).otherwise(area * planarity * (1 - F.abs(nz)))


def moments(df: DataFrame, by: list[str], axes=("x", "y", "z")) -> DataFrame:
    """Count, means and covariances of coordinates: what plane and line fits need, merged by partial aggregation."""
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"mean_{a}") for a in axes], *[F.covar_pop(a, b).alias(f"cov_{a}{b}") for a, b in pairs])


def fit_planes(df: DataFrame, by: list[str]) -> DataFrame:
    """Normal, centre and mean square distance of the best plane of each group: moments, then a 3 x 3 eigenproblem a group."""
    @F.pandas_udf("nx double, ny double, nz double, error double")
    def solve(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        m = np.stack([np.stack(r, -1) for r in ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))], -2).astype(float)
        values, vectors = np.linalg.eigh(m)
        n = vectors[:, :, 0]
        first = np.argmax(np.abs(n), axis=1)
        n = n * np.sign(n[np.arange(len(n)), first])[:, None]  # the largest component is positive
        return pd.DataFrame({"nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2], "error": np.maximum(values[:, 0], 0.0)})

    m = moments(df, by)
    fit = m.withColumn("f", solve(*[f"cov_{p}" for p in ("xx", "xy", "xz", "yy", "yz", "zz")]))
    return fit.select(*by, "n", "mean_x", "mean_y", "mean_z", "f.*")


def fit_lines(df: DataFrame, by: list[str]) -> DataFrame:
    """Direction (in the plane) and mean square distance of the best line of each group, in closed form."""
    m = moments(df, by, ("x", "y"))
    half, diff = (F.col("cov_xx") + F.col("cov_yy")) / 2, (F.col("cov_xx") - F.col("cov_yy")) / 2
    root = F.sqrt(diff * diff + F.col("cov_xy") * F.col("cov_xy"))
    return m.select(*by, "n", "mean_x", "mean_y", (F.atan2(F.col("cov_xy") * 2, diff * 2) / 2).alias("angle"), F.greatest(F.lit(0.0), half - root).alias("error"))


def keep_rate(df: DataFrame, time_ms: str, by: list[str], rate: float = 40.0) -> DataFrame:
    """Scans received as a share of those expected over the time spanned."""
    return df.groupBy(*by).agg(F.try_divide(F.count("*"), (F.max(time_ms) - F.min(time_ms)) * rate / 1000).alias("keep_rate"))


def flip_leaf(states: DataFrame) -> DataFrame:
    """Leaves with the other side of their probability: one sample of 1 - probability and the same weight."""
    p = 1 - probability()
    return states.withColumns({"prob_sum": p * F.col("total_weight"), "prob_sum_sq": p * p * F.col("total_weight"), "count": F.lit(1).cast("long")})


def mean_heading(df: DataFrame, by: list[str], vector=("mx", "my")) -> DataFrame:
    """Direction of the mean of unit vectors, such as magnetometer readings turned into the world; null where they cancel."""
    n = F.sqrt(F.col(vector[0]) * F.col(vector[0]) + F.col(vector[1]) * F.col(vector[1]))
    unit = [F.try_divide(F.col(v), n) for v in vector]
    return df.groupBy(*by).agg(F.avg(unit[0]).alias("x"), F.avg(unit[1]).alias("y")).withColumn("heading", F.when((F.col("x") != 0) | (F.col("y") != 0), F.atan2("y", "x"))).drop("x", "y")


def neighbourhood_sums(cells: DataFrame, value: str, reach: int = 1) -> DataFrame:
    """Sum of a value over the cells (i0, i1) that at most `reach` steps through existing 4-neighbours lead to, itself included.

    Each step spreads the set of cells reached by an equi-join, so that gaps block; the sets have at most 2 r^2 + 2 r + 1 cells.
    """
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    there = cells.select(F.col("i0").alias("j0"), F.col("i1").alias("j1"))
    reached = cells.select("i0", "i1", F.col("i0").alias("j0"), F.col("i1").alias("j1"))
    for _ in range(reach):
        step = reached.withColumn("m", F.explode(moves)).select("i0", "i1", (F.col("j0") + F.col("m.a")).alias("j0"), (F.col("j1") + F.col("m.b")).alias("j1")).distinct()
        reached = step.join(there, ["j0", "j1"], "left_semi")
    values = cells.select(F.col("i0").alias("j0"), F.col("i1").alias("j1"), F.col(value).alias("v"))
    return reached.join(values, ["j0", "j1"]).groupBy("i0", "i1").agg(F.sum("v").alias("total"))


def lit_components(pixels: DataFrame, brightness: str, least: float, least_area: int, watts_per_pixel: float) -> DataFrame:
    """One row a lamp: pixels (row, col) at least as bright as `least`, in 4-connected groups of `least_area` or more, with its watts."""
    from .sets import components_of
    from .volume import shifted

    bright = pixels.where(F.col(brightness) >= least).select(F.col("row").cast("long").alias("i0"), F.col("col").cast("long").alias("i1"))
    at = bright.select("i0", "i1", (F.col("i0") * F.lit(1 << 31) + F.col("i1")).alias("node"))
    near = shifted(at, ["i0", "i1"], [(1, 0), (0, 1)]).withColumnRenamed("node", "u").join(at.withColumnRenamed("node", "v"), ["i0", "i1"])
    found = components_of(at, near.select("u", "v"))
    return found.groupBy("number").agg(F.count("*").alias("area")).where(F.col("area") >= least_area).withColumn("watts", F.col("area") * float(watts_per_pixel))
