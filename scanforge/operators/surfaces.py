"""Faces, regions and corners of the boundary of a voxel tree, and smoothing of meshes by region."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import shapes as G
from .sets import components_of
from .volume import laplace_smooth


def leaf_faces(faces: DataFrame, leaves: DataFrame, key: str = "leaf") -> DataFrame:
    """Centre (fx, fy, fz), inward normal and position by probability of each face of boundary_faces.

    leaves: key, cx, cy, cz, hw, probability. The position lies where the probability passes 0.5 between the two centres.
    """
    side = lambda n: leaves.select(F.col(key).alias(n), *[F.col(c).alias(f"{n[0]}_{c}") for c in ("cx", "cy", "cz", "hw", "probability")])
    f = faces.join(side("interior"), "interior").join(side("exterior"), "exterior")
    small = F.when(F.col("i_hw") <= F.col("e_hw"), F.lit("i")).otherwise(F.lit("e"))
    out = f.withColumn("small", small)
    for a in "xyz":
        centre = F.when(F.col("small") == "i", F.col(f"i_c{a}")).otherwise(F.col(f"e_c{a}"))
        plane = F.col(f"i_c{a}") + F.col("sign") * F.col("i_hw")
        out = out.withColumn(f"f{a}", F.when(F.col("axis") == a, plane).otherwise(centre)).withColumn(f"n{a}", F.when(F.col("axis") == a, -F.col("sign").cast("double")).otherwise(0.0))
    at = {a: F.when(F.col("axis") == a, G.face_position(F.col("i_probability"), F.col("e_probability"), F.col(f"i_c{a}"), F.col(f"e_c{a}"))).otherwise(F.col(f"f{a}")) for a in "xyz"}
    return out.withColumns({f"p{a}": v for a, v in at.items()}).select("interior", "exterior", "axis", "sign", "area", *[f"{k}{a}" for k in "fnp" for a in "xyz"])


def face_links(faces: DataFrame, face: str = "face") -> DataFrame:
    """Pairs (u, v), u < v, of faces (face, axis, fx, fy, fz, hw) of one direction and plane that share an edge."""
    out = None
    for axis, others in (("x", "yz"), ("y", "xz"), ("z", "xy")):
        here = faces.where(F.col("axis") == axis)
        corner = F.explode(F.array(*[F.struct(F.round(F.col(f"f{others[0]}") + a * F.col("hw"), 9).alias("u0"), F.round(F.col(f"f{others[1]}") + b * F.col("hw"), 9).alias("v0"), F.lit(d).alias("d")) for a, b, d in ((0, -1, 0), (0, 1, 0), (-1, 0, 1), (1, 0, 1))]))
        sides = here.select(F.col(face).alias("f"), "sign", F.round(f"f{axis}", 9).alias("plane"), corner.alias("e")).select("f", "sign", "plane", "e.*")
        pair = sides.join(sides.withColumnRenamed("f", "g"), ["sign", "plane", "u0", "v0", "d"]).where("f < g").select(F.col("f").alias("u"), F.col("g").alias("v"))
        out = pair if out is None else out.unionByName(pair)
    return out.distinct()


def planar_regions(faces: DataFrame, links: DataFrame, face: str = "face") -> DataFrame:
    """(face, region, number): components of faces over links."""
    found = components_of(faces.select(F.col(face).alias("node")), links)
    return found.select(F.col("node").alias(face), F.col("component").alias("region"), "number")


def region_summary(faces: DataFrame, region: str = "region") -> DataFrame:
    """Area, least planarity, centre, mean normal, extents and L-infinity radius about the centre of each region.

    faces: region, area, planarity, fx, fy, fz, nx, ny, nz. Two aggregations: the radius needs the centre.
    """
    s = faces.groupBy(region).agg(F.sum("area").alias("area"), F.min("planarity").alias("planarity"), F.count("*").alias("faces"), *[F.avg(f"f{a}").alias(f"c{a}") for a in "xyz"], *[F.sum(F.col("area") * F.col(f"n{a}")).alias(f"s{a}") for a in "xyz"], *[f(f"f{a}").alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    n = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + F.col("sz") * F.col("sz"))
    s = s.withColumns({f"n{a}": F.try_divide(F.col(f"s{a}"), n) for a in "xyz"}).drop("sx", "sy", "sz")
    off = faces.join(s.select(region, "cx", "cy", "cz"), region)
    radius = off.groupBy(region).agg(F.max(F.greatest(*[F.abs(F.col(f"f{a}") - F.col(f"c{a}")) for a in "xyz"])).alias("radius"))
    return s.join(radius, region)


def dominant_direction(nx: Column, ny: Column, nz: Column) -> Column:
    """The axis direction nearest to a normal: x+, x-, y+, y-, z+ or z-; ties to the earlier."""
    dirs = [("x+", nx), ("x-", -nx), ("y+", ny), ("y-", -ny), ("z+", nz), ("z-", -nz)]
    best = F.greatest(*[v for _, v in dirs])
    out = F.when(dirs[0][1] == best, dirs[0][0])
    for name, v in dirs[1:]:
        out = out.when(v == best, name)
    return out


def horizontal_kind(nz: Column, area: Column, least_area: float, least_alignment: float) -> Column:
    """floor, ceiling, or null for regions that are small or not level; nz points into the open space."""
    return F.when((area >= least_area) & (F.abs(nz) >= least_alignment), F.when(nz > 0, "floor").otherwise("ceiling"))


def wall_basis(nx: Column, ny: Column) -> list[Column]:
    """Horizontal unit direction along an upright wall of some normal; null for a level one."""
    n = F.sqrt(nx * nx + ny * ny)
    return [F.try_divide(-ny, n), F.try_divide(nx, n), F.when(n > 0, 0.0)]


def extents_in_basis(faces: DataFrame, by: list[str], along: list[Column]) -> DataFrame:
    """Range of positions along a direction and in height, from the face centres."""
    s = G.dot(G.vec("fx", "fy", "fz"), along)
    return faces.groupBy(*by).agg(F.min(s).alias("min_s"), F.max(s).alias("max_s"), F.min("fz").alias("min_z"), F.max("fz").alias("max_z"))


def quadric_error(faces: DataFrame, by: list[str], v: list[Column]) -> DataFrame:
    """Sum over faces of area times the square distance of v to the face's plane, as a quadratic form in v."""
    d = -G.dot(G.vec("nx", "ny", "nz"), G.vec("fx", "fy", "fz"))
    terms = {f"q{i}{j}": F.sum(F.col("area") * a * b) for i, a in enumerate((*G.vec("nx", "ny", "nz"), d)) for j, b in enumerate((*G.vec("nx", "ny", "nz"), d)) if i <= j}
    q = faces.groupBy(*by).agg(*[e.alias(n) for n, e in terms.items()])
    w = [*v, F.lit(1.0)]
    error = sum((1 if i == j else 2) * F.col(f"q{i}{j}") * w[i] * w[j] for i in range(4) for j in range(i, 4))
    return q.select(*by, error.alias("error"))


def corner_probability(corners: DataFrame, leaves: DataFrame, key: str = "leaf") -> DataFrame:
    """Mean probability of the leaves at each corner, weighted by their weight; 0.5 without any."""
    each = corners.select("x", "y", "z", F.explode("leaves").alias(key)).join(leaves.select(key, "probability", "weight"), key)
    return each.groupBy("x", "y", "z").agg(F.coalesce(F.try_divide(F.sum(F.col("probability") * F.col("weight")), F.sum("weight")), F.lit(0.5)).alias("probability"))


def corner_edges(corners: DataFrame, step: float) -> DataFrame:
    """Pairs of corners (x, y, z) and (ox, oy, oz) that are one step apart on an axis, the lower one first."""
    moves = F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for a, v in zip("xyz", m)]) for m in ((step, 0.0, 0.0), (0.0, step, 0.0), (0.0, 0.0, step))])
    to = corners.select("x", "y", "z", F.explode(moves).alias("m")).select("x", "y", "z", *[F.round(F.col(a) + F.col(f"m.d{a}"), 9).alias(f"o{a}") for a in "xyz"])
    there = corners.select(*[F.round(a, 9).alias(f"o{a}") for a in "xyz"])
    return to.join(there, ["ox", "oy", "oz"], "left_semi").select("x", "y", "z", "ox", "oy", "oz")


def best_vertex(planes: DataFrame, by: list[str], at: list[str], most: float) -> DataFrame:
    """For each vertex the point nearest to all its planes (nx, ny, nz, d with n . p = d) and, where they leave it free, to `at`.

    Least squares from sums over the planes; moves are bounded by `most` on each axis.
    """
    s = planes.groupBy(*by, *at).agg(*[F.sum(F.col(f"n{a}") * F.col(f"n{b}")).alias(f"m{a}{b}") for i, a in enumerate("xyz") for b in "xyz"[i:]], *[F.sum(F.col(f"n{a}") * (F.col("d") - G.dot(G.vec("nx", "ny", "nz"), G.vec(*at)))).alias(f"r{a}") for a in "xyz"])
    names = ["mxx", "mxy", "mxz", "myy", "myz", "mzz", "rx", "ry", "rz"]

    @F.pandas_udf("x double, y double, z double")
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.to_numpy(float)
        m = v[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
        x = np.einsum("nij,nj->ni", np.linalg.pinv(m, rcond=1e-6, hermitian=True), v[:, 6:])
        return pd.DataFrame(np.clip(x, -most, most), columns=["x", "y", "z"])

    moved = s.withColumn("__v", solve(F.struct(*names)))
    return moved.select(*by, *[(F.col(a) + F.col(f"__v.{k}")).alias(k) for a, k in zip(at, "xyz")])


def vertex_regions(face_corners: DataFrame) -> DataFrame:
    """(v, regions): the ordered set of regions whose faces (region, v) meet at a vertex."""
    return face_corners.groupBy("v").agg(F.array_sort(F.collect_set("region")).alias("regions"))


def nearest_region(faces: DataFrame, candidates: DataFrame) -> DataFrame:
    """(face, region) of the candidate plane (face, region, nx, ny, nz, d) nearest to the face's centre; ties to the smaller region."""
    err = F.abs(G.dot(G.vec("nx", "ny", "nz"), G.vec("fx", "fy", "fz")) - F.col("d"))
    best = faces.join(candidates, "face").groupBy("face").agg(F.min(F.struct(err.alias("e"), "region")).alias("m"))
    return best.select("face", F.col("m.region").alias("region"), F.col("m.e").alias("error"))


def snap_to_plane(vertices: DataFrame, planes: DataFrame, region: str = "region") -> DataFrame:
    """Vertices projected on the plane (region, nx, ny, nz, px, py, pz) of their region; those without a plane stay."""
    j = vertices.join(planes, region, "left")
    q = G.project_on_plane(G.vec("x", "y", "z"), G.vec("nx", "ny", "nz"), G.vec("px", "py", "pz"))
    return j.withColumns({a: F.coalesce(v, F.col(a)) for a, v in zip("xyz", q)}).select(*vertices.columns)


def quad_triangles(faces: DataFrame) -> DataFrame:
    """Two triangles (face, t, i, j, k) of each face with four vertices in order."""
    c = lambda n: F.get("vertices", n)
    tri = F.array(*[F.struct(F.lit(t).alias("t"), c(0).alias("i"), c(a).alias("j"), c(b).alias("k")) for t, (a, b) in enumerate(((1, 2), (2, 3)))])
    return faces.select("face", F.explode(tri).alias("q")).select("face", "q.*")


def surrounded_regions(links: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """(region, into): regions of at most `most` faces that a single other region surrounds. links: u, v both ways."""
    around = links.groupBy(F.col("u").alias("region")).agg(F.count_distinct("v").alias("n"), F.min("v").alias("into")).where("n = 1")
    return around.join(sizes.where(F.col("faces") <= most).select("region"), "region", "left_semi").select("region", "into")


def largest_neighbour(links: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """(region, into): for each region of at most `most` faces its largest neighbour that is larger than it; ties to the smaller number."""
    own = sizes.where(F.col("faces") <= most).select(F.col("region").alias("u"), F.col("faces").alias("fu"))
    other = sizes.select(F.col("region").alias("v"), F.col("faces").alias("fv"))
    best = links.join(own, "u").join(other, "v").where("fv > fu").groupBy(F.col("u").alias("region")).agg(F.max(F.struct("fv", (-F.col("v")).alias("o"))).alias("m"))
    return best.select("region", (-F.col("m.o")).alias("into"))


def smooth_regions(vertices: DataFrame, triangles: DataFrame, region: str = "region", inside: bool = True, own: float = 2.0) -> DataFrame:
    """Laplace smoothing of vertices whose triangles are all of one region (inside), or of those on region borders, along borders."""
    corner = F.explode(F.array("i", "j", "k")).alias("v")
    count = triangles.select(region, corner).groupBy("v").agg(F.count_distinct(region).alias("n"))
    chosen = count.where("n = 1" if inside else "n > 1").select("v")
    if inside:
        moved = laplace_smooth(vertices, triangles, own)
    else:
        edge = F.explode(F.array(*[F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("w")) for a, b in (("i", "j"), ("j", "k"), ("k", "i"))]))
        border = triangles.select(region, edge.alias("e")).select(region, "e.*").groupBy("u", "w").agg(F.count_distinct(region).alias("n")).where("n > 1")
        near = border.select(F.col("u").alias("v"), F.col("w").alias("n")).union(border.select("w", "u"))
        sums = near.join(vertices.select(F.col("v").alias("n"), *[F.col(a).alias(f"n{a}") for a in "xyz"]), "n").groupBy("v").agg(F.count("*").alias("m"), *[F.sum(f"n{a}").alias(f"s{a}") for a in "xyz"])
        moved = vertices.join(sums, "v", "left").select("v", *[((F.col(a) * own + F.coalesce(f"s{a}", F.lit(0.0))) / (own + F.coalesce("m", F.lit(0)))).alias(a) for a in "xyz"])
    new = moved.join(chosen, "v", "left_semi")
    return new.unionByName(vertices.select("v", "x", "y", "z").join(chosen, "v", "left_anti"))


def oriented(nx: Column, ny: Column, nz: Column, inward: list[Column]) -> list[Column]:
    """A normal turned so that it points the same way as `inward`."""
    s = F.when(G.dot([nx, ny, nz], inward) < 0, -1.0).otherwise(1.0)
    return [nx * s, ny * s, nz * s]


def first_in_path_order(poses: DataFrame, time: str, start: int, count: int, by: list[str]) -> DataFrame:
    """Consecutive pairs of poses from position `start` on, `count` of them."""
    w = Window.partitionBy(*by).orderBy(time)
    cols = [c for c in poses.columns if c not in by]
    rows = poses.withColumns({"pos": F.row_number().over(w) - 1, **{f"next_{c}": F.lead(c).over(w) for c in cols}})
    return rows.where(F.col("pos").between(start, start + count - 1) & F.col(f"next_{time}").isNotNull())
